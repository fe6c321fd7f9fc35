"""Jobs followed to their end, counts taken on the way, extractors in SQL: events stand for status events of jobs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import counters
from lectern.plugins import register_extractor
from lectern.queries.base import duck, put_in, table
from lectern.queries.media import SEG_CTE, _segments
from lectern.queries.text import GUARD_CTE, REWRITE
from lectern.shared import dropped, kept_once, shared_folder
from lectern.streaming import jobs

LIMIT_MS, DELAY_MS = 15 * 60_000, 60_000
STATUS = "CASE WHEN event_id % 13 = 5 THEN 'cancel' WHEN event_id % 5 < 3 THEN 'in_progress' WHEN event_id % 7 = 1 THEN 'failed' WHEN event_id % 7 = 2 THEN 'budget_exceeded' WHEN event_id % 7 < 5 THEN 'completed' ELSE 'queued' END"


def _events(e):
    return e.select(F.floor(F.col("event_id") / 4).cast("long").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), F.expr(STATUS).alias("status"))


def _decided(found):
    return found.select("job_id", "outcome", F.date_format(F.timestamp_millis("decided_ms"), "yyyy-MM-dd HH:mm:ss.SSS").alias("decided"))


def _outcomes(spark, sf):
    return _decided(jobs.outcomes(_events(table(spark, sf, "events")), LIMIT_MS, DELAY_MS))


def _streamed(spark, sf):
    """The same, the events read as a stream."""
    at = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/[e]vents.parquet")
    found = kept_once(_decided(jobs.follow(_events(stream), f"{at}/out", f"{at}/state", LIMIT_MS, DELAY_MS)))
    dropped(spark, at)
    return found


OUTCOMES_SQL = f"""WITH e AS (SELECT event_id // 4 AS job_id, epoch_us(ts) // 1000 AS ms, {STATUS} AS status FROM events),
o AS (SELECT *, CASE status WHEN 'cancel' THEN 'stopped' WHEN 'failed' THEN 'failed' WHEN 'budget_exceeded' THEN 'quota' WHEN 'completed' THEN 'done' END AS outcome FROM e),
f AS (SELECT job_id, min(ms) + {LIMIT_MS} AS deadline, min({{'ms': ms, 'outcome': outcome}}) FILTER (outcome IS NOT NULL) AS first FROM o GROUP BY job_id),
d AS (SELECT job_id, CASE WHEN first.ms <= deadline THEN first.outcome ELSE 'timeout' END AS outcome, CASE WHEN first.ms <= deadline THEN first.ms ELSE deadline END AS ms FROM f)
SELECT job_id, outcome, strftime(make_timestamp(ms * 1000), '%Y-%m-%d %H:%M:%S.%g') AS decided FROM d WHERE ms < (SELECT max(ms) - {DELAY_MS} FROM e)"""


def _observed(spark, sf):
    """Rewrites guarded and kept; the reasons are counted as they go by."""
    d = put_in(spark, sf, REWRITE)
    used, reason = T.guard(F.col("original"), F.col("candidate"), F.col("failed"))
    rows, seen = counters.by_value(d.select("doc_id", used.alias("used"), reason.alias("reason")), F.col("reason"), counters.REASONS, "rewrites")
    kept_once(rows)
    return spark.createDataFrame([(k, n) for k, n in seen.get.items() if n], "reason string, n long")


def _attempts(spark, sf):
    s = _segments(spark, sf).withColumn("error", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("segment "), F.col("event_id").cast("string"))))
    rows, seen = counters.attempts(s, "attempts")
    kept_once(rows.select("event_id", "error"))
    return spark.createDataFrame([(seen.get["made"], seen.get["failed"])], "made long, failed long")


def lines(text: str | None) -> list[tuple[str, str, int]]:
    """An extractor: lines are blocks, short ones headings."""
    return [("heading", x, 1) if len(x) < 40 else ("paragraph", x, 0) for x in (text or "").split("\n")]


def _lines(spark, sf):
    register_extractor(spark, "lectern_lines", lines)
    return spark.sql("SELECT doc_id, CAST(place AS BIGINT) AS place, kind, x.text, CAST(level AS BIGINT) AS level, error FROM {d} AS d, LATERAL lectern_lines(d.text) AS x", d=table(spark, sf, "documents"))


QUERIES = {
    "job_outcomes": (_outcomes, OUTCOMES_SQL),
    "job_outcomes_streamed": (_streamed, OUTCOMES_SQL),
    "guarded_rewrite_observed": (_observed, f"{GUARD_CTE} SELECT reason, count(*) AS n FROM r GROUP BY reason"),
    "attempts_observed": (_attempts, f"WITH {SEG_CTE} SELECT count(*) AS made, count(*) FILTER (event_id % 4 = 0) AS failed FROM s"),
    "extracted_lines": (_lines, "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), x AS (SELECT doc_id, unnest(t) AS text, CAST(generate_subscripts(t, 1) - 1 AS BIGINT) AS place FROM l) SELECT doc_id, place, CASE WHEN length(text) < 40 THEN 'heading' ELSE 'paragraph' END AS kind, text, CAST(CASE WHEN length(text) < 40 THEN 1 ELSE 0 END AS BIGINT) AS level, CAST(NULL AS VARCHAR) AS error FROM x"),
}
