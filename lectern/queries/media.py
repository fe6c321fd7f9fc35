"""Media planning: users' events stand for a document's segments, orders for jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import media as M
from lectern.operators import media as O
from lectern.operators import resume as R
from lectern.queries.base import duck, put_in, table

SEGMENTS = """SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS idx, CAST(floor(value * 10) AS BIGINT) + 1 AS duration_ms, event_type, event_id FROM {events}"""
#: Two cues a segment, which overlap.
CUES = """SELECT doc_id, idx AS seg_idx, cue_idx, duration_ms, CASE WHEN cue_idx = 0 THEN 0 ELSE CAST(floor(duration_ms / 3) AS BIGINT) END AS start_ms,
    CASE WHEN cue_idx = 0 THEN CAST(floor(duration_ms / 2) AS BIGINT) ELSE duration_ms + 40 * (doc_id % 3) END AS end_ms, event_type || ' ' || CAST(event_id AS STRING) AS text
    FROM (SELECT s.*, c.n AS cue_idx FROM (""" + SEGMENTS + """) s CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) c)"""


def _d(sql: str) -> str:
    return duck(sql).replace("AS STRING", "AS VARCHAR")


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def _segments(spark, sf):
    return put_in(spark, sf, SEGMENTS).withColumn("chapter_idx", F.floor(F.col("idx") / 10).cast("long"))


def _cues(spark, sf):
    return O.cues(put_in(spark, sf, CUES))


def _srt(spark, sf):
    t = put_in(spark, sf, CUES)
    c = O.cues(t).join(t.select("doc_id", "seg_idx", "cue_idx", "text"), ["doc_id", "seg_idx", "cue_idx"])
    return O.srt(c)


def _manifest(spark, sf):
    marks = O.chapter_marks(_segments(spark, sf)).withColumn("chapter_title", F.concat(F.lit("Part; #"), F.col("chapter_idx").cast("string"), F.lit("\n=x\\")))
    docs = marks.select("doc_id").distinct().select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("T="), F.col("doc_id").cast("string"))).alias("title"), F.when(F.col("doc_id") % 4 != 0, F.lit("A;b")).alias("author"))
    return O.chapter_manifest(marks, docs)


def _playlist(spark, sf):
    s = _segments(spark, sf).withColumn("path", F.concat(F.lit("/it's/"), M.chunk_name(F.col("idx"))))
    return O.playlist(s)


def _chapter_of(spark, sf):
    s = _segments(spark, sf)
    counts = s.groupBy("doc_id", "chapter_idx").agg(F.count("*").alias("n_utterances"))
    wanted = s.select("doc_id", (F.col("idx") + F.when(F.col("event_id") % 21 == 0, 1000).otherwise(0)).cast("long").alias("n"))
    return O.chapter_of(counts, wanted)


def _progress(spark, sf):
    s = _segments(spark, sf).select("doc_id", "idx", F.length("event_type").alias("n_chars"))
    return _long(O.progress(s), "idx", "done_chars", "total_chars").drop("n_chars")



def _speeds(spark, sf):
    s = table(spark, sf, "lineitem").select("l_quantity").distinct().withColumn("speed", F.col("l_quantity") / 8.0)
    return s.select("l_quantity", M.tempo_chain(F.col("speed")).alias("chain"), M.rate_text(F.col("speed")).alias("rate"))


def _codec(spark, sf):
    o = table(spark, sf, "orders")
    kinds = F.when(F.col("o_orderkey") % 5 == 0, ".wav").otherwise(".mp3")
    g = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set(kinds)).alias("suffixes"))
    box = F.when(F.col("o_custkey") % 3 == 0, "m4b").otherwise("mp3")
    speed = F.when(F.col("o_custkey") % 4 == 0, 1.5).when(F.col("o_custkey") % 4 == 1, 1.0005)
    return g.select("o_custkey", M.codec(box, F.col("suffixes"), speed).alias("codec"))


def _resume(spark, sf):
    s = _segments(spark, sf)
    done = s.where(F.col("event_id") % 3 != 0).select("doc_id", "idx", F.when(F.col("event_id") % 5 == 0, 0).otherwise(100).alias("size"), "duration_ms")
    return s, done


def _outstanding(spark, sf):
    s, done = _resume(spark, sf)
    return _long(R.outstanding(s, done).select("doc_id", "idx", "event_id"), "idx")


def _failures(spark, sf):
    s = _segments(spark, sf).select("doc_id", "idx", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("segment "), F.col("event_id").cast("string"))).alias("error"))
    return R.failures(s).select("doc_id", "n_failed", F.array_join("messages", "|").alias("messages"))


def _backoff(spark, sf):
    a = table(spark, sf, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(1), (2 + F.col("o_orderkey") % 3).cast("int"))).alias("attempt"))
    upto = Window.partitionBy("o_orderkey").orderBy("attempt")
    return a.select("o_orderkey", F.col("attempt").cast("long").alias("attempt"), M.backoff_s(F.col("attempt")).alias("delay_s"), F.sum(M.backoff_s(F.col("attempt"))).over(upto).alias("waited_s"))


def _clip(spark, sf):
    return table(spark, sf, "events").select("event_id", _sample(), M.pcm16(_sample()).cast("long").alias("pcm")).drop("sample")


def _sample():
    return ((F.col("value") - 250) / 200).alias("sample")


def _meta(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", M.escaped_meta(F.concat("c_name", F.lit("=;#\\x\ny"))).alias("escaped"), M.chunk_name(F.col("c_custkey"), ".wav").alias("chunk"), M.srt_time((F.col("c_acctbal") * 1000).cast("long")).alias("at"))


CUE_CTE = f"""t AS ({_d(CUES)}), seg AS (SELECT doc_id, seg_idx, max(duration_ms) AS ms FROM t GROUP BY doc_id, seg_idx),
cur AS (SELECT doc_id, seg_idx, CAST(coalesce(sum(ms) OVER (PARTITION BY doc_id ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cursor FROM seg),
j AS (SELECT t.*, cursor + start_ms AS s, cursor + end_ms AS e, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.seg_idx, cue_idx) AS n FROM t JOIN cur ON cur.doc_id = t.doc_id AND cur.seg_idx = t.seg_idx)"""
#: Cue after cue, as a player would go.
STEP_CTE = f"""{CUE_CTE}, step AS (
    SELECT doc_id, seg_idx, cue_idx, n, text, greatest(s, 0) AS b, greatest(e, greatest(s, 0) + 1) AS f FROM j WHERE n = 1
    UNION ALL
    SELECT j.doc_id, j.seg_idx, j.cue_idx, j.n, j.text, greatest(j.s, p.f), greatest(j.e, greatest(j.s, p.f) + 1) FROM step p JOIN j ON j.doc_id = p.doc_id AND j.n = p.n + 1
)"""
SRT_TIME = "printf('%02d:%02d:%02d,%03d', {0} // 3600000, {0} // 60000 % 60, {0} // 1000 % 60, {0} % 1000)"
SEG_CTE = f"s AS (SELECT *, CAST(idx // 10 AS BIGINT) AS chapter_idx FROM ({_d(SEGMENTS)}))"
MARK_CTE = f"""{SEG_CTE}, c AS (SELECT doc_id, chapter_idx, CAST(sum(duration_ms) AS BIGINT) AS ms FROM s GROUP BY doc_id, chapter_idx),
m AS (SELECT doc_id, chapter_idx, CAST(coalesce(sum(ms) OVER (PARTITION BY doc_id ORDER BY chapter_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms, ms FROM c)"""
NUMBER = r"regexp_replace(regexp_replace(printf('%.9f', {0}), '0+$', ''), '\.$', '')"

QUERIES = {
    "chapter_marks": (lambda spark, sf: O.chapter_marks(_segments(spark, sf)), f"WITH {MARK_CTE} SELECT doc_id, chapter_idx, start_ms, start_ms + ms AS end_ms FROM m"),
    "chapter_of": (_chapter_of, f"WITH {SEG_CTE}, w AS (SELECT doc_id, CAST(idx + CASE WHEN event_id % 21 = 0 THEN 1000 ELSE 0 END AS BIGINT) AS n FROM s) SELECT w.doc_id, w.n, s.chapter_idx FROM w LEFT JOIN s ON s.doc_id = w.doc_id AND s.idx = w.n"),
    "srt_cues": (lambda spark, sf: _long(_cues(spark, sf), "seg_idx", "cue_idx"), f"WITH RECURSIVE {STEP_CTE} SELECT doc_id, CAST(seg_idx AS BIGINT) AS seg_idx, CAST(cue_idx AS BIGINT) AS cue_idx, CAST(n AS BIGINT) AS cue_no, CAST(b AS BIGINT) AS begin_ms, CAST(f AS BIGINT) AS finish_ms FROM step"),
    "srt_text": (_srt, f"WITH RECURSIVE {STEP_CTE} SELECT doc_id, string_agg(CAST(n AS VARCHAR) || chr(10) || {SRT_TIME.format('b')} || ' --> ' || {SRT_TIME.format('f')} || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM step GROUP BY doc_id"),
    "ffmetadata_text": (
        _manifest,
        f"""WITH {MARK_CTE} SELECT doc_id, ';FFMETADATA1' || chr(10) || CASE WHEN doc_id % 3 <> 0 THEN 'title=T\\=' || CAST(doc_id AS VARCHAR) || chr(10) || 'album=T\\=' || CAST(doc_id AS VARCHAR) || chr(10) ELSE '' END
        || CASE WHEN doc_id % 4 <> 0 THEN 'artist=A\\;b' || chr(10) || 'album_artist=A\\;b' || chr(10) ELSE '' END
        || string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(start_ms AS VARCHAR) || chr(10) || 'END=' || CAST(start_ms + greatest(ms, 1) AS VARCHAR) || chr(10) || 'title=Part\\; \\#' || CAST(chapter_idx AS VARCHAR) || ' \\=x\\\\' || chr(10), '' ORDER BY chapter_idx) AS manifest FROM m GROUP BY doc_id""",
    ),
    "concat_manifest": (_playlist, f"WITH {SEG_CTE} SELECT doc_id, string_agg('file ''/it''\\''''s/' || printf('chunk_%05d.mp3', idx) || '''', chr(10) ORDER BY idx) || chr(10) AS playlist FROM s GROUP BY doc_id"),
    "progress": (_progress, f"WITH {SEG_CTE} SELECT doc_id, idx, CAST(sum(length(event_type)) OVER (PARTITION BY doc_id ORDER BY idx) AS BIGINT) AS done_chars, CAST(greatest(1, sum(length(event_type)) OVER (PARTITION BY doc_id)) AS BIGINT) AS total_chars FROM s"),
    "tempo_chain": (
        lambda spark, sf: _speeds(spark, sf).select("l_quantity", "chain"),
        f"""WITH RECURSIVE q AS (SELECT DISTINCT l_quantity, l_quantity / 8.0 AS r, []::DOUBLE[] AS f FROM lineitem),
        g AS (SELECT * FROM q UNION ALL SELECT l_quantity, CASE WHEN r > 2 THEN r / 2 ELSE r / 0.5 END, f || [CASE WHEN r > 2 THEN 2.0 ELSE 0.5 END] FROM g WHERE r > 2 OR r < 0.5)
        SELECT l_quantity, array_to_string(list_transform(f || [r], lambda x: 'atempo=' || {NUMBER.format('round_even(x * 10 ** (5 - CAST(floor(log10(x)) AS INT)), 0) / 10 ** (5 - CAST(floor(log10(x)) AS INT))')}), ',') AS chain FROM g WHERE r BETWEEN 0.5 AND 2""",
    ),
    "rate_string": (
        lambda spark, sf: _speeds(spark, sf).select("l_quantity", "rate"),
        "WITH q AS (SELECT DISTINCT l_quantity, l_quantity / 8.0 AS s FROM lineitem) SELECT l_quantity, CASE WHEN s < 0.25 OR s >= 5 THEN NULL WHEN s < 1 THEN '-' || CAST(CAST(round_even((1 - s) * 100, 0) AS BIGINT) AS VARCHAR) || '%' ELSE '+' || CAST(CAST(round_even((s - 1) * 100, 0) AS BIGINT) AS VARCHAR) || '%' END AS rate FROM q",
    ),
    "codec_decision": (_codec, "SELECT o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 'aac' WHEN count(*) FILTER (o_orderkey % 5 = 0) = 0 AND o_custkey % 4 <> 0 THEN 'copy' ELSE 'libmp3lame' END AS codec FROM orders GROUP BY o_custkey"),
    "resume_anti_join": (_outstanding, f"WITH {SEG_CTE} SELECT doc_id, idx, event_id FROM s WHERE event_id % 3 = 0 OR event_id % 5 = 0"),
    "completeness_check": (lambda spark, sf: R.completeness(*_resume(spark, sf)), f"WITH {SEG_CTE} SELECT doc_id, count(*) AS n_utterances, count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0) AS n_segments, count(*) = count(*) FILTER (event_id % 3 <> 0 AND event_id % 5 <> 0) AS complete FROM s GROUP BY doc_id"),
    "failure_summary": (_failures, f"WITH {SEG_CTE}, f AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN 'segment ' || CAST(event_id AS VARCHAR) END AS error FROM s) SELECT doc_id, count(error) AS n_failed, array_to_string(coalesce((list(error ORDER BY idx) FILTER (error IS NOT NULL))[1:10], []), '|') AS messages FROM f GROUP BY doc_id"),
    "backoff_schedule": (_backoff, "WITH a AS (SELECT o_orderkey, unnest(range(1, 3 + o_orderkey % 3)) AS attempt FROM orders) SELECT o_orderkey, attempt, 2.0::DOUBLE * 2 ** (attempt - 1) AS delay_s, sum(2.0::DOUBLE * 2 ** (attempt - 1)) OVER (PARTITION BY o_orderkey ORDER BY attempt) AS waited_s FROM a"),
    "pcm_clip": (_clip, "SELECT event_id, CAST(trunc(greatest(-1.0, least(1.0, (value - 250) / 200)) * 32767) AS BIGINT) AS pcm FROM events"),
    "media_text": (
        _meta,
        rf"""SELECT c_custkey, replace(replace(replace(replace(replace(c_name || '=;#\x' || chr(10) || 'y', '\', '\\'), '=', '\='), ';', '\;'), '#', '\#'), chr(10), ' ') AS escaped,
        printf('chunk_%05d.wav', c_custkey) AS chunk, {SRT_TIME.format('greatest(CAST(trunc(c_acctbal * 1000) AS BIGINT), 0)')} AS at FROM customer""",
    ),
}
