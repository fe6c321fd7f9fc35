"""Settings, statuses, labels: users' events and customers stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import records as R
from lectern.queries.base import duck, put_in, table
from lectern.sources.wav import duration_ms, encoded

SETTINGS = """SELECT event_id, CASE event_id % 8 WHEN 0 THEN ' 12 ' WHEN 1 THEN '-3' WHEN 2 THEN '1.5' WHEN 3 THEN 'x' || event_type WHEN 4 THEN '' WHEN 5 THEN NULL WHEN 6 THEN 'Yes' ELSE '0.25e1' END AS s FROM {events}"""
STATUS = """SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'queued' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'completed' WHEN 3 THEN 'budget_exceeded' WHEN 4 THEN 'requires_action' WHEN 5 THEN 'cancelled' WHEN 6 THEN 'incomplete' WHEN 7 THEN 'failed' ELSE event_type END AS status FROM {events}"""
JOBS = """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS engine, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END AS voice, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE 'm4b' END AS box, c_name AS output FROM {customer}"""


def _settings(spark, sf):
    d = put_in(spark, sf, SETTINGS)
    s = F.col("s")
    return d.select("event_id", R.int_setting(s, 7).alias("as_int"), R.float_setting(s, 1.1).alias("as_float"), R.bool_setting(s, True).alias("as_bool"), R.playback_speed(s).alias("speed"))


def _statuses(spark, sf):
    return put_in(spark, sf, STATUS).groupBy(R.outcome(F.col("status")).alias("outcome")).agg(F.count("*").alias("n"))


def _jobs(spark, sf):
    return put_in(spark, sf, JOBS).select("c_custkey", R.job_detail(F.col("engine"), F.col("voice"), F.col("box"), F.col("output")).alias("detail"))


def _metas(spark, sf):
    c = table(spark, sf, "customer")
    k, name = F.col("c_custkey") % 4, F.col("c_name")
    text = F.when(k == 0, F.concat(F.lit('{"title": "'), name, F.lit('", "x": "1"}'))).when(k == 1, F.concat(F.lit("{'title': '"), name, F.lit("'}"))).when(k == 2, '["no object"]').otherwise("nothing")
    meta = R.merged_meta(F.create_map(F.lit("title"), F.lit("from catalogue"), F.lit("author"), name), F.coalesce(R.meta_object(text), F.create_map().cast("map<string,string>")))
    return c.select("c_custkey", F.element_at(meta, "title").alias("title"), F.element_at(meta, "author").alias("author"), F.try_element_at(meta, F.lit("x")).alias("x"))


def _searches(spark, sf):
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 3 == 0, F.concat(F.col("event_type"), F.lit("_search"))).when(F.col("event_id") % 3 == 1, F.lit("search_result")).otherwise(F.col("event_type"))
    return e.groupBy("user_id").agg(R.searches(F.collect_list(kind)).cast("long").alias("n_searches"))


def _labels(spark, sf):
    p = table(spark, sf, "part")
    label = R.book_label(F.col("p_name"), F.col("p_brand"), F.col("p_partkey"), F.col("p_size") * 1000)
    line = R.voice_line(F.concat(F.lit("en-US-"), F.col("p_brand")), F.lit("Female"), F.split("p_name", " ", -1))
    return p.select("p_partkey", label.alias("label"), line.alias("line"))


def _wav(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.collect_list((F.col("value") - 250) / 200).alias("samples"))
    return e.select("user_id", duration_ms(encoded(F.col("samples"), 100)).alias("duration_ms"))


QUERIES = {
    "typed_settings": (
        _settings,
        rf"""WITH d AS (SELECT event_id, s, trim(s) AS t FROM ({duck(SETTINGS)}))
        SELECT event_id, CAST(CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) ELSE 7 END AS BIGINT) AS as_int,
        coalesce(CASE WHEN regexp_full_match(t, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(t AS DOUBLE) END, 1.1::DOUBLE) AS as_float,
        CASE WHEN s IS NULL THEN true ELSE lower(t) IN ('1', 'true', 'yes', 'on') END AS as_bool, CASE WHEN TRY_CAST(t AS DOUBLE) BETWEEN 0.5 AND 3 THEN TRY_CAST(t AS DOUBLE) END AS speed FROM d""",
    ),
    "research_outcomes": (
        _statuses,
        f"SELECT CASE status WHEN 'queued' THEN 'pending' WHEN 'in_progress' THEN 'pending' WHEN 'completed' THEN 'done' WHEN 'budget_exceeded' THEN 'quota' WHEN 'requires_action' THEN 'waiting for input' WHEN 'cancelled' THEN 'cancelled' WHEN 'incomplete' THEN 'incomplete' WHEN 'failed' THEN 'failed' ELSE 'unexpected' END AS outcome, count(*) AS n FROM ({duck(STATUS)}) GROUP BY 1",
    ),
    "job_details": (_jobs, f"SELECT c_custkey, concat_ws(' · ', CASE WHEN engine <> '' THEN engine ELSE 'default engine' END, coalesce(voice, 'default voice'), CASE WHEN box <> '' THEN upper(box) END) || ' → ' || output AS detail FROM ({duck(JOBS)})"),
    "meta_merge": (_metas, "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_name ELSE 'from catalogue' END AS title, c_name AS author, CASE WHEN c_custkey % 4 = 0 THEN '1' END AS x FROM customer"),
    "search_steps": (_searches, "SELECT user_id, count(*) FILTER (event_id % 3 = 0 OR (event_id % 3 = 2 AND strpos(event_type, 'search') > 0)) AS n_searches FROM events GROUP BY user_id"),
    "book_labels": (_labels, "SELECT p_partkey, p_name || ' — ' || p_brand || '  (#' || CAST(p_partkey AS VARCHAR) || ', ' || format('{:,}', CAST(p_size AS BIGINT) * 1000) || ' downloads)' AS label, 'en-US-' || p_brand || ',en,US,Female,\"' || replace(p_name, ' ', ',') || '\"' AS line FROM part"),
    "wav_durations": (_wav, "SELECT user_id, count(*) * 2 * 1000 // 200 AS duration_ms FROM events GROUP BY user_id"),
}
