"""Pages, books to fetch, engines, the job queue, outputs: conversations, parts, orders and customers stand for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import library as L
from lectern.operators import pages as P
from lectern.queries.base import duck, put_in, table
from lectern.queries.catalog import BOOK_CTE, _books
from lectern.queries.text import WS


def _d(sql: str) -> str:
    return duck(sql).replace("AS STRING", "AS VARCHAR")


PAGES = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, CASE WHEN conv_id % 3 = 0 THEN CASE WHEN turn % 2 = 0 THEN '# ' || text ELSE ' ' END END AS layout,
CASE WHEN turn % 4 = 1 THEN ' ' ELSE text END AS plain, CASE WHEN (conv_id + turn) % 5 = 0 THEN NULL ELSE 'scan ' || text END AS ocr, CASE WHEN (conv_id + turn) % 7 = 3 THEN 'no reader ' || CAST(turn AS STRING) END AS ocr_error FROM {conversations}"""
MARKS = """SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, CAST(8 + turn % 3 AS INT) AS kind, CASE turn % 3 WHEN 0 THEN 'Highlight' WHEN 1 THEN 'Underline' ELSE 'Note' END AS name, ' ' || text || ' ' AS text, 'yellow' AS color, role AS note FROM {conversations}"""
JOBS = """SELECT o_custkey AS queue, o_orderkey AS seq, '/out/' || CAST(o_orderkey % 500 AS STRING) || '.m4b' AS output_path, CASE WHEN o_orderkey % 9 = 0 THEN 'running' WHEN o_orderkey % 9 = 1 THEN 'done' ELSE 'pending' END AS state FROM {orders}"""
TAGS = """SELECT c_custkey, '/a/' || c_name || CASE c_custkey % 5 WHEN 0 THEN '.mp3' WHEN 1 THEN '.M4B' WHEN 2 THEN '.mp4' WHEN 3 THEN '.wav' ELSE '.m4a' END AS path, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS author, CASE WHEN c_custkey % 6 < 3 THEN 'c.png' END AS image, c_custkey % 6 = 1 AS image_exists FROM {customer}"""
REPORTS = """SELECT 'r' || CAST(doc_id AS STRING) AS name, lang AS topic, source AS agent, doc_id % 7 AS searches, chr(10) || text || ' ' AS report, text AS narration FROM {documents}"""


def _range(spark, sf):
    p = put_in(spark, sf, PAGES)
    return P.page_range(p, F.col("doc_id").cast("int") % 5 - 1, F.col("doc_id").cast("int") % 4 + 1).select("doc_id", F.col("page").cast("long").alias("page"))


def _tiers(spark, sf):
    return P.tiers(put_in(spark, sf, PAGES)).withColumn("page", F.col("page").cast("long"))


def _marks(spark, sf):
    return P.annotations(put_in(spark, sf, MARKS), 2, 5).withColumn("page", F.col("page").cast("long"))


def _lookup(spark, sf):
    wanted = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 3000).alias("id"))
    return L.lookup(wanted, _books(spark, sf).select("id", "title")).select("o_orderkey", "id", "title", "error")


def _best(title, author=None):
    def run(spark, sf):
        return L.best_match(_books(spark, sf), title, author).select(F.col("rank").cast("long").alias("rank"), "choice", "id", "title", "error")

    return run


def _downloads(spark, sf):
    b = _books(spark, sf)
    cached = b.select(F.concat(F.lit("/c/pg"), F.col("id").cast("string"), F.lit("_"), F.replace("title", F.lit(" "), F.lit("_")), F.when(F.col("id") % 3 == 0, ".txt").otherwise(".epub")).alias("path"), (F.col("id") % 5).alias("size"))
    return L.downloads(b, cached, "/c", "text")


def _choices(spark, sf):
    """Each nation's suppliers stand for the engines of a list; some report no state and are left out."""
    e = table(spark, sf, "supplier")
    known = e.select(F.col("s_name").alias("name"), F.concat(F.lit("Engine "), F.col("s_suppkey") % 7).alias("label"), F.col("s_nationkey").alias("nation"))
    k = F.col("s_suppkey") % 5
    states = e.where(k != 4).select(F.col("s_name").alias("name"), F.when(k == 3, F.lit(None).cast("boolean")).otherwise(F.col("s_acctbal") > 3000).alias("available"), F.when(k != 1, F.concat(F.lit("no key "), k)).alias("reason"))
    return L.choices(L.availability(known, states), "nation").withColumns({"place": F.col("place").cast("long"), "nation": F.col("nation").cast("long")})


def _agents(spark, sf):
    names = F.element_at(F.array(*[F.lit(x) for x in (" standard ", "max", "pro", "deep-research-own", "Max", "other")]), (F.col("n_nationkey") % 6 + 1).cast("int"))
    return L.checked(table(spark, sf, "nation").select("n_nationkey", names.alias("name")), "agent").select("n_nationkey", "resolved", "error")


def _static(spark, sf):
    """Every customer asks for a voice by its number, beyond the known ones too."""
    ids = F.array(*[F.lit(v) for v in (*L.KOKORO, *(n for n, _ in L.GEMINI))])
    asked = table(spark, sf, "customer").select("c_custkey", F.get(ids, (F.col("c_custkey") % 90).cast("int")).alias("id"))
    return asked.join(F.broadcast(L.static_voices(spark)), "id", "left").select("c_custkey", "id", "engine", "name", "language", "locale", "gender", "tags")


def _cloud(spark, sf):
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    code = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("de"))).otherwise(F.array(F.lit("en-US"), F.lit("en-GB")))
    gender = F.when(k % 3 == 0, "FEMALE").when(k % 3 == 1, "MALE")
    return L.cloud_voices(s.select(F.concat(F.lit("en-US-Neural2-"), "s_name").alias("name"), code.alias("language_codes"), gender.alias("ssml_gender"), (k * 100).alias("sample_rate")))


def _voice_list(spark, sf):
    c = table(spark, sf, "customer")
    v = c.select(F.concat(F.lit("en-GB-"), "c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, "Female").otherwise("Male").alias("gender"), F.when(F.col("c_custkey") % 3 > 0, F.array("c_mktsegment", F.lit("Warm"))).alias("personalities"))
    return L.voice_list(v).withColumn("place", F.col("place").cast("long"))


def _popped(spark, sf):
    return L.popped(put_in(spark, sf, JOBS))


def _removed(spark, sf):
    jobs = put_in(spark, sf, JOBS)
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("queue"), (F.col("c_custkey") % 4 - 1).alias("place"))
    return L.removed(jobs, places)


def _held(spark, sf):
    jobs = put_in(spark, sf, JOBS)
    asked = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit("/out/"), F.col("c_custkey").cast("string"), F.lit(".m4b")).alias("output_path"))
    return L.holds_output(jobs, asked).select("c_custkey", "held")


def _outputs(spark, sf):
    c = table(spark, sf, "customer")
    source = F.concat(F.lit("/in/"), "c_mktsegment", F.lit("/"), "c_name", F.when(F.col("c_custkey") % 3 == 0, ".tar.txt").when(F.col("c_custkey") % 3 == 1, ".md").otherwise(""))
    return c.select("c_custkey", L.preview_path(F.lit("edge"), F.concat(F.lit("#"), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")")), "/tmp/p").alias("preview"), L.output_path(source, "m4b").alias("beside"), L.output_path(source, "mp3", "/out").alias("inside"))


def _reports(spark, sf):
    return L.report_files(put_in(spark, sf, REPORTS), "/notes")


def _tags(spark, sf):
    p = L.tag_plan(put_in(spark, sf, TAGS))
    return p.select("path", F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|").alias("tags"), "cover", "warning")


def _zipped(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("idx"), "event_type", F.floor("value").alias("ms"))
    return L.zipped(e.select("doc_id", "idx", "event_type"), e.select("doc_id", "idx", "ms"))


SOME = "trim(coalesce({0}, ''), " + WS + ") <> ''"
PRINT = "regexp_replace(translate(replace(replace(translate({0}, '—–', '  '), '\xad' || chr(10), ''), '-' || chr(10), ''), '\xa0', ' '), '[^\\x20-\\x7E\\n]', '', 'g')"
ERROR = "nothing matched '{}'{}; try fewer words, or drop the author".replace("'", "''")
AGENTS = "CASE x WHEN 'standard' THEN 'deep-research-preview-04-2026' WHEN 'max' THEN 'deep-research-max-preview-04-2026' WHEN 'pro' THEN 'deep-research-pro-preview-12-2025' ELSE CASE WHEN starts_with(x, 'deep-research') THEN x END END"
KOKORO_SQL = "SELECT unnest([" + ", ".join(f"'{v}'" for v in L.KOKORO) + "]) AS id"
GEMINI_SQL = "VALUES " + ", ".join(f"('{n}', '{t}')" for n, t in L.GEMINI)

QUERIES = {
    "pages_in_range": (_range, f"SELECT doc_id, CAST(page AS BIGINT) AS page FROM ({_d(PAGES)}) WHERE page BETWEEN greatest(1, CASE WHEN doc_id % 5 - 1 = 0 THEN 1 ELSE doc_id % 5 - 1 END) AND doc_id % 4 + 1"),
    "page_tiers": (
        _tiers,
        f"""WITH p AS (SELECT *, max((layout IS NOT NULL)::INT) OVER (PARTITION BY doc_id) = 1 AS laid, {PRINT.format('plain')} AS t, {PRINT.format('ocr')} AS o FROM ({_d(PAGES)})),
        q AS (SELECT *, CASE WHEN {SOME.format('layout')} THEN 'layout' WHEN NOT laid AND {SOME.format('t')} THEN 'text' END AS early FROM p),
        f AS (SELECT *, (SELECT min(x.page) FROM q x WHERE x.doc_id = q.doc_id AND x.early IS NULL AND x.ocr_error IS NOT NULL) AS failed FROM q),
        g AS (SELECT *, coalesce(early, CASE WHEN (failed IS NULL OR page < failed) AND {SOME.format('o')} THEN 'ocr' END, 'none') AS tier FROM f)
        SELECT doc_id, CAST(page AS BIGINT) AS page, tier, CASE tier WHEN 'layout' THEN layout WHEN 'text' THEN t WHEN 'ocr' THEN o END AS text, CASE WHEN page = failed THEN ocr_error END AS ocr_error FROM g""",
    ),
    "page_annotations": (_marks, f"SELECT doc_id, CAST(page AS BIGINT) AS page, name AS type, CASE WHEN kind < 10 THEN trim(text, {WS}) END AS text, CASE WHEN kind < 10 THEN color END AS color, note FROM ({_d(MARKS)}) WHERE page BETWEEN 2 AND 5"),
    "book_lookup": (_lookup, "SELECT o_orderkey, o_orderkey % 3000 AS id, p_name AS title, CASE WHEN p_partkey IS NULL THEN 'no book with id ' || CAST(o_orderkey % 3000 AS VARCHAR) END AS error FROM orders LEFT JOIN part ON p_partkey = o_orderkey % 3000"),
    "best_match": (_best("the blue bolt of"), f"WITH {BOOK_CTE}, n AS (SELECT *, row_number() OVER (ORDER BY rel DESC, no_epub, downloads DESC, id) AS rank FROM k) SELECT rank, CASE rank WHEN 1 THEN 'chosen' ELSE 'alternate' END AS choice, id, title, CAST(NULL AS VARCHAR) AS error FROM n WHERE rank <= 5"),
    "best_match_or_error": (
        lambda spark, sf: L.best_match(_books(spark, sf).where("size(formats) = 0"), "no such book", "Nobody").select(F.col("rank").cast("long").alias("rank"), "choice", "id", "title", "error"),
        f"SELECT CAST(1 AS BIGINT) AS rank, CAST(NULL AS VARCHAR) AS choice, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS title, '{ERROR.format('no such book', ' by Nobody')}' AS error".replace("''no such book''", "''no such book''"),
    ),
    "download_plan": (
        _downloads,
        """WITH b AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') AS s, p_partkey % 4 AS m FROM part),
        f AS (SELECT *, CASE m WHEN 0 THEN 'text' WHEN 1 THEN 'text' WHEN 2 THEN 'html' END AS format, CASE m WHEN 0 THEN 't.txt' WHEN 1 THEN 'u.txt' WHEN 2 THEN 'h2' END AS url, CASE m WHEN 0 THEN '.txt' WHEN 1 THEN '.txt' WHEN 2 THEN '.html' END AS suffix FROM b)
        SELECT id, format, '/c/pg' || CAST(id AS VARCHAR) || '_' || s || suffix AS path, url, coalesce(suffix = '.txt' AND id % 3 = 0 AND id % 5 > 0, false) AS hit, CASE WHEN format IS NULL THEN 'no downloadable text format' END AS error FROM f""",
    ),
    "engine_choices": (
        _choices,
        """WITH e AS (SELECT s_name AS name, 'Engine ' || s_suppkey % 7 AS label, CAST(s_nationkey AS BIGINT) AS nation, s_suppkey % 5 AS k, coalesce(s_suppkey % 5 <> 3 AND s_acctbal > 3000, false) AS available FROM supplier WHERE s_suppkey % 5 <> 4)
        SELECT row_number() OVER (PARTITION BY nation ORDER BY available DESC, label, name) AS place, name, label, nation, available, CASE WHEN available OR k = 1 THEN '' ELSE 'no key ' || k END AS reason, CASE WHEN available THEN label ELSE label || ' — needs setup' END AS display FROM e""",
    ),
    "agent_choices": (
        _agents,
        f"WITH n AS (SELECT n_nationkey, ([' standard ', 'max', 'pro', 'deep-research-own', 'Max', 'other'])[n_nationkey % 6 + 1] AS name FROM nation), a AS (SELECT *, trim(name) AS x FROM n), r AS (SELECT *, {AGENTS} AS resolved FROM a) SELECT n_nationkey, resolved, CASE WHEN resolved IS NULL THEN 'unknown agent ''' || name || '''; choose from: standard, max, pro' END AS error FROM r",
    ),
    "static_voices": (
        _static,
        f"""WITH k AS ({KOKORO_SQL}), p AS (SELECT id, 'mlx' AS engine, upper(id[4]) || substr(id, 5) AS name, CASE id[1] WHEN 'a' THEN 'en' WHEN 'b' THEN 'en' WHEN 'e' THEN 'es' WHEN 'f' THEN 'fr' WHEN 'h' THEN 'hi' WHEN 'i' THEN 'it' WHEN 'j' THEN 'ja' WHEN 'p' THEN 'pt' WHEN 'z' THEN 'zh' END AS language,
            CASE id[1] WHEN 'a' THEN 'US' WHEN 'b' THEN 'GB' WHEN 'p' THEN 'BR' ELSE '' END AS locale, CASE id[2] WHEN 'f' THEN 'Female' ELSE 'Male' END AS gender, 'Kokoro' AS tags FROM k
            UNION ALL SELECT n, 'gemini', n, 'en', '', '', t FROM ({GEMINI_SQL}) AS g(n, t)),
        c AS (SELECT c_custkey, ([{", ".join(f"'{v}'" for v in (*L.KOKORO, *(n for n, _ in L.GEMINI)))}])[c_custkey % 90 + 1] AS id FROM customer)
        SELECT c_custkey, c.id, engine, name, language, locale, gender, tags FROM c LEFT JOIN p ON p.id = c.id""",
    ),
    "cloud_voices": (
        _cloud,
        """SELECT 'en-US-Neural2-' || s_name AS id, 'google-cloud' AS engine, 'Neural2-' || s_name AS name, CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'de' ELSE 'en' END AS language, CASE WHEN s_suppkey % 4 > 1 THEN 'US' ELSE '' END AS locale,
        CASE s_suppkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE '' END AS gender, CAST(s_suppkey * 100 AS VARCHAR) || ' Hz' AS tags FROM supplier""",
    ),
    "voice_list_lines": (
        _voice_list,
        """SELECT row_number() OVER (ORDER BY 'en-GB-' || c_name) AS place, 'en-GB-' || c_name || ',en,GB,' || CASE WHEN c_custkey % 2 = 0 THEN 'Female' ELSE 'Male' END || ',"' || CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment || ',Warm' ELSE '' END || '"' AS line FROM customer""",
    ),
    "queue_next": (
        _popped,
        f"""WITH j AS ({_d(JOBS)}), q AS (SELECT queue, bool_or(state = 'running') AS busy, min(seq) FILTER (state = 'pending') AS first FROM j GROUP BY queue)
        SELECT j.queue, seq, output_path, CASE WHEN state = 'pending' AND seq = first AND NOT busy THEN 'running' ELSE state END AS state FROM j JOIN q ON q.queue = j.queue""",
    ),
    "queue_removed": (
        _removed,
        f"""WITH j AS ({_d(JOBS)}), p AS (SELECT queue, seq, row_number() OVER (PARTITION BY queue ORDER BY seq) - 1 AS place FROM j WHERE state = 'pending')
        SELECT * FROM j WHERE seq NOT IN (SELECT seq FROM p JOIN customer ON c_custkey = queue WHERE place = c_custkey % 4 - 1)""",
    ),
    "queue_cleared": (lambda spark, sf: L.cleared(put_in(spark, sf, JOBS)), f"SELECT * FROM ({_d(JOBS)}) WHERE state <> 'pending'"),
    "output_held": (_held, f"SELECT c_custkey, '/out/' || CAST(c_custkey AS VARCHAR) || '.m4b' IN (SELECT output_path FROM ({_d(JOBS)}) WHERE state IN ('pending', 'running')) AS held FROM customer"),
    "output_paths": (
        _outputs,
        """SELECT c_custkey, '/tmp/p/edge-' || trim(regexp_replace('#' || c_name || ' (' || c_mktsegment || ')', '[^A-Za-z0-9._-]+', '-', 'g'), '-') || '.mp3' AS preview,
        '/in/' || c_mktsegment || '/' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '.tar' ELSE '' END || '.m4b' AS beside, '/out/' || c_name || CASE WHEN c_custkey % 3 = 0 THEN '.tar' ELSE '' END || '.mp3' AS inside FROM customer""",
    ),
    "report_files": (
        _reports,
        f"""WITH r AS ({_d(REPORTS)}) SELECT '/notes/' || name || '.md' AS path, narration AS content FROM r UNION ALL SELECT '/notes/' || name || '.notes.md', concat_ws(chr(10), '# ' || name || ': research as delivered', '', 'Topic: ' || topic, 'Researched by: ' || agent,
        'Searches made: ' || CAST(searches AS VARCHAR), '', 'Citations are kept here; what is read aloud is in ' || name || '.md.', '', trim(report, {WS}), '') FROM r""",
    ),
    "tag_plan": (
        _tags,
        f"""WITH t AS (SELECT *, lower(regexp_extract(path, '\\.[^./]+$')) AS s FROM ({_d(TAGS)})), u AS (SELECT *, coalesce(title, '') <> '' AS has_t, coalesce(author, '') <> '' AS has_a, image IS NOT NULL AS has_i, s = '.mp3' AS m3, s IN ('.m4b', '.mp4', '.m4a') AS m4 FROM t),
        v AS (SELECT *, has_t OR has_a OR has_i AS asked FROM u)
        SELECT path, CASE WHEN NOT asked THEN '' WHEN m3 THEN concat_ws('|', CASE WHEN has_t THEN 'album=' || title END, CASE WHEN has_a THEN 'artist=' || author END, CASE WHEN has_t THEN 'title=' || title END)
            WHEN m4 THEN concat_ws('|', CASE WHEN has_a THEN 'aART=' || author END, 'stik=2', CASE WHEN has_a THEN '\xa9ART=' || author END, CASE WHEN has_t THEN '\xa9alb=' || title END, CASE WHEN has_t THEN '\xa9nam=' || title END) ELSE '' END AS tags,
            CASE WHEN has_i AND image_exists AND (m3 OR m4) THEN image END AS cover,
            CASE WHEN asked THEN nullif(concat_ws('; ', CASE WHEN has_i AND NOT image_exists THEN 'cover does not exist' END, CASE WHEN NOT (m3 OR m4) THEN 'no tags for ' || s || ' files' END), '') END AS warning FROM v""",
    ),
    "zipped_segments": (_zipped, "SELECT user_id AS doc_id, event_id AS idx, event_type, CAST(floor(value) AS BIGINT) AS ms FROM events"),
}
