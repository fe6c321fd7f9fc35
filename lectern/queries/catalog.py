"""Catalogue and voices: parts stand for books, customers for authors, suppliers and nations for voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import catalog as C
from lectern.operators import batch_search
from lectern.operators import catalog as O
from lectern.queries.base import duck, put_in, table

NAMES = """SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Aurelius, Emperor of Rome' WHEN c_custkey % 7 = 1 THEN c_name || ', ' || c_mktsegment WHEN c_custkey % 7 = 2 THEN c_name WHEN c_custkey % 7 = 3 THEN 'Poe, Edgar ' || c_mktsegment || ' III' WHEN c_custkey % 7 = 4 THEN ' Twain,  Mark. ' WHEN c_custkey % 7 = 5 THEN 'A, B, C' ELSE 'Smith, Dr. ' || c_mktsegment END AS name FROM {customer}"""
VOICES = """SELECT s_suppkey, s_name || '-' || CAST(s_suppkey AS STRING) || 'Neural' AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'gemini' WHEN s_suppkey % 4 = 1 THEN 'mlx' ELSE 'edge' END AS engine, CASE WHEN s_suppkey % 3 = 0 THEN 'en' WHEN s_suppkey % 3 = 1 THEN 'fr' ELSE '' END AS language, CASE WHEN s_suppkey % 5 = 0 THEN 'US' ELSE '' END AS locale, CASE WHEN s_suppkey % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender, CASE WHEN s_suppkey % 6 = 0 THEN 'Friendly,Bright' ELSE '' END AS tags FROM {supplier}"""
QUERY, AUTHOR = "the blue bolt of", "Author 7, x"


def _d(sql: str) -> str:
    return duck(sql).replace("AS STRING", "AS VARCHAR")


def _books(spark, sf):
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    f = lambda mime, url: F.struct(F.lit(mime).alias("mime"), F.lit(url).alias("url"))
    formats = (
        F.when(k % 4 == 0, F.array(f("text/html", "h"), f("application/epub+zip", "e.epub"), f("text/plain", "t.txt")))
        .when(k % 4 == 1, F.array(f("text/plain; charset=us-ascii", "a.zip"), f("text/plain", "p.txt"), f("text/plain; charset=utf-8", "u.txt")))
        .when(k % 4 == 2, F.array(f("text/html; charset=utf-8", "h2"), f("application/epub+zip", "e.zip")))
        .otherwise(F.array(f("image/jpeg", "c.jpg")))
    )
    author = F.array(F.concat(F.lit("Author "), (k % 10).cast("string")))
    return p.select(k.alias("id"), F.col("p_name").alias("title"), author.alias("authors"), F.col("p_size").cast("long").alias("download_count"), formats.alias("formats"), k.alias("ord"))


BOOK_CTE = """b AS (SELECT p_partkey AS id, p_name AS title, 'author ' || CAST(p_partkey % 10 AS VARCHAR) AS author, CAST(p_size AS BIGINT) AS downloads, p_partkey % 4 AS m,
    list_filter(string_split(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '') AS w FROM part),
r AS (SELECT *, (list_contains(w, 'blue'))::INT + (list_contains(w, 'bolt'))::INT AS hit FROM b WHERE m <> 3),
k AS (SELECT *, CASE WHEN hit = 2 THEN 2 WHEN hit = 1 THEN 1 ELSE 0 END AS rel, (m <> 0)::INT AS no_epub FROM r)"""


def _search(author):
    def run(spark, sf):
        found = O.search(_books(spark, sf), QUERY, author, 20)
        return found.select(F.col("rank").cast("long").alias("rank"), "id", "title", "download_count")

    return run


#: Of every title some words, so that few, some or no books hold them all; every seventh asks for none.
ASKED = "SELECT p_partkey AS asked, CASE p_partkey % 7 WHEN 0 THEN 'of the' WHEN 1 THEN p_name WHEN 2 THEN p_name || ' unseen' ELSE split_part(p_name, ' ', 1) || ' AND ' || split_part(p_name, ' ', CAST(2 + p_partkey % 3 AS INT)) END AS title FROM {part}"


def _batch(spark, sf):
    found = batch_search.searched(batch_search.built(_books(spark, sf)), put_in(spark, sf, ASKED), 5)
    return found.select("asked", F.col("rank").cast("long").alias("rank"), F.col("relevance").cast("long").alias("relevance"), "book.id")


WORDS_OF = "list_filter(string_split(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t NOT IN ('', 'the', 'a', 'an', 'of', 'and', 'or', 'on', 'in', 'to', 'for'))"
BATCH_SQL = f"""WITH b AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS downloads, p_partkey % 4 <> 0 AS no_epub, {WORDS_OF.format('p_name')} AS w FROM part WHERE p_partkey % 4 <> 3),
q AS (SELECT asked, list_distinct({WORDS_OF.format('title')}) AS w FROM ({duck(ASKED)})), s AS (SELECT DISTINCT list_sort(w) AS w FROM q),
hits AS (SELECT s.w AS asked_w, b.*, len(list_intersect(s.w, b.w)) AS n FROM s, b),
r AS (SELECT *, CASE WHEN len(asked_w) = 0 OR n = 0 THEN 0 WHEN n = len(asked_w) THEN 2 ELSE 1 END AS relevance FROM hits),
k AS (SELECT *, row_number() OVER (PARTITION BY asked_w ORDER BY relevance DESC, no_epub, downloads DESC, id) AS rank FROM r QUALIFY rank <= 5)
SELECT asked, rank, CAST(relevance AS BIGINT) AS relevance, id FROM q JOIN k ON k.asked_w = list_sort(q.w)"""


def _formats(spark, sf):
    b = _books(spark, sf)
    return b.select("id", *[C.url_of(F.col("formats"), k).alias(k) for k in C.FORMATS], F.array_join(C.available(F.col("formats")), ",").alias("available"))


def _voices(spark, sf):
    v = put_in(spark, sf, VOICES)
    name = F.regexp_replace(F.element_at(F.split("id", "-", -1), -1), "Neural$", "")
    return v.select("id", "engine", name.alias("name"), "language", "locale", "gender", "tags")


VOICE_CTE = f"v AS (SELECT id, engine, regexp_replace(regexp_extract(id, '[^-]*$'), 'Neural$', '') AS name, language, locale, gender, tags FROM ({_d(VOICES)}))"


def _filtered(spark, sf):
    v = O.filter_voices(_voices(spark, sf), "en", "FEMALE")
    return v.select("id", C.voice_display(F.col("name"), F.col("locale"), F.col("gender"), F.col("tags")).alias("label"))


def _found(spark, sf):
    v = _voices(spark, sf).withColumn("line", F.concat_ws(",", "id", "language", "locale", "gender", F.concat(F.lit('"'), "tags", F.lit('"'))))
    return O.find_voices(v, "Bright", "", "Female").select("id")


def _union(spark, sf):
    v = _voices(spark, sf)
    engines = spark.createDataFrame([("edge", True), ("gemini", False), ("mlx", True)], "engine string, available boolean")
    allv = O.all_voices([v.where(F.col("engine") == e) for e in ("edge", "gemini", "mlx")], engines)
    from pyspark.sql import Window

    w = Window.partitionBy("language").orderBy("locale", F.lower("name"), "id")
    return allv.select("id", "language", F.row_number().over(w).cast("long").alias("place"))


def _languages(spark, sf):
    return _voices(spark, sf).where("language <> ''").select("language").distinct()


def _prefixes(spark, sf):
    n = table(spark, sf, "nation").select(F.concat(F.substring(F.lit("abefhijpzxy"), F.col("n_nationkey") % 11 + 1, F.lit(1)), F.when(F.col("n_nationkey") % 3 == 0, "f").when(F.col("n_nationkey") % 3 == 1, "m").otherwise("q"), F.when(F.col("n_nationkey") % 8 != 7, F.concat(F.lit("_"), F.lower("n_name"))).otherwise(F.lit(""))).alias("id"), "n_nationkey")
    n = n.select(F.regexp_replace("id", " ", "").alias("id"))
    return O.voices_of_prefix(n)


def _engines(spark, sf):
    names = table(spark, sf, "nation").select("n_nationkey", F.element_at(F.array(*[F.lit(x) for x in (" Google ", "kokoro", "EDGE", "edge-tts", "gcp", "other", "mlx", "")]), F.col("n_nationkey") % 8 + 1).alias("name"))
    return O.resolved_engines(names)


def _queue(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("name"), F.concat(F.lit("/out/"), F.col("o_custkey").cast("string"), F.lit(".m4b")).alias("output_path"))
    return O.queue(o).select("seq", "output_path", "claimed")


PREFIX = ", ".join(f"'{k}'" for k in C.LANGUAGE_OF_PREFIX)
LANG = "CASE substr(id, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in C.LANGUAGE_OF_PREFIX.items()) + " ELSE '' END"
PLACE = "CASE substr(id, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in C.LANGUAGE_OF_PREFIX.items()) + " ELSE '' END"
EPITHETS = ", ".join(f"'{w}'" for w in C.EPITHETS)
ALIAS = "CASE x " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.ALIASES.items()) + " ELSE x END"

QUERIES = {
    "title_relevance_batch": (_batch, BATCH_SQL),
    "author_normalize": (
        lambda spark, sf: put_in(spark, sf, NAMES).select("c_custkey", C.author_name(F.col("name")).alias("author")),
        f"""WITH n AS (SELECT c_custkey, trim(name) AS name FROM ({_d(NAMES)})), p AS (SELECT *, string_split(name, ',') AS s FROM n),
        g AS (SELECT *, list_filter(regexp_split_to_array(trim(s[len(s)]), '\\s+'), lambda t: t <> '') AS given FROM p)
        SELECT c_custkey, CASE WHEN len(s) = 2 AND len(given) BETWEEN 1 AND 2 AND NOT list_bool_or(list_transform(given, lambda t: lower(trim(t, '.')) IN ({EPITHETS}))) THEN trim(trim(s[2]) || ' ' || trim(s[1])) ELSE name END AS author FROM g""",
    ),
    "title_relevance_topk": (_search(None), f"WITH {BOOK_CTE} SELECT row_number() OVER (ORDER BY rel DESC, no_epub, downloads DESC, id) AS rank, id, title, downloads AS download_count FROM k QUALIFY rank <= 20"),
    "author_search_topk": (_search(AUTHOR), f"WITH {BOOK_CTE} SELECT row_number() OVER (ORDER BY rel DESC, no_epub, downloads DESC, id) AS rank, id, title, downloads AS download_count FROM k WHERE strpos(author, 'author') > 0 QUALIFY rank <= 20"),
    "format_preference": (
        _formats,
        "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'e.epub' END AS epub, CASE p_partkey % 4 WHEN 0 THEN 't.txt' WHEN 1 THEN 'u.txt' END AS text, CASE p_partkey % 4 WHEN 0 THEN 'h' WHEN 2 THEN 'h2' END AS html, CASE p_partkey % 4 WHEN 3 THEN 'c.jpg' END AS cover, CASE p_partkey % 4 WHEN 0 THEN 'epub,text,html' WHEN 1 THEN 'text' WHEN 2 THEN 'html' ELSE '' END AS available FROM part",
    ),
    "voice_filter": (_filtered, f"WITH {VOICE_CTE} SELECT id, name || CASE WHEN locale <> '' THEN ' (' || locale || ')' ELSE '' END || ' — ' || gender || CASE WHEN tags <> '' THEN ' · ' || tags ELSE '' END AS label FROM v WHERE language = 'en' AND lower(gender) = 'female'"),
    "voice_find": (_found, f"WITH {VOICE_CTE} SELECT id FROM v WHERE strpos(tags, 'Bright') > 0 AND gender = 'Female'"),
    "voice_union_sorted": (_union, f"WITH {VOICE_CTE} SELECT id, language, row_number() OVER (PARTITION BY language ORDER BY locale, lower(name), id) AS place FROM v WHERE engine IN ('edge', 'mlx')"),
    "voice_languages": (_languages, f"WITH {VOICE_CTE} SELECT DISTINCT language FROM v WHERE language <> ''"),
    "voice_prefixes": (
        _prefixes,
        f"""WITH n AS (SELECT replace(substr('abefhijpzxy', CAST(n_nationkey % 11 + 1 AS INT), 1) || CASE n_nationkey % 3 WHEN 0 THEN 'f' WHEN 1 THEN 'm' ELSE 'q' END || CASE WHEN n_nationkey % 8 <> 7 THEN '_' || lower(n_name) ELSE '' END, ' ', '') AS id FROM nation),
        g AS (SELECT id, CASE WHEN strpos(id, '_') > 0 THEN substr(id, strpos(id, '_') + 1) ELSE '' END AS given FROM n)
        SELECT id, 'mlx' AS engine, CASE WHEN given <> '' THEN upper(substr(given, 1, 1)) || substr(given, 2) ELSE id END AS name, {LANG} AS language, {PLACE} AS locale, CASE substr(id, 2, 1) WHEN 'f' THEN 'Female' WHEN 'm' THEN 'Male' ELSE '' END AS gender, 'Kokoro' AS tags FROM g""",
    ),
    "engine_aliases": (
        _engines,
        f"WITH n AS (SELECT n_nationkey, ([' Google ', 'kokoro', 'EDGE', 'edge-tts', 'gcp', 'other', 'mlx', ''])[n_nationkey % 8 + 1] AS name FROM nation), a AS (SELECT *, lower(trim(name)) AS x FROM n), e AS (SELECT *, {ALIAS} AS y FROM a) SELECT n_nationkey, name, CASE WHEN y IN ('edge', 'gemini', 'google-cloud', 'mlx') THEN y END AS engine, y NOT IN ('edge', 'gemini', 'google-cloud', 'mlx') AND trim(name) <> '' AS \"unknown\" FROM e",
    ),
    "queue_duplicates": (_queue, "SELECT o_orderkey AS seq, '/out/' || CAST(o_custkey AS VARCHAR) || '.m4b' AS output_path, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) > 1 AS claimed FROM orders"),
}
