"""Page artifacts, chapters, stub folding and utterances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import artifacts as A
from lectern.operators import script as S
from lectern.queries.base import table
from lectern.queries.text import STRIP, WS

LIMIT, CHUNK_LIMIT = 300, 500
BYLINE = r"(?i)^\s*(by|translated by|edited by|illustrated by|adapted by)\s+\S"
NAVIGATION = r"(?i)^\s*(table of )?(contents|index|colophon|bibliography|illustrations|list of (figures|tables|illustrations))\s*$"


def _blocks(spark, sf) -> DataFrame:
    """Lines as blocks; short ones are headings, some of them bylines or a navigation heading."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "line"))
    short, i = F.length("line") <= 60, F.col("block_idx")
    text = F.when(short & (i % 7 == 3), F.concat(F.lit("By "), "line")).when(short & (i % 7 == 5), "Contents").when(i % 9 == 4, F.concat(F.lit("  "), "line")).otherwise(F.col("line"))
    kind = F.when(short, "heading").when(i % 11 == 6, "table").when(i % 5 == 2, "quote").otherwise("paragraph")
    return lines.select("doc_id", "block_idx", kind.alias("kind"), text.alias("text"), F.when(short, 1 + i % 4).otherwise(0).cast("int").alias("level"), F.lit(None).cast("int").alias("page"))


BLOCKS_SQL = rf"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
blocks AS (SELECT doc_id, i AS block_idx, CASE WHEN length(line) <= 60 THEN 'heading' WHEN i % 11 = 6 THEN 'table' WHEN i % 5 = 2 THEN 'quote' ELSE 'paragraph' END AS kind,
    CASE WHEN length(line) <= 60 AND i % 7 = 3 THEN 'By ' || line WHEN length(line) <= 60 AND i % 7 = 5 THEN 'Contents' WHEN i % 9 = 4 THEN '  ' || line ELSE line END AS text,
    CASE WHEN length(line) <= 60 THEN 1 + i % 4 ELSE 0 END AS level FROM lines),
spoken AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_idx) AS n FROM blocks WHERE kind IN ('heading', 'paragraph', 'quote', 'list') AND {STRIP.format('text')} <> ''),
opened AS (SELECT *, n > 1 AND kind = 'heading' AND level BETWEEN 1 AND 2 AND NOT regexp_matches(text, '{BYLINE}') AS opens FROM spoken),
sectioned AS (SELECT *, opens OR (n = 1 AND kind = 'heading') AS names, CAST(sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY block_idx) AS BIGINT) AS section FROM opened),
secs AS (SELECT doc_id, section, max(text) FILTER (names) AS title, coalesce(list(text ORDER BY block_idx) FILTER (NOT names), []) AS runs,
    CAST(coalesce(sum(length(text)) FILTER (NOT names), 0) AS BIGINT) AS size FROM sectioned GROUP BY doc_id, section)"""
FOLD_SQL = rf"""{BLOCKS_SQL},
docs AS (SELECT doc_id, count(*) AS n, least(400, greatest(1.0, 0.2 * median(size))) AS ceiling, min(title) FILTER (section = 0) AS first_title FROM secs GROUP BY doc_id),
fold(doc_id, i, carried, csize, kept) AS (
    SELECT doc_id, 0::BIGINT, []::VARCHAR[], 0::BIGINT, []::STRUCT(title VARCHAR, prelude VARCHAR[], runs VARCHAR[])[] FROM docs
    UNION ALL
    SELECT f.doc_id, f.i + 1,
        CASE WHEN small THEN f.carried || said || s.runs ELSE [] END, CASE WHEN small THEN f.csize + s.size + CASE WHEN len(said) > 0 THEN length(said[1]) ELSE 0 END ELSE 0 END,
        CASE WHEN small THEN f.kept ELSE f.kept || [{{'title': s.title, 'prelude': f.carried, 'runs': s.runs}}] END
    FROM fold f JOIN docs d ON d.doc_id = f.doc_id AND d.n >= 2
    JOIN (SELECT *, CASE WHEN coalesce(title, '') <> '' THEN [title || '.'] ELSE []::VARCHAR[] END AS said FROM secs) s ON s.doc_id = f.doc_id AND s.section = f.i,
    LATERAL (SELECT s.size + f.csize < d.ceiling AS small) x
),
ends AS (
    SELECT f.doc_id, CASE WHEN len(carried) = 0 THEN kept
        WHEN len(kept) > 0 THEN kept[1:len(kept) - 1] || [{{'title': kept[len(kept)].title, 'prelude': kept[len(kept)].prelude, 'runs': kept[len(kept)].runs || carried}}]
        ELSE [{{'title': d.first_title, 'prelude': []::VARCHAR[], 'runs': carried}}] END AS secs
    FROM fold f JOIN docs d ON d.doc_id = f.doc_id AND f.i = d.n
    UNION ALL
    SELECT d.doc_id, [{{'title': s.title, 'prelude': []::VARCHAR[], 'runs': s.runs}}] FROM docs d JOIN secs s ON s.doc_id = d.doc_id WHERE d.n = 1
),
folded AS (SELECT doc_id, unnest(secs) AS s, generate_subscripts(secs, 1) - 1 AS i FROM ends)"""


def chunks_sql(source: str, key: str, limit: int) -> str:
    """CTEs that pack ``text`` of ``source`` (columns ``key``) into chunks (key, chunk, text)."""
    return rf"""
paras AS (SELECT {key}, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), ' +', ' ', 'g'), chr(10) || chr(10)), lambda p: {STRIP.format('p')}), lambda p: p <> '') AS ps FROM {source}),
cut AS (SELECT {key}, flatten(list_transform(ps, lambda p: CASE WHEN length(p) > {limit}
    THEN list_transform(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s, k: {{'t': s, 'g': ' ', 'f': k = 1}})
    ELSE [{{'t': p, 'g': chr(10) || chr(10), 'f': false}}] END)) AS ts FROM paras),
toks AS (SELECT {key}, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM cut),
pack AS (
    SELECT {key}, 0::BIGINT AS k, 0::BIGINT AS cur, 0::BIGINT AS chunk FROM cut
    UNION ALL
    SELECT {', '.join('p.' + c for c in key.split(', '))}, p.k + 1, CASE WHEN flush THEN 0 ELSE p.cur END + length(t.t.t) + length(t.t.g), p.chunk + flush::INT
    FROM pack p JOIN toks t ON {' AND '.join(f'p.{c} = t.{c}' for c in key.split(', '))} AND t.k = p.k + 1,
    LATERAL (SELECT p.cur > 0 AND (t.t.f OR p.cur + length(t.t.t) + length(t.t.g) > {limit}) AS flush) x
),
chunks AS (SELECT {', '.join('t.' + c for c in key.split(', '))}, p.chunk, {STRIP.format("string_agg(t.t.t || t.t.g, '' ORDER BY t.k)")} AS text
    FROM toks t JOIN pack p ON {' AND '.join(f'p.{c} = t.{c}' for c in key.split(', '))} AND p.k = t.k GROUP BY ALL)"""


def _texts(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\n \n"))).otherwise(F.col("text")).alias("text"))


TEXTS_SQL = "texts AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || ' ' || chr(10)) ELSE text END AS text FROM documents)"


def _greedy(spark, sf):
    d = _texts(spark, sf).select("doc_id", F.posexplode(S.packed(F.col("text"), CHUNK_LIMIT)).alias("n", "chunk"))
    return d.select("doc_id", F.col("n").cast("long").alias("n"), "chunk", (F.length("chunk") > CHUNK_LIMIT).alias("over_limit"))


def _sections(spark, sf):
    b = S.with_sections(_blocks(spark, sf))
    return b.select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), F.col("section").cast("long").alias("section"), "names")


def _sizes(spark, sf):
    s = S.sections(_blocks(spark, sf))
    sizes = F.transform("sections", lambda x: S.total_length(x["runs"]))
    return s.select("doc_id", F.size("sections").cast("long").alias("n_sections"), S.median(sizes).alias("median_size"))


def _fold(spark, sf):
    s = S.sections(_blocks(spark, sf)).select("doc_id", F.posexplode(S.folded(F.col("sections"))).alias("i", "s"))
    return s.select("doc_id", F.col("i").cast("long").alias("i"), "s.title", F.array_join("s.prelude", "|").alias("prelude"), F.array_join("s.runs", "|").alias("runs"))


def script_utterances(spark, sf):
    """Lines to chapters to utterances: the flagship plan."""
    titles = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"))
    u = S.utterances(_blocks(spark, sf), titles, limit=LIMIT)
    return u.select("doc_id", F.col("chapter_idx").cast("long").alias("chapter_idx"), "chapter_title", F.col("utt_idx").cast("long").alias("utt_idx"), "text", F.length("text").cast("long").alias("n_chars"))


FILLED = f"array_to_string(list_filter({{}}, lambda r: trim(r, {WS}) <> ''), chr(10) || chr(10))"
UTTER_SQL = rf"""
WITH RECURSIVE {FOLD_SQL},
bodies AS (SELECT doc_id, i, coalesce(s.title, '') AS title, s.prelude AS prelude, {FILLED.format('s.runs')} AS body FROM folded),
said AS (SELECT doc_id, i, title, {FILLED.format("prelude || CASE WHEN title <> '' THEN [title || '.'] ELSE [] END || [body]")} AS text FROM bodies
    WHERE NOT ({STRIP.format('body')} = '' AND len(prelude) = 0 AND regexp_matches(title, '{NAVIGATION}'))),
{chunks_sql('said', 'doc_id, i', LIMIT)},
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY chunk) - 1 AS u, dense_rank() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS c FROM chunks WHERE text <> '')
SELECT x.doc_id, CAST(c AS BIGINT) AS chapter_idx, CASE WHEN b.title <> '' THEN b.title WHEN x.i = 0 THEN 'Book ' || CAST(x.doc_id AS VARCHAR) ELSE 'Chapter ' || CAST(x.i + 1 AS VARCHAR) END AS chapter_title,
    CAST(u AS BIGINT) AS utt_idx, x.text, CAST(length(x.text) AS BIGINT) AS n_chars
FROM numbered x JOIN bodies b ON b.doc_id = x.doc_id AND b.i = x.i
"""


def _document_text(spark, sf):
    from lectern.operators.media import ordered_text

    b = S.with_rules(_blocks(spark, sf)).where(F.col("kind").isin("heading", "paragraph", "quote", "list") & (F.trim("text") != ""))
    return b.groupBy("doc_id").agg(ordered_text([F.col("block_idx")], F.col("text"), "\n\n").alias("text"))


def _char_counts(spark, sf):
    b = S.with_sections(_blocks(spark, sf)).withColumn("n", F.length("text"))
    return b.groupBy("doc_id").agg(F.sum("n").alias("n_chars"), F.sum(F.when(~F.col("names"), F.col("n")).otherwise(0)).alias("body_chars"), F.countDistinct("section").alias("n_sections"))


def _pages(spark, sf) -> DataFrame:
    """Turns as pages of lines with a running header and a page number."""
    c = table(spark, sf, "conversations")
    text = F.concat(F.lit("HEADER "), (F.col("conv_id") % 3).cast("string"), F.lit("\n"), "text", F.when(F.col("conv_id") % 5 != 0, F.concat(F.lit("\n "), F.col("turn").cast("string"), F.lit(" "))).otherwise(""))
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page"), F.posexplode(F.split(text, "\n", -1)).alias("i", "text"))
    return rows.select("doc_id", (F.col("page") * 10000 + F.col("i")).cast("int").alias("block_idx"), F.lit("paragraph").alias("kind"), "text", F.lit(0).alias("level"), "page")


PAGES_SQL = rf"""texts AS (SELECT conv_id AS doc_id, turn AS page, string_split('HEADER ' || CAST(conv_id % 3 AS VARCHAR) || chr(10) || text || CASE WHEN conv_id % 5 <> 0 THEN chr(10) || ' ' || CAST(turn AS VARCHAR) || ' ' ELSE '' END, chr(10)) AS l FROM conversations),
blocks AS (SELECT doc_id, page, page * 10000 + generate_subscripts(l, 1) - 1 AS block_idx, unnest(l) AS text FROM texts),
placed AS (SELECT *, block_idx = min(block_idx) OVER (PARTITION BY doc_id, page) AS is_head, block_idx = max(block_idx) OVER (PARTITION BY doc_id, page) AS is_foot FROM blocks),
edges AS (SELECT doc_id, page, block_idx, 'head' AS edge, substr({STRIP.format('text')}, 1, 120) AS key FROM placed WHERE is_head
    UNION ALL SELECT doc_id, page, block_idx, 'foot', substr({STRIP.format('text')}, 1, 120) FROM placed WHERE is_foot),
enough AS (SELECT doc_id, count(DISTINCT page) AS pages FROM edges GROUP BY doc_id HAVING count(DISTINCT page) >= 4),
recurring AS (SELECT DISTINCT e.doc_id, key FROM edges e JOIN enough n ON n.doc_id = e.doc_id WHERE length(key) BETWEEN 1 AND 119 GROUP BY e.doc_id, edge, key, pages HAVING count(*) >= greatest(3, pages // 4)),
hits AS (SELECT DISTINCT e.doc_id, e.block_idx FROM edges e JOIN enough n ON n.doc_id = e.doc_id LEFT JOIN recurring r ON r.doc_id = e.doc_id AND r.key = e.key
    WHERE r.key IS NOT NULL OR regexp_full_match(e.key, '[\s\divxlcIVXLC.\-—–]+'))"""


def _long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


QUERIES = {
    "page_edges": (lambda spark, sf: _long(A.page_edges(_pages(spark, sf)).select("doc_id", "page", "block_idx", "edge", "key"), "page", "block_idx"), f"WITH {PAGES_SQL} SELECT doc_id, page, CAST(block_idx AS BIGINT) AS block_idx, edge, key FROM edges"),
    "recurring_edges": (lambda spark, sf: A.recurring_edges(A.page_edges(_pages(spark, sf))), f"WITH {PAGES_SQL} SELECT doc_id, key FROM recurring"),
    "page_artifacts": (lambda spark, sf: _long(A.marked(_pages(spark, sf)).select("doc_id", "block_idx", "kind"), "block_idx"), f"WITH {PAGES_SQL} SELECT b.doc_id, CAST(b.block_idx AS BIGINT) AS block_idx, CASE WHEN h.doc_id IS NULL THEN 'paragraph' ELSE 'page_artifact' END AS kind FROM blocks b LEFT JOIN hits h ON h.doc_id = b.doc_id AND h.block_idx = b.block_idx"),
    "chapter_sections": (_sections, f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(block_idx AS BIGINT) AS block_idx, section, names FROM sectioned"),
    "section_sizes_median": (_sizes, f"WITH {BLOCKS_SQL} SELECT doc_id, count(*) AS n_sections, CAST(median(size) AS DOUBLE) AS median_size FROM secs GROUP BY doc_id"),
    "fold_small_sections": (_fold, f"WITH RECURSIVE {FOLD_SQL} SELECT doc_id, CAST(i AS BIGINT) AS i, s.title AS title, array_to_string(s.prelude, '|') AS prelude, array_to_string(s.runs, '|') AS runs FROM folded"),
    "greedy_chunks": (_greedy, f"WITH RECURSIVE {TEXTS_SQL}, {chunks_sql('texts', 'doc_id', CHUNK_LIMIT)} SELECT doc_id, chunk AS n, text AS chunk, length(text) > {CHUNK_LIMIT} AS over_limit FROM chunks"),
    "script_utterances": (script_utterances, UTTER_SQL),
    "document_text": (_document_text, f"WITH {BLOCKS_SQL} SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY block_idx) AS text FROM (SELECT doc_id, block_idx, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([^\\d][;,.?!)])\\d{{1,2}}(\\s)', '\\1\\2', 'g'), '\\.{{3,}}|(?:\\.\\s){{2,}}\\.', '…', 'g'), '\\s*(?:—|–|--+)\\s*', ', ', 'g'), '[ \\t]{{2,}}', ' ', 'g'), {WS}) AS x FROM spoken) WHERE x <> '' GROUP BY doc_id"),
    "char_counts": (_char_counts, f"WITH {BLOCKS_SQL} SELECT doc_id, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(coalesce(sum(length(text)) FILTER (NOT names), 0) AS BIGINT) AS body_chars, count(DISTINCT section) AS n_sections FROM sectioned GROUP BY doc_id"),
}
