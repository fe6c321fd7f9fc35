"""Scalar text rules, blocks and boilerplate."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import blocks as B
from lectern.operators.html import html_blocks
from lectern.queries.base import duck, put_in, table

SPEECH = """SELECT doc_id, replace(replace(replace(text, '. ', '.' || CAST(1 + doc_id % 120 AS STRING) || '  — '), ', ', ' .... “so” ‘it’ '), 'an ', 'a\xadn\xa0--- ') AS text FROM {documents}"""
MARKUP = """SELECT doc_id, replace(replace(replace(replace(replace(text, ' the ', ' **the** '), ' de ', ' [de](http://x/y) '), ' in ', ' `in` '), ' und ', ' <b class="x">und</b>[^1] '), ' to ', ' ![i](u.png) _to_ ***ab* c** ') AS text FROM {documents}"""
PDF = """SELECT doc_id, replace(replace(replace(text, ' the ', ' the—'), ' de ', ' d\xad' || chr(10) || 'e '), ' und ', ' un-' || chr(10) || 'd–\xa0 ') AS text FROM {documents}"""
WRAPPED = """SELECT doc_id, replace(replace(text, chr(10), '  ' || chr(10) || '   '), '. ', '.' || chr(10) || ' ' || chr(10) || chr(9)) AS text FROM {documents}"""
PLAIN = """SELECT doc_id, replace(replace(replace(text, chr(10), chr(10) || ' ' || chr(10) || chr(10)), '. ', '.' || chr(10)), ', ', ',   ') || chr(10) || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'CHAPTER ÉÇÜ' WHEN doc_id % 3 = 1 THEN 'Part two of it' ELSE 'Parting words of it' END || chr(10) || chr(10) || 'end' AS text FROM {documents}"""
BOILER = """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN text ELSE 'Project Gutenberg Project Gutenberg Project Gutenberg Project Gutenberg Project Gutenberg Project Gutenberg' || CASE WHEN doc_id % 4 = 1 THEN '' ELSE chr(10) || '*** START OF THIS ***' || chr(10) || CASE WHEN doc_id % 4 = 2 THEN chr(10) ELSE ' x' || chr(10) || chr(10) END END || text || CASE WHEN doc_id % 4 = 1 THEN '' ELSE chr(10) || '*** END OF A *** more *** END OF THIS ***' END END AS text FROM {documents}"""
REPORT = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text WHEN doc_id % 5 = 1 THEN replace(text, '. ', ' [1]. ') || chr(10) || '## Sources' || chr(10) || 'a' WHEN doc_id % 5 = 2 THEN '# References and more' || chr(10) || replace(text, '. ', ' [12, 3]. ') WHEN doc_id % 5 = 3 THEN text || chr(10) || '### works cited' || chr(10) || replace(text, ', ', ' [7], ') || chr(10) || '# Bibliography: x' || chr(10) || 'tail' ELSE ' ' END AS report FROM {documents}"""
REWRITE = """SELECT doc_id, text AS original, CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, CAST(length(text) / 2 AS INT)) WHEN 2 THEN 'Sure, ' || text WHEN 3 THEN '' WHEN 4 THEN NULL WHEN 5 THEN '  ' || text || ' ok' ELSE 'As an AI ' || text END AS candidate, doc_id % 11 = 0 AS failed FROM {documents}"""
LINES = """SELECT doc_id, text FROM {documents}"""
#: Blocks of a text with banner, fields, marks or a licence heading put in.
BLOCKS = """SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN '*** START OF X ***' || chr(10) WHEN doc_id % 6 = 1 THEN 'The Project Gutenberg eBook of X' || chr(10) || 'Title: x' || chr(10) || 'Release date : y' || chr(10) WHEN doc_id % 6 = 2 THEN 'x' || chr(10) ELSE '' END || text || CASE WHEN doc_id % 5 = 0 THEN chr(10) || 'x *** END OF X' || chr(10) || 'tail' WHEN doc_id % 5 = 1 THEN chr(10) || 'THE FULL PROJECT GUTENBERG™ LICENSE' || chr(10) || 'tail' WHEN doc_id % 30 = 2 THEN '' ELSE '' END AS text FROM {documents}"""


def _simple(sql: str, fn, out: str = "spoken"):
    return lambda spark, sf: put_in(spark, sf, sql).select("doc_id", fn(F.col("text")).alias(out))


def _d(sql: str) -> str:
    return duck(sql).replace("AS STRING", "AS VARCHAR")


WS = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
FOOT = r"regexp_replace({}, '([^\d][;,.?!)])\d{{1,2}}(\s)', '\1\2', 'g')"


def _nested(x: str, *steps: tuple[str, str]) -> str:
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', '{new}', 'g')"
    return x


SPEAK_SQL = "trim(" + _nested("translate(" + _nested(FOOT.format("text"), (r"\.{3,}|(?:\.\s){2,}\.", "…"), (r"[\s\x{A0}]*(?:—|–|--+)[\s\x{A0}]*", ", ")) + ", '\xa0“”’‘\xad', ' \"\"''''')", (r"[ \t]{2,}", " ")) + f", {WS})"
PAIR = "|".join(f"{m}(\\S(?:.*?\\S)?){m}" for m in (r"\*\*\*", r"\*\*", r"\*", "___", "__", "_"))


def _markup(x: str) -> str:
    return "trim(" + _nested(x, (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[\^[^\]]+\]", ""), (r"`([^`]+)`", r"\1"), (PAIR, r"\1\2\3\4\5\6"), (r"</?[a-zA-Z][^>]*>", "")) + f", {WS})"


MARKUP_SQL = _markup("text")
UNWRAP = "array_to_string(list_filter(list_transform(string_split(regexp_replace({}, '\\r\\n|[\\r\\x0b\\x0c\\x1c-\\x1e]', chr(10), 'g'), chr(10)), lambda x: trim(x, " + WS + ")), lambda x: x <> ''), ' ')"
HEADING = rf"""(strpos({{0}}, chr(10)) = 0 AND length({{0}}) BETWEEN 4 AND 60 AND NOT regexp_matches({{0}}, '[.!?,;:]$')
    AND (regexp_full_match(regexp_replace({{0}}, '[^\p{{{{L}}}}]', '', 'g'), '\p{{{{Lu}}}}+') OR (regexp_matches({{0}}, '^(?i:{T.DIVISIONS})\b') AND regexp_matches({{0}}, '\p{{{{L}}}}'))))"""
STRIP = "trim({}, " + WS + ")"


def heading_sql(x: str) -> str:
    return HEADING.format(x)


def _lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), T.heading_like(F.col("line")).alias("is_heading"), T.capitals(F.col("line")).alias("upper_line")).withColumn("shouted", T.heading_like(F.col("upper_line"))).drop("upper_line")


def _plain(spark, sf):
    b = B.plain_blocks(put_in(spark, sf, PLAIN))
    return b.select("doc_id", F.row_number().over(_by_block()).cast("long").alias("n"), "kind", "text", F.col("level").cast("long").alias("level"))


def _by_block():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("block_idx")


def _boiler_text(spark, sf):
    d = put_in(spark, sf, BOILER)
    looks = T.mentions(F.col("text")) > 5
    kept = F.when(looks, T.without_boilerplate(F.col("text"))).otherwise(F.col("text"))
    return d.select("doc_id", T.mentions(F.col("text")).alias("mentions"), kept.alias("kept"), kept.isNull().alias("rejected"))


def _boiler_blocks(spark, sf):
    d = put_in(spark, sf, BLOCKS).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block_idx", "text"))
    b = d.select("doc_id", "block_idx", F.when(F.col("text").contains("LICENSE"), "heading").otherwise("paragraph").alias("kind"), "text", F.lit(0).alias("level"), F.lit(None).cast("int").alias("page"))
    return B.without_boilerplate(b).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "kind", "text")


def _guarded(spark, sf):
    d = put_in(spark, sf, REWRITE)
    used, reason = T.guard(F.col("original"), F.col("candidate"), F.col("failed"))
    return d.select("doc_id", used.alias("used"), reason.alias("reason"))


def _guard_counts(spark, sf):
    d = put_in(spark, sf, REWRITE)
    _, reason = T.guard(F.col("original"), F.col("candidate"), F.col("failed"))
    return d.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def _sentences(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "sentence"))
    return d.select("doc_id", F.col("n").cast("long").alias("n"), "sentence")


def _slugs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" And THE end")).alias("t"))
    t = F.col("t")
    return d.select("doc_id", T.slug(t).alias("book"), T.topic_slug(t).alias("topic"), T.title_key(t).alias("title_key"), T.clean_stem(F.concat(t, F.lit(".PDF"))).alias("stem"))


def _sparse(spark, sf):
    c = table(spark, sf, "conversations")
    b = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("block_idx"), F.when(F.col("role") == "system", "table").otherwise("paragraph").alias("kind"), "text", F.lit(0).alias("level"), F.col("turn").cast("int").alias("page"))
    return B.sparse(b)


#: HTML put into the pages after their title: nested lists, tables, quotes and navigation, blocks inside headings, captions.
HTML_ENDS = (
    "<ul><li>a <b>b</b><ul><li>c</li></ul>d</li><li>e<p>f</p></li></ul>loose<p>g<ol><li>h</li></ol>",
    "<table><tr><td>1<table><tr><td>2</table><p>3</table><blockquote>q<p>r</p><blockquote>s</blockquote>t</blockquote></blockquote>u<p>v",
    "<h2>t<p>u</h2><pre>x  y" + "  z</pre><nav><nav><p>no</p></nav>n</nav></nav><h3>v</h4><p>w</h3><p>x</p>y",
    "<p>z<figure><figcaption>cap</figcaption></figure><!-- <p>no --><script>\"<p>\"</script><p>",
)
PAGES = "SELECT page_id, replace(html, '</h1>', '</h1>' || CASE page_id % 5 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(HTML_ENDS)) + " ELSE '' END) AS html FROM {pages}"


def _html(spark, sf):
    p = put_in(spark, sf, PAGES).select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    return html_blocks(p).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "kind", "text", F.col("level").cast("long").alias("level"))


#: Markdown put into the texts: what each sort of line does after each other.
MD_ENDS = (
    ("---", "```", "code"),
    ("", "Name", "of *it*", "===", "---", "***", "![x](y)", "==", "~~~", "# no", "", "  deep", "```", "after", "- - -", "w"),
    ("* * *", "1. one", "2) [two](u)", "> q", "---", "z", "--", "  ___", "#not", "### ", "---", "y"),
    ("", "---", "--", "--", "| t |", "---", "| u |", "==", "| v |", "- - -", "***", "", "```", "", "```", "x `y`", "![i](j)"),
)
MD = (
    "SELECT doc_id, replace(replace(replace(text, chr(10), chr(10) || '- item' || chr(10) || 'lazy **b**' || chr(10) || chr(10) || '> quoted' || chr(10) || '| a | b |' || chr(10)), '. ', '.' || chr(10) || chr(10) || '## Heading ##' || chr(10)), ', ', ',' || chr(10)) || CASE doc_id % 4 "
    + " ".join(f"WHEN {k} THEN " + " || ".join(f"chr(10) || '{x}'" for x in end) for k, end in enumerate(MD_ENDS))
    + " END AS text FROM {documents}"
)


def _markdown(spark, sf):
    return B.markdown_blocks(put_in(spark, sf, MD)).select("doc_id", F.col("block_idx").cast("long").alias("block_idx"), "kind", "text", F.col("level").cast("long").alias("level"))


PLAIN_SQL = rf"""
WITH d AS ({_d(PLAIN)}), p AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), chr(10) || chr(10))) AS para,
    generate_subscripts(string_split(regexp_replace(text, '\n\s*\n', chr(10) || chr(10), 'g'), chr(10) || chr(10)), 1) AS i FROM d),
k AS (SELECT doc_id, i, {STRIP.format('para')} AS line, para FROM p),
b AS (SELECT doc_id, i, {heading_sql('line')} AS h, line, trim(regexp_replace({UNWRAP.format('para')}, ' +', ' ', 'g')) AS body FROM k)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n, CASE WHEN h THEN 'heading' ELSE 'paragraph' END AS kind,
    CASE WHEN h THEN line ELSE body END AS text, CAST(CASE WHEN h THEN 2 ELSE 0 END AS BIGINT) AS level FROM b WHERE h OR body <> ''
"""
BOILER_SQL = rf"""
WITH d AS ({_d(BOILER)}), m AS (SELECT *, CAST((length(text) - length(replace(text, 'Project Gutenberg', ''))) / 17 AS BIGINT) AS mentions,
    strpos(text, '*** START OF') AS s, length(text) - strpos(reverse(text), reverse('*** END OF')) - 8 AS e, strpos(text, '*** END OF') AS any_e FROM d),
c AS (SELECT *, CASE WHEN s > 0 AND strpos(substr(text, s), chr(10) || chr(10)) > 0 THEN s + strpos(substr(text, s), chr(10) || chr(10)) - 1 ELSE 0 END AS b FROM m),
k AS (SELECT doc_id, mentions, CASE WHEN mentions > 5 THEN CASE WHEN b > 0 AND any_e > 0 THEN substr(text, b, greatest(e - b, 0)) END ELSE text END AS kept FROM c)
SELECT doc_id, mentions, kept, kept IS NULL AS rejected FROM k
"""
ATX = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
#: What is open before a line is told by the last sign of a string that a fold over the lines appends to.
MD_SQL = rf"""
WITH d AS ({_d(MD)}), a AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS ls FROM d),
k AS (SELECT *, list_transform(ls, lambda x: CASE WHEN regexp_matches(x, '^\s*(```|~~~)') THEN 'F--' WHEN trim(x, {WS}) = '' THEN 'B--'
    WHEN regexp_matches(x, '{ATX}') THEN 'A--' WHEN regexp_matches(x, '^\s*!\[[^\]]*\]\([^)]*\)\s*$') THEN 'I--' ELSE
    CASE WHEN regexp_matches(x, '^\s*\|.*\|\s*$') THEN 't' WHEN regexp_matches(x, '^\s*>\s?') THEN 'q' WHEN regexp_matches(x, '^\s*(?:[-*+]|\d{{1,3}}[.)])\s+') THEN 'l' ELSE 'p' END
    || CASE WHEN regexp_matches(x, '^\s*(?:[-*_]\s*){{3,}}$') THEN 'r' ELSE '-' END || CASE WHEN regexp_matches(x, '^=+\s*$') THEN '1' WHEN regexp_matches(x, '^-{{2,}}\s*$') THEN '2' ELSE '-' END END) AS ks FROM a),
f AS (SELECT *, list_reduce(ks, lambda s, x: s || CASE WHEN x[1] = 'F' THEN CASE WHEN s[-1] = 'c' THEN 'n' ELSE 'c' END WHEN s[-1] = 'c' THEN 'c' WHEN x[1] IN ('B', 'A', 'I') THEN 'n'
    WHEN x[2] = 'r' AND s[-1] = 'n' THEN 'n' WHEN x[3] <> '-' AND s[-1] = 'p' THEN 'n' WHEN x[1] <> 'p' THEN x[1] WHEN s[-1] IN ('q', 'l') THEN s[-1] ELSE 'p' END, 'n') AS states FROM k),
l AS (SELECT doc_id, states, unnest(ls) AS x, unnest(ks) AS sort, generate_subscripts(ls, 1) AS i FROM f),
m AS (SELECT *, substr(states, i, 1) AS was, substr(states, i + 1, 1) AS now FROM l),
n AS (SELECT *, sort[1] IN ('A', 'I') AND was <> 'c' AS alone FROM m),
o AS (SELECT *, sum(CASE WHEN alone OR (now <> was AND now <> 'n') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS b,
    CASE WHEN was = 'c' THEN sort[1] <> 'F' ELSE alone OR (now <> 'n' AND sort[1] <> 'F') END AS part,
    CASE WHEN was = 'p' AND now = 'n' AND sort[3] <> '-' THEN sort[3] ELSE '' END AS under FROM n),
g AS (SELECT doc_id, b, first(now ORDER BY i) AS now, first(alone ORDER BY i) AS alone, first(sort[1] ORDER BY i) AS sort, first(x ORDER BY i) AS head, max(under) AS under,
    coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (part), '') AS raw,
    coalesce(string_agg(trim(CASE WHEN now = 'q' THEN regexp_replace(x, '^\s*>\s?', '') WHEN now = 'l' THEN regexp_replace(x, '^\s*(?:[-*+]|\d{{1,3}}[.)])\s+', '') ELSE x END, {WS}), ' ' ORDER BY i) FILTER (part), '') AS words
    FROM o WHERE b > 0 GROUP BY doc_id, b),
e AS (SELECT doc_id, b, CASE WHEN sort = 'I' AND alone THEN 'figure' WHEN alone OR under <> '' THEN 'heading' ELSE CASE now WHEN 'c' THEN 'code' WHEN 't' THEN 'table' WHEN 'q' THEN 'quote' WHEN 'l' THEN 'list' ELSE 'paragraph' END END AS kind,
    CASE WHEN sort = 'I' AND alone THEN trim(head, {WS}) WHEN alone THEN {_markup(f"regexp_extract(head, '{ATX}', 2)")} WHEN now IN ('c', 't') THEN trim(raw, {WS}) ELSE {_markup("words")} END AS text,
    CASE WHEN sort = 'A' AND alone THEN length(regexp_extract(head, '{ATX}', 1)) WHEN under <> '' THEN CAST(under AS INT) ELSE 0 END AS level FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1 AS block_idx, kind, text, CAST(level AS BIGINT) AS level FROM e WHERE text <> ''
"""
BLOCKS_SQL = rf"""
WITH d AS ({_d(BLOCKS)}), l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
b AS (SELECT *, CASE WHEN strpos(text, 'LICENSE') > 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM l),
g AS (SELECT doc_id, min(i) FILTER (strpos(text, '*** START OF') > 0) AS s, min(i) FILTER (i = 0 AND regexp_matches(text, '(?i)^\s*The Project Gutenberg eBook of\b')) AS banner,
    min(i) FILTER (i > 0 AND NOT regexp_matches(text, '(?i)^\s*(title|author|translator|illustrator|editor|contributor|release date|language|credits|original publication|most recently updated)\s*:')) AS f,
    min(i) FILTER (strpos(text, '*** END OF') > 0) AS e, min(i) FILTER (kind = 'heading' AND regexp_matches(text, '(?i)(full\W+project\W+gutenberg\W+licen[sc]e|end of\W+(the\W+)?project\W+gutenberg|start:?\W+full\W+licen[sc]e)')) AS licence, max(i) + 1 AS n FROM b GROUP BY doc_id),
r AS (SELECT doc_id, CASE WHEN s IS NOT NULL THEN s + 1 WHEN banner IS NOT NULL THEN coalesce(f, n) ELSE 0 END AS lo, coalesce(e, licence, n) AS hi FROM g)
SELECT b.doc_id, CAST(i AS BIGINT) AS block_idx, kind, text FROM b JOIN r ON b.doc_id = r.doc_id WHERE (i >= lo AND i < hi) OR lo >= hi
"""
GUARD_CTE = rf"""WITH d AS ({_d(REWRITE)}), o AS (SELECT *, trim(coalesce(candidate, ''), {WS}) AS c FROM d),
r AS (SELECT *, CASE WHEN trim(original, {WS}) = '' THEN 'blank' WHEN failed THEN 'error' WHEN c = '' THEN 'empty'
    WHEN {' OR '.join("starts_with(lower(substr(c, 1, 80)), '" + h.replace("'", "''") + "')" for h in T.REFUSALS)} THEN 'preamble'
    WHEN abs(length(c) - length(original)) / greatest(1, length(original)) > 0.25 THEN 'drift' ELSE 'accepted' END AS reason FROM o)"""
REPORT_SQL = rf"""
WITH d AS ({_d(REPORT)}), l AS (SELECT *, regexp_split_to_array(report, '(?im)^#{{1,6}}\s*(?:references|sources|citations|works cited|bibliography|further reading)\b.*$') AS parts,
    regexp_extract_all(report, '(?im)^#{{1,6}}\s*(?:references|sources|citations|works cited|bibliography|further reading)\b.*$') AS hits FROM d),
c AS (SELECT *, length(report) - length(parts[len(parts)]) - length(hits[len(hits)]) AS cut FROM l)
SELECT doc_id, CASE WHEN trim(report, {WS}) = '' THEN '' ELSE trim(regexp_replace(CASE WHEN len(hits) > 0 AND cut > length(report) * 0.4 THEN substr(report, 1, cut) ELSE report END,
    '\s*\[\d{{1,3}}(?:\s*,\s*\d{{1,3}})*\]', '', 'g'), {WS}) || chr(10) END AS narration FROM c
"""
TOPIC_STOP = ", ".join(f"'{w}'" for w in T.TOPIC_STOPWORDS)
SLUG_SQL = rf"""
WITH d AS (SELECT doc_id, text || ' And THE end' AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS f FROM d),
v AS (SELECT *, list_filter(f, lambda x: x NOT IN ({TOPIC_STOP})) AS telling FROM w)
SELECT doc_id,
    CASE WHEN rtrim(substr(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60), '_') = '' THEN 'book' ELSE rtrim(substr(trim(regexp_replace(lower(t), '[^a-z0-9]+', '_', 'g'), '_'), 1, 60), '_') END AS book,
    CASE WHEN trim(substr(array_to_string((CASE WHEN len(telling) > 0 THEN telling ELSE f END)[1:5], '_'), 1, 60), '_') = '' THEN 'research' ELSE trim(substr(array_to_string((CASE WHEN len(telling) > 0 THEN telling ELSE f END)[1:5], '_'), 1, 60), '_') END AS topic,
    regexp_replace(regexp_replace(trim(regexp_replace(lower(t), '(^|[^\p{{L}}\p{{N}}_])(?:and|the)\b', '\1', 'g'), {WS}), '\s+', '_', 'g'), '[^\p{{L}}\p{{N}}_]+', '', 'g') AS title_key,
    regexp_replace(replace(lower(regexp_replace(t || '.PDF', '\.[^.]*$', '')), ' ', '_'), '[^a-z0-9_]', '', 'g') AS stem FROM v
"""

HTML_SQL = "WITH put AS (" + duck(PAGES) + r"""), cut AS (
    SELECT page_id AS doc_id, list_concat([''], regexp_extract_all(html, '{tag}')) AS tags, string_split_regex(html, '{tag}') AS texts FROM put
), t AS (SELECT doc_id, unnest(range(1, len(tags) + 1)) AS i, unnest(tags) AS tag, unnest(texts) AS text FROM cut),
named AS (SELECT doc_id, i, text, lower(regexp_extract(tag, '^</?([a-zA-Z][a-zA-Z0-9]*)', 1)) AS name, tag LIKE '</%' AS closes FROM t),
body AS (SELECT * FROM (SELECT *, min(i) FILTER (name = 'body' AND NOT closes) OVER w AS first, min(i) FILTER (name = 'body' AND closes) OVER w AS last FROM named WINDOW w AS (PARTITION BY doc_id)) WHERE i >= coalesce(first, 1) AND i < coalesce(last, 1e9)),
navs AS (SELECT *, sum(CASE WHEN name <> 'nav' THEN 0 WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM body),
seen AS (SELECT * EXCLUDE (s) FROM (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY i)) AS depth FROM navs) WHERE depth = 0),
steps AS (SELECT *, [CASE WHEN name <> h THEN 0 WHEN closes THEN -1 ELSE 1 END FOR h IN ['blockquote', 'table', 'pre', 'li']] AS step FROM seen),
sums AS (SELECT *, [sum(step[1]) OVER w, sum(step[2]) OVER w, sum(step[3]) OVER w, sum(step[4]) OVER w] AS s FROM steps WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
depths AS (SELECT *, s[1] + s[2] + s[3] + s[4] - least(0, min(s[1]) OVER w) - least(0, min(s[2]) OVER w) - least(0, min(s[3]) OVER w) - least(0, min(s[4]) OVER w) AS after FROM sums WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
kinds(name, kind, level) AS (VALUES ('p', 'paragraph', 0), ('h1', 'heading', 1), ('h2', 'heading', 2), ('h3', 'heading', 3), ('h4', 'heading', 4), ('h5', 'heading', 5), ('h6', 'heading', 6), ('figcaption', 'figure', 0), ('blockquote', 'quote', 0), ('table', 'table', 0), ('pre', 'code', 0), ('li', 'list', 0)),
-- tags of blocks outside holders: those that begin where no holder is open, and those that end where none is left
top AS (
    SELECT d.doc_id, d.i, d.name, d.closes, k.kind, k.level FROM (SELECT *, coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY i), 0) AS before FROM depths) d JOIN kinds k USING (name)
    WHERE CASE WHEN closes THEN after = 0 ELSE before = 0 END
), ends AS (SELECT a.doc_id, a.i, a.name, a.kind, a.level, min(b.i) AS own FROM top a LEFT JOIN top b ON b.doc_id = a.doc_id AND b.i > a.i AND b.name = a.name AND b.closes WHERE NOT a.closes GROUP BY ALL),
begins AS (SELECT * FROM ends a WHERE NOT EXISTS (FROM ends h WHERE h.doc_id = a.doc_id AND h.kind IN ('heading', 'figure') AND h.i < a.i AND a.i < h.own)),
spans AS (SELECT *, least(coalesce(own, 1e9), coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), 1e9)) AS until FROM begins),
joined AS (
    SELECT p.doc_id, p.i, kind, level, string_agg(x.text, ' ' ORDER BY x.i) AS text FROM spans p JOIN seen x ON x.doc_id = p.doc_id AND x.i >= p.i AND x.i < p.until GROUP BY ALL
    UNION ALL SELECT doc_id, 1000000000, 'paragraph', 0, string_agg(text, ' ' ORDER BY i) FROM seen GROUP BY doc_id
), plain AS (
    SELECT doc_id, i, kind, level, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '[\s\p{Z}\x1c-\x1f\x85]+', ' ', 'g')) AS text FROM joined
), filled AS (SELECT *, count(*) FILTER (i < 1000000000) OVER (PARTITION BY doc_id) AS n FROM plain WHERE text <> '')
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block_idx, kind, text, CAST(level AS BIGINT) AS level FROM filled WHERE i < 1000000000 OR n = 0
""".replace("{tag}", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|</?[a-z][^>]*>|<[!?/][^>]*>".replace("'", "''"))


QUERIES = {
    "footnote_strip": (_simple(SPEECH, T.drop_footnote_refs), f"SELECT doc_id, {FOOT.format('text')} AS spoken FROM ({_d(SPEECH)})"),
    "speech_normalize": (_simple(SPEECH, T.speakable), f"SELECT doc_id, {SPEAK_SQL} AS spoken FROM ({_d(SPEECH)})"),
    "inline_markup_strip": (_simple(MARKUP, T.drop_inline_markup), f"SELECT doc_id, {MARKUP_SQL} AS spoken FROM ({_d(MARKUP)})"),
    "pdf_text_cleanup": (_simple(PDF, T.printable), f"SELECT doc_id, regexp_replace(translate(replace(replace(translate(text, '—–', '  '), '\xad' || chr(10), ''), '-' || chr(10), ''), '\xa0', ' '), '[^\\x20-\\x7E\\n]', '', 'g') AS spoken FROM ({_d(PDF)})"),
    "paragraph_unwrap": (_simple(WRAPPED, T.unwrapped), f"SELECT doc_id, {UNWRAP.format('text')} AS spoken FROM ({_d(WRAPPED)})"),
    "heading_detect": (_lines, f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents), s AS (SELECT doc_id, line_no, {STRIP.format('line')} AS x, {STRIP.format('upper(line)')} AS y FROM l) SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, {heading_sql('x')} AS is_heading, {heading_sql('y')} AS shouted FROM s"),
    "plain_blocks": (_plain, PLAIN_SQL),
    "boilerplate_text_strip": (_boiler_text, BOILER_SQL),
    "boilerplate_block_strip": (_boiler_blocks, BLOCKS_SQL),
    "sentence_split": (_sentences, r"WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents) SELECT doc_id, unnest(p) AS sentence, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS n FROM s"),
    "report_cleanup": (lambda spark, sf: put_in(spark, sf, REPORT).select("doc_id", T.narration_of_report(F.col("report")).alias("narration")), REPORT_SQL),
    "guarded_rewrite": (_guarded, f"{GUARD_CTE} SELECT doc_id, CASE WHEN reason = 'accepted' THEN c ELSE original END AS used, reason FROM r"),
    "guarded_rewrite_counts": (_guard_counts, f"{GUARD_CTE} SELECT reason, count(*) AS n FROM r GROUP BY reason"),
    "slug_variants": (_slugs, SLUG_SQL),
    "sparse_escalation": (_sparse, f"WITH a AS (SELECT conv_id AS doc_id, count(DISTINCT turn) AS pages, CAST(coalesce(sum(length(text)) FILTER (role <> 'system' AND trim(text, {WS}) <> ''), 0) AS BIGINT) AS spoken_chars FROM conversations GROUP BY conv_id) SELECT *, pages > 0 AND spoken_chars / pages < 200 AS escalate FROM a"),
    "markdown_blocks": (_markdown, MD_SQL),
    "html_blocks": (_html, HTML_SQL),
    "html_h1": (
        lambda spark, sf: table(spark, sf, "pages").select("page_id", B.first_h1(F.col("html")).alias("h1")),
        r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS h1 FROM pages",
    ),
}
