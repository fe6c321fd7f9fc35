"""HTML, long documents, numbers over all rows and files that are written together, on small inputs."""

import html
import os
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions.arrays import cut_at, scanned
from lectern.functions.text import unescaped
from lectern.operators import html as H
from lectern.operators import media, script
from lectern.shared import free, numbered
from lectern.sources import sink
from tests.html_reader import html_items


def column(spark, values, kind, fn):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").repartition(2)
    return [r[1] for r in sorted(df.select("k", fn(F.col("v")).alias("x")).collect())]


# -- HTML --------------------------------------------------------------------------------------

REFERENCES = ["&amp;lt;", "&copy x", "&notit;", "&#65;&#x41;", "&#128;&#129;", "&#0;&#xD800;", "&#99999999999999999999999;", "&#x110000;&#x10FFFD;", "&nosuch;", "& &am &ampx &", "&hellip;", "&#1;&#11;&#12;&#xFDD0;&#xFFFE;", "&NotEqualTilde;", "&;&#;&#x;", "&#xfeff;a", "é🙂&Eacute;", "", "&amp" * 3, "&lt;p&gt;", "&CounterClockwiseContourIntegral;"]


def test_references_are_those_of_the_standard(spark):
    assert column(spark, REFERENCES, "string", unescaped) == [html.unescape(t) for t in REFERENCES]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*REFERENCES, "&", ";", "#", "x", "amp", "1", " "]), max_size=8).map("".join), min_size=1, max_size=12))
def test_references_anywhere(spark, texts):
    assert column(spark, texts, "string", unescaped) == [html.unescape(t) for t in texts]


def blocks_of(spark, pages):
    return [[tuple(b) for b in x] for x in column(spark, pages, "string", H.html_structs)]


def test_html_structures(spark):
    cases = {
        "<body><nav><p>no</p></nav><script>var x='</p>'</script><h2>T <b>x</b></h2><p>one<p>two<ul><li>a <p>b</p></li></ul><div>loose</div></body>": [("heading", "T x", 2), ("paragraph", "one", 0), ("paragraph", "two", 0), ("list", "a b", 0)],
        "<div>just text</div>": [("paragraph", "just text", 0)],
        "a &lt; b < c": [("paragraph", "a < b < c", 0)],
        "": [],
        None: [],
        "<ul><li>a<ul><li>b</li></ul>c<li>d</ul><p>e<li>f<li>g</ol>h": [("list", "a b c", 0), ("list", "d", 0), ("paragraph", "e", 0), ("list", "f", 0), ("list", "g", 0)],
        "<table><td>1<table><td>2</table>3</table>x<blockquote>q<p>r<blockquote>s</blockquote>t</blockquote></blockquote><pre>u\n v</pre>": [("table", "1 2 3", 0), ("quote", "q r s t", 0), ("code", "u v", 0)],
        "<h1>a<p>b</h2>c</h1>d<P TITLE='x>y'>e</P>f<figcaption>g": [("heading", "a b c", 1), ("paragraph", "e", 0), ("figure", "g", 0)],
        "<head><title>t</title><p>x</head><body class=a><p>b<!-- <p>c --> d</body><p>after": [("paragraph", "b d", 0)],
        "<nav>a<nav>b</nav>c</nav><p>d</nav>e<style>p{}</style>\xa0f\x1cg": [("paragraph", "d e f g", 0)],
        "<p>x<!-- open <p>y": [("paragraph", "x", 0)],
        "<p>x<script>open <p>y": [("paragraph", "x", 0)],
        "<p>" + "a<b c='d>'>" * 400: [("paragraph", " ".join("a" * 400), 0)],
        "<p>&amp;</p>x": [("paragraph", "&", 0)],
        "<p>&nbsp;<p>&#32; </p>x &lt;": [("paragraph", "x <", 0)],
        "<p " + "a='>' " * 300 + ">z": None,
    }
    got = blocks_of(spark, list(cases))
    assert [g for g, w in zip(got, cases.values()) if w is not None] == [w for w in cases.values() if w is not None]


def test_html_of_the_pages_equals_the_tag_by_tag_reader(spark, sf):
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = blocks_of(spark, pages)
    assert got == [html_items(p) for p in pages] and sum(map(len, got)) > 300


def test_a_page_of_many_tags(spark):
    page = "<body>" + "<ul><li>a <b>b</b></li></ul><p>c" * 20_000
    began = time.perf_counter()
    (got,) = blocks_of(spark, [page])
    assert len(got) == 40_000 and got[:2] == [("list", "a b", 0), ("paragraph", "c", 0)]
    assert time.perf_counter() - began < 90


# -- long documents ----------------------------------------------------------------------------


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=40), min_size=1, max_size=6))
def test_scan_and_cut(spark, lists):
    step = lambda a, x: F.when(a + x > 15, 0).otherwise(a + x)
    got = column(spark, lists, "array<int>", lambda v: scanned(v, F.lit(0), step, lambda a, x: a + x > 15))
    for values, found in zip(lists, got):
        at, want = 0, []
        for k, x in enumerate(values):
            want += [k + 1] if at + x > 15 else []
            at = 0 if at + x > 15 else at + x
        assert found == want
    cut = column(spark, lists, "array<int>", lambda v: cut_at(v, scanned(v, F.lit(0), lambda a, x: a, lambda a, x: x > 6)))
    for values, parts in zip(lists, cut):
        first = next((k for k, x in enumerate(values) if x > 6), len(values))
        assert [x for p in parts for x in p] == values[first:] and all(p[0] > 6 and max(p[1:], default=0) <= 6 for p in parts)


def folded_by_loop(text, limit):
    out, cur = [], ""
    for para in (p.strip() for p in re.sub(" +", " ", re.sub(r"\n\s*\n", "\n\n", text)).split("\n\n")):
        if not para:
            continue
        long = len(para) > limit
        for k, piece in enumerate(re.split(r"(?<=[.!?])\s+", para) if long else [para]):
            glue = " " if long else "\n\n"
            if cur and ((long and k == 0) or len(cur) + len(piece) + len(glue) > limit):
                out.append(cur.strip())
                cur = ""
            cur += piece + glue
    return out + ([cur.strip()] if cur.strip() else [])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb. ", "c! d ", "\n\n", "\n \n\n", "eeeee? ", "  "]), max_size=40).map("".join), min_size=1, max_size=6), st.sampled_from([1, 6, 15]))
def test_packing_equals_the_loop(spark, texts, limit):
    assert column(spark, texts, "string", lambda t: script.packed(t, limit)) == [folded_by_loop(t, limit) for t in texts]


def test_a_document_of_a_million_paragraphs(spark):
    text = "\n\n".join(f"p {k % 7}" + "x" * (k % 50) for k in range(1_000_000))
    began = time.perf_counter()
    (got,) = column(spark, [text], "string", lambda t: script.packed(t, 300))
    assert time.perf_counter() - began < 120
    assert got == folded_by_loop(text, 300)


def test_a_document_of_many_sections(spark):
    kind = f"array<{script.SECTION}>"
    many = [(f"t{k}" if k % 3 else None, [], ["r" * (k % 9 * 60)] if k % 5 else []) for k in range(100_000)]
    began = time.perf_counter()
    got, few, one = column(spark, [many, many[:4], many[:1]], kind, script.folded)
    assert time.perf_counter() - began < 90
    sizes = sorted(sum(map(len, s[2])) for s in many)
    least = min(400.0, max(1.0, 0.2 * (sizes[49_999] + sizes[50_000]) / 2))
    carried, size, want = [], 0, []
    for title, _, runs in many:
        own = sum(map(len, runs))
        if own + size < least:
            carried += ([f"{title}."] if title else []) + runs
            size = sum(map(len, carried))
        else:
            want.append((title, carried, runs))
            carried, size = [], 0
    if carried:
        want[-1] = (*want[-1][:2], want[-1][2] + carried)
    assert [tuple(s) for s in got] == want and 100 < len(want) < 100_000
    assert len(few) >= 1 and [tuple(s) for s in one] == [tuple(many[0])]


def test_points_in_many_ranges(spark):
    counts = [(d, c, (c * 7 + d) % 4) for d in (1, 2) for c in range(30_000)]
    total = {d: sum(n for e, _, n in counts if e == d) for d in (1, 2)}
    wanted = [(d, n) for d in (1, 2, 3) for n in range(0, 60_000, 11)] + [(1, total[1] - 1), (1, total[1]), (1, -1), (1, -1), (2, None)]
    began = time.perf_counter()
    got = media.chapter_of(spark.createDataFrame(counts, "doc_id long, chapter_idx int, n_utterances int"), spark.createDataFrame(wanted, "doc_id long, n int")).collect()
    assert time.perf_counter() - began < 60 and len(got) == len(wanted)
    of, at = {}, {1: 0, 2: 0}
    for d, c, n in counts:
        of |= {(d, at[d] + k): c for k in range(n)}
        at[d] += n
    assert all(r.chapter_idx == of.get((r.doc_id, r.n)) for r in got)


# -- numbers and files -------------------------------------------------------------------------


def test_numbers_over_all_rows(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id * 7919 % 1000 AS string) AS name", "1 AS at", "2 AS part").repartition(7)
    got = numbered(rows, "name", "id").collect()
    want = sorted((r.name, r.id) for r in rows.collect())
    assert [(r.name, r.id) for r in sorted(got, key=lambda r: r.place)] == want and sorted(r.place for r in got) == list(range(1, 5001))
    assert got[0].at == 1 and got[0].part == 2 and numbered(rows.limit(0), "id").count() == 0
    assert free(rows, "At") == "_At" and free(rows, "x") == "x"


def tree(folder):
    return {os.path.relpath(os.path.join(d, n), folder): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(folder) for n in names}


def test_files_are_written_together(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(f"/a/{k}.srt", f"cue {k}\n\0é") for k in range(30)] + [("b.md", ""), ("a_1", None), ("a/1", "x")]
    sink.write_files(spark.createDataFrame(rows, "path string, content string").repartition(4), folder)
    assert tree(folder) == {p.lstrip("/"): (c or "").encode() for p, c in rows}
    binary = spark.createDataFrame([("b.md", b"\xff"), ("c/d", b"1")], "path string, content binary")
    with pytest.raises(Exception, match="there already"):
        sink.write_files(binary, folder)
    assert "c/d" not in tree(folder)
    sink.write_files(binary, folder, overwrite=True)
    assert tree(folder)["b.md"] == b"\xff" and tree(folder)["c/d"] == b"1" and len(tree(folder)) == len(rows) + 1


@pytest.mark.parametrize("bad", ["../x", None, "/", "a/../..", "n2.txt"])
def test_nothing_is_written_by_a_failed_job(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    rows = [(f"n{k}.txt", "x") for k in range(20)] + [(bad, "y")]
    with pytest.raises(Exception, match="file|path|rows|folder"):
        sink.write_files(spark.createDataFrame(rows, "path string, content string").repartition(3), folder)
    for _ in range(40):  # tasks that outlive their job take a moment to give up
        if tree(folder) == {}:
            break
        time.sleep(0.25)
    assert tree(folder) == {}


def test_a_file_per_document(spark, sf, tmp_path):
    segs = spark.createDataFrame([(d, k, f"/s/{d}-{k}.wav") for d in (1, 2) for k in range(3)], "doc_id long, idx int, path string")
    lists = media.playlist(segs)
    sink.write_per_document(lists, "playlist", ".txt", str(tmp_path / "lists"))
    assert tree(tmp_path / "lists") == {f"{r.doc_id}.txt": r.playlist.encode() for r in lists.collect()}
