"""Rules on small inputs."""

import io
import zipfile

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern import queries as core
from lectern.functions import catalog as C
from lectern.functions import media as M
from lectern.functions import text as T
from lectern.operators import artifacts as A
from lectern.operators import blocks as B
from lectern.operators import media as OM
from lectern.operators import script as S
from lectern.operators.html import html_blocks
from tests.oracle import rows_of, rows_of_sql


def apply(spark, fn, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i long, x {kind}")
    return [r.y for r in rows.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (T.speakable, {"A word.3 Next": "A word. Next", "Pi is 3.14 here": "Pi is 3.14 here", "Wait.... what": "Wait… what", "a — b -- c": "a, b, c", "so\xadft\xa0gap  x ": "soft gap x", "“q” ‘r’": "\"q\" 'r'", "": ""}),
        (T.drop_inline_markup, {"**bold** _it_ `code`": "bold it code", "[label](http://x) ![i](u) z[^1]": "label  z", "<b>x</b>": "x", "2 * 3 * 4": "2 * 3 * 4"}),
        (T.printable, {"caf\xe9—x–y": "caf x y", "hy-\nphen so\xad\nft": "hyphen soft"}),
        (T.unwrapped, {" a \n\n b\r\nc ": "a b c", "\n": ""}),
        (T.heading_like, {"CHAPTER I": True, "Chapter one": True, "A sentence.": False, "abc": False, "Parting": False, "1234": False, "TWO\nLINES": False}),
        (T.narration_of_report, {"Text [1, 2].\n# Sources\nx": "Text.\n", "# Sources\n" + "body " * 20: "# Sources\n" + ("body " * 20).strip() + "\n", "  ": ""}),
        (T.slug, {"The Art, of War!": "the_art_of_war", "": "book", "!!!": "book"}),
        (T.topic_slug, {"The history of the marine chronometer": "history_marine_chronometer", "of the": "of_the", "": "research"}),
        (C.author_name, {"Austen, Jane": "Jane Austen", "Marcus Aurelius, Emperor of Rome": "Marcus Aurelius, Emperor of Rome", "A, B, C": "A, B, C", "Plato": "Plato"}),
        (M.escaped_meta, {"a=b;c#d\\e\nf": "a\\=b\\;c\\#d\\\\e f"}),
        (C.engine_name, {" Google ": "google-cloud", "kokoro": "mlx", "nobody": None}),
    ],
)
def test_text_rules(spark, rule, cases):
    assert apply(spark, rule, list(cases)) == list(cases.values())


def test_capitals_keep_the_length_as_in_sql(spark, tmp_path):
    long, short = "ß" + "a | " * 14 + "abc", "Maß"  # 60 and 3 characters; with two for the sharp s 61 and 4
    assert (len(long), len(short)) == (60, 3)
    spark.createDataFrame([(1, f"{long}\n{short}\nGroße Maße\nﬁ ᾳ ŉ ΐ ab\nplain words\n")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got, _ = rows_of(core.queries()["heading_detect"](spark, str(tmp_path)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want, columns = rows_of_sql(con, core.oracle_sql()["heading_detect"])
    assert got == want and [r[columns.index("shouted")] for r in sorted(want, key=lambda r: r[columns.index("line_no")])][:3] == [True, False, True]
    several = "".join(c for c in map(chr, range(1, 0x10000)) if len(c.upper()) > 1)
    assert apply(spark, T.capitals, [several, "a\U00010428ß", "", None]) == [con.execute("SELECT upper(?)", [several]).fetchone()[0], "A\U00010400ẞ", "", None]


def test_numbers(spark):
    assert apply(spark, M.srt_time, [0, -5, 3_723_004], "long") == ["00:00:00,000", "00:00:00,000", "01:02:03,004"]
    assert apply(spark, M.rate_text, [1.5, 0.5, 1.0, 0.1, 5.0], "double") == ["+50%", "-50%", "+0%", None, None]
    assert apply(spark, M.tempo_chain, [1.0, 4.0, 3.0, 0.25, 0.3], "double") == ["atempo=1", "atempo=2,atempo=2", "atempo=2,atempo=1.5", "atempo=0.5,atempo=0.5", "atempo=0.5,atempo=0.6"]
    assert apply(spark, M.pcm16, [2.0, -2.0, 0.5], "double") == [32767, -32767, 16383]


def test_relevance_counts_query_words_in_titles(spark):
    fn = lambda x: C.relevance(x, F.lit("the art of war"))
    assert apply(spark, fn, ["The Art of War", "War and Peace", "Emma", None]) == [2, 1, 0, 0]


MARKDOWN = {
    "# Title #\ntext\nmore\n\n> quote\nlazy\n\n- a\n- b\n": [("heading", "Title", 1), ("paragraph", "text more", 0), ("quote", "quote lazy", 0), ("list", "a b", 0)],
    "Name\n===\nSub\n---\n": [("heading", "Name", 1), ("heading", "Sub", 2)],
    "```\ncode # x\n": [("code", "code # x", 0)],
    "| a |\n|---|\nafter\n![x](y)\n---\n": [("table", "| a |\n|---|", 0), ("paragraph", "after", 0), ("figure", "![x](y)", 0)],
    "": [],
    "~~~\n\n a\n```\nx\n---\ny\n---\n---\n- - -\n* * *\nz\n- - -\nw": [("code", "a", 0), ("heading", "x", 2), ("heading", "y", 2), ("paragraph", "z", 0), ("list", "- - w", 0)],
    "==\n==\n--\np\n***\n\n***\n>a\n---\n--\n": [("heading", "==", 1), ("paragraph", "-- p *", 0), ("quote", "a --- --", 0)],
    "# `only` **markup**\n#none\n### \n```\n```\n![a](b)\n1. x\n2) y": [("heading", "only markup", 1), ("paragraph", "#none", 0), ("figure", "![a](b)", 0), ("list", "x y", 0)],
}


@pytest.mark.parametrize(("text", "want"), MARKDOWN.items())
def test_markdown(spark, text, want):
    (got,) = apply(spark, B.markdown_structs, [text])
    assert [tuple(x) for x in got] == want


def told_by_tokens(page):
    """The blocks of a page by its tags in a row, another way than the reader's: a stack of open block tags as a string."""
    import html
    import re

    kinds = {**{f"h{n}": ("heading", n) for n in range(1, 7)}, "p": ("paragraph", 0), "blockquote": ("quote", 0), "li": ("list", 0), "table": ("table", 0), "pre": ("code", 0), "figcaption": ("figure", 0)}
    page = re.sub(r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style|nav)\b.*?</\1\s*>", " ", page)
    body = re.split(r"(?i)<body[^>]*>", page)[-1]
    out, kind, text, inside = [], None, "", ""
    for tag in re.split(r"(<[^>]*>)", body) + ["<end>"]:
        name = re.match(r"</?\s*([a-z0-9]*)", tag.lower())
        if not tag.startswith("<"):
            text += html.unescape(tag)
            continue
        text += " "
        block, opens = name[1] in kinds, not tag.startswith("</")
        holder = kind in ("quote", "list", "table", "code") if kind else False
        if not holder and block and opens:
            if kind and kind != "paragraph":
                continue  # a block inside a heading is its text
            out.append((kind, text, kinds[inside][1])) if kind else None
            kind, inside, text = kinds[name[1]][0], name[1], ""
        elif kind and not opens and name[1] == inside:
            out.append((kind, text, kinds[inside][1]))
            kind, inside, text = None, "", ""
        elif not kind:
            text = ""
    out += [(kind, text, kinds[inside][1])] if kind else []
    return [(k, " ".join(t.split()), n) for k, t, n in out if t.split()]


def test_html_of_the_pages_equals_another_reading(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").selectExpr("page_id AS doc_id", "html AS text")
    got = {}
    for r in html_blocks(rows).orderBy("doc_id", "block_idx").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.text, r.level))
    pages = {r.doc_id: r.text for r in rows.collect()}
    assert len(got) > 40 and {k for b in got.values() for k, _, _ in b} >= {"heading", "paragraph"}
    assert all(told_by_tokens(t) == got.get(i, []) or not told_by_tokens(t) for i, t in pages.items())


def greedy(text, limit):
    """The packing rule, told as a loop."""
    import re

    text = re.sub(r"\n\s*\n", "\n\n", text)
    text = re.sub(r" +", " ", text)
    out, cur = [], ""
    for para in (p.strip() for p in text.split("\n\n")):
        if not para:
            continue
        parts = [(s, " ", k == 0) for k, s in enumerate(re.split(r"(?<=[.!?])\s+", para))] if len(para) > limit else [(para, "\n\n", False)]
        for s, glue, force in parts:
            if cur and (force or len(cur) + len(s) + len(glue) > limit):
                out.append(cur.strip())
                cur = ""
            cur += s + glue
    return out + ([cur.strip()] if cur.strip() else [])


def test_packing_equals_the_loop(spark):
    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.text(alphabet="ab. \n!", max_size=120), min_size=20, max_size=40))
    def check(texts):
        assert apply(spark, lambda x: S.packed(x, 20), texts, "string") == [greedy(t, 20) for t in texts]

    check()


def test_folding_and_packing_are_planned_once(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", "One. Two.", 0)], "doc_id long, block_idx int, kind string, text string, level int")
    plan = S.utterances(blocks, spark.createDataFrame([(1, "T")], "doc_id long, title string"), 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?<=[.!?])") == 1 and "Filter (size(CASE" not in plan and plan.count("0.2") == 1


def test_chapters_without_utterances_are_not_counted(spark):
    rows = [(1, "heading", "Contents", 1), (2, "heading", "Two", 1), (3, "paragraph", "Said here.", 0), (4, "heading", "Index", 1), (5, "heading", "Three", 1), (6, "paragraph", "\u2003 And\xa0here.\u3000", 0)]
    blocks = spark.createDataFrame([(d, *r) for d in (1, 2) for r in rows] + [(3, 1, "heading", "Contents", 1), (4, 1, "paragraph", "\xa0", 0)], "doc_id long, block_idx int, kind string, text string, level int")
    got = [tuple(r) for r in S.utterances(blocks, minimum=0).orderBy("doc_id", "chapter_idx", "utt_idx").collect()]
    assert got == [(d, c, t, 0, said) for d in (1, 2) for c, t, said in ((0, "Two", "Two.\n\nSaid here."), (1, "Three", "Three.\n\nAnd\xa0here."))]


def test_strip_takes_the_white_space_of_expressions(spark):
    signs = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(c,) for c in signs], "x string").select("x", T.strip(F.concat(F.col("x"), F.lit("a b"), F.col("x"))).alias("y"), F.col("x").rlike(r"(?U)\s").alias("white"), T.filled(F.col("x")).alias("filled"))
    assert df.where("(y = 'a b') != white or (y = concat(x, 'a b', x)) = white or filled = white").count() == 0 and df.where("white").count() == 25
    assert apply(spark, T.strip, [" \n\u2003", "", None, "a\xa0\x85"]) == ["", "", None, "a"]


def test_stubs_fold_into_neighbours(spark):
    rows = [(1, k, "heading" if h else "paragraph", t, 1 if h else 0, None) for k, (h, t) in enumerate([(1, "Book"), (0, "x"), (1, "One"), (0, "a" * 900), (1, "Two"), (0, "b" * 900), (1, "End"), (0, "z")])]
    blocks = spark.createDataFrame(rows, "doc_id long, block_idx int, kind string, text string, level int, page int")
    got = S.utterances(blocks).select("chapter_title", "text").collect()
    assert [r.chapter_title for r in got] == ["One", "Two"]
    assert got[0].text.startswith("Book.\n\nx\n\nOne.\n\naaa") and got[1].text.endswith("End.\n\nz")


def test_navigation_without_content_is_skipped(spark):
    rows = [(1, 0, "heading", "Contents", 1, None), (1, 1, "heading", "One", 1, None), (1, 2, "paragraph", "text", 0, None)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_idx int, kind string, text string, level int, page int")
    got = S.utterances(blocks, minimum=0).collect()
    assert [(r.chapter_idx, r.chapter_title, r.text) for r in got] == [(0, "One", "One.\n\ntext")]


def test_cues_never_overlap(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.tuples(st.integers(0, 50), st.integers(0, 80)), min_size=1, max_size=30))
    def check(cues):
        rows = [(1, k, 0, 30, s, e) for k, (s, e) in enumerate(cues)]
        df = spark.createDataFrame(rows, "doc_id long, seg_idx int, cue_idx int, duration_ms long, start_ms long, end_ms long")
        got = [(r.begin_ms, r.finish_ms) for r in OM.cues(df).orderBy("cue_no").collect()]
        want, cursor, previous = [], 0, 0
        for s, e in cues:
            begin = max(cursor + s, previous)
            previous = max(cursor + e, begin + 1)
            want.append((begin, previous))
            cursor += 30
        assert got == want

    check()


def epub(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OPS/b.opf"/></rootfiles></container>')
        z.writestr("OPS/b.opf", '<package xmlns="x"><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>')
        z.writestr("OPS/a.xhtml", "<body><h1>First</h1><p>one</p></body>")
        z.writestr("OPS/b.xhtml", "<body><h1>Second</h1><p>two</p></body>")


def test_folder_of_files_to_utterances_batch_and_stream(spark, tmp_path):
    from lectern.plans.narration import media_plan, of_folder
    from lectern.plugins import SilentEngine
    from lectern.sources import files
    from lectern.streaming.folder import follow

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("CHAPTER ONE\n\nIt was so.\n\nCHAPTER TWO\n\nIt went on.")
    (folder / "b.md").write_text("# Title\n\nHello *there*.\n")
    (folder / "c.zip").write_bytes(b"x")
    epub(folder / "d.epub")
    (folder / "e.epub").write_bytes(b"no archive")
    u = of_folder(spark, str(folder), minimum=0)
    assert sorted(r.text for r in u.collect()) == ["CHAPTER ONE.\n\nIt was so.", "CHAPTER TWO.\n\nIt went on.", "First.\n\none", "Second.\n\ntwo", "Title.\n\nHello there."]
    docs = files.documents(spark, str(folder))
    assert sorted((r.path.rpartition("/")[2], r.reason) for r in files.rejected(docs, files.blocks(docs)).collect()) == [("c.zip", "unsupported suffix"), ("e.epub", "nothing to speak")]
    segments, marks = media_plan(u, SilentEngine(10))
    assert segments.count() == 5 and marks.where("end_ms > start_ms").count() == 5
    follow(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "state"), minimum=0).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_voice_catalogue(spark, tmp_path):
    from lectern.sources.files import voice_catalogue

    (tmp_path / "v.csv").write_text('xx-YY-AbcNeural,xx,YY,Female,"Friendly,Positive"\n\nbad,line\n')
    (v,) = voice_catalogue(spark, str(tmp_path / "v.csv")).collect()
    assert (v.id, v.name, v.tags) == ("xx-YY-AbcNeural", "Abc", "Friendly,Positive")


def test_failed_segments_keep_their_message(spark):
    from lectern.plugins import synthesized

    class Broken:
        name, concurrency = "broken", 1

        def synthesize(self, text, name):
            if "x" in text:
                raise ValueError("no x")
            return name, 1, 1

    u = spark.createDataFrame([(1, 0, "a"), (1, 1, "x")], "doc_id long, idx int, text string")
    assert [r.error for r in synthesized(u, Broken(), backoff_s=0).orderBy("idx").collect()] == [None, "no x"]


def test_long_leaders_before_prose_are_no_page_number(spark):
    texts = {1: "." * 130 + " and so the story began", 2: "1 " * 70 + "goats", 3: " 12 ", 4: "- " * 90 + "xiv"}
    rows = [(1, 10 * page + i, "paragraph", t, page) for page, edge in texts.items() for i, t in enumerate((f"opening {page}", "body", edge))]
    b = spark.createDataFrame(rows, "doc_id long, block_idx int, kind string, text string, page int")
    assert {r.block_idx for r in A.marked(b).where("kind = 'page_artifact'").collect()} == {32, 42}


def test_a_folder_with_damaged_files_is_read_to_the_end(spark, tmp_path):
    from lectern.sources import files

    (tmp_path / "a.txt").write_text("CHAPTER ONE\n\nIt was so.")
    (tmp_path / "latin.txt").write_bytes("Caf\xe9 au lait".encode("latin-1"))
    (tmp_path / "latin.md").write_bytes(b"# Caf\xe9")
    (tmp_path / "empty.txt").write_text(" \n")
    (tmp_path / "p.pdf").write_bytes(b"%PDF")
    epub(tmp_path / "good.epub")
    whole = (tmp_path / "good.epub").read_bytes()
    (tmp_path / "cut.epub").write_bytes(whole[: len(whole) // 2])
    at = whole.index(b"OPS/a.xhtml") + 20
    (tmp_path / "bits.epub").write_bytes(whole[:at] + bytes(b ^ 255 for b in whole[at : at + 12]) + whole[at + 12 :])
    with zipfile.ZipFile(tmp_path / "bare.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
    docs = files.documents(spark, str(tmp_path))
    found = files.blocks(docs)
    name = lambda path: path.rpartition("/")[2]
    speaking = {name(r.path) for r in docs.join(found, "doc_id").collect()}
    assert {"a.txt", "good.epub"} <= speaking and not speaking & {"latin.txt", "latin.md", "cut.epub", "bare.epub"}
    reasons = {name(r.path): r.error for r in files.rejected(docs, found).collect()}
    assert reasons["latin.txt"] == reasons["latin.md"] == "not UTF-8 text" and reasons["empty.txt"] is None and reasons["p.pdf"] == "needs an extractor"
    assert reasons["cut.epub"].startswith("unreadable archive: BadZipFile") and reasons["bare.epub"] == "unreadable archive: no package"
    assert reasons.get("bits.epub", "unreadable archive").startswith("unreadable archive")


def test_each_text_is_spoken_once(spark, tmp_path):
    from lectern.plans.narration import media_plan, narrated, preview

    calls = tmp_path / "calls"

    class Counting:
        name, concurrency = "counting", 2

        def is_available(self):
            return True, ""

        def synthesize(self, text, name):
            with open(calls, "a") as f:
                f.write(".")
            return f"{name}.mp3", len(text), 10

    u = spark.createDataFrame([(1, 0, "c", k, f"text {k}") for k in range(6)], "doc_id long, chapter_idx int, chapter_title string, utt_idx int, text string")
    segments, marks = media_plan(u, Counting())
    assert segments.count() == 6 and marks.first().end_ms == 60 and segments.agg(F.sum("duration_ms")).first()[0] == 60
    assert calls.read_text() == "." * 6

    class Absent(Counting):
        def is_available(self):
            return False, "no key"

    with pytest.raises(RuntimeError, match="no key"):
        media_plan(u, Absent())
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.txt").write_text("CHAPTER ONE\n\nIt was so.")
    plan = narrated(spark, str(tmp_path / "in"), Counting(), model=str.upper, container="m4b", minimum=0)
    assert [r.text for r in plan["utterances"].collect()] == ["CHAPTER ONE.\n\nIT WAS SO."]
    assert plan["complete"].first().complete and [(r.output.rpartition("/")[2], r.codec) for r in plan["outputs"].collect()] == [("b.m4b", "aac")]
    shown = preview(spark, ["af_heart", "a b/c"], Counting(), "hello", "/tmp/p").orderBy("voice").collect()
    assert [(r.path, r.duration_ms) for r in shown] == [("/tmp/p/counting-a-b-c.mp3", 10), ("/tmp/p/counting-af_heart.mp3", 10)]


def test_batches_of_rewrites(spark):
    from lectern.plugins import candidates

    class Model:
        def rewrite_all(self, texts):
            if any(t == "bad" for t in texts):
                raise ValueError
            return [t + "!" for t in texts]

        def __call__(self, text):
            if text == "bad":
                raise ValueError
            return text + "?"

    run = lambda texts: apply(spark.newSession(), lambda x: candidates(x, Model()), texts)
    assert [tuple(r) for r in run(["a"])] == [("a!", False)]
    assert {tuple(r) for r in run(["a", "bad"])} <= {("a!", False), ("a?", False), (None, True)}


def test_unequal_numbers_of_rows_are_an_error(spark):
    from lectern.operators.library import zipped

    a, b = spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, idx int"), spark.createDataFrame([(1, 0, 5)], "doc_id long, idx int, ms int")
    with pytest.raises(Exception, match="as many rows"):
        zipped(a, b).collect()
    assert zipped(a.where("idx = 0"), b).collect()[0].ms == 5


def test_pages_from_three_backends(spark):
    from lectern.operators.pages import page_range, tiers
    from lectern.plugins import page_texts

    def ocr(content):
        if content == b"2":
            raise RuntimeError("no reader")
        return "scanned"

    pages = spark.createDataFrame([(1, p, bytes(str(p % 4), "ascii")) for p in range(1, 6)], "doc_id long, page int, content binary")
    got = tiers(page_texts(pages, plain=lambda c: "plain" if c == b"1" else " ", ocr=ocr)).orderBy("page").collect()
    assert [(r.page, r.tier, r.text, r.ocr_error) for r in got] == [(1, "text", "plain", None), (2, "none", None, "no reader"), (3, "none", None, None), (4, "none", None, None), (5, "text", "plain", None)]
    got = tiers(page_texts(pages, layout=lambda c: "# md" if c == b"3" else "", plain=lambda c: "plain", ocr=lambda c: "scan")).orderBy("page").collect()
    assert [r.tier for r in got] == ["ocr", "ocr", "layout", "ocr", "ocr"]
    assert [r.page for r in page_range(pages, 0, 2).collect()] == [1, 2] and page_range(pages, 3, 0).count() == 3 and page_range(pages, -4, -1).count() == 0


def test_texts_go_to_a_fixed_number_of_folders(spark, tmp_path):
    from lectern.sources.files import write_texts, write_voice_list

    write_texts(spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb"), "id").alias("t")), str(tmp_path / "o"), "t", 4)
    assert len(list((tmp_path / "o").glob("bucket=*"))) == 4
    assert spark.read.json(str(tmp_path / "o")).where("text = concat('a\\nb', doc_id)").count() == 200
    write_voice_list(spark.createDataFrame([("b-B-x", "Male", None), ("a-A-y", "Female", ["W", "V"])], "name string, gender string, personalities array<string>"), str(tmp_path / "v"))
    (file,) = (tmp_path / "v").glob("part-*")
    assert file.read_text() == 'a-A-y,a,A,Female,"W,V"\nb-B-x,b,B,Male,""\n'


def test_entry_without_the_libraries_of_the_training_data_part():
    import os
    import subprocess
    import sys

    if not os.path.exists("lectern/llm/queries.py"):
        pytest.skip("the part is not there")
    code = "import sys, warnings; sys.modules['xxhash'] = None; warnings.simplefilter('error', ImportWarning); import __spark_entry__ as e; q = e.queries(); assert 'script_utterances' in q and not any(k.startswith('op') and k[2:3].isdigit() for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert done.returncode == 0 and "left out" in done.stderr, done.stderr
