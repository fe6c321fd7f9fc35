"""Archives as a table, EPUBs out of it, and that only what is wanted is read."""

import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, StringEndsWith

from lectern.plans.narration import of_folder
from lectern.sources import archive, epub, files

OPF = """<?xml version="1.0"?><opf:package xmlns:opf="http://www.idpf.org/2007/opf"><opf:manifest>{items}</opf:manifest><opf:spine toc="n">{refs}</opf:spine></opf:package>"""


def book(path, chapters, root="OPS/deep/b.opf", href="../text/c%20{}.xhtml#top", entry="OPS/text/c {}.xhtml", stored=False):
    """An EPUB whose spine is its chapters in reverse, with a picture and a chapter outside the spine."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED if stored else zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("META-INF/container.xml", f'<container xmlns="urn:x"><rootfiles><rootfile full-path="{root}" media-type="x"/></rootfiles></container>')
        items = [f'<opf:item id="i{k}" href="{href.format(k)}"/>' for k in range(len(chapters))]
        z.writestr(root, OPF.format(items="".join(items) + '<opf:item id="p" href="p.png"/>', refs="".join(f'<opf:itemref idref="i{k}"/>' for k in reversed(range(len(chapters)))) + '<opf:itemref idref="gone"/>'))
        for k, text in enumerate(chapters):
            z.writestr(entry.format(k), text)
        z.writestr("OPS/deep/p.png", os.urandom(5000))
        z.writestr("OPS/text/other.xhtml", "<p>not in the spine</p>")


@pytest.fixture()
def folder(tmp_path):
    rng = random.Random(1)
    noise = lambda: "".join(rng.choices("abcdefgh ", k=4000))
    (tmp_path / "sub").mkdir()
    book(tmp_path / "sub" / "large.epub", [f"<body><h1>Chapter {k}</h1><p>text {k}</p><p>{noise()}</p></body>" for k in range(30)], stored=True)
    book(tmp_path / "flat.epub", ["<h1>Alone &amp; flat</h1><p>Words.</p>"], root="b.opf", href="./x{}.html", entry="x{}.html")
    (tmp_path / "no.epub").write_bytes(b"no archive")
    book(tmp_path / "odd.epub", ["<p>x</p>"])
    with zipfile.ZipFile(tmp_path / "bad.epub", "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='b.opf'/></rootfiles>")
        z.writestr("b.opf", "<package><manifest><item id=")
    return str(tmp_path)


def test_entries_of_archives(spark, folder):
    rows = archive.entries(spark, folder, split="20000").collect()
    assert {r.path.rpartition("/")[2] for r in rows} == {"large.epub", "flat.epub", "no.epub", "odd.epub", "bad.epub"}
    assert [(r.entry, r.content) for r in rows if r.path.endswith("no.epub")] == [(None, None)] and [r.path.rpartition("/")[2] for r in rows if r.error] == ["no.epub"]
    with zipfile.ZipFile(f"{folder}/sub/large.epub") as z:
        assert {(r.entry, r.place, r.size, bytes(r.content)) for r in rows if r.path.endswith("large.epub")} == {(x.filename, k, x.file_size, z.read(x)) for k, x in enumerate(z.infolist())}
    html = archive.entries(spark, folder, suffixes=".xhtml, .HTML").where("error is null").select("entry").collect()
    assert len(html) == 30 + 1 + 1 + 2 + 1 - 1 + 1


def test_a_large_archive_is_read_by_several_tasks(spark, folder):
    large = f"{folder}/sub/large.epub"
    rows = archive.entries(spark, large, split="20000")
    assert rows.rdd.getNumPartitions() > 4
    assert rows.where(F.spark_partition_id() >= 0).groupBy(F.spark_partition_id()).count().count() > 4
    assert archive.entries(spark, large).rdd.getNumPartitions() == 1


def test_only_what_is_asked_for_is_opened(spark, folder, monkeypatch):
    reader = archive.ArchiveReader({"path": folder, "split": "20000"})
    entry, path = EqualTo(("entry",), "OPS/text/c 3.xhtml"), StringEndsWith(("path",), "large.epub")
    assert list(reader.pushFilters([entry, path])) == []
    opened, read = [], zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, x: opened.append(x.filename) or read(self, x))
    found = [b.to_pylist() for p in reader.partitions() for b in reader.read(p)]
    assert opened == ["OPS/text/c 3.xhtml"] and [r["entry"] for b in found for r in b] == opened
    got = archive.entries(spark, folder).where("entry = 'OPS/text/c 3.xhtml' AND path LIKE '%large.epub'")
    # the source takes both predicates: none is left to Spark
    assert got.count() == 1 and "Filter" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_chapters_in_the_order_of_the_spine(spark, folder):
    docs = files.documents(spark, folder)
    a = epub.chapters_of_folder(spark, folder, docs, split="20000")
    b = epub.chapters_of_content(docs)
    key = lambda rows: sorted((r.doc_id, r.chapter, r.entry, r.text) for r in rows.collect())
    assert key(a) == key(b) and a.count() == 32
    found = epub.blocks(a).join(docs.where("path like '%large.epub'").select("doc_id"), "doc_id").orderBy("block_idx").collect()
    assert [r.block_idx for r in found] == list(range(90)) and [r.text for r in found[::3]] == [f"Chapter {k}" for k in reversed(range(30))]
    titles = {r.chapter_title for r in of_folder(spark, folder, minimum=0).collect()}
    assert {"Chapter 29", "Chapter 0", "Alone & flat"} <= titles


@pytest.mark.parametrize(("folder", "href", "want"), [("OPS/", "a.html", "OPS/a.html"), ("", "./a.html", "a.html"), ("a/b/", "../../c/d.html", "c/d.html"), ("a/", ".././b/./c+d%20e%zz", "b/c+d%20e%zz"), ("a/", "b%20c+.html#x", "a/b c+.html"), ("", "../a", "../a")])
def test_paths_in_packages(spark, folder, href, want):
    assert spark.range(1).select(epub.resolved(F.lit(folder), F.lit(href)).alias("x")).first().x == want
