"""Requests, answers with retries, downloads, narrated texts and the removal of segments, on small inputs."""

import os
from urllib.parse import quote_plus, urlencode

import pytest
from pyspark.sql import functions as F

from lectern import plugins
from lectern.functions.catalog import FORMATS
from lectern.operators import catalog, library
from lectern.plans import narration
from lectern.sources import remote, sink


class Notes:
    """A fetcher that answers from a table and notes every call in a file."""

    concurrency = 2

    def __init__(self, notes, answers):
        self.notes, self.answers = str(notes), answers

    def get(self, url):
        with open(self.notes, "a") as f:
            f.write(url + "\n")
        answer = self.answers.get(url, OSError("no such host"))
        if isinstance(answer, Exception):
            raise answer
        return answer

    def calls(self):
        return sorted(open(self.notes).read().split("\n")[:-1]) if os.path.exists(self.notes) else []


def test_values_are_quoted_as_in_forms(spark):
    values = ["a b", "~-._*", "é&=+%/", "", "日本", "'\"<>\n", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.q for r in df.select(remote.quoted(F.col("v")).alias("q")).collect()] == [None if v is None else quote_plus(v) for v in values]


@pytest.mark.parametrize("title, author, language, want", [
    ("Sea & War", "Poe", "en", {"search": "Sea & War Poe", "languages": "en"}),
    (" ", "Poe", "", {"search": "Poe"}), ("x", None, None, {"search": "x"}), ("", "  ", "en", None), (None, None, "en", None),
])
def test_search_requests(spark, title, author, language, want):
    df = spark.createDataFrame([(title, author, language)], "t string, a string, l string")
    got = df.select(remote.search_request("http://c/b", F.col("t"), F.col("a"), F.col("l")).alias("u")).first().u
    assert got == (None if want is None else "http://c/b?" + urlencode(want))


def test_an_address_is_asked_once_and_again_only_where_that_may_help(spark, tmp_path):
    fetcher = Notes(tmp_path / "n", {"u": b"\xff\x00", "v": ValueError("not allowed"), "w": b""})
    urls = spark.createDataFrame([("u",), ("u",), ("v",), ("w",), ("x",), (None,)], "url string")
    rows = remote.fetched(urls, fetcher, delay_s=0)
    got = {r.url: (r.content and bytes(r.content), r.attempts, r.error) for r in rows.collect()}
    assert got == {"u": (b"\xff\x00", 1, None), "v": (None, 1, "could not reach v: not allowed"), "w": (b"", 1, None), "x": (None, 3, "could not reach x: no such host")}
    assert rows.count() == 4 and fetcher.calls() == ["u", "v", "w", "x", "x", "x"]  # read again, asked once
    assert remote.fetched(urls.limit(0), fetcher).count() == 0


def test_waits_grow_linearly(spark, tmp_path):
    class Timed(Notes):
        def get(self, url):
            import time

            with open(self.notes, "a") as f:
                f.write(f"{time.time()}\n")
            raise TimeoutError

    fetcher = Timed(tmp_path / "n", {})
    remote.fetched(spark.createDataFrame([("u",)], "url string"), fetcher, delay_s=0.2)
    a, b, c = (float(x) for x in fetcher.calls())
    assert 0.2 <= b - a < 0.39 and 0.4 <= c - b < 0.9


def test_answers_are_books_or_errors(spark, tmp_path):
    one = b'{"results": [{"id": 7, "title": " Odd ", "authors": [{"name": "Poe, Edgar Allan"}], "formats": {"application/epub+zip": "e"}, "download_count": 3}, null, {"id": 8}]}'
    fetcher = Notes(tmp_path / "n", {"a": one, "b": b"<html>", "c": b'{"count": 0}', "d": b'{"results": [{"id": 9, "title": "caf\xe9"}]}', "f": b"[]", "g": b""})
    wanted = spark.createDataFrame([(k, u, f"own {k}") for k, u in enumerate("abcadefg")], "q int, url string, error string")
    books, errors = remote.answered(wanted.withColumnRenamed("error", "content"), fetcher, delay_s=0)
    got = sorted((r.q, r.ord, r.id, r.title, tuple(r.authors), r.content) for r in books.collect())
    poe = ("Edgar Allan Poe",)
    assert got == [(0, 0, 7, "Odd", poe, "own 0"), (0, 2, 8, "", (), "own 0"), (3, 0, 7, "Odd", poe, "own 3"), (3, 2, 8, "", (), "own 3"), (4, 0, 9, "caf�", (), "own 4")]
    assert sorted((r.q, r.error) for r in errors.collect()) == [(1, "b answered with something that is no JSON"), (5, "could not reach e: no such host"), (7, "g answered with something that is no JSON")]
    assert [r.id for r in catalog.search(books.where("q = 0"), "odd").collect()] == [7]


def test_a_mirror_answers_from_files(spark, tmp_path):
    (tmp_path / "m" / "h.org" / "a b").mkdir(parents=True)
    (tmp_path / "m" / "h.org" / "a b" / "c?ids=3").write_bytes(b"yes")
    mirror = remote.Mirror(str(tmp_path / "m"))
    urls = spark.createDataFrame([("http://h.org/a%20b/c?ids=3",), ("http://h.org/none",), ("http://h.org/../../etc",)], "url string")
    got = {r.url[13:]: (r.content and bytes(r.content), r.error is None) for r in remote.fetched(urls, mirror, delay_s=0).collect()}
    assert got == {"a%20b/c?ids=3": (b"yes", True), "none": (None, False), "../../etc": (None, False)}


def test_downloads_fetch_what_is_lacking(spark, tmp_path):
    epub = lambda u: [(FORMATS["epub"][0], u)]
    rows = [(1, "One", epub("u1")), (2, "Two", epub("u2")), (3, "Three", epub("u3")), (4, "Four", epub("u4")), (5, "Five", [])]
    books = spark.createDataFrame(rows, "id long, title string, formats array<struct<mime: string, url: string>>")
    folder = str(tmp_path / "books")
    empty = spark.createDataFrame([], "path string, size long")
    paths = {r.id: r.path for r in library.downloads(books, empty, folder).collect()}
    os.makedirs(folder)
    for k, data in ((1, b"have"), (2, b"")):
        with open(paths[k], "wb") as f:
            f.write(data)
    cached = spark.createDataFrame([(paths[k], os.path.getsize(paths[k])) for k in (1, 2)], "path string, size long")
    fetcher = Notes(tmp_path / "n", {"u1": b"new", "u2": b"two", "u3": b""})
    plan = library.downloads(books, cached, folder)
    got = {r.id: (r.hit, r.size, r.error) for r in remote.downloaded(plan, fetcher, folder, delay_s=0).collect()}
    assert got == {1: (True, None, None), 2: (False, 3, None), 3: (False, None, "nothing is at u3"), 4: (False, None, "could not reach u4: no such host"), 5: (False, None, "no downloadable text format")}
    assert sorted(os.listdir(folder)) == sorted(os.path.basename(paths[k]) for k in (1, 2))
    assert open(paths[1], "rb").read() == b"have" and open(paths[2], "rb").read() == b"two" and fetcher.calls() == ["u2", "u3", "u4", "u4", "u4"]


class Files(plugins.SilentEngine):
    """Leaves a file per segment."""

    max_chars = 40

    def __init__(self, folder):
        super().__init__()
        self.folder = str(folder)

    def synthesize(self, text, name):
        path = f"{self.folder}/{name}.mp3"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w") as f:
            f.write(text)
        return path, len(text), 10 * len(text)


def test_texts_to_media_and_what_is_left_behind(spark, tmp_path):
    rows = [(1, "It was so. It went on for a while. And then it ended at last.", "/o/a.mp3"), (2, "Short.", "/o/b.m4b"), (3, "None.", "/o/c")]
    texts = spark.createDataFrame(rows, "doc_id long, text string, output string")
    plan = narration.narrated_texts(texts, Files(tmp_path / "s"))
    said = plan["utterances"].collect()
    assert max(len(r.text) for r in said) <= 40 and sorted({r.doc_id for r in said}) == [1, 2, 3]
    assert {(r.doc_id, r.output, r.codec) for r in plan["outputs"].collect()} == {(1, "/o/a.mp3", "copy"), (2, "/o/b.m4b", "aac"), (3, "/o/c", "copy")}
    assert all(r.complete for r in plan["complete"].collect()) and plan["marks"].count() == 3
    outputs = spark.createDataFrame([(1, 10), (2, 0), (4, 5)], "doc_id long, size long")
    got = narration.cleaned(plan["complete"], outputs, str(tmp_path / "s"))
    assert [tuple(r) for r in got.collect()] == [(1, True, None)] and sorted(os.listdir(tmp_path / "s")) == ["2", "3"]
    again = narration.cleaned(plan["complete"], outputs, str(tmp_path / "s"))
    assert [tuple(r) for r in again.collect()] == [(1, False, None)]
    away = sink.removed(spark.createDataFrame([("../s",), ("2",), (None,)], "doc_id string"), str(tmp_path / "s"))
    assert {r.doc_id: r.removed for r in away.collect()} == {"../s": False, "2": True} and os.listdir(tmp_path / "s") == ["3"]
