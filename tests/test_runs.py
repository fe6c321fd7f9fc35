"""Jobs as streams, the ledger of what was spoken, batch search, counters and table functions, on small inputs."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from lectern import plugins
from lectern.functions.catalog import FORMATS
from lectern.operators import batch_search, catalog, counters
from lectern.plans import ledger
from lectern.streaming import jobs

# -- jobs --------------------------------------------------------------------------------------

START = datetime.datetime(2024, 5, 1, tzinfo=datetime.timezone.utc)


def test_events_in_any_order_decide_as_a_table_of_them_does(spark, tmp_path):
    rng = random.Random(3)
    status = ["queued", "in_progress", "completed", "failed", "cancel", "strange", "in_progress", "queued"]
    events = [(j, START + datetime.timedelta(milliseconds=1000 * j + rng.randint(0, 90_000)), rng.choice(status)) for j in range(60) for _ in range(rng.randint(1, 6))]
    events.append((999, START + datetime.timedelta(hours=1), "queued"))  # what moves the watermark past all others
    rng.shuffle(events)
    # that one comes last; the others in any order, but within the delay
    events.sort(key=lambda e: e[0] == 999)
    schema = "job_id long, at timestamp, status string"
    for k in range(4):
        own = [e for n, e in enumerate(events) if (n * 4) // len(events) == k]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {(r.job_id, r.outcome, r.decided_ms) for r in jobs.outcomes(spark.createDataFrame(events, schema), 60_000, 300_000).collect()}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = jobs.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), 60_000, 300_000)
    assert {tuple(r) for r in got.collect()} == want and got.count() == 60
    assert {o for _, o, _ in want} >= {"done", "failed", "stopped", "timeout", "unexpected"}
    by_job = {}
    for j, at, s in events:
        by_job.setdefault(j, []).append((int(at.timestamp() * 1000), s))
    for j, outcome, ms in want:
        deadline = min(t for t, _ in by_job[j]) + 60_000
        ends = sorted((t, s) for t, s in by_job[j] if s not in ("queued", "in_progress") and t <= deadline)
        assert ms == (ends[0][0] if ends else deadline) and (outcome == "timeout") == (not ends)


def test_jobs_are_followed_in_groups_and_told_once(spark, tmp_path):
    schema, at = "job_id long, at timestamp, status string", lambda ms: START + datetime.timedelta(milliseconds=ms)
    # the watermark of the first run is 500,000: job 1 ends on it, job 2 before it, the one without number ends, an event has no time
    first = [(1, at(490_000), "queued"), (1, at(500_000), "completed"), (2, at(499_999), "failed"), (None, at(100), "completed"), (3, None, "cancel"), (3, at(7), "queued")]
    first += [(k, at(k), "queued") for k in range(100, 3100)] + [(9, at(800_000), "queued")]
    # then job 2 is heard of again, and everything else passes
    second = [(2, at(800_001), "completed"), (3, at(800_002), "cancel"), (10, at(2_000_000), "queued")]
    for n, (new, seen) in enumerate([(first, first), (second, first + second)]):
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        got = jobs.follow(stream, str(tmp_path / "out"), str(tmp_path / "state"), 60_000, 300_000)
        found = [tuple(r) for r in got.collect()]
        want = [tuple(r) for r in jobs.outcomes(spark.createDataFrame(seen, schema), 60_000, 300_000).collect()]
        assert sorted(found, key=str) == sorted(want, key=str) and len(found) == (3003, 3005)[n]
        assert {j for j, o, _ in found if o != "timeout"} == ({2, None}, {1, 2, None})[n]
    keys = spark.read.format("statestore").option("stateVarName", "told").load(str(tmp_path / "state"))
    assert 0 < keys.count() <= jobs.GROUPS + 1 < len(found)


# -- the ledger --------------------------------------------------------------------------------


class Counting:
    """Notes every call in a file; ends its process at the n-th if told to."""

    name, concurrency = "counting", 2

    def __init__(self, notes, dies_at=0):
        self.notes, self.dies_at = str(notes), dies_at

    def synthesize(self, text, name):
        with open(self.notes, "a") as f:
            f.write(text.replace("\n", " ") + "\n")
        if self.dies_at and len(open(self.notes).readlines()) == self.dies_at:
            os._exit(1)
        if "bad" in text:
            raise ValueError("no voice for it")
        return f"{name}.wav", len(text), 10 * len(text)

    def calls(self):
        return open(self.notes).read().split("\n")[:-1] if os.path.exists(self.notes) else []


def spoken(spark, texts, engine, folder, **more):
    rows = spark.createDataFrame([(d, k, t) for d, own in enumerate(texts) for k, t in enumerate(own)], "doc_id long, idx int, text string")
    return {(r.doc_id, r.idx): r for r in ledger.speak(rows, engine, str(folder), backoff_s=0, **more).collect()}


def test_changed_texts_alone_are_spoken_again(spark, tmp_path):
    texts = [["one", "two", "three"], ["two", "four", "bad one"], []]
    engine = Counting(tmp_path / "a")
    got = spoken(spark, texts, engine, tmp_path / "ledger", batch=2)
    assert sorted(engine.calls()) == ["bad one"] * 3 + ["four", "one", "three", "two"]  # a text once, a failure thrice
    assert len(got) == 6 and got[0, 1].path == got[1, 0].path and got[1, 2].error == "no voice for it" and got[0, 2].duration_ms == 50
    again = Counting(tmp_path / "b")
    texts[0][1] = "changed"
    got = spoken(spark, texts, again, tmp_path / "ledger", batch=2)
    assert sorted(again.calls()) == ["bad one"] * 3 + ["changed"] and len(got) == 6 and got[0, 1].size == 7
    assert spoken(spark, [["one"]], Counting(tmp_path / "c"), tmp_path / "ledger", voice="other")[0, 0].size == 3 and Counting(tmp_path / "c").calls() == ["one"]
    assert spoken(spark, [[]], Counting(tmp_path / "d"), tmp_path / "ledger") == {}


def test_a_lost_task_repeats_a_batch_at_most(spark, tmp_path):
    texts = [[f"text {k}" for k in range(40)]]
    with pytest.raises(Exception):
        spoken(spark, texts, Counting(tmp_path / "n", dies_at=23), tmp_path / "ledger", batch=4)
    first = len(Counting(tmp_path / "n").calls())
    got = spoken(spark, texts, Counting(tmp_path / "n"), tmp_path / "ledger", batch=4)
    calls = Counting(tmp_path / "n").calls()
    assert len(got) == 40 and all(r.error is None for r in got.values()) and 23 <= first
    assert sorted(set(calls)) == sorted(texts[0]) and len(calls) - 40 <= 4 * Counting.concurrency


def test_engines_tell_what_they_can(spark):
    class Off(plugins.SilentEngine):
        name = "off"

        def is_available(self):
            return False, "no key"

    class Broken(plugins.SilentEngine):
        def voices(self):
            raise OSError

    engine = plugins.SilentEngine()
    assert [r.engine for r in plugins.voices_of(spark, [engine, Off(), Broken()]).collect()] == ["silent"]
    assert plugins.limit_of(engine, 8000) == 4000 and plugins.limit_of(object(), 8000) == 8000


# -- batch search ------------------------------------------------------------------------------


def books(spark, titles):
    url = lambda k: [(FORMATS["epub"][0], "e")] if k % 3 == 0 else [(FORMATS["text"][2], "t")] if k % 3 == 1 or k < 30 else []
    rows = [(k, t, [], k * 7 % 5, url(k), k) for k, t in enumerate(titles)]
    return spark.createDataFrame(rows, "id long, title string, authors array<string>, download_count long, formats array<struct<mime: string, url: string>>, ord long").repartition(3)


@pytest.mark.parametrize("piece", [2, 1024])
def test_batch_search_equals_one_search_after_the_other(spark, monkeypatch, piece):
    monkeypatch.setattr(batch_search, "FIRST_PIECE", piece)
    rng = random.Random(piece)
    words = ["red", "blue", "sea", "war", "of", "The", "x"]
    titles = [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(80)] + [None]
    b = books(spark, titles)
    asked = ["red sea", "SEA  red", "of the", "", None, "red blue sea war", "nowhere", "red nowhere", "x"]
    queries = spark.createDataFrame([(k, t, "p") for k, t in enumerate(asked)], "q long, title string, key string")
    got = {}
    for r in batch_search.searched(batch_search.built(b), queries, 4).collect():
        got.setdefault(r.q, []).append((r["rank"], r.book.id, r.relevance))
    for k, t in enumerate(asked):
        want = [(r["rank"], r.id) for r in catalog.search(b, t or "", limit=4).collect()]
        assert [x[:2] for x in sorted(got[k])] == sorted(want), t
    assert batch_search.searched(batch_search.built(b), queries.limit(0), 4).count() == 0


# -- counters and table functions --------------------------------------------------------------


def test_counts_are_taken_on_the_way(spark):
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("z",)], "v string")
    rows, seen = counters.by_value(df, F.col("v"), ("a", "b", "c"), "own")
    assert rows.count() == 5 and seen.get == {"a": 2, "b": 1, "c": 0, "other": 2}


def test_an_extractor_as_a_table_function(spark):
    class Words:
        """Words of a text, from the n-th on; with or without their sizes."""

        def returns(self, arguments):
            out = StructType().add("word", StringType())
            return out.add("size", IntegerType()) if len(arguments) == 3 else out

        def __call__(self, text, first, sized=False):
            if text == "bad":
                raise ValueError("no words")
            yield from [(w, len(w)) if sized else (w,) for w in text.split()[first:]]

    plugins.register_extractor(spark, "own_words", Words())
    spark.createDataFrame([(1, "a bb ccc"), (2, "bad"), (3, "")], "id int, text string").createOrReplaceTempView("own_texts")
    plain = spark.sql("SELECT id, place, word, error FROM own_texts, LATERAL own_words(text, 1)").collect()
    assert sorted(tuple(r) for r in plain if r.id == 1) == [(1, 0, "bb", None), (1, 1, "ccc", None)]
    assert [tuple(r) for r in plain if r.id == 2] == [(2, None, None, "ValueError: no words")] and len(plain) == 3
    sized = spark.sql("SELECT sum(size) AS n FROM own_texts, LATERAL own_words(text, 0, true) WHERE error IS NULL").first()
    assert sized.n == 6


# -- plans -------------------------------------------------------------------------------------


def test_a_strict_run_takes_no_exception(spark, tmp_path):
    from lectern.plans.narration import of_folder

    (tmp_path / "a.txt").write_text("It was so.")
    assert of_folder(spark, str(tmp_path), strict=True).count() == 1
    (tmp_path / "b.md").write_bytes(b"# Caf\xe9")
    assert of_folder(spark, str(tmp_path)).count() == 1
    with pytest.raises(Exception, match="nothing to speak in 1 files, such as .*b.md: not UTF-8 text"):
        of_folder(spark, str(tmp_path), strict=True).collect()


def test_sparse_documents_are_read_again_as_markdown(spark):
    rows = [(1, 0, "paragraph", "x" * 300, 0, 1), (2, 0, "paragraph", "few", 0, 1), (3, 0, "paragraph", "few", 0, 1), (4, 0, "paragraph", "few", 0, 1)]
    blocks = spark.createDataFrame(rows, "doc_id long, block_idx int, kind string, text string, level int, page int")
    docs = spark.createDataFrame([(k, bytes([k])) for k in range(1, 6)], "doc_id long, content binary")

    def converter(content):
        if bytes(content) == b"\x03":
            raise OSError
        return "# Title\n\nSome *text*." if bytes(content) == b"\x02" else ""

    got = plugins.escalated(blocks, docs, converter).orderBy("doc_id", "block_idx").collect()
    assert [(r.doc_id, r.kind, r.text[:9]) for r in got] == [(1, "paragraph", "xxxxxxxxx"), (2, "heading", "Title"), (2, "paragraph", "Some text"), (3, "paragraph", "few"), (4, "paragraph", "few")]


def test_texts_without_files_and_media_from_a_ledger(spark, tmp_path):
    from lectern.plans.narration import media_plan, of_texts

    texts = spark.createDataFrame([(1, "CHAPTER ONE\n\nIt was.\n\nCHAPTER TWO\n\nIt went on.", "Own"), (2, "Loose words.", None)], "doc_id long, text string, title string")
    said = of_texts(texts, minimum=0)
    assert sorted((r.doc_id, r.chapter_title) for r in said.collect()) == [(1, "CHAPTER ONE"), (1, "CHAPTER TWO"), (2, "Chapter 1")]
    engine = Counting(tmp_path / "n")
    segments, marks = media_plan(said, engine, book=str(tmp_path / "ledger"))
    assert segments.count() == 3 and marks.count() == 3 and len(engine.calls()) == 3
    media_plan(said, engine, book=str(tmp_path / "ledger"))
    assert len(engine.calls()) == 3


def test_a_catalogue_from_json_lines(spark, tmp_path):
    from lectern.sources.files import catalogue

    lines = ['{"id": 7, "title": "  Odd ", "authors": [{"name": "Poe, Edgar Allan"}, {"name": null}], "languages": ["en"], "download_count": 3, "copyright": false, "formats": {"text/plain": "u"}}', '{"id": 8}', "no json"]
    (tmp_path / "c.jsonl").write_text("\n".join(lines))
    got = {r.id: r for r in catalogue(spark, str(tmp_path / "c.jsonl")).collect()}
    assert (got[7].title, got[7].authors, got[7].download_count, got[7].copyrighted, [tuple(f) for f in got[7].formats]) == ("Odd", ["Edgar Allan Poe", ""], 3, False, [("text/plain", "u")])
    assert (got[8].title, got[8].authors, got[8].languages, got[8].download_count, got[8].copyrighted, got[8].formats) == ("", [], [], 0, None, [])
