"""From files to a script and the media plan that follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import media as M
from lectern.functions import text as T
from lectern.functions.catalog import MAX_CHARS
from lectern.operators import artifacts, library, media, resume, script
from lectern.operators import blocks as B
from lectern.plans import ledger
from lectern.plugins import Engine, candidates, limit_of, require, synthesized
from lectern.shared import free, kept_once
from lectern.sources import epub, files
from lectern.sources.sink import removed


def document_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks as they are to be spoken: page artifacts marked, speech rules applied."""
    return script.with_rules(artifacts.marked(blocks))


def script_of(blocks: DataFrame, titles: DataFrame | None = None, engine: str = "edge", chunk: int = script.CHUNK, level: int = script.CHAPTER_LEVEL, minimum: int = script.MIN_CHAPTER) -> DataFrame:
    """Utterances that fit the engine."""
    return script.utterances(document_blocks(blocks), titles, min(chunk, MAX_CHARS[engine]), level, minimum)


def of_folder(spark: SparkSession, folder: str, strict: bool = False, **options) -> DataFrame:
    """Utterances of all files of a folder; a document's title is its first level-1 heading or file stem.

    A strict run fails where a file gives nothing to speak; others leave such files to ``rejected``.
    """
    docs = files.documents(spark, folder)
    blocks = files.blocks(docs, epub.chapters_of_folder(spark, folder, docs.where("reader = 'epub'")))
    blocks = files.required(docs, blocks) if strict else blocks
    return script_of(blocks, titles_of(docs, blocks), **options)


def of_texts(texts: DataFrame, **options) -> DataFrame:
    """Utterances of plain texts (doc_id, text, and title if there are any) that come from no file."""
    titles = texts.select("doc_id", "title") if "title" in texts.columns else None
    return script_of(B.plain_blocks(texts.select("doc_id", "text")), titles, **options)


def titles_of(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """doc_id, title: a document's first level-1 heading, or else its file's stem."""
    stems = docs.select("doc_id", files.stem(F.col("path")).alias("stem"))
    return stems.join(B.title_of(blocks), "doc_id", "left").select("doc_id", F.coalesce("title", "stem").alias("title"))


def rewritten(utterances: DataFrame, candidate: Column, failed: Column | None = None) -> DataFrame:
    """Utterances with a model's rewrite where the guard accepts it, and the reason."""
    text, reason = T.guard(F.col("text"), candidate, failed if failed is not None else F.lit(False))
    return utterances.withColumns({"reason": reason, "text": text})


def media_plan(utterances: DataFrame, engine: Engine, done: DataFrame | None = None, book: str | None = None, voice: str = "") -> tuple[DataFrame, DataFrame]:
    """(segments, chapter marks): synthesizes what has no usable segment yet, each text once, however often either is read.

    With a ledger's folder (``book``) only texts that no earlier run spoke are spoken, by content.
    """
    require(engine.name, engine)
    order = Window.partitionBy("doc_id").orderBy("chapter_idx", "utt_idx")
    rows = utterances.withColumn("idx", (F.row_number().over(order) - 1).cast("int"))
    if book is not None:
        segments = kept_once(ledger.speak(rows, engine, book, voice))
        return segments, media.chapter_marks(segments.join(rows.select("doc_id", "idx", "chapter_idx"), ["doc_id", "idx"]))
    todo = rows if done is None else resume.outstanding(rows, done)
    new = kept_once(synthesized(todo, engine))
    segments = new if done is None else new.unionByName(resume.usable(done).select(*new.columns))
    marks = media.chapter_marks(segments.join(rows.select("doc_id", "idx", "chapter_idx"), ["doc_id", "idx"]))
    return segments, marks


def narrated(spark: SparkSession, folder: str, engine: Engine, model=None, container: str = "mp3", speed: float | None = None, book: str | None = None, **options) -> dict[str, DataFrame]:
    """From a folder to all that assembling needs: utterances, segments, marks, complete, files, outputs.

    With a rewriting model, which must be available, utterances are rewritten where the guard accepts it.
    """
    if model is not None:
        require("the rewriting model", model)
    docs = files.documents(spark, folder)
    utterances = of_folder(spark, folder, **options)
    if model is not None:
        c = free(utterances, "c")
        told = utterances.withColumn(c, candidates(F.col("text"), model))
        utterances = kept_once(rewritten(told, F.col(f"{c}.candidate"), F.col(f"{c}.failed")).drop(c, "reason"))
    found = _spoken(utterances, docs.select("doc_id", library.output_path(F.col("path"), container).alias("output")), engine, container, speed, book, "")
    return found | {"rejected": files.rejected(docs, files.blocks(docs))}


def narrated_texts(texts: DataFrame, engine: Engine, speed: float | None = None, book: str | None = None, voice: str = "", chunk: int = script.CHUNK, **options) -> dict[str, DataFrame]:
    """The same for plain texts (doc_id, text, output, and title if there are any), whose container their output's suffix tells (mp3 if it has none)."""
    suffix = F.ltrim(files.suffix(F.col("output")), F.lit("."))
    utterances = of_texts(texts, engine=engine.name if engine.name in MAX_CHARS else "edge", chunk=limit_of(engine, chunk), **options)
    return _spoken(utterances, texts.select("doc_id", "output"), engine, F.when(suffix == "", "mp3").otherwise(suffix), speed, book, voice)


def _spoken(utterances: DataFrame, outputs: DataFrame, engine: Engine, container: str | Column, speed: float | None, book: str | None, voice: str) -> dict[str, DataFrame]:
    """What assembling the outputs (doc_id, output) needs."""
    segments, marks = media_plan(utterances, engine, book=book, voice=voice)
    indexed = utterances.withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("chapter_idx", "utt_idx")) - 1).cast("int"))
    by_doc = segments.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)))).alias("suffixes"))
    kind = F.lit(container) if isinstance(container, str) else container
    told = outputs.join(by_doc, "doc_id").select("doc_id", "output", M.codec(kind, F.col("suffixes"), F.lit(speed).cast("double")).alias("codec"))
    return {"utterances": utterances, "segments": segments, "marks": marks, "complete": resume.completeness(indexed, segments), "outputs": told}


def cleaned(complete: DataFrame, outputs: DataFrame, folder: str) -> DataFrame:
    """Removes the segments' folders of documents that are safely in their outputs (doc_id, size): doc_id, removed, error."""
    return removed(resume.releasable(complete, outputs), folder)


def preview(spark: SparkSession, voices: list[str], engine: Engine, text: str, folder: str) -> DataFrame:
    """A short text spoken by each of some voices: voice, path, duration_ms, error; a path is the same for the same voice always."""
    require(engine.name, engine)
    rows = spark.createDataFrame([(v,) for v in voices], "voice string")
    rows = rows.select("voice", F.xxhash64("voice").alias("doc_id"), F.lit(0).alias("idx"), F.lit(text).alias("text"), library.preview_path(F.lit(engine.name), F.col("voice"), folder).alias("path"))
    spoken = kept_once(synthesized(rows, engine)).drop("path", "idx", "size")
    return rows.select("voice", "doc_id", "path").join(spoken, "doc_id").drop("doc_id")
