"""The media plan that follows from segments: chapter marks, cues, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import media as M


def ordered_text(order: list[Column], text: Column, glue: str) -> Column:
    """Aggregate: texts joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], text.alias("text")))), lambda x: x["text"]), glue)


def chapter_marks(segments: DataFrame) -> DataFrame:
    """Segments (doc_id, chapter_idx, duration_ms) to doc_id, chapter_idx, start_ms, end_ms."""
    total = segments.groupBy("doc_id", "chapter_idx").agg(F.sum("duration_ms").alias("ms"))
    before = Window.partitionBy("doc_id").orderBy("chapter_idx").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("ms").over(before), F.lit(0)).cast("long")
    return total.select("doc_id", "chapter_idx", start.alias("start_ms"), "ms").select("doc_id", "chapter_idx", "start_ms", (F.col("start_ms") + F.col("ms")).alias("end_ms"))


def chapter_of(counts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chapter that utterance n of a document is in. counts: doc_id, chapter_idx, n_utterances; wanted: doc_id, n.

    Ranges and points go into one ordered row: a point takes the last range that begins at or before
    it, if that hasn't ended. Ranges without utterances hold none.
    """
    upto = Window.partitionBy("doc_id").orderBy("chapter_idx")
    until = F.sum("n_utterances").over(upto)
    ranges = counts.select("doc_id", (until - F.col("n_utterances")).cast("long").alias("n"), F.struct("chapter_idx", until.cast("long").alias("until")).alias("range")).where("range.until > n")
    points = wanted.select("doc_id", F.col("n").cast("long").alias("n"), F.lit(None).cast(ranges.schema["range"].dataType).alias("range"))
    order = Window.partitionBy("doc_id").orderBy("n", F.asc_nulls_last("range")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.last("range", ignorenulls=True).over(order)
    told = ranges.unionByName(points).withColumn("at", at).where("range is null")
    return told.select("doc_id", F.col("n").cast(wanted.schema["n"].dataType).alias("n"), F.when(F.col("n") < F.col("at.until"), F.col("at.chapter_idx")).alias("chapter_idx"))


def cues(timings: DataFrame, offset_ms: int = 0) -> DataFrame:
    """Timings (doc_id, seg_idx, cue_idx, duration_ms, start_ms, end_ms) to numbered cues that don't overlap.

    A cue starts no earlier than the one before ends and lasts a millisecond at least, so an end is
    the running maximum of what each cue would end at by itself, less its place.
    """
    segments = timings.groupBy("doc_id", "seg_idx").agg(F.max("duration_ms").alias("ms"))
    before = Window.partitionBy("doc_id").orderBy("seg_idx").rowsBetween(Window.unboundedPreceding, -1)
    cursor = segments.select("doc_id", "seg_idx", (F.coalesce(F.sum("ms").over(before), F.lit(0)) + offset_ms).alias("cursor"))
    order = Window.partitionBy("doc_id").orderBy("seg_idx", "cue_idx")
    c = timings.join(cursor, ["doc_id", "seg_idx"]).withColumn("j", F.row_number().over(order) - 1)
    start, end = F.col("cursor") + F.col("start_ms"), F.col("cursor") + F.col("end_ms")
    c = c.withColumn("s", start).withColumn("a", F.greatest(end, start + 1) - F.col("j"))
    c = c.withColumn("end", F.col("j") + F.greatest(F.lit(1), F.max("a").over(order)))
    c = c.withColumn("begin", F.greatest(F.col("s"), F.coalesce(F.lag("end").over(order), F.lit(0))))
    return c.select("doc_id", "seg_idx", "cue_idx", (F.col("j") + 1).cast("long").alias("cue_no"), F.col("begin").cast("long").alias("begin_ms"), F.col("end").cast("long").alias("finish_ms"))


def srt(cues: DataFrame) -> DataFrame:
    """Cues with text to doc_id, srt."""
    line = F.concat(F.col("cue_no").cast("string"), F.lit("\n"), M.srt_time(F.col("begin_ms")), F.lit(" --> "), M.srt_time(F.col("finish_ms")), F.lit("\n"), F.col("text"), F.lit("\n"))
    return cues.groupBy("doc_id").agg(ordered_text([F.col("cue_no")], line, "\n").alias("srt"))


def chapter_manifest(marks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chapter marks with titles, and documents (doc_id, title, author), to doc_id, manifest."""
    esc = M.escaped_meta
    part = F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.greatest(F.lit(0), F.col("start_ms")).cast("string"), F.lit("\nEND="), F.greatest(F.col("start_ms") + 1, F.col("end_ms")).cast("string"), F.lit("\ntitle="), esc(F.col("chapter_title")), F.lit("\n"))
    chapters = marks.groupBy("doc_id").agg(ordered_text([F.col("chapter_idx")], part, "").alias("body"))
    some = lambda c, a, b: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{a}="), esc(F.col(c)), F.lit(f"\n{b}="), esc(F.col(c)), F.lit("\n"))).otherwise("")
    head = F.concat(F.lit(";FFMETADATA1\n"), some("title", "title", "album"), some("author", "artist", "album_artist"))
    return docs.join(chapters, "doc_id", "left").select("doc_id", F.concat(head, F.coalesce("body", F.lit(""))).alias("manifest"))


def playlist(segments: DataFrame) -> DataFrame:
    """Segments (doc_id, idx, path) to doc_id, playlist."""
    text = ordered_text([F.col("idx")], M.playlist_line(F.col("path")), "\n")
    return segments.groupBy("doc_id").agg(F.concat(text, F.lit("\n")).alias("playlist"))


def progress(segments: DataFrame) -> DataFrame:
    """Share of characters done after each segment (doc_id, idx, n_chars)."""
    order, whole = Window.partitionBy("doc_id").orderBy("idx"), Window.partitionBy("doc_id")
    return segments.withColumn("done_chars", F.sum("n_chars").over(order)).withColumn("total_chars", F.greatest(F.lit(1), F.sum("n_chars").over(whole)))
