"""What is left to synthesize, and whether everything was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(segments: DataFrame) -> DataFrame:
    return segments.where((F.col("size") > 0) & (F.col("duration_ms") > 0))


def outstanding(utterances: DataFrame, segments: DataFrame, keys: tuple[str, ...] = ("doc_id", "idx")) -> DataFrame:
    """Utterances without a usable segment. Keys may include a hash of the text, so that edits count."""
    return utterances.join(usable(segments).select(*keys), list(keys), "left_anti")


def completeness(utterances: DataFrame, segments: DataFrame) -> DataFrame:
    """Per document: n_utterances, n_segments, complete."""
    u = utterances.groupBy("doc_id").agg(F.count("*").alias("n_utterances"))
    s = usable(segments).groupBy("doc_id").agg(F.count("*").alias("n_segments"))
    out = u.join(s, "doc_id", "full").select("doc_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_utterances", "n_segments")])
    return out.withColumn("complete", F.col("n_utterances") == F.col("n_segments"))


def failures(attempts: DataFrame, shown: int = 10) -> DataFrame:
    """Per document: n_failed and the first messages (attempts: doc_id, idx, error)."""
    first = F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct("idx", "error")))), lambda x: x["error"]), 1, shown)
    return attempts.groupBy("doc_id").agg(F.count("error").alias("n_failed"), first.alias("messages"))


def releasable(complete: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id of documents whose segments are no longer needed: all are in an output (doc_id, size) that isn't empty."""
    safe = outputs.where("size > 0").select("doc_id").distinct()
    return complete.where("complete and n_utterances > 0").select("doc_id").join(safe, "doc_id", "left_semi")
