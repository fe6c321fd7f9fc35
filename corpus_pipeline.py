"""A corpus pipeline over ``documents``: quality, near copies, benchmark leaks, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a
DataFrame; all but the last return the columns of ``documents``, extra ones of any name included.
``run`` writes each stage's result to the shared folder and reads it again, so a lost executor costs
no more than one stage; what a stage wrote on its way is removed once its result is there.

Behaviour at the edges, in all stages: a null text counts as empty, rows without doc_id are worked on
like any other, repeated rows are decided one by one unless copies are
what is decided, an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import decontam, pattern_packing, quality, secret_scan, simhash_dedup
from lectern.llm.common import scratch, settled


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Empty texts get the score of an empty text; without labels, or with those of one class only, all stay or none."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id; rows without doc_id are decided like others, and stay only where their group has no row with one. Texts without words are copies of each other; of rows of one doc_id, each text is decided by itself."""
    return simhash_dedup.one_of_each(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Items without words are in no document; without items all documents stay."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a placeholder, ``n_chars`` following. Null texts stay null; spans that overlap become one placeholder."""
    return secret_scan.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in training sequences. An empty text is one piece, the end id; null ids stay null."""
    return pattern_packing.packed(docs, pattern_packing.public_tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("simhash near-dedup", keep_one_copy),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack),
]

#: Trained and iterative stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    *filters, (_, last) = STAGES
    for k, (_, stage) in enumerate(filters):
        with scratch(spark):
            docs = settled(stage(spark, docs, sf_dir), f"stage{k}")
    return last(spark, docs, sf_dir)
