"""Tables with structure put in, for Spark and for DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Tables of texts smaller than this many bytes may be one row group, which only one task reads.
SMALL, TEXTS = 64 << 20, ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; a small one of texts is dealt out to all cores, for reading is cheap and the rules are not."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name in TEXTS and int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SMALL:
        return df.repartition(spark.sparkContext.defaultParallelism)
    return df


def put_in(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a piece of SQL that names tables in braces."""
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in set(re.findall(r"\{(\w+)\}", sql))})


def duck(sql: str) -> str:
    """The same piece for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
