"""What several parts of the library use: tables written once, names that are free, numbers over all rows, file systems."""

from __future__ import annotations

import tempfile

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; only a local session may lack one and gets one of its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        at = sc.getConf().get("spark.checkpoint.dir")
        if not at and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(at or tempfile.mkdtemp(prefix="lectern-"))
    return sc.getCheckpointDir()


def kept_once(df: DataFrame) -> DataFrame:
    """``df``, computed now and once: written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def dropped(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with places from 1 by ``order`` over all rows, whatever their number.

    Rows are dealt out by ranges of the order and sorted in each; a partition's rows are numbered on
    from the sizes of those before it. The only table that is joined has a row per partition.
    """
    at, part = free(df, "at"), free(df, "part")
    kept = kept_once(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    sizes = kept.groupBy(F.shiftright(at, 33).alias(part)).count()
    before = F.sum("count").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(part, F.coalesce(before, F.lit(0)).alias("count"))
    out = kept.join(F.broadcast(starts), F.shiftright(at, 33) == F.col(part))
    return out.select(*[kept[c] for c in df.columns], (F.col(at).bitwiseAND((1 << 33) - 1) + F.col("count") + 1).alias(name))


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without scheme is a local one."""
    if "://" in path or path.startswith("file:"):
        scheme, _, rest = path.partition(":")
        return pafs.FileSystem.from_uri(f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else path)
    return pafs.LocalFileSystem(), path
