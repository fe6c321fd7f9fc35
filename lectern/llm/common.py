"""Pieces shared by the training-data operators: the shared scratch folder, written
intermediate tables, tolerant word splitting, joins that no hot key slows and distributed
connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts longer than this many bytes are split into words piece by piece.
SEGMENT_BYTES = 4 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) may have none; it gets a temporary folder.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lectern-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


#: The folders made inside each ``scratch`` that is open, the innermost last; a thread has its own.
_MADE: ContextVar[tuple[list[str], ...]] = ContextVar("made", default=())


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    if _MADE.get():
        _MADE.get()[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes the tables written inside; what shall stay is written after it, or by ``settled``."""
    made: list[str] = []
    before = _MADE.set((*_MADE.get(), made))
    try:
        yield
    finally:
        _MADE.reset(before)
        for path in made:
            drop_path(spark, path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``written``, kept by the innermost ``scratch`` and left to the one around it, if any."""
    before = _MADE.set(_MADE.get()[:-1])
    try:
        return written(df, name)
    finally:
        _MADE.reset(before)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text, in lists of bounded size.

    ``bytes.split`` splits at exactly these six bytes, none of which occurs inside a longer
    UTF-8 sequence.
    """
    if len(data) <= SEGMENT_BYTES:
        yield data.split()
        return
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + SEGMENT_BYTES)
        end = gap.start() if gap else len(data)
        yield data[at:end].split()
        at = end


#: A key is hot if it holds more than one of so many parts of the rows (so there are at most as many
#: hot keys, and they may be broadcast), and more than so many rows.
HOT_SHARE, LEAST_HOT = 4096, 256


def hot_keys(counts: DataFrame, n: int) -> DataFrame:
    """(key, pieces) of the hot ones of ``counts`` (key, count) over ``n`` rows: HOT_SHARE at most."""
    limit = max(LEAST_HOT, n // HOT_SHARE)
    key, count = counts.columns
    return counts.where(F.col(count) > limit).select(key, F.ceil(F.col(count) / limit).cast("int").alias("_pieces"))


def spread_join(many: DataFrame, one: DataFrame, key: str, n: int, how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """``many`` (about ``n`` rows) joined with ``one``, which has a row per key, on ``key``.

    Rows of a hot key are dealt out to several tasks, by a hash of all their columns (so that a task
    run again deals alike), and the one row they meet is copied to each: a key's share of the rows
    is no task's share. ``hot`` may be given if known (key, _pieces).
    """
    hot = hot_keys(many.groupBy(key).count(), n) if hot is None else hot
    pieces = F.coalesce("_pieces", F.lit(1))
    dealt = many.join(F.broadcast(hot), key, "left").withColumn("_piece", F.pmod(F.xxhash64(*many.columns), pieces).cast("int")).drop("_pieces")
    copied = one.join(F.broadcast(hot), key, "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces")
    return dealt.join(copied, [key, "_piece"], how).drop("_piece")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): one row (node, root) per node of an edge,
    root being the smallest node reachable.

    Each round points every node at its neighbour of smallest hash (or itself), shortens that path
    once and rewrites the edges onto the nodes pointed at; by hash, not by id, for chains of growing
    ids would else shrink by an end only. A round leaves a third of the nodes or so. Minima are taken
    by partial aggregation and joins deal hot nodes out, so neither a node with many edges nor a
    root with many nodes is a single task's work. Rounds are written tables: a lost executor costs
    one stage. They are removed when the result, itself a written table, is there.
    """
    with scratch(edges.sparkSession):
        return settled(_components(edges), "components")


def _components(edges: DataFrame) -> DataFrame:
    spark = edges.sparkSession
    live = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, "edges")
    first = n = both.count()
    hops: list[DataFrame] = []
    ranked = lambda c: F.struct(F.xxhash64(c), F.col(c).alias("node"))
    while n:
        near = both.groupBy("a").agg(F.min(ranked("b")).alias("r"), F.count("*").alias("n"))
        low = written(near.select("a", F.least(ranked("a"), "r")["node"].alias("m"), "n"), "low")
        nxt = low.select(F.col("a").alias("m"), F.col("m").alias("mm"))
        hop = written(spread_join(low.select("a", "m"), nxt, "m", n).select("a", F.col("mm").alias("g")), "hop")
        hops.append(hop)
        by_b = hop.select(F.col("a").alias("b"), F.col("g").alias("gb"))
        # every edge is there both ways, so a node is hot on either side or on neither
        hot = hot_keys(low.select("a", "n"), n)
        half = spread_join(both, hop, "a", n, hot=hot).drop("a")
        moved = spread_join(half, by_b, "b", n, hot=hot.withColumnRenamed("a", "b")).where("g <> gb").select(F.col("g").alias("a"), F.col("gb").alias("b"))
        both = written(moved.distinct(), "edges")
        n = both.count()
    if not hops:
        return spark.createDataFrame([], "node long, root long")
    out = hops[0].select(F.col("a").alias("node"), F.col("g").alias("root"))
    for hop in hops[1:]:
        step = hop.select(F.col("a").alias("root"), F.col("g"))
        out = written(spread_join(out, step, "root", first, "left").select("node", F.coalesce("g", "root").alias("root")), "roots")
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    return spread_join(out, least, "root", first).select("node", F.col("least").alias("root"))


#: Bits of a map per id, most bits of a map (16 MB), and hashes per id.
BITS_PER_ID, MOST_BITS, HASHES = 16, 1 << 27, 3


def possible(ids: DataFrame, value: Column) -> Column:
    """False where ``value`` (long) surely isn't among ``ids`` (one long column); never false where it is.

    A Bloom filter of bounded size: beyond MOST_BITS it lets more values pass, it misses none.
    """
    spark, (name,) = ids.sparkSession, ids.columns
    bits = min(MOST_BITS, 1 << max(10, int(ids.count() * BITS_PER_ID).bit_length()))
    places = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in range(HASHES)]
    at = ids.select(F.explode(F.array(*places(F.col(name)))).alias("p"))
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("b")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["w"].to_numpy()] = words["b"].to_numpy().view(np.uint64)
    shared = spark.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def passes(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = np.ones(len(a), bool)
        for p in (a, b, c):
            p = p.to_numpy(np.int64)
            out &= (shared.value[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pd.Series(out)

    # xxhash64 passes over nulls, so they are told apart here
    return value.isNotNull() & passes(*places(value))
