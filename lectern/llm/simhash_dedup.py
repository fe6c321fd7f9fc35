"""SimHash near-deduplication with vantage-point trees.

Every text gets a 64-bit SimHash fingerprint; fingerprints at Hamming distance ``RADIUS`` or less
are linked, and texts reachable over links form one group.

The search is exact. Two fingerprints that differ in at most four bits differ in at most one bit
inside at least one of three disjoint bit bands (4 // 3 = 1). The Hamming distance restricted to a
band is a metric of its own, so a vantage-point tree is kept per band: a node splits at the median
distance ``mu`` from its vantage point, and by the triangle inequality a linked pair lands on
different sides only if the nearer point is within one bit of ``mu``; such points are sent to both
shards. A small radius keeps that overlap narrow (about a sixth of the points per level; over the
whole 64 bits and radius four it would be a third, and the trees would hardly prune). Leaves
compare whole fingerprints. A leaf that stays large (a dense group) is cut into blocks and every
two blocks meet in a task of their own.

Leaves emit a spanning star of each group found, never all its pairs; groups are joined by
distributed connected components over the distinct fingerprints.

Behaviour at the edges: a null text counts as empty; a text without words has fingerprint zero and
is linked like any other; equal fingerprints (copies, repeated rows) share a component; rows
without ``doc_id`` keep their fingerprint and take the component of their group, which is null if
nobody in the group has an id; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import components, possible, scratch, settled, spread_join, unused, words_of, written

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Bit bands; RADIUS // len(BANDS) is the radius inside a band.
BANDS = ((0, 22), (22, 21), (43, 21))
BAND_RADIUS = RADIUS // len(BANDS)
#: Fingerprints a leaf should hold, and the most that one task compares with each other at once.
LEAF, BLOCK = 1024, 4096
#: Fingerprints from which vantage points and medians of the upper levels are taken.
TREE_SAMPLE, STORED_LEVELS = 8192, 10


def fingerprint(text: bytes | None) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    ones, total, tail, low = np.zeros(64, np.int64), 0, [], (text or b"").lower()
    for words in words_of(low):
        words = tail + words
        if len(words) < SHINGLE:
            tail = words
            continue
        ones += _votes(words)
        total += len(words) - SHINGLE + 1
        tail = words[1 - SHINGLE :]
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(tail), SEED) if tail else 0
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def _votes(words: list[bytes]) -> np.ndarray:
    """How often each bit is set in the hashes of the shingles of ``words``."""
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[: len(words) - SHINGLE + 1].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return ones


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        marks = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64)), pa.array(np.arange(row, row + len(marks)))], ["doc_id", "fp", "row"])
        row += len(marks)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, row) of every row of ``docs``; row tells repeated rows apart."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, row long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64: vantage points of the levels below the sampled ones."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BandTree:
    """The vantage-point tree of one band. Nodes are numbered as in a heap, the root being 1."""

    def __init__(self, band: int, depth: int, sample: np.ndarray):
        start, width = BANDS[band]
        self.band, self.depth = band, depth
        self.mask, self.middle = np.uint64(((1 << width) - 1) << start), width // 2
        stored = min(depth, STORED_LEVELS)
        self.points = _mixed(np.arange(1 << stored) + (band << 48))
        self.medians = np.full(1 << stored, self.middle, np.int64)
        node = np.ones(len(sample), np.int64)
        for _ in range(stored):
            order = np.argsort(node, kind="stable")
            heads, firsts, sizes = np.unique(node[order], return_index=True, return_counts=True)
            for head, first, size in zip(heads, firsts, sizes):
                if size >= 16:
                    own = sample[order[first : first + size]]
                    self.points[head] = own[size // 2]
                    self.medians[head] = int(np.median(self._distance(own, self.points[head])))
            node = 2 * node + (self._distance(sample, self.points[node]) > self.medians[node])

    def _distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count((a ^ b) & self.mask).astype(np.int64)

    def shards(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``fps`` and the leaves that each is sent to."""
        at, node = np.arange(len(fps)), np.ones(len(fps), np.int64)
        for _ in range(self.depth):
            inside = node < len(self.points)
            kept = np.where(inside, node, 0)
            point = np.where(inside, self.points[kept], _mixed(node + (self.band << 48)))
            median = np.where(inside, self.medians[kept], self.middle)
            d = self._distance(fps[at], point)
            border = (d <= median) & (d > median - BAND_RADIUS)
            at, node = np.concatenate([at, at[border]]), np.concatenate([2 * node + (d > median), 2 * node[border] + 1])
        return at, node


def _routed(trees: list[BandTree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for tree in trees:
                at, node = tree.shards(fps)
                leaf = (node << 2) | tree.band
                yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(fps[at].view(np.int64))], ["leaf", "fp"])

    return run


def linked_stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of linked fingerprints, edges from one member to the others."""
    label = np.arange(len(fps))
    for at in range(0, len(fps), 256):
        near = np.bitwise_count(fps[at : at + 256, None] ^ fps[None, at:]) <= RADIUS
        for k in np.flatnonzero(near.sum(1) > 1):
            hit = label[at + np.flatnonzero(near[k])]
            low = hit.min()
            if (hit != low).any():
                label[np.isin(label, hit)] = low
    far = np.flatnonzero(label != np.arange(len(fps)))
    return fps[label[far]], fps[far]


def _leaf_stars(group: pd.DataFrame) -> pd.DataFrame:
    fps = np.unique(group["fp"].to_numpy()).view(np.uint64)
    a, b = linked_stars(fps)
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def depth_for(n: int) -> int:
    """Levels after which leaves hold about LEAF of ``n`` fingerprints, a sixth overlapping per level."""
    return max(0, math.ceil(math.log(max(n, 1) / LEAF) / math.log(2 / 1.17)))


def links(fps: DataFrame, n: int) -> DataFrame:
    """Edges (a, b) that connect all linked ones of ``n`` distinct fingerprints (column fp)."""
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(TREE_SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    trees = [BandTree(band, depth_for(n), sample) for band in range(len(BANDS))]
    routed = written(fps.select("fp").mapInArrow(_routed(trees), "leaf long, fp long"), "shards")
    large = routed.groupBy("leaf").count().where(F.col("count") > BLOCK)
    large = large.select("leaf", F.ceil(F.col("count") / (BLOCK // 2)).cast("int").alias("blocks"))
    rows = spread_join(routed, large, "leaf", routed.count(), "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))).cast("int"))
    others = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = rows.withColumn("other", F.explode(others))
    met = met.select("leaf", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    # a block meets itself together with any other, unless it is alone
    met = met.where("lo < hi or (lo = 0 and hi = 0)")
    return met.groupBy("leaf", "lo", "hi").applyInPandas(_leaf_stars, "a long, b long")


def _grouped(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id and root, which tells groups apart; a written table."""
    with scratch(docs.sparkSession):
        marks = written(fingerprints(docs), "fingerprints")
        classes = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
        n = classes.count()
        found = components(written(links(classes.select("fp"), n), "links"))
        rooted = written(
            classes.join(found, F.col("node") == F.col("fp"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "first"), "rooted"
        )
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        member = spread_join(rooted, least, "root", n).select("fp", "component_id", "root")
        out = spread_join(marks, written(member, "member"), "fp", marks.count(), "left")
        return settled(out.select("doc_id", "fp", "component_id", "root"), "grouped")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id (smallest doc_id reachable)."""
    return _grouped(docs).select("doc_id", "fp", "component_id")


def _marked(text: Column) -> Column:
    """The fingerprint of each text, as ``fingerprints`` gives it."""

    @F.pandas_udf("long")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, texts), np.uint64, len(texts)).view(np.int64))

    return marks(text.cast("binary"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id.

    A doc_id that several rows have is decided row by row: of each group whose smallest doc_id it is,
    one row stays, that of the smallest fingerprint (of equal ones, of the least text); so a text that
    is nobody's copy stays, whatever other texts its id has. Rows without doc_id are copies of any
    row of their group that has one; of a group where none has, one row stays, chosen in the same way.
    Other columns, of any name, are carried along. Whole rows are shuffled only if they have no
    doc_id, or if a bit map of the ids to look at (rejected or repeated ones) doesn't clear them.
    """
    key, low, mark = (unused(docs, c) for c in ("id", "low", "mark"))
    grouped = _grouped(docs)
    found = grouped.where("doc_id is not null").select(F.col("doc_id").cast("long").alias(key), "fp", "component_id", "root")
    again = written(found.groupBy(key).count().where("count > 1").select(key), "repeated")
    apart = written(found.where(F.col(key) != F.col("component_id")).select(key).unionByName(again).distinct(), "apart")
    is_id = docs["doc_id"].cast("long")
    suspect = possible(apart, is_id)
    kept = docs.where(is_id.isNotNull() & ~suspect).unionByName(docs.where(suspect).join(apart, is_id == F.col(key), "left_anti"))
    least = lambda rows, *by: rows.groupBy(*by).agg(F.min_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias(low)).select(f"{low}.*")
    if not again.isEmpty():
        # a row of each group, and each text of it once: equal fingerprints of an id are one text as far as copies go
        first = found.where(F.col(key) == F.col("component_id")).join(again, key, "left_semi").groupBy("root", key).agg(F.min("fp").alias(low)).drop("root")
        rows = docs.where(possible(again, is_id)).withColumn(mark, _marked(docs["text"]))
        kept = kept.unionByName(least(rows.join(first, (is_id == F.col(key)) & (F.col(mark) == F.col(low)), "left_semi"), "doc_id", mark))
    nameless = grouped.where("doc_id is null and component_id is null").groupBy("root").agg(F.min("fp").alias(key)).drop("root")
    if not nameless.isEmpty():
        # copies of one text are brought down to a row in the tasks that read them
        rows = least(docs.where(is_id.isNull()).withColumn(mark, _marked(docs["text"])), mark)
        rows = rows.withColumn(mark, _marked(F.col("text")))
        kept = kept.unionByName(rows.join(written(nameless, "nameless"), F.col(mark) == F.col(key), "left_semi").drop(mark))
    return kept


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
