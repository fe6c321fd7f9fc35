r"""Benchmark decontamination: size-partitioned MinHash containment search.

A benchmark item is found in a document if at least ``THRESHOLD`` of the item's distinct five-word
shingles occur in the document. Words are the runs of letters and digits of the lower-cased text;
an item of fewer than five words is one shingle, its whole word sequence.

Search is by MinHash, over items partitioned by size. A partition holds the items of ``n`` shingles
with ``low <= n < 2 * low`` and has one sketch size ``s`` (what its largest item may lack at the
threshold, times ``SURPLUS``, and one more): an item's sketch is its ``s`` smallest shingle hashes.
The partition's greatest sketched hash bounds the hashes that matter; those of a document that are
no greater are the document's sketch for that partition, whose length follows the document's, so
that a long one doesn't drown a short item as it would in a signature of fixed length. An item is a
candidate if its sketch and the document's share as many hashes as an item at the threshold must:
of ``n`` shingles at most ``n - needed(n)`` are lacking, so at least ``s - (n - needed(n))`` sketched
ones are there. The estimate thus errs to one side only and nothing is missed; candidates are
verified by exact shingle containment on the words themselves.

Items are handled in blocks of bounded size, each shipped to the tasks and matched against all
documents; words outside a block's vocabulary are skipped by one dictionary lookup.

Behaviour at the edges: null texts count as empty; an item without words is found nowhere; items
or documents without id are searched and reported with null ids; repeated rows of either side are
each reported; a document and an item may be equal; other columns are ignored; empty tables on
either side give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, THRESHOLD = 5, 0.8
#: Sketched hashes for each shingle that an item may lack: more make candidates fewer and sketches longer.
SURPLUS = 2
#: Code points of item texts in a block, and of a document's text that are split into words at once.
BLOCK_CHARS, SEGMENT = 8 << 20, 4 << 20
PAIRS = "doc_id long, item_id long, n_shingles long, n_found long, containment double"

_WORD = re.compile(r"[^\W_]+")
_EDGE = re.compile(r"[\W_]")
_STEP = 0x9E3779B97F4A7C15


def words(text: str | None) -> Iterator[list[str]]:
    text, at = text or "", 0
    while len(text) - at > SEGMENT:
        edge = _EDGE.search(text, at + SEGMENT)
        end = edge.start() if edge else len(text)
        yield _WORD.findall(text[at:end].lower())
        at = end
    yield _WORD.findall(text[at:].lower())


def needed(n: int) -> int:
    """How many of an item's ``n`` shingles a document must hold."""
    return next(k for k in range(math.ceil(THRESHOLD * n) - 1, n + 1) if k / n >= THRESHOLD)


class Partition:
    """Items of similar size (places among a block's items) and the index of their sketches."""

    def __init__(self, hashes: dict[int, np.ndarray], shingles: list[set]):
        largest = max(len(shingles[k]) for k in hashes)
        self.sketch = SURPLUS * (largest - needed(largest)) + 1
        keys, owners, self.least = [], [], {}
        for k, own in hashes.items():
            lacking, mine = len(shingles[k]) - needed(len(shingles[k])), np.sort(own)[: self.sketch]
            keys.append(mine)
            owners.append(np.full(len(mine), k))
            self.least[k] = len(mine) - lacking
        flat, of = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(flat, kind="stable")
        self.keys, self.owners = flat[order], of[order]
        self.greatest = self.keys[-1]

    def sketched(self, keys: np.ndarray) -> np.ndarray:
        """The hashes of a document's sketch that are in the index; ``keys`` are its shingles' hashes."""
        small = keys[keys <= self.greatest]
        return np.unique(small[self.keys[np.searchsorted(self.keys, small)] == small])

    def candidates(self, keys: list[np.ndarray]) -> list[int]:
        """Items whose sketches share enough hashes with a document's (given in parts)."""
        found = np.unique(np.concatenate(keys))
        if not len(found):
            return []
        a, b = np.searchsorted(self.keys, found), np.searchsorted(self.keys, found, "right")
        owners = self.owners[np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)]
        items, shared = np.unique(owners, return_counts=True)
        return [k for k, n in zip(items.tolist(), shared.tolist()) if n >= self.least[k]]


class Block:
    """A block of items, ready to be looked for in documents."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids, self.shingles, self.vocabulary = [], [], {}
        for item_id, text in items:
            w = [x for part in words(text) for x in part]
            if w:
                width = min(SHINGLE, len(w))
                self.ids.append(item_id)
                self.shingles.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)})
                for x in w:
                    self.vocabulary.setdefault(x, xxhash.xxh64_intdigest(x.encode()) | 1)
        by_size: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for k, own in enumerate(self.shingles):
            hashes = self._key(np.array([[self.vocabulary[x] for x in s] for s in own], np.uint64))
            by_size.setdefault((len(next(iter(own))), len(own).bit_length()), {})[k] = np.unique(hashes)
        self.partitions: dict[int, list[Partition]] = {}
        for width, size in sorted(by_size):
            self.partitions.setdefault(width, []).append(Partition(by_size[width, size], self.shingles))

    @staticmethod
    def _key(columns: np.ndarray) -> np.ndarray:
        """Hashes of rows of word hashes."""
        out = np.full(len(columns), columns.shape[1], np.uint64)
        for k in range(columns.shape[1]):
            out = (out ^ columns[:, k]) * np.uint64(_STEP)
            out ^= out >> np.uint64(31)
        return out

    def find(self, text: str | None) -> list[tuple[int | None, int, int]]:
        """(item_id, shingles of the item, those found) of the items contained in the text."""
        sketches: dict[tuple[int, int], list[np.ndarray]] = {}
        held: set[tuple[str, ...]] = set()
        tail: list[str] = []
        for part in words(text):
            w = tail + part
            known = np.fromiter(map(self.vocabulary.get, w, repeat(0)), np.uint64, len(w))
            runs = np.concatenate([[0], np.cumsum(known != 0)])
            for width, partitions in self.partitions.items():
                if len(w) < width:
                    continue
                at = np.flatnonzero(runs[width:] - runs[:-width] == width)
                if not len(at):
                    continue
                keys = self._key(known[at[:, None] + np.arange(width)])
                for k, own in enumerate(partitions):
                    sketches.setdefault((width, k), []).append(own.sketched(keys))
                held.update(tuple(w[k : k + width]) for k in at.tolist())
            tail = w[len(w) - SHINGLE + 1 :] if len(w) >= SHINGLE else w
        out = []
        for k in sorted(k for (width, p), parts in sketches.items() for k in self.partitions[width][p].candidates(parts)):
            n, found = len(self.shingles[k]), len(self.shingles[k] & held)
            if found / n >= THRESHOLD:
                out.append((self.ids[k], n, found))
        return out


def blocks(items: DataFrame) -> Iterator[Block]:
    """The items in blocks of about BLOCK_CHARS, one at a time on the driver."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows
        block = Block([tuple(r) for r in own.collect()])
        if block.ids:
            yield block


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs of a document and an item that it contains: doc_id, item_id, n_shingles, n_found, containment."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], PAIRS)
    for block in blocks(items):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(d, *x, x[2] / x[1]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in shared.value.find(t.as_py())]
                names = ["doc_id", "item_id", "n_shingles", "n_found", "containment"]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.float64() if k == 4 else pa.int64()) for k in range(5)], names)

        out = out.unionByName(rows.mapInArrow(run, PAIRS))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that contain no item; decided in one pass per block, nothing is shuffled."""
    spark = docs.sparkSession
    for block in blocks(items):
        docs = docs.where(~_leaks(spark.sparkContext.broadcast(block))(docs["text"].cast("string")))
    return docs


def _leaks(shared):
    @F.pandas_udf("boolean")
    def leaks(texts: pd.Series) -> pd.Series:
        return pd.Series([bool(shared.value.find(t)) for t in texts], dtype=bool)

    return leaks


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH split AS (
    SELECT 'i' AS side, row_number() OVER () AS n, CAST(item_id AS BIGINT) AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark
    UNION ALL SELECT 'd', row_number() OVER (), CAST(doc_id AS BIGINT), regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM documents
), items AS (SELECT n, id, w, least(5, len(w)) AS width FROM split WHERE side = 'i' AND len(w) > 0),
item_shingles AS (SELECT DISTINCT n, id, width, array_to_string(w[k:k + width - 1], ' ') AS s FROM items, range(1, len(w) - width + 2) AS r(k)),
sizes AS (SELECT n, count(*) AS n_shingles FROM item_shingles GROUP BY n),
doc_shingles AS (
    SELECT DISTINCT d.n, d.id, width, array_to_string(d.w[k:k + width - 1], ' ') AS s
    FROM split d, (SELECT DISTINCT width FROM items) x, range(1, len(d.w) - width + 2) AS r(k) WHERE d.side = 'd'
)
SELECT d.id AS doc_id, i.id AS item_id, CAST(any_value(n_shingles) AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_found,
    count(*) / any_value(n_shingles) AS containment
FROM doc_shingles d JOIN item_shingles i ON d.s = i.s AND d.width = i.width JOIN sizes z ON z.n = i.n
GROUP BY d.n, d.id, i.n, i.id HAVING count(*) / any_value(n_shingles) >= 0.8
"""
