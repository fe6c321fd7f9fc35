"""Embedding near-deduplication: spherical k-means cells, blocked cosine products, exact links.

Vectors at cosine ``THRESHOLD`` or more are linked; groups are the connected components of the
links and the smallest vec_id of a group is kept.

Equal vectors are first folded into one, with a count. Spherical k-means on a bounded sample gives
cell centres, whose number grows with the vectors; every vector belongs to the cell of its nearest
centre. A vector x of cell A can be linked to a vector of cell B only if it lies near the plane
between the two centres: as y of B is no nearer to a than to b, and x and y are no farther apart
than the threshold's chord, x.a - x.b is at most chord times |a - b|. Cells are gathered into
bundles of at most ``BLOCK`` vectors (a fuller cell is cut into several bundles); a vector stays in
its own bundle and is sent, once, to each later bundle with a cell that the bound leaves, where it
meets only that cell's vectors. Visitors of a bundle are cut into slices of about ``BLOCK`` too, so
no cell, however full, is one task. Where vectors don't cluster (in 64 dimensions a random vector
is far from every centre), the bound leaves most cells and nearly everything is compared: the work
is then quadratic, and a vector is sent about once per ``BLOCK`` others. Beyond ``MOST_CELLS`` times
``CELL`` vectors of one length cells fill up and the work per vector grows.

Products are taken in single precision; those near the threshold again in double precision, which
decides. Blocks return sums per vector and a spanning star per group, never pairs.

Behaviour at the edges: vectors that are null, empty, zero or hold null or non-finite components
link with nothing and are groups of their own; vectors of different length don't link; repeated
rows are vectors of their own, so a row repeated once has a link to its repetition, and different
vectors of one vec_id have each their own links and component; rows without
vec_id link with nothing, have a null component and aren't kept; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import components, hot_keys, scratch, settled, spread_join, written

THRESHOLD = 0.95
#: Vectors in an average cell, most cells, vectors that k-means learns from (at least, and per cell), vectors in a block.
CELL, MOST_CELLS, SAMPLE, PER_CELL, BLOCK, ROUNDS = 1024, 16_384, 4096, 4, 16_384, 8
#: Components of a block at most, so that long vectors make smaller blocks.
BLOCK_SIZE = 1 << 21
#: Components of all centres, and of the vectors that k-means learns from, at most: the driver holds both.
CENTRE_SIZE, SAMPLE_SIZE = 1 << 22, 1 << 23
#: The distance of unit vectors at the threshold, and what is added to the bound, far above its rounding errors.
CHORD, SLACK = float(np.sqrt(2 - 2 * THRESHOLD)), 1e-6
_KEY = 1 << 16  # cells of one length of vectors


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very small or large components would be 0 or infinite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, k: int) -> np.ndarray:
    """Centres of ``k`` cells of unit vectors; starts from evenly spaced rows."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        own = np.concatenate([np.argmax(x[at : at + 512] @ centres.T, axis=1) for at in range(0, len(x), 512)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centres


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, matrix of unit vectors) for each length of the lists of ``column``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    lengths = np.diff(ends, prepend=0)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield at, unit(flat[(ends[at] - n)[:, None] + np.arange(n)])


def centres_of(classes: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Cell centres for each length of vectors, learned from vectors of small hash: about as many as asked for."""
    length = (classes.agg(F.sum(F.size("embedding"))).first()[0] or 0) // max(n, 1) + 1
    cells = int(np.clip(-(-n // CELL), 1, min(MOST_CELLS, max(1, CENTRE_SIZE // length))))
    wanted = min(max(SAMPLE, PER_CELL * cells), max(1, SAMPLE_SIZE // length))
    few = F.pmod(F.xxhash64("vec_id", "node"), F.lit(1 << 31)) < (1 << 31) * wanted // max(n, 1)
    sample = classes.where(few).select("embedding").toArrow()
    if not sample.num_rows:  # few vectors, by chance none of small hash
        sample = classes.limit(1).select("embedding").toArrow()
    out = {}
    if sample.num_rows:
        for at, x in by_length(sample["embedding"]):
            out[x.shape[1]] = spherical_kmeans(x, int(np.clip(cells * len(at) // sample.num_rows, 1, len(at))))
    return out


def _centres(centres: dict[int, np.ndarray], length: int) -> np.ndarray:
    return centres.get(length, np.full((1, length), length**-0.5))


def _assigned(centres: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.zeros(batch.num_rows, np.int64)
            for at, x in by_length(batch.column(2)):
                for k in range(0, len(x), 512):
                    cell[at[k : k + 512]] = x.shape[1] * _KEY + np.argmax(x[k : k + 512] @ _centres(centres, x.shape[1]).T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["node", "n", "embedding", "cell"])

    return run


def near_plane(x: np.ndarray, own: np.ndarray, centres: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Whether each of ``x``, of cells ``own``, may be linked to a vector of each of ``cells``."""
    a, b = centres[own], centres[cells]
    apart = np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))
    return np.einsum("ij,ij->i", x, a)[:, None] - x @ b.T <= CHORD * apart + SLACK


class Bundles:
    """Cells gathered into, or cut into, bundles of at most a block; their numbers ascend."""

    def __init__(self, cells: dict[int, int]):
        self.first: dict[int, int] = {}
        self.pieces: dict[int, int] = {}
        self.count, room, of_length = 0, 0, -1
        for cell, n in sorted(cells.items()):
            length = cell // _KEY
            block = max(1, min(BLOCK, BLOCK_SIZE // max(1, length)))
            if n > room or length != of_length:
                self.count, room, of_length = self.count + 1, block, length
            self.first[cell], self.pieces[cell] = self.count - 1, -(-n // block)
            self.count += self.pieces[cell] - 1
            room = room - n if n <= room else 0
        # by length: number of a cell's first bundle and of its bundles, by the cell's place among the centres
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length in {c // _KEY for c in cells}:
            size = max(c % _KEY for c in cells if c // _KEY == length) + 1
            first, pieces = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for c in cells:
                if c // _KEY == length:
                    first[c % _KEY], pieces[c % _KEY] = self.first[c], self.pieces[c]
            self.tables[length] = first, pieces

    def home(self, length: int, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
        first, pieces = self.tables[length]
        return first[own] + _spread(ids) % pieces[own]

    def visits(self, length: int, x: np.ndarray, own: np.ndarray, home: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows of ``x``, bundles) of the visits to be made, each once."""
        first, pieces = self.tables[length]
        rows, bundles = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(x), 512):
            r, c = np.nonzero(near_plane(x[k : k + 512], own[k : k + 512], centres, np.arange(len(first))) & (pieces > 0))
            n = pieces[c]
            r, to = np.repeat(r + k, n), np.repeat(first[c], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs = np.unique((r * self.count + to)[to > home[r]])
            rows.append(pairs // self.count)
            bundles.append(pairs % self.count)
        return np.concatenate(rows), np.concatenate(bundles)


def _counted(centres: dict[int, np.ndarray], bundles: Bundles):
    """How many visitors each bundle gets from a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, cell = np.zeros(bundles.count, np.int64), batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for at, x in by_length(batch.column(2)):
                own = cell[at] % _KEY
                _, to = bundles.visits(x.shape[1], x, own, bundles.home(x.shape[1], own, ids[at]), _centres(centres, x.shape[1]))
                n += np.bincount(to, minlength=bundles.count)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bundle", "n"])

    return run


def _routed(centres: dict[int, np.ndarray], bundles: Bundles, slices: np.ndarray):
    """Vectors at home, in every slice of their bundle, and as visitors, in one slice of each other's."""
    names = ["bundle", "slice", "visitor", "node", "n", "embedding", "cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, cell = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            for at, x in by_length(batch.column(2)):
                own = cell[at] % _KEY
                home = bundles.home(x.shape[1], own, ids[at])
                n = slices[home]
                rows = np.repeat(np.arange(len(at)), n)
                yield told(batch, at[rows], home[rows], np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n), False)
                rows, to = bundles.visits(x.shape[1], x, own, home, _centres(centres, x.shape[1]))
                for k in range(0, len(rows), 1 << 14):
                    r, b = rows[k : k + (1 << 14)], to[k : k + (1 << 14)]
                    yield told(batch, at[r], b, (_spread(ids[at[r]]) >> 7) % slices[b], True)

    def told(batch: pa.RecordBatch, at: np.ndarray, bundle: np.ndarray, piece: np.ndarray, visitor: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bundle), pa.array(piece), pa.array(np.full(len(at), visitor)), *batch.take(pa.array(at)).columns], names)

    return run


def _spread(ids: np.ndarray) -> np.ndarray:
    return ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)


def links_in_block(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, matrix of links) of slices of ``x`` against all of ``y``."""
    low, margin = x.astype(np.float32), max(1e-4, 4e-7 * x.shape[1])
    other = y.astype(np.float32).T.copy()
    for at in range(0, len(x), 512):
        cos = low[at : at + 512] @ other
        hit = cos >= THRESHOLD
        r, c = np.nonzero(np.abs(cos - THRESHOLD) <= margin)
        for k in range(0, len(r), 1 << 16):
            p, q = r[k : k + (1 << 16)], c[k : k + (1 << 16)]
            hit[p, q] = np.einsum("ij,ij->i", x[at + p], y[q]) >= THRESHOLD
        yield at, hit


OUT = "node long, other long, links long"


def _compared(centres: dict[int, np.ndarray]):
    """Links inside a bundle (once, in its first slice) and with its visitors: sums per vector, then stars."""

    def run(table: pa.Table) -> pa.Table:
        ids, n, cell, visitor = (table[c].to_numpy() for c in ("node", "n", "cell", "visitor"))
        _, x = next(by_length(table["embedding"]))
        own, centre = cell % _KEY, _centres(centres, x.shape[1])
        total, label = np.zeros(len(ids), np.int64), np.arange(len(ids))

        def meet(left: np.ndarray, right: np.ndarray, alone: bool) -> None:
            for at, hit in links_in_block(x[left], x[right]):
                rows = left[at : at + len(hit)]
                if alone:
                    hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
                else:
                    total[right] += n[rows] @ hit
                total[rows] += hit @ n[right]
                for k in np.flatnonzero(hit.any(1)):
                    group = np.append(label[right[hit[k]]], label[rows[k]])
                    if (group != group[0]).any():
                        label[np.isin(label, group)] = group.min()

        inside = table["slice"][0].as_py() == 0
        for c in np.unique(own[~visitor]):
            here = np.flatnonzero((own == c) & ~visitor)
            if inside:
                meet(here, here, True)
            others = np.flatnonzero(visitor | ((own > c) & inside))
            # visitors of this very cell come from another bundle of it, within the bound as any of the cell
            for k in range(0, len(others), 4096):
                near = others[k : k + 4096]
                near = near[near_plane(x[near], own[near], centre, np.array([c]))[:, 0]]
                if len(near):
                    meet(near, here, False)
        linked, far = np.flatnonzero(total), np.flatnonzero(label != np.arange(len(ids)))
        node, other = np.concatenate([ids[linked], ids[label[far]]]), pa.array(np.concatenate([ids[linked], ids[far]]), mask=np.arange(len(linked) + len(far)) < len(linked))
        return pa.table({"node": node, "other": other, "links": np.concatenate([total[linked], np.zeros(len(far), np.int64)])})

    return run


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", bad) & F.exists("embedding", lambda v: v != 0)
    sound = F.coalesce(sound, F.lit(False))
    kind = rows.schema["embedding"].dataType.simpleString()
    with scratch(rows.sparkSession):
        classes = rows.where(sound).groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
        # numbers tell vectors apart, for an id may have several; written, they stay as they are
        classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "vectors")
        centres = centres_of(classes, classes.count())
        assigned = written(classes.select("node", "n", "embedding").mapInArrow(_assigned(centres), f"node long, n long, embedding {kind}, cell long"), "cells")
        # a row per cell and per bundle
        bundles = Bundles({r["cell"]: r["count"] for r in assigned.groupBy("cell").count().collect()})
        slices = np.ones(max(1, bundles.count), np.int64)
        for r in assigned.mapInArrow(_counted(centres, bundles), "bundle long, n long").groupBy("bundle").agg(F.sum("n").alias("n")).collect():
            slices[r["bundle"]] = -(-r["n"] // BLOCK)
        pairs = assigned.mapInArrow(_routed(centres, bundles, slices), f"bundle long, slice long, visitor boolean, node long, n long, embedding {kind}, cell long")
        found = written(pairs.groupBy("bundle", "slice").applyInArrow(_compared(centres), OUT), "links")
        direct = found.where("other is null").groupBy("node").agg(F.sum("links").alias("direct"))
        root = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
        member = written(classes.select("node", "vec_id").join(root, "node"), "member")
        least = member.groupBy("root").agg(F.min("vec_id").alias("component_id"))
        labels = spread_join(member, least, "root", member.count()).select("node", "component_id")
        told = classes.join(direct, "node", "left").join(labels, "node", "left")
        told = told.select(F.col("embedding").alias("e"), (F.col("n") - 1 + F.coalesce("direct", F.lit(0))).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), "n")
        told = settled(told, "told")
    return _joined(rows, told, sound)


def _joined(rows: DataFrame, told: DataFrame, sound: Column) -> DataFrame:
    """Every row with what is ``told`` of its vector; copies of a common vector are dealt out to several tasks."""
    n = rows.count()
    keyed = rows.withColumn("e", F.when(sound, F.col("embedding"))).select("vec_id", F.col("e").alias("e"))
    out = spread_join(keyed.where("e is not null"), told.drop("n"), "e", n, "left", hot=hot_keys(told.select("e", "n"), n)).drop("e")
    odd = keyed.where("e is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(odd).select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS size FROM v),
links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
    AND list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.95
), reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT r.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = r.vec_id) AS BIGINT) AS n_links, r.component_id, r.vec_id = r.component_id AS kept
FROM root r
"""
