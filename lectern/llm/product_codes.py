"""Vector compression by product codes, learned with Elkan's form of Lloyd's algorithm.

Components become integers, floor(256 x), and vectors are cut into ``PARTS`` equal parts. Each part
position has a codebook of up to ``ENTRIES`` entries, which starts as that part of the vectors of
smallest vec_id. A round assigns every part to its codebook's nearest entry (squared Euclidean
distance in integers, ties to the lower index) and replaces entries by their parts' means, rounded
down; an entry that nothing is assigned to stays.

The first assignment measures all distances and persists, for every part of every vector, an upper
bound on the distance to its entry and one lower bound per entry. Later ones read that table: bounds
are shifted by how far the entries moved, and an entry is passed over if its lower bound, or half its
distance from the part's own entry, is strictly above the upper bound. Bounds are rounded outwards,
so that what is passed over is truly farther; all others are measured in integers, which also decide
ties. Lower bounds take a byte each (in steps of a part's largest), so a vector's state is about a
kilobyte. Rounds are written tables: a lost executor costs one round's tasks.

What reaches the driver is the codebooks and, per round, a sum and a count per entry; sums are taken
in the tasks first. No step brings a label's, a part's or an entry's rows together.

Behaviour at the edges: vectors that are null or hold null or non-finite components are dropped.
Vectors shorter than the longest, or than a multiple of ``PARTS``, count as filled up with zeros;
components beyond +-2**22 (after multiplication) count as that. Rows without vec_id are coded like
others and come last where the smallest ids are taken; of equal ids the lesser vector comes first;
with fewer vectors than ``ENTRIES`` there are fewer entries. Repeated rows each have their result;
other columns are ignored; an empty table gives an empty result. A sum beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import scratch, settled, spread_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Largest component, so that squared distances of parts stay far below 64 bits.
LIMIT = 1 << 22
#: Bounds are rounded outwards by this share, far above the rounding of single precision.
SLACK = 1e-6
STATE = "vec_id long, label string, parts binary, codes binary, upper binary, lower binary, steps binary"
SUMS = "part int, entry int, n long, sums array<long>"


def integers(column: pa.Array, width: int) -> np.ndarray:
    """(vectors, PARTS, width) of the lists of ``column``."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = np.clip(np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False)), -LIMIT, LIMIT).astype(np.int32)
    out = np.zeros((len(column), PARTS * width), np.int32)
    out[np.arange(PARTS * width) < sizes[:, None]] = flat
    return out.reshape(len(column), PARTS, width)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of parts (n, width) from each of the entries, in integers."""
    out = np.empty((len(x), len(entries)), np.int64)
    for j, c in enumerate(entries):
        d = x - c
        out[:, j] = np.einsum("ij,ij->i", d, d)
    return out


class Bounds:
    """Codes and bounds of one part position of many vectors."""

    def __init__(self, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        self.codes, self.upper, self.lower = codes, upper, lower

    @classmethod
    def measured(cls, x: np.ndarray, entries: np.ndarray) -> Bounds:
        d = distances(x, entries)
        codes = d.argmin(1)  # the lowest of equals
        root = np.sqrt(d)
        return cls(codes, root[np.arange(len(x)), codes] * (1 + SLACK), root * (1 - SLACK))

    def assign(self, x: np.ndarray, old: np.ndarray, new: np.ndarray) -> int:
        """The assignment after entries moved from ``old`` to ``new``; how many distances were measured."""
        moved = np.sqrt(((new - old) ** 2).sum(1)) * (1 + SLACK)
        half = np.sqrt(distances(new, new)) * (0.5 * (1 - SLACK))
        self.upper = self.upper + moved[self.codes]
        self.lower = np.maximum(self.lower - moved, 0)
        near = self._near(np.arange(len(x)), half)
        rows = np.flatnonzero(near.any(1))
        if not len(rows):
            return 0
        own = x[rows] - new[self.codes[rows]]
        exact = np.einsum("ij,ij->i", own, own)
        self.upper[rows] = np.sqrt(exact) * (1 + SLACK)
        r, j = np.nonzero(self._near(rows, half))
        measured = np.empty(len(r), np.int64)
        for k in range(0, len(r), 1 << 17):
            d = x[rows[r[k : k + (1 << 17)]]] - new[j[k : k + (1 << 17)]]
            measured[k : k + (1 << 17)] = np.einsum("ij,ij->i", d, d)
        self.lower[rows[r], j] = np.sqrt(measured) * (1 - SLACK)
        # nearest of the own entry and those measured, by integers, then by index
        row, entry, d = np.append(np.arange(len(rows)), r), np.append(self.codes[rows], j), np.append(exact, measured)
        order = np.lexsort((entry, d, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        self.codes[rows], self.upper[rows] = entry[first], np.sqrt(d[first]) * (1 + SLACK)
        return len(rows) + len(r)

    def _near(self, rows: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Which entries but the own may be as near as it: (rows, entries)."""
        upper, codes = self.upper[rows, None], self.codes[rows]
        near = (self.lower[rows] <= upper) & (half[codes] <= upper)
        near[np.arange(len(rows)), codes] = False
        return near

    def stored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """codes, upper, lower and step as they are persisted, bounds rounded outwards."""
        step = (self.lower.max(1) / 255 * (1 + SLACK)).astype(np.float32)
        lower = np.floor(self.lower / np.maximum(step, np.finfo(np.float32).tiny)[:, None].astype(float) * (1 - SLACK))
        return self.codes.astype(np.uint8), (self.upper * (1 + SLACK)).astype(np.float32), lower.astype(np.uint8), step

    @classmethod
    def restored(cls, codes: np.ndarray, upper: np.ndarray, lower: np.ndarray, step: np.ndarray) -> Bounds:
        return cls(codes.astype(np.int64), upper.astype(float), lower.astype(float) * step[:, None].astype(float))


def _blob(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of an array."""
    data = np.ascontiguousarray(rows)
    width = data.nbytes // max(1, len(data))
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer((np.arange(len(data) + 1) * width).astype(np.int32)), pa.py_buffer(data.tobytes())])


def _unblob(column: pa.Array, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def _restored(batch: pa.RecordBatch, width: int, entries: int) -> tuple[np.ndarray, list[Bounds]]:
    x = _unblob(batch.column(2), np.int32, PARTS, width).astype(np.int64)
    codes, upper, lower, steps = (_unblob(batch.column(k), kind, *shape) for k, kind, shape in ((3, np.uint8, (PARTS,)), (4, np.float32, (PARTS,)), (5, np.uint8, (PARTS, entries)), (6, np.float32, (PARTS,))))
    return x, [Bounds.restored(codes[:, p], upper[:, p], lower[:, p], steps[:, p]) for p in range(PARTS)]


def _batch(head: list[pa.Array], bounds: list[Bounds]) -> pa.RecordBatch:
    state = [np.stack(x, axis=1) for x in zip(*(b.stored() for b in bounds))]
    return pa.RecordBatch.from_arrays([*head, *map(_blob, state)], [c.split()[0] for c in STATE.split(", ")])


#: Vectors whose bounds are worked on at once.
AT_ONCE = 4096


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(k, AT_ONCE)


def _first(books: np.ndarray):
    """The first assignment: all distances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = integers(batch.column(2), books.shape[2])
            yield _batch([batch.column(0), batch.column(1), _blob(x)], [Bounds.measured(x[:, p].astype(np.int64), books[p]) for p in range(PARTS)])

    return run


def _next(old: np.ndarray, new: np.ndarray):
    """A later assignment, by the bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, bounds = _restored(batch, new.shape[2], new.shape[1])
            for p, b in enumerate(bounds):
                b.assign(x[:, p], old[p], new[p])
            yield _batch([batch.column(k) for k in range(3)], bounds)

    return run


def _last(old: np.ndarray, new: np.ndarray):
    """The last assignment: codes and their exact errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x, bounds = _restored(batch, new.shape[2], new.shape[1])
            error = np.zeros(len(x), np.int64)
            for p, b in enumerate(bounds):
                b.assign(x[:, p], old[p], new[p])
                d = x[:, p] - new[p][b.codes]
                error += np.einsum("ij,ij->i", d, d)
            codes = np.stack([b.codes for b in bounds], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in codes], pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def _summed(width: int, entries: int):
    """Sum and count of the parts of each entry, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((PARTS, entries, width), np.int64), np.zeros((PARTS, entries), np.int64)
        for batch in batches:
            x, codes = _unblob(batch.column(0), np.int32, PARTS, width).astype(np.int64), _unblob(batch.column(1), np.uint8, PARTS)
            for p in range(PARTS):
                np.add.at(sums[p], codes[:, p], x[:, p])
                n[p] += np.bincount(codes[:, p], minlength=entries)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def moved(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after an update: means of the parts assigned, rounded down."""
    new = books.copy()
    per_task = state.select("parts", "codes").mapInArrow(_summed(books.shape[2], books.shape[1]), SUMS)
    at = per_task.select("part", "entry", "n", F.posexplode("sums").alias("place", "x"))
    for r in at.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toLocalIterator():  # a row per component of the codebooks
        new[r["part"], r["entry"], r["place"]] = r["x"] // r["n"]
    return new


def starting(kept: DataFrame, entries: int) -> np.ndarray:
    """Codebooks of the vectors of smallest vec_id."""
    width = max(1, -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 0) // PARTS))
    # ids as far from the smallest as one power of two bounds: a count per power says how far is enough
    least = kept.agg(F.min("vec_id")).first()[0]
    rows = kept.select("vec_id", "embedding")
    if least is not None:
        power = F.coalesce(F.length(F.bin(F.try_subtract(F.col("vec_id"), F.lit(least)))), F.lit(64))
        have = 0
        for r in kept.where("vec_id is not null").groupBy(power.alias("p")).count().orderBy("p").collect():  # 64 rows at most
            have += r["count"]
            if have >= entries:
                rows = rows.where(power <= r["p"]).where("vec_id is not null")
                break
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    column = first["embedding"].combine_chunks()
    return integers(column, width).transpose(1, 0, 2).astype(np.int64)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of the vectors kept, and the codebooks (part, entry, place).

    ``label`` is the label as a string, ``-`` in front of it, or ``null``; without such a column all are ``null``.
    """
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    label = F.coalesce(F.concat(F.lit("-"), F.col("label").cast("string")), F.lit("null")) if "label" in vectors.columns else F.lit("null")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kept = rows.where(F.col("embedding").isNotNull() & ~F.coalesce(F.exists("embedding", bad), F.lit(True)))
    books = starting(kept, entries)
    out = "vec_id long, label string, code string, error long"
    if not books.shape[1]:
        return vectors.sparkSession.createDataFrame([], out), books
    state = written(kept.mapInArrow(_first(books), STATE), "codes")
    for k in range(rounds):
        old, books = books, moved(state, books)
        state = written(state.mapInArrow(_next(old, books), STATE) if k + 1 < rounds else state.mapInArrow(_last(old, books), out), "codes")
    return state, books


def coded(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector kept: vec_id, code, error, label_error, codebooks_sha256."""
    with scratch(vectors.sparkSession):
        rows, books = compressed(vectors, entries, rounds)
        of_label = rows.groupBy("label").agg(F.try_sum("error").alias("label_error"))
        told = spread_join(rows, of_label, "label", rows.count())
        return settled(told.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")), "coded")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    nearest = "a{k} AS (SELECT p.vec_id, p.part, min({{'d': {d}, 'entry': c.entry}}) AS best FROM parts p JOIN c{k} c ON c.part = p.part GROUP BY p.vec_id, p.part)"
    distance = "CAST(list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i]))) AS BIGINT)"
    update = """m{n} AS (
    SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
        SELECT a.part, a.best.entry AS entry, i, sum(p.x[i]) AS s, count(*) AS n FROM a{k} a JOIN parts p USING (vec_id, part), range(1, len(p.x) + 1) AS r(i) GROUP BY ALL
    ) GROUP BY part, entry
), c{n} AS (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{n} m USING (part, entry))"""
    steps = [nearest.format(k=0, d=distance)]
    for k in range(ROUNDS):
        steps += [update.format(k=k, n=k + 1), nearest.format(k=k + 1, d=distance)]
    return f"""
WITH v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (SELECT vec_id, part, e[part * (len(e) // {PARTS}) + 1:(part + 1) * (len(e) // {PARTS})] AS x FROM v, range({PARTS}) AS r(part)),
firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}),
c0 AS (SELECT part, entry, x FROM parts JOIN firsts USING (vec_id)),
{', '.join(steps)},
coded AS (
    SELECT vec_id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN v USING (vec_id), books
"""


OP13_SQL = _sql()
