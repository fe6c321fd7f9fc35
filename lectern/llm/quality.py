"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Every word has a sparse ternary index vector derived from its hash. A word's context vector is the
sum of the index vectors of its neighbours in all documents outside the held-out fold, labelled or
not, added up task by task; a document is the mean of its
words' context vectors, with the share of distinct words beside it. A text's length is no input,
so short texts aren't held against. Words are known by themselves if frequent in training, and
always by their shape (runs of capitals, small letters and digits, other characters as they are),
so that unseen words still count. A network of two layers in numpy turns the pooled vector into a
logit, and a temperature fitted on held-back training rows calibrates the probability.

Only labels and texts of training rows are learned from; the score sees the text alone. Training is
bounded: at most ``TRAIN_ROWS`` labelled documents, those with the smallest hash of the doc_id, and
about ``TRAIN_BYTES`` of text are brought to the driver, whatever the size of the corpus. Which
words and shapes have vectors follows from these rows, the vectors from the corpus: sums are whole
numbers, so they are the same however rows are dealt out; a task's are a table of constant size, so
of large corpora a task takes ``TASK_BYTES`` or more, and tables are added up in two steps, of about
the root of their number each. Scoring reads every
whole text once, as the contexts do those outside the held-out fold.

Behaviour at the edges: a null text counts as empty and gets the score of an empty text; labels
that are null or have no document are not used, of conflicting labels of a document the majority
counts (ties: 0); documents without doc_id are scored, not learned from; repeated rows are scored
alike and learned once; with no labels at all, or one class only, every score is the smoothed
share of label 1; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import scratch, words_of, written

#: Most labelled documents learned from, and most bytes of text among them.
TRAIN_ROWS, TRAIN_BYTES = 4000, 24 << 20
WORDS, SHAPES, DIM, NONZERO, REACH = 16_000, 400, 64, 8, 2
#: Words whose contexts are summed at once, and pieces that a task's sums travel in.
CONTEXT_WORDS, SLABS = 1 << 20, 16
#: Tables of sums are made by no more tasks than these, or than one for so many bytes of input.
SUM_TASKS, TASK_BYTES = 256, 1 << 30
HIDDEN, EPOCHS, RATE, DECAY, MEMO = 32, 300, 0.01, 1e-4, 400_000
HELD_OUT = (3, 1)

_RUNS = ((re.compile(rb"[A-Z]+"), b"X"), (re.compile(rb"[a-z\x80-\xff]+"), b"x"), (re.compile(rb"[0-9]+"), b"9"), (re.compile(rb"([^A-Za-z0-9\x80-\xff])\1+"), rb"\1"))


def shape(word: bytes) -> bytes:
    """``THERE!!`` is ``X!``, ``Word-12,`` is ``Xx-9,``; long shapes are cut off to their first eight signs."""
    for pattern, sign in _RUNS:
        word = pattern.sub(sign, word)
    return word[:8]


class Rows(dict):
    """Rows of the vector table by word, in a bounded memo."""

    def __init__(self, words: dict[bytes, int], shapes: dict[bytes, int]):
        self.words, self.shapes = words, shapes

    def __missing__(self, word: bytes) -> int:
        row = self.words.get(word.lower())
        s = self.shapes.get(shape(word), 0)
        row = len(self.shapes) + 1 + row * (len(self.shapes) + 1) + s if row is not None else s
        if len(self) >= MEMO:
            self.clear()
        self[word] = row
        return row


class Model:
    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.shapes: dict[bytes, int] = {}
        self.share = 0.5
        self.net: list[np.ndarray] | None = None
        self.temperature = 1.0
        self._rows: Rows | None = None

    def names(self) -> list[bytes]:
        """What has a vector: other shapes, shapes, words, in the order of the rows."""
        return [b"\x00other", *(b"\x00" + s for s in self.shapes), *self.words]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_rows": None}

    # the table: one row per shape (0: any other), then by word and shape; kept as two small tables
    def pooled(self, text: bytes | None) -> np.ndarray:
        if self._rows is None:
            self._rows = Rows(self.words, self.shapes)
        width, total, n, seen = len(self.shapes) + 1, np.zeros(DIM), 0, 0
        for words in words_of(text or b""):
            if not words:
                continue
            rows = np.fromiter(map(self._rows.__getitem__, words), np.int64, len(words))
            known = rows >= width
            shapes = np.where(known, (rows - width) % width, rows)
            total += np.bincount(shapes, minlength=width) @ self.shape_vectors
            own = (rows[known] - width) // width
            if len(own):
                total += self.word_vectors[own].sum(0, dtype=np.float64)
            n += len(words)
            seen += len(set(words))
        return np.append(total / max(n, 1), seen / max(n, 1))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.net
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.net is None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        x = np.stack([self.pooled(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def index_vectors(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each word's index vector, from its hash."""
    seeds = np.array([zlib.crc32(n) for n in names], np.uint64)
    places, signs = np.zeros((len(names), NONZERO), np.int64), np.zeros((len(names), NONZERO))
    for k in range(NONZERO):
        x = (seeds + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        places[:, k], signs[:, k] = x % np.uint64(DIM), 1 - 2.0 * (x >> np.uint64(40) & np.uint64(1)).astype(float)
    return places, signs


class Contexts:
    """Sums of the neighbours' index vectors, by row of ``names``, over the texts added."""

    def __init__(self, names: list[bytes]):
        self.places, self.signs = index_vectors(names)
        self.sums = np.zeros(len(names) * DIM)  # whole numbers, exact far beyond any corpus
        self.tail, self.waiting, self.n = np.full(REACH, -1), [], 0

    def add(self, rows: np.ndarray) -> None:
        """The next words of a text, as rows."""
        self.waiting.append(rows)
        self.n += len(rows)
        if self.n >= CONTEXT_WORDS:
            self.flush()

    def end(self) -> None:
        """The text is over: its words are no neighbours of the next one's."""
        self.add(np.full(REACH, -1))

    def flush(self) -> None:
        flat = np.concatenate([self.tail, *self.waiting])
        for reach in range(1, REACH + 1):
            a, b = flat[REACH - reach : -reach], flat[REACH:]  # pairs whose second word is new
            ok = (a >= 0) & (b >= 0)
            for x, y in ((a[ok], b[ok]), (b[ok], a[ok])):
                for k in range(NONZERO):
                    self.sums += np.bincount(x * DIM + self.places[y, k], weights=self.signs[y, k], minlength=len(self.sums))
        self.tail, self.waiting, self.n = flat[-REACH:], [], 0


def _summed(model: Model):
    """The context sums of a task's texts, in slabs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Contexts(model.names())
        rows_of, width = Rows(model.words, model.shapes), len(model.shapes) + 1
        for batch in batches:
            for text in batch.column(0):
                for words in words_of(text.as_py() or b""):
                    rows = np.fromiter(map(rows_of.__getitem__, words), np.int64, len(words))
                    # a word stands in the contexts as itself if known, else as its shape
                    own.add(np.where(rows >= width, width + (rows - width) // width, rows))
                own.end()
        own.flush()
        yield _slabs(TaskContext.get().partitionId(), dict(enumerate(np.array_split(own.sums.astype(np.int64), SLABS))))

    return run


def _slabs(part: int, sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    data = [zstandard.compress(x.tobytes()) for x in sums.values()]
    return pa.RecordBatch.from_arrays([pa.array([part] * len(sums), pa.int64()), pa.array(list(sums), pa.int64()), pa.array(data, pa.binary())], ["part", "slab", "data"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slab that the task has rows of, read one by one."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for slab, data in zip(batch.column(1).to_pylist(), batch.column(2)):
            x = np.frombuffer(zstandard.decompress(data.as_py()), np.int64)
            sums[slab] = sums[slab] + x if slab in sums else x
    yield _slabs(TaskContext.get().partitionId(), sums)


def context_vectors(texts: DataFrame, model: Model) -> np.ndarray:
    """Unit vectors of the rows of ``model.names()`` from their contexts in ``texts`` (one binary column)."""
    kind = "part long, slab long, data binary"
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = max(SUM_TASKS, -(-size // TASK_BYTES))
    with scratch(texts.sparkSession):
        each = written(texts.coalesce(tasks).mapInArrow(_summed(model), kind), "contexts")
        deal = max(1, int(each.where("slab = 0").count() ** 0.5))
        for by in ([F.col("slab"), F.col("part") % deal], [F.col("slab")]):
            each = each.repartition(SLABS * deal if len(by) > 1 else SLABS, *by).mapInArrow(_added, kind)
        found = {r["slab"]: np.frombuffer(zstandard.decompress(r["data"]), np.int64) for r in each.collect()}  # a row per slab
    if not found:
        return np.zeros((len(model.names()), DIM), np.float32)
    out = np.concatenate([found[k] for k in range(SLABS)]).reshape(-1, DIM).astype(float)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def train(texts: list[bytes], labels: np.ndarray, corpus: DataFrame) -> Model:
    """A model from labelled texts (UTF-8) and labels 0 or 1; ``corpus`` (one binary column) gives words their contexts."""
    model, n = Model(), len(texts)
    model.share = (float(labels.sum()) + 1) / (n + 2)
    if n < 4 or labels.min() == labels.max():
        return model
    counts: Counter = Counter()
    for t in texts:
        for part in words_of(t):
            counts.update(part)
    of_lower, of_shape = Counter(), Counter()
    for w, c in counts.items():
        of_lower[w.lower()] += c
        of_shape[shape(w)] += c
    common = sorted(((w, c) for w, c in of_lower.items() if c > 1), key=lambda x: (-x[1], x[0]))[:WORDS]
    model.words = {w: k for k, (w, _) in enumerate(common)}
    model.shapes = {s: k + 1 for k, (s, _) in enumerate(sorted(of_shape.items(), key=lambda x: (-x[1], x[0]))[:SHAPES])}
    vectors, width = context_vectors(corpus, model), len(model.shapes) + 1
    model.shape_vectors, model.word_vectors = vectors[:width].astype(np.float64), vectors[width:]
    x, y = np.stack([model.pooled(t) for t in texts]), labels.astype(float)
    model.mean, model.scale = x.mean(0), x.std(0) + 1e-6
    x = (x - model.mean) / model.scale
    held = np.arange(n) % 5 == 4
    if min(y[held].sum(), (1 - y[held]).sum()) < 1:
        held[:] = False
    model.net = _fit(x[~held], y[~held])
    if held.any():
        z, t = np.tanh(x[held] @ model.net[0] + model.net[1]) @ model.net[2] + model.net[3], np.geomspace(0.25, 8, 200)
        loss = [np.mean(np.logaddexp(0, z / k) - y[held] * z / k) for k in t]
        model.temperature = float(t[int(np.argmin(loss))])
    return model


def _fit(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Two layers by Adam on the whole batch; fixed seed."""
    rng = np.random.default_rng(0)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(())]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, EPOCHS + 1):
        h = np.tanh(x @ p[0] + p[1])
        d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y) / len(y)
        dh = np.outer(d, p[2]) * (1 - h * h)
        for k, g in enumerate((x.T @ dh + DECAY * p[0], dh.sum(0), h.T @ d + DECAY * p[2], d.sum())):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - RATE * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return p


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """At most TRAIN_ROWS labelled texts outside the held-out fold and about TRAIN_BYTES of them, by smallest hash of their id.

    Ids without a document take no place. A text that would exceed what is left of the bytes is
    passed over, but a class that would have none keeps its shortest. Of the texts of a repeated id
    the one of smallest hash is taken, so the rows are the same every time.
    """
    folds, held = HELD_OUT
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q")).where("id is not null and q in (0, 1)")
    known = known.where(fold(F.col("id"), folds) != held).groupBy("id").agg((F.avg("q") > 0.5).cast("int").alias("q")).withColumn("r", F.xxhash64("id"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("t"))
    asked, found = 0, pd.DataFrame({"id": [], "q": [], "r": [], "h": [], "n": []})
    total = known.count()
    # as many labels as it takes until enough of them have a document; they are sent to all tasks
    while len(found) < TRAIN_ROWS and asked < total:
        asked = min(total, max(2 * TRAIN_ROWS, 4 * asked))
        own = texts.join(F.broadcast(known.orderBy("r", "id").limit(asked)), "id")
        least = own.groupBy("id", "q", "r").agg(F.min(F.struct(F.xxhash64("t").alias("h"), F.octet_length("t").alias("n"))).alias("x"))
        found = least.orderBy("r", "id").limit(TRAIN_ROWS).select("id", "q", "r", "x.h", "x.n").toPandas()
    taken, left = [], TRAIN_BYTES
    for k, n in enumerate(found["n"].tolist()):
        if n <= left:
            taken.append(k)
            left -= n
    for q in (0, 1):
        own = found[found["q"] == q]
        if len(own) and not set(own.index) & set(taken):
            taken.append(own["n"].astype(int).idxmin())
    if not taken:
        return [], np.zeros(0, np.int64)
    chosen = docs.sparkSession.createDataFrame(found.loc[taken, ["id", "q", "h"]].astype("int64"), "id long, q long, h long")
    rows = texts.join(F.broadcast(chosen), "id").where(F.xxhash64("t") == F.col("h")).dropDuplicates(["id"]).select("id", "t", "q").toPandas().sort_values("id")
    return [bytes(t) for t in rows["t"]], rows["q"].to_numpy(np.int64)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    folds, held = HELD_OUT
    corpus = docs.where(fold(docs["doc_id"].cast("long"), folds) != held).select(F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    return train(*training_rows(docs, labels), corpus)


def score_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """The probability of label 1 for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for texts in parts:
            yield pd.Series(own.scores(texts.tolist()), dtype=float)

    return score(text.cast("binary"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    folds, held = HELD_OUT
    score = score_of(docs.sparkSession, model, F.col("text"))
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model predicts to be of label 1."""
    model = fit(docs, labels)
    return docs.where(score_of(docs.sparkSession, model, docs["text"]) >= 0.5)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
