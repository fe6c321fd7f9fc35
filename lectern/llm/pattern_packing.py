"""Best-fit packing of tokenized documents by repeated length patterns.

Documents become token ids plus an end id; only longer ones are cut, into pieces of the sequence
length of which the first may be shorter. The histogram of piece lengths (one number per length,
however many documents there are) is fitted by non-negative least squares with patterns of two or
three pieces that fill a sequence; the repeat counts are rounded down to what the histogram holds
and the remaining lengths are packed by best fit decreasing, again as counts per length. A piece
finds its place from its length and its rank among pieces of that length: ranks come from counts
per partition and length, so no length, however common, is gathered in one task.

Ids are those of the ``tokenizers`` library for the given file as it is loaded: the strings of its
added tokens (``<|endoftext|>``) become their one id; ``added=False`` takes them for ordinary text.
Byte-pair merging never crosses the borders of the file's pre-tokens, so the ids of each run between
spaces are kept in a bounded memo; runs not in it go through the same vocabulary in ``tiktoken``'s
merge loop, and very long runs through ``tokenizers`` itself.

Behaviour at the edges: a null text counts as empty and gives one piece, the end id; a null doc_id
stays null; repeated rows are packed each for itself; other columns are ignored; an empty table
gives an empty result. Texts are tokenized in segments of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import written

LENGTH, END_ID = 1024, 2
#: Runs kept in a worker's memo, and bytes of the longest run that tiktoken merges.
MEMO, LONG_RUN = 250_000, 512
#: Characters of a text that are tokenized at once.
SEGMENT = 2 << 20
#: Sweeps of coordinate descent, and the grid of the patterns of three.
SWEEPS, GRID = 40, 32

_UNSAFE = re.compile(r"\s (?!\S)")
_CUT = re.compile(r" (?=\S)")
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class RunIds(dict):
    """Ids (little-endian uint32 bytes) of runs of text, computed on first use.

    ``added`` tells whether strings of added tokens in a text become their ids.
    """

    def __init__(self, path: str, added: bool = False):
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self.exact = Tokenizer.from_file(path)
        tokens = self.exact.get_added_tokens_decoder()
        special = {t.content for t in tokens.values()}
        # plain ones part a text wherever they stand; others are left to the library, text by text
        self.of_added = {t.content: np.array([k], "<u4").tobytes() for k, t in tokens.items()} if added else {}
        self.split_at = re.compile("(" + "|".join(map(re.escape, sorted(self.of_added, key=len, reverse=True))) + ")") if self.of_added else None
        self.plain = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in tokens.values())
        self.untouched = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        to_byte = _byte_of_symbol(sorted(pre_tokenizers.ByteLevel.alphabet()))
        vocab = {bytes(to_byte[c] for c in token): k for token, k in self.exact.get_vocab().items() if token not in special}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.merged = tiktoken.Encoding("runs", pat_str=pattern, mergeable_ranks=vocab, special_tokens={}).encode_ordinary

    def __missing__(self, run: str) -> bytes:
        ids = self.merged(run) if len(run) <= LONG_RUN else self.exact.encode(run, add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        if len(run) <= LONG_RUN:
            if len(self) >= MEMO:
                self.clear()
            self[run] = packed
        return packed

    def ids(self, text: str) -> bytes:
        return b"".join(self.stream(text))

    def stream(self, text: str) -> Iterator[bytes]:
        """The ids of ``text``, segment by segment."""
        if self.split_at is None or not self.split_at.search(text):
            yield from map(self._segment, segments(text))
        elif not self.plain:
            yield np.array(self.untouched.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        else:
            for k, x in enumerate(self.split_at.split(text)):
                yield from [self.of_added[x]] if k % 2 else map(self._segment, segments(x))

    def _segment(self, text: str) -> bytes:
        # a space between white space is no border of pre-tokens: such texts are taken whole
        if _UNSAFE.search(text):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = text.split(" ")
        return (self[first] if first else b"") + b"".join([self[" " + x] for x in rest])


def _byte_of_symbol(alphabet: list[str]) -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others in order from U+0100."""
    shifted = [c for c in alphabet if ord(c) >= 256]
    plain = {ord(c) for c in alphabet if ord(c) < 256}
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | dict(zip(shifted, others))


def segments(text: str) -> Iterator[str]:
    """``text`` in pieces that end before a space followed by a non-space, a border of pre-tokens."""
    at = 0
    while len(text) - at > SEGMENT:
        cut = _CUT.search(text, at + SEGMENT)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_RUNS: dict[tuple[str, bool], RunIds] = {}


def run_ids(path: str, added: bool) -> RunIds:
    """The worker's memo for a vocabulary file."""
    return _RUNS[path, added] if (path, added) in _RUNS else _RUNS.setdefault((path, added), RunIds(path, added))


def _pieces(path: str, length: int, end_id: int, added: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = run_ids(path, added)
        part, seen, end = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "nth")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = runs.ids(text.as_py() or "") + end
                n = len(ids) // 4
                borders = [0, *range((n - 1) % length + 1, n + 1, length)]
                for k, (a, b) in enumerate(zip(borders, borders[1:])):
                    for name, value in (("doc_id", doc_id), ("piece", k), ("start", a), ("length", b - a), ("ids_crc32", zlib.crc32(ids[4 * a : 4 * b])), ("nth", int(seen[b - a]))):
                        out[name].append(value)
                    seen[b - a] += 1
            arrays = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(out["nth"]), pa.int32()), pa.array(out["nth"], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def patterns(counts: np.ndarray) -> list[tuple[int, ...]]:
    """Patterns of two pieces that fill a sequence, and of three on a grid of lengths, of lengths that occur."""
    size = len(counts) - 1
    have = counts > 0
    found = [(size - a, a) for a in range(1, size // 2 + 1) if have[a] and have[size - a]]
    for c in range(1, size // 3 + 1):
        for b in range(c, (size - c) // 2 + 1, GRID):
            if have[c] and have[b] and have[size - b - c]:
                found.append((size - b - c, b, c))
    return found


def fitted(counts: np.ndarray, found: list[tuple[int, ...]]) -> np.ndarray:
    """Repeat counts by non-negative least squares, by cyclic coordinate descent."""
    left, x = counts.astype(float), np.zeros(len(found))
    columns = [np.unique(p, return_counts=True) for p in found]
    norms = [float((m * m).sum()) for _, m in columns]
    for _ in range(SWEEPS):
        for k, (at, m) in enumerate(columns):
            step = max(-x[k], float(left[at] @ m) / norms[k])
            if step:
                x[k] += step
                left[at] -= step * m
    return x


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing over counts per length: (pattern, repeats)."""
    size = len(counts) - 1
    room: list[dict[tuple[int, ...], int]] = [{} for _ in range(size + 1)]

    def put(pattern: tuple[int, ...], free: int, n: int) -> None:
        room[free][pattern] = room[free].get(pattern, 0) + n

    for length in range(size, 0, -1):
        n = int(counts[length])
        for free in range(length, size):
            while n and room[free]:
                pattern, bins = room[free].popitem()
                each = free // length
                full = min(bins, n // each)
                if full:
                    put(pattern + (length,) * each, free - each * length, full)
                    n -= full * each
                if full < bins and n and n < each:
                    put(pattern + (length,) * n, free - n * length, 1)
                    n, full = 0, full + 1
                if full < bins:
                    put(pattern, free, bins - full)
            if not n:
                break
        each = size // length
        if n // each:
            put((length,) * each, size - each * length, n // each)
        if n % each:
            put((length,) * (n % each), size - n % each * length, 1)
    return [x for own in room for x in own.items()]


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that hold every piece counted in ``counts`` (index: length) exactly once."""
    left = counts.astype(np.int64).copy()
    done: list[tuple[tuple[int, ...], int]] = []
    found = patterns(left)
    x = fitted(left, found)
    for k in np.argsort(-x, kind="stable"):
        at, m = np.unique(found[k], return_counts=True)
        n = int(min(np.floor(x[k]), (left[at] // m).min()))
        if n > 0:
            done.append((found[k], n))
            left[at] -= n * m
    return done + best_fit(left)


class Slots:
    """Where the n-th piece of a length goes."""

    def __init__(self, planned: list[tuple[tuple[int, ...], int]], size: int = LENGTH):
        rows, base = [], 0
        for pattern, n in planned:
            offsets = np.cumsum((0, *pattern))[:-1].tolist()
            rows += [(length, n, base, offset) for length, offset in zip(pattern, offsets)]
            base += n
        rows.sort(key=lambda r: r[0])
        table = np.array(rows, np.int64).reshape(-1, 4)
        lengths, counts = table[:, 0], table[:, 1]
        before = np.cumsum(counts) - counts
        self.first = np.zeros(size + 2, np.int64)  # pieces of shorter lengths
        np.add.at(self.first, lengths + 1, counts)
        self.first = np.cumsum(self.first)
        self.before, self.base, self.offset, self.sequences = before, table[:, 2], table[:, 3], base

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.first[length] + rank
        k = np.searchsorted(self.before, at, side="right") - 1
        return self.base[k] + at - self.before[k], self.offset[k]


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, added: bool = True) -> DataFrame:
    """One row per piece of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    pieces = written(rows.mapInArrow(_pieces(tokenizer, length, end_id, added), PIECE), "pieces")
    per_part = written(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(length + 1, np.int64)
    for row in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row per length
        counts[row.length] = row.n
    slots = Slots(plan(counts), length)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a number per task that cut pieces and length, joined by merging: nothing here is broadcast
    before = per_part.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")).hint("merge")

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = slots.place(size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = pieces.join(before, ["part", "length"]).withColumn("slot", place("length", F.col("nth") + F.col("before")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "slot.sequence_id", "slot.offset")


def public_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
