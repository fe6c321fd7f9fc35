"""Best-fit-decreasing packing of tokenized documents into training sequences.

Documents become token ids plus an end id. Overlong ones are first cut into full windows; what is
left of them, and the shorter ones, are packed by best fit decreasing: a segment tree over the
remaining capacities of open windows finds the tightest one that holds a piece. Documents are packed
in shards of bounded size, in the tasks that read them: nothing is shuffled and no table is written
on the way. One shard's packing is the usual sequential algorithm; what it loses against packing all
documents at once is made good by what follows.

Sequences are padded to the full length unless their length is a power of two. Windows of a shard
that would be padded are topped up: the emptiest are taken apart, their pieces cut wherever a gap of
a fuller window ends. Less than one window of ids remains, which goes on to the task's next shard;
the last remainder of a task is cut into sequences of lengths that are powers of two. So no sequence
is padded, at the price of cutting some pieces; ``top_up=False`` leaves the windows as best fit
decreasing made them.

Ids are those of the ``tokenizers`` library for the file as it is loaded, as for pattern packing.

Behaviour at the edges: a null text counts as empty and gives one piece, the end id; a null doc_id
stays null; repeated rows are packed each for itself; other columns are ignored; an empty table
gives an empty result. Texts are tokenized in segments; full windows of a long document are told off
as they are made, so that only its remainder is held.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.pattern_packing import public_tokenizer, run_ids

LENGTH, END_ID = 1024, 0
#: Ids and pieces of a shard that aren't in full windows yet.
SHARD_IDS, SHARD_PIECES = 4 << 20, 200_000
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Which remaining capacities (0 to ``size``) open windows have: a segment tree of their numbers."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        k = self.leaves + capacity
        while k:
            self.count[k] += n
            k >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open window has."""
        k = self.leaves + need
        if self.count[k]:
            return need
        while k > 1 and (k & 1 or not self.count[k + 1]):  # up, until there is something to the right
            k >>= 1
        if k <= 1:
            return None
        k += 1
        while k < self.leaves:
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.leaves


def best_fit_decreasing(lengths: list[int], size: int = LENGTH) -> list[list[int]]:
    """Windows as lists of places of ``lengths``, each piece in the tightest window that holds it.

    A window that took a piece and still holds another of that length is then the tightest, so equal
    lengths are placed window by window.
    """
    tree, open_at = CapacityTree(size), [[] for _ in range(size + 1)]
    of_length: dict[int, list[int]] = {}
    for k, n in enumerate(lengths):
        of_length.setdefault(n, []).append(k)
    windows: list[list[int]] = []
    for n in sorted(of_length, reverse=True):
        left = of_length[n]
        at = 0
        while at < len(left):
            capacity = tree.tightest(n)
            if capacity is None:
                windows.append([])
                capacity, window = size, len(windows) - 1
            else:
                window = open_at[capacity].pop()
                tree.add(capacity, -1)
            take = min(capacity // n, len(left) - at)
            windows[window] += left[at : at + take]
            at += take
            open_at[capacity - take * n].append(window)
            tree.add(capacity - take * n, 1)
    return windows


def padded(n: int, size: int = LENGTH) -> bool:
    """Whether a sequence of ``n`` ids is padded."""
    return n < size and n & (n - 1) != 0


def gaps_filled(fills: list[int], size: int = LENGTH) -> tuple[list[int], list[int]]:
    """(receivers, donors) of windows of so many ids: as many of the fullest as the others can top up."""
    order = sorted(range(len(fills)), key=lambda k: (-fills[k], k))
    have, need, cut = sum(fills), 0, 0
    for k in order:
        if have - fills[k] < need + size - fills[k]:
            break
        have, need, cut = have - fills[k], need + size - fills[k], cut + 1
    return order[:cut], order[cut:]


class Packer:
    """A task's packer: takes documents, gives rows of PIECE."""

    def __init__(self, first_sequence: int, size: int = LENGTH, top_up: bool = True):
        self.sequence, self.size, self.top_up = first_sequence, size, top_up
        self.pieces: list[tuple] = []  # doc_id, start, ids, doc_tokens
        self.held = 0
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, parts: Iterator[bytes]) -> None:
        """A document, its ids in ``parts`` (little-endian, 32 bits each)."""
        window, start, rest, full = 4 * self.size, 0, b"", []
        for ids in parts:
            rest += ids
            for at in range(0, len(rest) - window + 1, window):
                full.append((start, zlib.crc32(rest[at : at + window])))
                start += self.size
            rest = rest[len(rest) // window * window :]
        n = start + len(rest) // 4
        for at, crc in full:
            self.rows.append((doc_id, at, self.size, crc, n, self._next(), 0))
        if rest:
            self.pieces.append((doc_id, start, rest, n))
            self.held += len(rest) // 4

    def full(self) -> bool:
        return self.held >= SHARD_IDS or len(self.pieces) >= SHARD_PIECES

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows

    def pack(self, last: bool) -> None:
        """Packs what is held; unless ``last``, what is left of it (less than a window) is held on."""
        lengths = [len(p[2]) // 4 for p in self.pieces]
        windows = [[self.pieces[k] for k in w] for w in best_fit_decreasing(lengths, self.size)]
        fills = [sum(len(p[2]) for p in w) // 4 for w in windows]
        whole = [k for k, n in enumerate(fills) if not (self.top_up and padded(n, self.size))]
        for k in whole:
            self._put(windows[k], self._next(), 0)
        short = sorted(set(range(len(windows))) - set(whole))
        receivers, donors = gaps_filled([fills[k] for k in short], self.size)
        stream = deque(p for k in donors for p in windows[short[k]])
        for k in receivers:
            sequence = self._next()
            self._put(windows[short[k]], sequence, 0)
            self._put(self._cut(stream, self.size - fills[short[k]]), sequence, fills[short[k]])
        left = sum(len(p[2]) for p in stream) // 4
        while left >= self.size:
            self._put(self._cut(stream, self.size), self._next(), 0)
            left -= self.size
        if last:
            while left:
                n = 1 << left.bit_length() - 1
                self._put(self._cut(stream, n), self._next(), 0)
                left -= n
        self.pieces, self.held = list(stream), left

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def _put(self, pieces: list[tuple], sequence: int, offset: int) -> None:
        for doc_id, start, ids, n in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset))
            offset += len(ids) // 4

    @staticmethod
    def _cut(stream: deque[tuple], n: int) -> list[tuple]:
        """Takes the first ``n`` ids off a stream of pieces."""
        own = []
        while n:
            doc_id, start, ids, total = stream.popleft()
            here = min(n, len(ids) // 4)
            own.append((doc_id, start, ids[: 4 * here], total))
            if 4 * here < len(ids):
                stream.appendleft((doc_id, start + here, ids[4 * here :], total))
            n -= here
        return own


def _packed(path: str, size: int, end_id: int, added: bool, top_up: bool):
    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in PIECE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, end = run_ids(path, added), np.array([end_id], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, size, top_up)

        def parts(text: str) -> Iterator[bytes]:
            yield from runs.stream(text)
            yield end

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, parts(text.as_py() or ""))
                if packer.full():
                    packer.pack(False)
                    yield batch_of(packer.taken())
            yield batch_of(packer.taken())
        packer.pack(True)
        yield batch_of(packer.taken())

    return run


def packed(docs: DataFrame, tokenizer: str, length: int = LENGTH, end_id: int = END_ID, added: bool = True, top_up: bool = True) -> DataFrame:
    """One row per piece of ``docs``: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_packed(tokenizer, length, end_id, added, top_up), PIECE)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizer())
