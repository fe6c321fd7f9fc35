r"""Katz back-off language model of any order, trained on and applied to a whole corpus.

Good-Turing discounts apply to counts up to ``K``, order by order; back-off weights make every
history's distribution sum to one exactly over the training vocabulary and one unknown word. A
token's probability is looked up recursively: the discounted gram of the highest order if it was
seen in training, else its history's back-off weight times the probability of the gram without its
first word, and so on down to the unigram, which itself backs off to the unknown word's share. A
text starts with one sign of its own: its first token is told from that alone.

Counts come from all training documents and the tables grow with them, so nothing of the model is
broadcast but global sums and the few hot histories. The tables of each order are partitioned by
hash and written to the shared folder. The plan:

1. Documents become chunks of bounded size. A chunk asks each partition for its distinct words.
2. A word partition adds up the training counts and answers every chunk with counts and word
   numbers (position in the partition times the number of partitions, plus the partition).
3. Order by order, chunks ask for their distinct grams whose history was seen in training; a
   partition holds all grams of a history, adds up counts, computes the back-off weight and answers
   every chunk, with numbers for the seen grams, which are histories of the next order. Hot
   histories (more than a share ``HOT`` of all tokens, and the start of a text) are dealt out by
   their next word instead; their partial sums, one row per history and partition, are added up at
   the end.
4. Chunks evaluate their tokens with the answers; documents that span chunks are added up.

A gram is sent once per chunk however often it occurs, so very common grams load no task. Requests
and answers are packed arrays, one row per chunk and partition; numbers have 64 bits. Each word or
gram partition is a task of its own. Words are told apart by their 64-bit XXH64.

Behaviour at the edges: a null text counts as empty, an empty text is the one token end; rows
without doc_id are scored, not learned from, and have a null held_out; repeated rows each count
and are each scored; without training documents every token is unknown with probability one; other
columns are ignored; an empty table gives an empty result. Long texts are cut into words, and
spread over chunks, piece by piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import new_path, scratch, settled, words_of

#: Order of the model that the query uses; trigrams need more disk than the check tool grants (README).
ORDER = 2
#: Greatest count that is discounted, share of tokens from which a history is hot, tokens in a chunk, text in a partition.
K, HOT, CHUNK_TOKENS, PART_BYTES = 5, 0.002, 1 << 20, 16 << 20
HELD_OUT = (5, 1)
END, START = b"\n", b"\n\n"  # no words, which hold no white space
START_ID = 1 << 62
ROW = "chunk long, part int, kind string, data binary, stats array<long>"
NAMES = ["chunk", "part", "kind", "data", "stats"]
_SCHEMA = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary()), ("stats", pa.list_(pa.int64()))])


# -- packed arrays -----------------------------------------------------------------------------


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string, byte planes apart, for small numbers leave most planes zero."""
    head, planes = [], []
    for a in arrays:
        a = np.ascontiguousarray(a)
        head += [len(a), ord(a.dtype.kind), a.dtype.itemsize]
        planes.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return np.array([len(arrays), *head], np.int64).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 3 * n, 8).reshape(n, 3)
    plain, at, out = zstandard.ZstdDecompressor().decompress(data[8 + 24 * n :], max_output_size=max(1, int((head[:, 0] * head[:, 2]).sum()))), 0, []
    for size, kind, width in head.tolist():
        planes = np.frombuffer(plain, np.uint8, size * width, at).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"{chr(kind)}{width}").ravel())
        at += size * width
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _SCHEMA.field(k).type) for k in range(5)], NAMES)


# -- the model ---------------------------------------------------------------------------------


class Discounts:
    """Katz discounts of counts 1 to K from the numbers n_1 .. n_(K+1) of items with such counts.

    Where Good-Turing gives no factor between 0 and 1 (small corpora), an absolute discount
    n_1 / (n_1 + 2 n_2) is taken off instead.
    """

    def __init__(self, n: np.ndarray):
        n = np.asarray(n, float)
        self.factor = np.ones(K + 1)
        absolute = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        common = (K + 1) * n[K] / n[0] if n[0] else 1.0
        for r in range(1, K + 1):
            good = (r + 1) * n[r] / (r * n[r - 1]) if n[r - 1] else 0.0
            d = (good - common) / (1 - common) if common < 1 else 0.0
            self.factor[r] = d if 0 < d < 1 else (r - absolute) / r

    def __call__(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts <= K, self.factor[np.minimum(counts, K)], 1.0)


class Unigrams:
    """Unigram probabilities: discounted, the rest for the one unknown word."""

    def __init__(self, tokens: int, types: int, n: list[int]):
        self.tokens, self.types, self.discount = tokens, types, Discounts(np.array(n))
        left = sum((1 - self.discount.factor[r]) * r * n[r - 1] for r in range(1, K + 1))
        self.total = tokens if left > 0 else tokens + 1
        self.unknown = (left if left > 0 else 1) / self.total

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discount(counts) * counts / self.total, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def backoff(kept: np.ndarray, lower: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight, denominator) of histories from the sums of discounted counts, of the unigram
    probabilities of the words seen after them, and of counts. A history that no discount leaves
    anything gets one more in its denominator."""
    denominator = np.where(total - kept > 1e-9, total, total + 1).astype(float)
    return (1 - kept / denominator) / (1 - lower), denominator


# -- pass 1: documents to chunks ---------------------------------------------------------------


class Chunk:
    """Documents, or pieces of long ones, as numbers of the chunk's distinct words."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids: list[np.ndarray] = []
        self.pieces: list[tuple[int, int, int, int, int]] = []  # row, doc_id, fold, words before, tokens
        self.size = 0

    def add(self, row: int, doc_id: int, kind: int, before: list[bytes], words: list[bytes]) -> None:
        known = self.known
        self.ids.append(np.array([known.setdefault(w, len(known)) for part in (before, words) for w in part], np.uint32))
        self.pieces.append((row, doc_id, kind, len(before), len(words)))
        self.size += len(words)

    def rows(self, chunk: int, parts: int) -> list[tuple]:
        ids = np.concatenate(self.ids)
        table = np.array(self.pieces, np.int64)
        words = np.array([xxhash.xxh64_intdigest(w) for w in self.known], np.uint64)
        counts = np.bincount(ids[learned_tokens(*table.T[2:])], minlength=len(words))
        part = (words % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((words, part))
        start = self.known.get(START, -1)
        out = [(chunk, 0, "chunk", pack(ids, order.astype(np.uint32), np.array([start], np.int64), *table.T), None)]
        ends = np.searchsorted(part[order], np.arange(parts + 1))
        out += [(chunk, p, "ask", pack(words[order[a:b]], counts[order[a:b]]), None) for p, (a, b) in enumerate(zip(ends, ends[1:])) if b > a]
        return out


def places_in_pieces(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """How far each token is into its piece, the words before it included."""
    size = before + tokens
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def learned_tokens(kind: np.ndarray, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return np.repeat(kind == 0, before + tokens) & (places_in_pieces(before, tokens) >= np.repeat(before, before + tokens))


def _ended(lists: Iterator[list[bytes]]) -> Iterator[list[bytes]]:
    """The lists that hold words, the last one followed by END."""
    last: list[bytes] = []
    for words in lists:
        if last and words:
            yield last
        last = words or last
    yield [*last, END]


def _chunks(parts: int, order: int):
    folds, held = HELD_OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, n, chunk = TaskContext.get().partitionId() << 36, TaskContext.get().partitionId() << 24, Chunk()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                # 0: learned from, 1: held out, 2: no id
                kind = 2 if doc_id is None else int(zlib.crc32(str(doc_id).encode()) % folds == held)
                before = [START]
                for words in _ended(words_of((text.as_py() or b"").lower())):
                    chunk.add(row, doc_id or 0, kind, before, words)
                    before = [*before, *words[1 - order :]][1 - order :]
                    if chunk.size >= CHUNK_TOKENS:
                        yield from (_rows([r]) for r in chunk.rows(n, parts))
                        n, chunk = n + 1, Chunk()
                row += 1
        if chunk.size:
            yield from (_rows([r]) for r in chunk.rows(n, parts))

    return run


# -- pass 2: word partitions -------------------------------------------------------------------


def _asked(table: pa.Table, kind: str) -> list[tuple[int, list[np.ndarray]]]:
    """(chunk or partition, arrays) of the rows of a kind, in order, so that sums have one order."""
    which = table["kind"].to_pylist()
    found = [(table["chunk"][i].as_py(), table["part"][i].as_py(), i) for i, k in enumerate(which) if k == kind]
    return [(c if kind in ("ask", "chunk") else p, unpack(table["data"][i].as_py())) for c, p, i in sorted(found)]


def _spectrum(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def _words(parts: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        asked = _asked(table, "ask")
        words, at = np.unique(np.concatenate([a[0] for _, a in asked]), return_inverse=True)
        counts = np.zeros(len(words), np.int64)
        np.add.at(counts, at, np.concatenate([a[1] for _, a in asked]))
        seen = counts > 0
        number = np.arange(len(words)) * parts + part
        rows = [(0, part, "words", pack(words[seen], counts[seen], number[seen]), [int(counts.sum()), int(seen.sum()), *_spectrum(counts)])]
        begin = 0
        for chunk, (own, _) in asked:
            mine = at[begin : begin + len(own)]
            begin += len(own)
            rows.append((chunk, part, "answer", pack(counts[mine], mine), None))
        return pa.Table.from_batches([_rows(rows)])

    return run


# -- pass 3: partitions of grams, order by order -----------------------------------------------


class Hot:
    """The hot histories of an order, by number, and, once known, their weights and denominators."""

    def __init__(self, numbers: list[int]):
        self.numbers = np.array(sorted(numbers), np.int64)
        self.weight, self.total = np.ones(len(numbers)), np.ones(len(numbers))

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``numbers`` are hot, where they are among the hot)."""
        at = np.searchsorted(self.numbers, numbers)
        at[at == len(self.numbers)] = 0
        return (self.numbers[at] == numbers if len(self.numbers) else np.zeros(len(numbers), bool)), at


class Grams:
    """A chunk's distinct grams of one order: places of their parts, then what partitions tell of them."""

    def __init__(self, of_token: np.ndarray, number: np.ndarray, counts: np.ndarray, p: np.ndarray):
        self.of_token, self.number, self.counts, self.p = of_token, number, counts, p
        self.total = np.zeros(len(counts))  # denominator of each gram's history


class Asking:
    """The grams of the next order, before anything is told of them; those of seen histories are asked for."""

    def __init__(self, chunk: Chunked, prev: Grams, parts: int, hot: Hot):
        valid = np.flatnonzero((chunk.place > 0) & (prev.of_token >= 0))
        valid = valid[prev.of_token[valid - 1] >= 0]
        history, word = prev.of_token[valid - 1].astype(np.int64), chunk.ids[valid].astype(np.int64)
        code, first, inverse = np.unique(history * len(chunk.words.number) + word, return_index=True, return_inverse=True)
        self.history, self.word = code // len(chunk.words.number), code % len(chunk.words.number)
        self.lower = prev.of_token[valid[first]]
        self.of_token = np.full(len(chunk.ids), -1, np.int32)
        self.of_token[valid] = inverse
        self.learned = np.bincount(inverse[chunk.learned[valid]], minlength=len(code))
        h, w = prev.number[self.history], chunk.words.number[self.word]
        self.is_hot, self.hot_at = hot.find(h)
        part = (mixed(np.where(self.is_hot, w, h)) % np.uint64(parts)).astype(np.int64)
        at = np.flatnonzero(h >= 0)
        self.at = at[np.lexsort((w[at], h[at], part[at]))]
        self.heads_of, self.words_of, self.parts, self.part = h, w, parts, part[self.at]
        self.prev, self.hot = prev, hot

    def parted(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(partition, grams asked of it, by history and word, where histories begin among them)."""
        ends = np.searchsorted(self.part, np.arange(self.parts + 1))
        for p, (a, b) in enumerate(zip(ends, ends[1:])):
            if b > a:
                at = self.at[a:b]
                yield p, at, np.flatnonzero(np.diff(self.heads_of[at], prepend=-1))

    def rows(self, chunk: int) -> list[tuple]:
        out = []
        for p, at, heads in self.parted():
            h, lower = self.heads_of[at][heads], self.lower[at]
            lengths = np.diff(heads, append=len(at))
            data = pack(np.diff(h, prepend=0), lengths.astype(np.uint32), self.words_of[at], self.learned[at].astype(np.uint32), self.prev.counts[lower], self.prev.total[lower].astype(np.int64))
            out.append((chunk, p, "ask", data, None))
        return out

    def told(self, told: dict[int, list[np.ndarray]], discount: Discounts) -> Grams:
        n = len(self.word)
        counts, number, p = np.zeros(n, np.int64), np.full(n, -1, np.int64), self.prev.p[self.lower].copy()
        # a history without training counts backs off whole
        weight, total = np.ones(n), np.ones(n)
        for part, at, heads in self.parted():
            c, steps, totals, weights = told[part]
            counts[at] = c
            some = at[c > 0]
            number[some] = np.cumsum(steps) * self.parts + part
            of = np.repeat(np.arange(len(heads)), np.diff(heads, append=len(at)))
            unseen = np.zeros(len(heads), bool)
            unseen[of[c == 0]] = True
            own = np.ones(len(heads))
            own[unseen] = weights
            weight[at], total[at] = own[of], totals[of]
        asked = self.heads_of >= 0
        weight[self.is_hot], total[self.is_hot] = self.hot.weight[self.hot_at[self.is_hot]], self.hot.total[self.hot_at[self.is_hot]]
        seen = counts > 0
        p[asked] *= weight[asked]
        p[seen] = discount(counts[seen]) * counts[seen] / total[seen]
        grams = Grams(self.of_token, number, counts, p)
        grams.total = total
        return grams


class Chunked:
    """A chunk's tokens and words, from the chunk and the answers of the word partitions."""

    def __init__(self, table: pa.Table, parts: int, unigrams: Unigrams):
        (_, stored), *_ = _asked(table, "chunk")
        self.ids, order, (start,), self.row, self.doc_id, self.kind, self.before, self.tokens = stored
        counts, number = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        begin = 0
        for part, (c, mine) in _asked(table, "answer"):
            own = order[begin : begin + len(c)]
            counts[own], number[own] = c, mine * parts + part
            begin += len(c)
        self.words = Grams(self.ids.astype(np.int32), number, counts, unigrams.p(counts))
        if start >= 0:
            number[start] = START_ID
        self.place = places_in_pieces(self.before, self.tokens)
        self.learned = learned_tokens(self.kind, self.before, self.tokens)
        self.known = np.where(counts > 0, number, -1)
        if start >= 0:
            self.known[start] = START_ID

    def grams(self, table: pa.Table, parts: int, hot: list[Hot], discounts: list[Discounts]) -> tuple[list[Grams], Grams]:
        """Grams of the orders told so far, words first, and the last of them."""
        # as histories, words count only if they were seen
        prev = Grams(self.words.of_token, self.known, self.words.counts, self.words.p)
        out = [prev]
        for order, discount in enumerate(discounts, 2):
            prev = Asking(self, prev, parts, hot[order - 2]).told(dict(_asked(table, f"told{order}")), discount)
            out.append(prev)
        return out, prev


def mixed(numbers: np.ndarray) -> np.ndarray:
    x = numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _ask(parts: int, unigrams: Unigrams, hot: list[Hot], discounts: list[Discounts]):
    """Requests for the order after those that ``discounts`` are of."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = Chunked(table, parts, unigrams)
        _, prev = chunk.grams(table, parts, hot, discounts)
        return pa.Table.from_batches([_rows(Asking(chunk, prev, parts, hot[len(discounts)]).rows(key[0].as_py()))])

    return run


def _grams(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """One row for a partition: its table of grams, and for each chunk what it asked for."""
    asked = _asked(table, "ask")
    heads, of_head = np.unique(np.concatenate([np.cumsum(a[0]) for _, a in asked]), return_inverse=True)
    words, of_word = np.unique(np.concatenate([a[2] for _, a in asked]), return_inverse=True)
    lengths = np.concatenate([a[1] for _, a in asked])
    code, first, at = np.unique((np.repeat(of_head, lengths).astype(np.uint64) << np.uint64(32)) | of_word.astype(np.uint64), return_index=True, return_inverse=True)
    counts = np.zeros(len(code), np.int64)
    np.add.at(counts, at, np.concatenate([a[3] for _, a in asked]))
    lower, lower_total = (np.concatenate([a[k] for _, a in asked])[first] for k in (4, 5))
    seen = counts > 0
    rank = np.cumsum(seen) - 1
    chunks = np.array([(c, len(a[2]), len(a[0])) for c, a in asked], np.int64)
    steps, begin = [], 0
    for n in chunks[:, 1]:
        own = at[begin : begin + n]
        steps.append(np.diff(rank[own[seen[own]]], prepend=0))
        begin += n
    data = pack(heads, words, code[seen], counts[seen], lower[seen], lower_total[seen], *chunks.T, counts[at], np.concatenate(steps), of_head.astype(np.uint32), lengths)
    return pa.Table.from_batches([_rows([(0, key[0].as_py(), "grams", data, _spectrum(counts))])])


def lower_p(counts: np.ndarray, total: np.ndarray, unigrams: Unigrams, below: Discounts | None) -> np.ndarray:
    """Probabilities of grams seen in training: discounted by their own order, or unigrams (``below``: none)."""
    return unigrams.p(counts) if below is None else below(counts) * counts / total


def history_sums(data: list[np.ndarray], unigrams: Unigrams, below: Discounts | None, discount: Discounts) -> tuple[np.ndarray, ...]:
    """Per history of a partition with seen grams: place, discounted counts, probability by the order below of the words seen, counts."""
    _, _, code, counts, lower, lower_total = data[:6]
    if not len(code):
        return (np.zeros(0, np.int64), *(np.zeros(0) for _ in range(3)))
    history = (code >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(history, prepend=-1))
    return history[at], np.add.reduceat(discount(counts) * counts, at), np.add.reduceat(lower_p(lower, lower_total, unigrams, below), at), np.add.reduceat(counts, at).astype(float)


def _hot_sums(unigrams: Unigrams, below: Discounts | None, discount: Discounts, hot: Hot):
    """A partition's sums for hot histories."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.column(0):
                data = unpack(row.as_py())
                place, *sums = history_sums(data, unigrams, below, discount)
                number = data[0][place]
                mine, _ = hot.find(number)
                yield pa.RecordBatch.from_arrays([pa.array(x[mine]) for x in (number, *sums)], ["history", "kept", "lower", "total"])

    return run


def _told(order: int, unigrams: Unigrams, below: Discounts | None, discount: Discounts):
    """A partition's answers: to each chunk its counts and numbers, each history's denominator, and
    the weight of histories with a gram that wasn't seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = unpack(row.as_py())
                heads, (chunks, sizes, n_heads, told, steps, of_head, lengths) = data[0], data[6:]
                place, *sums = history_sums(data, unigrams, below, discount)
                weight, total = np.ones(len(heads)), np.ones(len(heads))
                weight[place], total[place] = backoff(*sums)
                a, b, c = 0, 0, 0
                for chunk, n, m in zip(chunks.tolist(), sizes.tolist(), n_heads.tolist()):
                    own, mine = told[a : a + n], of_head[b : b + m]
                    unseen = np.add.reduceat(own == 0, np.cumsum(lengths[b : b + m], dtype=np.int64) - lengths[b : b + m], dtype=np.int64) > 0
                    s = int((own > 0).sum())
                    yield _rows([(chunk, part, f"told{order}", pack(own, steps[c : c + s], total[mine].astype(np.int64), weight[mine][unseen]), None)])
                    a, b, c = a + n, b + m, c + s

    return run


# -- pass 4: scores ----------------------------------------------------------------------------

SCORES = "row long, doc_id long, kind long, n_tokens long, n_known long, base_score double, score double"


def _scores(parts: int, unigrams: Unigrams, hot: list[Hot], discounts: list[Discounts]):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        chunk = Chunked(table, parts, unigrams)
        levels, _ = chunk.grams(table, parts, hot, discounts)
        p = levels[0].p[levels[0].of_token]
        for grams in levels[1:]:  # the highest order that a token has
            own = grams.of_token >= 0
            p[own] = grams.p[grams.of_token[own]]
        size = chunk.before + chunk.tokens
        starts, scored = np.cumsum(size) - size, chunk.place >= np.repeat(chunk.before, size)
        counts = chunk.words.counts[chunk.ids]
        add = lambda v: np.add.reduceat(np.where(scored, v, 0), starts)
        with np.errstate(divide="ignore"):
            logs = np.log10(p)
        out = {"row": chunk.row, "doc_id": chunk.doc_id, "kind": chunk.kind, "n_tokens": chunk.tokens, "n_known": add((counts > 0).astype(np.int64)), "base_score": add(unigrams.base(counts)), "score": add(logs)}
        return pa.table(out)

    return run


def _hot_numbers(least: float, parts: int):
    """Numbers of the words or grams with at least so many occurrences, from rows of either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = unpack(data.as_py())
                counts, number = (own[1], own[2]) if kind == "words" else (own[3], np.arange(len(own[3])) * parts + part)
                yield pa.RecordBatch.from_arrays([pa.array(number[counts >= least])], ["number"])

    return run


def _by_kind(rows: DataFrame, name: str) -> DataFrame:
    """A written table with a folder for each kind of row."""
    path = new_path(rows.sparkSession, name)
    rows.write.partitionBy("kind").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _sums(rows: DataFrame, n: int) -> list[int]:
    found = rows.agg(*[F.sum(F.element_at("stats", k + 1)) for k in range(n)]).first()
    return [int(x or 0) for x in found]


def scored(docs: DataFrame, order: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``order`` is that of the model, 2 or more. The result is a written table, the model's are removed.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    with scratch(docs.sparkSession):
        return settled(_scored(docs, order), "scores")


def _scored(docs: DataFrame, order: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    parts = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART_BYTES))
    by_part = lambda df: df.repartitionById(parts, F.col("part")).groupBy("part")
    first = _by_kind(rows.mapInArrow(_chunks(parts, order), ROW), "chunks")
    n_chunks = max(1, first.where("kind = 'chunk'").count())
    by_chunk = lambda df: df.repartition(n_chunks, "chunk").groupBy("chunk")
    words = _by_kind(by_part(first.where("kind = 'ask'")).applyInArrow(_words(parts), ROW), "words")
    held = words.where("kind = 'words'")
    tokens, types, *spectrum = _sums(held, K + 3)
    unigrams = Unigrams(tokens, types, spectrum)
    known = first.where("kind = 'chunk'").unionByName(words.where("kind = 'answer'"))
    hot: list[Hot] = []
    discounts: list[Discounts] = []
    for m in range(2, order + 1):
        # at most 1 / HOT of them
        frequent = held.select("part", "kind", "data").mapInArrow(_hot_numbers(max(1.0, HOT * tokens), parts), "number long").collect()
        hot.append(Hot([*([START_ID] if m == 2 else []), *(r[0] for r in frequent)]))
        held = _by_kind(by_part(by_chunk(known).applyInArrow(_ask(parts, unigrams, hot, discounts[:]), ROW)).applyInArrow(_grams, ROW), f"grams{m}")
        below, discount = discounts[-1] if discounts else None, Discounts(np.array(_sums(held, K + 1)))
        discounts.append(discount)
        partial = held.select("data").mapInArrow(_hot_sums(unigrams, below, discount, hot[-1]), "history long, kept double, lower double, total double")
        for r in partial.groupBy("history").agg(*[F.sum(c).alias(c) for c in ("kept", "lower", "total")]).collect():  # hot ones only
            k = int(np.searchsorted(hot[-1].numbers, r["history"]))
            (hot[-1].weight[k],), (hot[-1].total[k],) = backoff(np.array([r["kept"]]), np.array([r["lower"]]), np.array([r["total"]]))
        known = known.unionByName(held.select("part", "data").mapInArrow(_told(m, unigrams, below, discount), ROW))
    pieces = by_chunk(known).applyInArrow(_scores(parts, unigrams, hot, discounts), SCORES)
    whole = pieces.groupBy("row", "doc_id", "kind").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select(
        F.when(F.col("kind") < 2, F.col("doc_id")).alias("doc_id"), F.when(F.col("kind") < 2, F.col("kind") == 1).alias("held_out"), "n_tokens", "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), ORDER)
