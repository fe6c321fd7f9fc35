r"""Ranked lexical search: an impact-ordered index, evaluated score at a time.

Terms are the maximal runs of ASCII letters and digits and of all characters beyond ASCII; only
A-Z is lower-cased. A document of n terms (N documents with terms, L terms in all) has the measure
m = 10 + (90 n N) div L, and a term that it holds tf times has there the impact
(10**9 tf) div (1000 tf + 8 m). A term held by df documents weighs
w = floor(1000 ln((2 N + 2) / (2 df + 1))); a document's score is the sum of w times impact over the
query's different terms. All but w is integer arithmetic, so scores are exact.

``build`` cuts the documents into shards of bounded size, in the tasks that read them: nothing is
shuffled. A shard has a row per term, its postings grouped by exact impact, highest first, and one
row with its documents' ids. ``search`` reads the rows of the queries' terms, gathers each shard's
and works through every query's postings in descending order of weighted impact, all terms at once
and whole impacts at a time, adding to one accumulator per document. It stops only when what is left
can't change the set of the best k: when even the sum of the highest impacts that remain, on top of
the best document outside the set, stays below the worst inside. Then the scores of those k are
completed. A shard so returns k documents a query, of which Spark keeps the best k overall.

Shards are even whatever the documents: a common word has a row in each, and a group of copies,
however large, is dealt out with the documents around it. Queries go in blocks of bounded size, one
pass over the index's rows for each; only a block's terms are broadcast.

Behaviour at the edges: a null text has no terms; documents and queries without terms match
nothing; a row is a document or a query of its own, so repeated rows are ranked each for itself and
repeated queries answered each for itself; equal scores are ranked by doc_id, null last; other
columns are ignored; without documents or queries the result is empty.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import scratch, settled, words_of, written

BEST = 10
#: Postings and documents of a shard (the document that reaches a bound is its last), bytes of the terms of a block of queries.
POSTINGS, DOCUMENTS, BLOCK_BYTES = 1_000_000, 1 << 17, 8 << 20
#: Part of a query's postings that is worked through before the first look at the bounds; doubled each time.
FIRST_PART = 1 / 16
#: Tasks that shards are dealt out to, at most.
MOST_TASKS = 10_000

_TERM_BYTES = {*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", *range(128, 256)}
_FOLD = bytes(b if b in _TERM_BYTES else 32 for b in range(256)).lower()
INDEX = "shard long, term string, n int, levels array<int>, ends array<int>, docs array<int>, ids array<long>"
FOUND = "query long, doc_id long, score long"


def term_counts(data: bytes | None) -> Counter:
    """How often each term is in a UTF-8 text, which is taken in pieces of bounded size."""
    found: Counter = Counter()
    for terms in words_of((data or b"").translate(_FOLD)):
        found.update(terms)
    return found


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with terms, and terms, of each batch."""
    for batch in batches:
        n = [sum(map(len, words_of((t or b"").translate(_FOLD)))) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(k > 0 for k in n)]), pa.array([sum(n)])], ["docs", "terms"])


#: Bits of an impact, which is below a million, and of a document's number.
IMPACT_BITS, DOCUMENT_BITS = 20, DOCUMENTS.bit_length()


def in_order(term: np.ndarray, impact: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings by term, impact (descending) and document: as one number each, if that has room."""
    low = IMPACT_BITS + DOCUMENT_BITS
    if int(term.max()) >> (63 - low):
        order = np.lexsort((doc, -impact, term))
        return term[order], impact[order], doc[order]
    most = (1 << IMPACT_BITS) - 1
    key = (term << low) | ((most - impact) << DOCUMENT_BITS) | doc
    key.sort()
    return key >> low, most - (key >> DOCUMENT_BITS & most), key & ((1 << DOCUMENT_BITS) - 1)


class Shard:
    """Documents as they are read, made into rows of the index when there are enough."""

    def __init__(self, docs: int, terms: int):
        self.n_docs, self.n_terms = docs, terms
        self.number: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.measures: list[int] = []
        self.terms, self.tf, self.held = array("i"), array("i"), array("i")

    def add(self, doc_id: int | None, counts: Counter) -> None:
        self.ids.append(doc_id)
        # python's integers: the product may pass 64 bits
        self.measures.append(10 + 90 * sum(counts.values()) * self.n_docs // self.n_terms)
        number = self.number
        self.terms.extend([number.setdefault(t, len(number)) for t in counts])
        self.tf.extend(counts.values())
        self.held.append(len(counts))

    def full(self) -> bool:
        return len(self.terms) >= POSTINGS or len(self.ids) >= DOCUMENTS

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        # documents are numbered by doc_id, so that the lower number is the better of equals
        by_id = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] or 0))
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        yield self._batch(shard, ids=[self.ids[k] for k in by_id])
        names = sorted(self.number)
        rank = np.empty(len(names), np.int64)
        rank[[self.number[t] for t in names]] = np.arange(len(names))
        term, tf = rank[np.frombuffer(self.terms, np.int32)], np.frombuffer(self.tf, np.int32).astype(np.int64)
        held = np.frombuffer(self.held, np.int32)
        doc, m = np.repeat(place, held), np.repeat(np.array(self.measures, np.int64), held)
        term, impact, doc = in_order(term, 1_000_000_000 * tf // (1000 * tf + 8 * m), doc)
        first = np.searchsorted(term, np.arange(len(names) + 1))
        new = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(impact, prepend=-1))  # where a level begins
        ends = np.append(new[1:], len(term)) - first[term[new]]
        level = np.searchsorted(term[new], np.arange(len(names) + 1))
        for a in range(0, len(names), 1 << 15):
            b = min(a + (1 << 15), len(names))
            lists = [(impact[new], level), (ends, level), (doc, first)]
            yield self._batch(shard, names[a:b], np.diff(first[a : b + 1]), [(v[at[a] : at[b]], at[a : b + 1] - at[a]) for v, at in lists])

    @staticmethod
    def _batch(shard: int, names: list[bytes] | None = None, n: np.ndarray | None = None, lists: list[tuple] | None = None, ids: list | None = None) -> pa.RecordBatch:
        size, ints, longs = len(names) if names else 1, pa.list_(pa.int32()), pa.list_(pa.int64())
        if names is None:
            own = [pa.nulls(1, pa.string()), pa.array([len(ids)], pa.int32()), *[pa.nulls(1, ints)] * 3, pa.array([ids], longs)]
        else:
            own = [pa.array(names, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int32))]
            own += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v.astype(np.int32))) for v, at in lists] + [pa.nulls(size, longs)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(size, shard)), *own], ["shard", "term", "n", "levels", "ends", "docs", "ids"])


def _indexed(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, own = TaskContext.get().partitionId() << 32, Shard(n_docs, n_terms)
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if counts := term_counts(data.as_py()):
                    own.add(doc_id, counts)
                if own.full():
                    yield from own.rows(number)
                    number, own = number + 1, Shard(n_docs, n_terms)
        if own.ids:
            yield from own.rows(number)

    return run


class Index:
    """The written index of a table of documents, with N and L."""

    def __init__(self, table: DataFrame, n_docs: int, n_terms: int):
        self.table, self.n_docs, self.n_terms = table, n_docs, n_terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))


def build(docs: DataFrame) -> Index:
    """The index of ``docs`` (doc_id, text), a table in the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    n = rows.select("text").mapInArrow(_sizes, "docs long, terms long").agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = n[0] or 0, n[1] or 0
    return Index(written(rows.mapInArrow(_indexed(n_docs, n_terms), INDEX), "index"), n_docs, n_terms)


class Postings:
    """A term's postings in a shard: weighted impacts, descending, where each ends, and the documents."""

    def __init__(self, weight: int, levels: np.ndarray, ends: np.ndarray, docs: np.ndarray):
        self.impacts, self.ends, self.docs = levels.astype(np.int64) * weight, ends, docs
        self.sizes = np.diff(ends, prepend=0)

    def __len__(self) -> int:
        return len(self.docs)


def best(lists: list[Postings], n_docs: int, k: int) -> list[tuple[int, int]]:
    """(document, score) of the ``k`` best of a shard, score above 0, ties to the lower number."""
    score = np.zeros(n_docs, np.int64)
    done = [0] * len(lists)  # levels worked through, per term
    impacts, sizes = np.concatenate([x.impacts for x in lists]), np.concatenate([x.sizes for x in lists])
    order = np.argsort(-impacts, kind="stable")
    reached, total, part = np.cumsum(sizes[order]), int(sizes.sum()), FIRST_PART
    while True:
        least = impacts[order[min(np.searchsorted(reached, part * total), len(order) - 1)]]
        rest = 0
        for j, x in enumerate(lists):
            to = int(np.searchsorted(-x.impacts, -least, side="right"))
            if to > done[j]:
                a, b = x.ends[done[j] - 1] if done[j] else 0, x.ends[to - 1]
                score[x.docs[a:b]] += np.repeat(x.impacts[done[j] : to], x.sizes[done[j] : to])  # a document is there once
                done[j] = to
            rest += int(x.impacts[to]) if to < len(x.impacts) else 0
        if not rest:
            break
        if n_docs > k:
            inside, outside = np.partition(score, (n_docs - k, n_docs - k - 1))[[n_docs - k, n_docs - k - 1]]
            if inside > outside + rest:
                return _completed(lists, done, score, np.argpartition(score, n_docs - k)[n_docs - k :])
        part *= 2
    least = np.partition(score, n_docs - k)[n_docs - k] if n_docs > k else 0
    return _first(np.flatnonzero(score >= max(least, 1)), score, k)


def _completed(lists: list[Postings], done: list[int], score: np.ndarray, chosen: np.ndarray) -> list[tuple[int, int]]:
    """The scores of the ``chosen``, with what the lists still hold of them."""
    mark = np.zeros(len(score), bool)
    mark[chosen] = True
    for x, to in zip(lists, done):
        a = int(x.ends[to - 1]) if to else 0
        at = a + np.flatnonzero(mark[x.docs[a:]])
        score[x.docs[at]] += x.impacts[np.searchsorted(x.ends, at, side="right")]
    return _first(chosen, score, len(chosen))


def _first(docs: np.ndarray, score: np.ndarray, k: int) -> list[tuple[int, int]]:
    order = np.lexsort((docs, -score[docs]))[:k]
    return [(int(docs[j]), int(score[docs[j]])) for j in order if score[docs[j]] > 0]


def _searched(queries: list[tuple[int, list[str]]], weights: dict[str, int], k: int):
    """The best of one shard for each of the queries."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        terms, ids, lists = table["term"].to_pylist(), [], {}
        column = {c: table[c].combine_chunks() for c in ("levels", "ends", "docs", "ids")}
        value = lambda c, j: column[c][j].values.to_numpy()
        for j, term in enumerate(terms):
            if term is None:
                ids = column["ids"][j].as_py()
            else:
                lists[term] = Postings(weights[term], value("levels", j), value("ends", j), value("docs", j))
        out: list[tuple[int, int | None, int]] = []
        for query, own in queries:
            if mine := [lists[t] for t in own if t in lists]:
                out += [(query, ids[d], s) for d, s in best(mine, len(ids), k)]
        return pa.table([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], ["query", "doc_id", "score"])

    return run


def search(index: Index, items: DataFrame, k: int = BEST) -> DataFrame:
    """The ``k`` best documents for each row of ``items`` (item_id, text): item_id, rank, doc_id, score."""
    spark = items.sparkSession
    # numbers tell queries apart, for an id may have several; written, they stay as they are
    own = written(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(_terms_of, "item_id long, terms array<string>").withColumn("query", F.monotonically_increasing_id()), "queries")
    size = own.agg(F.sum(F.length(F.array_join("terms", " ")))).first()[0] or 0
    n_blocks, shards = -(-size // BLOCK_BYTES), index.table.where("term is null").count()
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(n_blocks):
        block = own.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == b)
        terms = F.broadcast(block.select(F.explode("terms").alias("term")).distinct())
        df = index.table.select("term", "n").join(terms, "term").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the block
        weights = {t: w for t, n in zip(df["term"].to_pylist(), df["n"].to_pylist()) if (w := index.weight(n)) > 0}
        queries = [(r["query"], r["terms"]) for r in block.select("query", "terms").toLocalIterator()]
        known = F.broadcast(spark.createDataFrame([(t,) for t in weights], "term string"))
        rows = index.table.join(known, "term", "left_semi").unionByName(index.table.where("term is null"))
        found = rows.repartition(max(1, min(shards, MOST_TASKS)), "shard").groupBy("shard").applyInArrow(_searched(queries, weights, k), FOUND)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        top = found.withColumn("rank", place).where(F.col("rank") <= k)
        out = out.unionByName(top.join(F.broadcast(block.select("query", "item_id")), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = [[t.decode() for t in term_counts(d)] for d in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["item_id", "terms"])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        index = build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
        return settled(search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), "ranked")


OP11_SQL = r"""
WITH split AS (
    SELECT 'd' AS side, row_number() OVER () AS row, CAST(doc_id AS BIGINT) AS id, text FROM documents
    UNION ALL SELECT 'i', row_number() OVER (), CAST(item_id AS BIGINT), text FROM benchmark
), terms AS (
    SELECT side, row, id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM split
), counts AS (SELECT row, id, term, count(*) AS tf FROM terms WHERE side = 'd' GROUP BY row, id, term),
sizes AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
measures AS (SELECT row, 10 + (90 * n * docs) // terms AS m FROM sizes, total),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counts, total GROUP BY term),
scores AS (
    SELECT q.row AS query, q.id AS item_id, c.row, c.id AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
    FROM (SELECT DISTINCT row, id, term FROM terms WHERE side = 'i') q JOIN counts c ON q.term = c.term
    JOIN weights g ON g.term = c.term JOIN measures x ON x.row = c.row GROUP BY q.row, q.id, c.row, c.id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 10
"""
