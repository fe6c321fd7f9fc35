"""Ranked search, best-fit packing and product codes against plain versions."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import best_fit, lexical_search, product_codes
from lectern.llm.common import scratch
from lectern.llm.pattern_packing import RunIds, public_tokenizer

# -- search ------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, k=10):
    """The contract, word for word."""
    held = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for row, (d, c) in enumerate(held):
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms if n_terms else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, row))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d, _) in enumerate(sorted(scores)[:k])]
    return out


def found(spark, docs, items, k=10):
    with scratch(spark):
        index = lexical_search.build(spark.createDataFrame(docs, "doc_id long, text string"))
        rows = lexical_search.search(index, spark.createDataFrame(items, "item_id long, text string"), k).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in rows), key=str)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aBZz09 é\x00\x1c\x7f\x80_-@[`{\n\xa0 İ", max_size=40))
def test_terms(text):
    assert lexical_search.term_counts(text.encode()) == Counter(t.encode() for t in terms(text))


def test_terms_of_a_long_text_in_pieces(monkeypatch):
    text = " ".join(f"W{k % 97}é" for k in range(5000)).encode()
    whole = lexical_search.term_counts(text)
    monkeypatch.setattr("lectern.llm.common.SEGMENT_BYTES", 101)
    assert lexical_search.term_counts(text) == whole and sum(whole.values()) == 5000


def test_order_of_postings():
    rng = np.random.default_rng(4)
    term, impact, doc = (rng.integers(0, n, 5000) for n in (300, 1_000_000, lexical_search.DOCUMENTS + 1))
    want = sorted(zip(term.tolist(), (-impact).tolist(), doc.tolist()))
    for shift in (0, 40):
        got = lexical_search.in_order(term << shift, impact, doc)
        assert [(t >> shift, -i, d) for t, i, d in zip(*(x.tolist() for x in got))] == want


def random_corpus(seed, n_docs, n_words, copies):
    rng = np.random.default_rng(seed)
    word = lambda: f"w{int(rng.zipf(1.3)) % n_words}"
    docs = [(int(k), " ".join(word() for _ in range(int(rng.integers(1, 60))))) for k in rng.permutation(n_docs)]
    docs += [(n_docs + k, docs[0][1]) for k in range(copies)]
    return docs, [(k, " ".join(word() for _ in range(int(rng.integers(1, 20))))) for k in range(25)]


@pytest.mark.parametrize("postings", [50, 1_000_000])
def test_search_equals_plain_ranking(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    docs, items = random_corpus(postings, 400, 300, 60)
    assert found(spark, docs, items) == sorted(ranked(docs, items), key=str)


def test_search_in_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 200)
    docs, items = random_corpus(3, 80, 50, 15)
    assert found(spark, docs, items, 3) == sorted(ranked(docs, items, 3), key=str)


def test_search_edges(spark):
    docs = [(5, None), (4, ""), (None, "Apple pie"), (3, "apple PIE"), (3, "apple pie"), (2, "--\x00"), (1, "straße"), (9, "x" * 100_000), (10, "plum")]
    items = [(1, "apple apple"), (1, "pie"), (None, "STRASSE straße"), (2, None), (3, ""), (4, "unseen"), (5, "x" * 100_000)]
    got = found(spark, docs, items)
    assert got == sorted(ranked(docs, items), key=str) and len(got) == 8
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, " ")], items) == []
    extra = spark.createDataFrame([(1, "a", 2, 3)], "doc_id long, text string, term int, shard int")
    with scratch(spark):
        assert lexical_search.search(lexical_search.build(extra), spark.createDataFrame([(7, "A b", 1)], "item_id int, text string, query int")).collect() == [(7, 1, 1, 287 * (10**9 // 1800))]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 12), st.integers(1, 300), st.integers(1, 12))
def test_stopping_early_changes_nothing(seed, n_lists, n_docs, k):
    rng = np.random.default_rng(seed)
    score, lists = np.zeros(n_docs, np.int64), []
    for _ in range(n_lists):
        docs = rng.permutation(n_docs)[: rng.integers(1, n_docs + 1)]
        impact = rng.integers(1, 40, len(docs)) ** int(rng.integers(1, 4))
        order = np.lexsort((docs, -impact))
        docs, impact, weight = docs[order], impact[order], int(rng.integers(1, 9))
        score[docs] += impact * weight
        last = np.append(np.flatnonzero(np.diff(impact)), len(docs) - 1)
        lists.append(lexical_search.Postings(weight, impact[last], last + 1, docs))
    want = sorted((-int(s), d) for d, s in enumerate(score) if s)[:k]
    assert lexical_search.best(lists, n_docs, k) == [(d, -s) for s, d in want]


# -- best fit ----------------------------------------------------------------------------------


def plain_best_fit(lengths, size):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [(f, k) for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits)[1]] -= n
        else:
            free.append(size - n)
    return sorted(free)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120))
def test_windows_are_those_of_best_fit_decreasing(lengths):
    windows = best_fit.best_fit_decreasing(lengths, 64)
    assert sorted(k for w in windows for k in w) == list(range(len(lengths)))
    assert sorted(64 - sum(lengths[k] for k in w) for w in windows) == plain_best_fit(lengths, 64)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 50)), st.integers(0, 50))
def test_tightest_capacity(have, need):
    tree = best_fit.CapacityTree(50)
    for c in have:
        tree.add(c, 2)
    assert tree.tightest(need) == min((c for c in have if c >= need), default=None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=60), st.sampled_from([7, 64]), st.integers(20, 2000), st.booleans())
def test_a_task_packs_every_id_once_without_padding(lengths, size, shard, top_up):
    best = best_fit.SHARD_IDS
    best_fit.SHARD_IDS = shard
    try:
        packer, at, ids = best_fit.Packer(5, size, top_up), 1, []
        for k, n in enumerate(lengths):
            ids.append(np.arange(at, at + n, dtype="<u4").tobytes())
            at += n
            packer.add(k, iter([ids[-1][: 4 * (n // 3)], ids[-1][4 * (n // 3) :]]))
            if packer.full():
                packer.pack(False)
        packer.pack(True)
    finally:
        best_fit.SHARD_IDS = best
    covered, ends = defaultdict(int), defaultdict(int)
    rows = packer.taken()
    for doc, start, n, crc, total, _, _ in sorted(rows):
        assert start == covered[doc] and total == lengths[doc] and n > 0 and crc == zlib.crc32(ids[doc][4 * start : 4 * (start + n)])
        covered[doc] += n
    assert dict(covered) == dict(enumerate(lengths))
    for _, _, n, _, _, sequence, offset in sorted(rows, key=lambda r: r[5:]):
        assert sequence >= 5 and offset == ends[sequence]
        ends[sequence] += n
    assert all(n <= size and not (top_up and best_fit.padded(n, size)) for n in ends.values())


def checked_sequences(rows, size=1024):
    """Gapless sequences; how many ids of padding they have by the rule, and how many they are."""
    own = defaultdict(list)
    for r in rows:
        own[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for places in own.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= size
        padding += size - at if best_fit.padded(at, size) else 0
    return padding, len(own)


def test_documents_are_packed_whole_and_without_padding(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    rows = best_fit.packed(docs, public_tokenizer()).collect()
    runs, texts, at = RunIds(public_tokenizer(), added=True), {r.doc_id: r.text for r in docs.collect()}, defaultdict(int)
    ids = {d: runs.ids(t or "") + bytes(4) for d, t in texts.items()}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) // 4
        at[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * at[r.doc_id]])
    assert {d: len(x) // 4 for d, x in ids.items()} == dict(at)
    padding, n = checked_sequences(rows)
    assert padding == 0 and n <= -(-sum(at.values()) // 1024) + 3 * 10
    left = best_fit.packed(docs, public_tokenizer(), top_up=False).collect()
    assert checked_sequences(left)[0] > 0 and sum(r.length for r in left) == sum(at.values())


def test_packing_by_best_fit_edges(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "x y z"), (3, "x y z"), (4, "word " * 30_000), (5, "a<|endoftext|>b")]
    docs = spark.createDataFrame([(*r, 1, "o") for r in rows], "doc_id long, text string, start int, offset string").coalesce(1)
    got = best_fit.packed(docs, public_tokenizer()).collect()
    assert checked_sequences(got)[0] == 0
    n = Counter()
    for r in got:
        n[r.doc_id] += r.length
    assert n[1] == n[2] == 1 and n[None] == 3 and n[3] == 8 and n[4] == 30_002 and n[5] == 4
    assert best_fit.packed(docs.limit(0), public_tokenizer()).count() == 0


# -- product codes -----------------------------------------------------------------------------


def plain_codes(vectors, entries=64, rounds=2, parts=16):
    """(codes, errors, codebooks) by measuring everything, of integer vectors in order of vec_id."""
    x = np.array(vectors, object).reshape(len(vectors), parts, -1)
    books = [[list(v[p]) for v in x[:entries]] for p in range(parts)]
    far = lambda a, b: sum((int(i) - int(j)) ** 2 for i, j in zip(a, b))
    for k in range(rounds + 1):
        near = [[min((far(v[p], c), j) for j, c in enumerate(books[p])) for p in range(parts)] for v in x]
        if k < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [v[p] for v, n in zip(x, near) if n[p][1] == j]
                    if own:
                        books[p][j] = [sum(int(v[i]) for v in own) // len(own) for i in range(len(own[0]))]
    return [bytes(j for _, j in n).hex() for n in near], [sum(d for d, _ in n) for n in near], books


def coded(spark, rows, kind="array<double>", **more):
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label string").repartition(3)
    return product_codes.coded(df, **more).collect()


@pytest.mark.parametrize("seed, scale, n", [(1, 0.01, 300), (2, 1.0, 150), (3, 40.0, 90), (4, 0.02, 40)])
def test_codes_equal_plain_lloyd(spark, seed, scale, n):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(0, scale, (n, 32)), np.repeat(rng.normal(0, scale, (1, 32)), 20, 0)])
    labels = [None if k % 3 == 0 else f"{k % 4}" for k in range(len(x))]
    got = {r.vec_id: r for r in coded(spark, [(k, v.tolist(), label) for k, (v, label) in enumerate(zip(x, labels))], entries=64)}
    codes, errors, books = plain_codes(np.floor(256 * x).astype(int))
    assert [got[k].code for k in range(len(x))] == codes and [got[k].error for k in range(len(x))] == errors
    sums = Counter()
    for label, e in zip(labels, errors):
        sums[label] += e
    assert all(got[k].label_error == sums[labels[k]] for k in got)
    assert {r.codebooks_sha256 for r in got.values()} == {product_codes.digest(np.array(books, np.int64))}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 40), st.sampled_from([3, 300, 1 << 22]))
def test_bounds_change_no_assignment(seed, width, k, size):
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-size, size, (200, width)), rng.integers(-size, size, (k, width))
    bounds = product_codes.Bounds.measured(x, books)
    for _ in range(3):
        assert (bounds.codes == product_codes.distances(x, books).argmin(1)).all()
        new = books + rng.integers(-1 - size // 50, 2 + size // 50, books.shape) * rng.integers(0, 2, (k, 1))
        bounds = product_codes.Bounds.restored(*bounds.stored())
        bounds.assign(x, books, new)
        books = new
        exact = np.sqrt(product_codes.distances(x, books))
        assert (bounds.lower <= exact).all() and (bounds.upper >= exact.min(1)).all()


def test_bounds_spare_most_distances():
    rng = np.random.default_rng(5)
    centres = rng.integers(-2000, 2000, (32, 4))
    x = centres[rng.integers(0, 32, 5000)] + rng.integers(-30, 30, (5000, 4))
    bounds = product_codes.Bounds.restored(*product_codes.Bounds.measured(x, centres).stored())
    assert bounds.assign(x, centres, centres + rng.integers(-3, 4, centres.shape)) < 0.05 * x.size / 4 * 32


def test_codes_edges(spark):
    one = [float(k) for k in range(16)]
    rows = [(1, one, "a"), (1, one[::-1], "a"), (2, None, "a"), (3, [*one[:15], None], "a"), (4, [*one[:15], float("nan")], "a"), (5, [*one[:15], float("inf")], "a"), (None, one, None), (7, [1.0] * 20, ""), (8, [], "b"), (9, [1e300] * 16, "null")]
    got = sorted(coded(spark, rows), key=lambda r: (r.vec_id is None, r.vec_id or 0, r.code))
    assert [r.vec_id for r in got] == [1, 1, 7, 8, 9, None] and all(r.error == 0 == r.label_error for r in got)
    few = {r.vec_id: r for r in coded(spark, rows[7:], entries=2, rounds=1)}
    assert few[7].code != few[8].code and few[9].error > 10**12
    assert coded(spark, rows[2:6]) == [] and coded(spark, []) == []
    plain = spark.createDataFrame([(1, one, 3)], "vec_id int, embedding array<float>, parts int")
    assert [r.label_error for r in product_codes.coded(plain).collect()] == [0]


@pytest.mark.parametrize("ids", [[-(2**63), 2**63 - 1, 0, 5, 6], [7] * 5, [10**15 + k for k in range(5)]])
def test_first_entries_are_the_smallest_ids(spark, ids):
    rows = [(i, [float(k)] * 16) for k, i in enumerate(ids)] * 2
    books = product_codes.starting(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), 4)
    want = sorted((i, v[0]) for i, v in rows)[:4]
    assert books[0, :, 0].tolist() == [int(256 * v) for _, v in want]
