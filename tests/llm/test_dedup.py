"""Near-duplicate operators against brute force."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.llm import embedding_dedup as E
from lectern.llm import simhash_dedup as S
from lectern.llm.common import components, hot_keys, scratch, settled, shared_dir, spread_join, words_of, written


def roots(ids, linked):
    """Smallest id reachable, by search over a function from place to places."""
    root, seen = dict.fromkeys(ids), set()
    for start in sorted(range(len(ids)), key=ids.__getitem__):
        stack = [start]
        while stack:
            k = stack.pop()
            if k not in seen:
                seen.add(k)
                root[ids[k]] = ids[start] if root[ids[k]] is None else root[ids[k]]
                stack += linked(k)
    return root


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(1000 + k, 1001 + k) for k in range(70)] + [(5000, k) for k in range(2000, 2300)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ids = sorted(near)
    place = {v: k for k, v in enumerate(ids)}
    assert got == roots(ids, lambda k: [place[x] for x in near[ids[k]]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\x1c\xa0", max_size=60))
def test_fingerprint(text):
    assert S.fingerprint(text.encode()) == plain_fingerprint(text)


def test_fingerprint_of_long_text_in_pieces(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(5000))
    whole = S.fingerprint(text.encode())
    monkeypatch.setattr("lectern.llm.common.SEGMENT_BYTES", 101)
    assert S.fingerprint(text.encode()) == whole == plain_fingerprint(text)
    assert [w for part in words_of(text.encode()) for w in part] == text.encode().split()


def test_trees_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "LEAF", 16)
    monkeypatch.setattr(S, "BLOCK", 64)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    near = base[rng.integers(0, 40, 1500)].copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    fps = np.unique(np.concatenate([base, near]))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components(S.links(df, len(fps))).collect()}
    ids = fps.view(np.int64).tolist()
    want = roots(ids, lambda k: np.flatnonzero(np.bitwise_count(fps ^ fps[k]) <= 4).tolist())
    assert all(got.get(i, i) == want[i] for i in ids) and len(got) > 500


def test_simhash_groups_and_edges(spark):
    text = " ".join(f"word{k}" for k in range(300))
    rows = [(5, text, "x"), (3, text, "y"), (9, text.upper(), None), (7, "", "a"), (8, None, "b"), (4, "other words altogether here now", "c"), (4, "other words altogether here now", "c"), (None, text, "d"), (None, "alone with nobody at all here", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 3), (7, 7), (8, 7), (4, 4), (4, 4), (None, 3), (None, None)], key=str)
    kept = S.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [3, 4, 7, None]
    assert S.near_duplicates(docs.limit(0)).count() == 0 and S.one_of_each(docs.limit(0)).count() == 0


def test_one_row_of_each_group_where_ids_repeat(spark):
    a, b, c, z, d = (" ".join(f"{sign}{k}" for k in range(300)) for sign in "abczd")
    fps = [S.fingerprint(x.encode()) for x in (a, b, c, z, d)]
    assert all((x ^ y).bit_count() > S.RADIUS for k, x in enumerate(fps) for y in fps[:k])
    rows = [(3, a), (5, a), (5, b), (5, b.upper()), (5, c), (6, c), (3, z), (7, z), (8, "single text of one row only"), (None, a), (None, a), (None, d), (None, d.upper()), (None, d)]
    kept = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.text.lower()) for r in kept), key=str)
    assert got == sorted([(3, a), (5, b), (5, c), (3, z), (8, "single text of one row only"), (None, d)], key=str)


def brute_vectors(x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    return hit


def test_embeddings_equal_brute_force_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 30)
    monkeypatch.setattr(E, "CELL", 60)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(25, 8))
    x = np.concatenate([base[rng.integers(0, 25, 400)] + rng.normal(size=(400, 8)) * 0.25, np.repeat(base[:1], 60, 0)]).astype(np.float32)
    rows = [(int(i), [float(v) for v in r], "z") for i, r in enumerate(x)]
    odd = [(9000, None), (9001, []), (9002, [0.0] * 8), (9003, [float("nan")] * 8), (9004, [1.0, None]), (9005, [1.0, 2.0]), (9006, [2.0, 4.0]), (9007, [float("inf")] * 8), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows + [(*o, "z") for o in odd], "vec_id long, embedding array<float>, n string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()}
    hit = brute_vectors(x.astype(float))
    want = roots(list(range(len(x))), lambda k: np.flatnonzero(hit[k]).tolist())
    assert all(got[k] == (hit[k].sum(), want[k], want[k] == k) for k in range(len(x)))
    assert all(got[k] == (0, k, True) for k in (9000, 9001, 9002, 9003, 9004, 9007))
    assert got[9005] == (1, 9005, True) and got[9006] == (1, 9005, False) and got[None] == (0, None, False)
    assert E.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("shift", [-1e-9, 1e-9])
def test_threshold_is_decided_in_double_precision(spark, shift):
    c = 0.95 + shift
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [c, float(np.sqrt(1 - c * c))])], "vec_id long, embedding array<double>")
    assert E.near_duplicates(df).where("n_links = 1").count() == (2 if shift > 0 else 0)


def test_repeated_vectors_are_linked(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0])] * 2 + [(2, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.n_links, r.component_id) for r in E.near_duplicates(df).orderBy("vec_id").collect()] == [(1, 2, 1), (1, 2, 1), (2, 2, 1)]


def test_different_vectors_of_one_id(spark):
    rows = [(3, [1.0, 0.0, 0.0]), (3, [0.0, 1.0, 0.0]), (2, [1.0, 0.01, 0.0]), (5, [0.0, 1.0, 0.01]), (3, [0.0, 0.0, 1.0])]
    got = E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got.collect()) == [(2, 1, 2, True), (3, 0, 3, True), (3, 1, 2, False), (3, 1, 3, True), (5, 1, 3, False)]


def test_components_of_a_star_and_a_long_chain(spark):
    star = spark.range(1, 1_000_001).select(F.lit(7_000_000).alias("a"), F.col("id").alias("b"))
    chain = spark.range(2_000_000, 2_000_700).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(star.unionByName(chain)).groupBy("root").agg(F.count("*").alias("n"), F.max("node").alias("last")).orderBy("root").collect()
    assert [tuple(r) for r in got] == [(1, 1_000_001, 7_000_000), (2_000_000, 701, 2_000_700)]


def test_hot_keys_meet_in_several_tasks(spark):
    many = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    one = spark.range(30_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    got = spread_join(many, one, "k", 20_000)
    assert got.count() == 20_000 and got.where("w <> 2 * k").count() == 0
    assert spread_join(many, one.where("k > 10"), "k", 20_000, "left").where("w is null").count() == many.where("k <= 10").count()
    (hot,) = hot_keys(many.groupBy("k").count(), 20_000).collect()
    assert hot["k"] == 5 and hot["_pieces"] > 20


def test_scratch_tables_are_removed(spark):
    import os

    at = f"{shared_dir(spark)}/lectern"
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    with scratch(spark):
        inner = settled(written(spark.range(5), "a").where("id > 2"), "b")
        with scratch(spark):
            own = settled(written(inner, "c"), "d")
        assert own.count() == 2
    assert set(os.listdir(at)) - before == {inner.inputFiles()[0].split("/")[-2]}


def test_one_of_each_takes_any_extra_column(spark):
    a, b = (" ".join(f"{sign}{k}" for k in range(200)) for sign in "ab")
    rows = [(1, a, "p", 1, 2), (5, a, "q", 3, 4), (5, b, "r", 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, _id int, mark int")
    for _ in range(2):
        assert sorted(tuple(r) for r in S.one_of_each(docs).collect()) == [rows[0], rows[2]]


def test_tiny_and_huge_components(spark):
    rows = [(1, [1e-200, 0.0]), (2, [3e-200, 1e-210]), (3, [1e300, 1e299]), (4, [1e-300, 1e-301]), (5, [0.0, 5e-324])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_many_centres_take_bounded_memory(spark):
    """16,384 centres of short vectors: no matrix of sample times centres, no more vectors than asked for."""
    import tracemalloc

    x = np.random.default_rng(8).normal(size=(65_536, 4))
    tracemalloc.start()
    centres = E.spherical_kmeans(E.unit(x), 16_384)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert centres.shape == (16_384, 4) and most < 200 << 20


def test_the_sample_of_k_means_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 10)
    monkeypatch.setattr(E, "SAMPLE", 500)
    rows = spark.range(20_000).selectExpr("7L AS vec_id", "id AS node", "array(cos(id), sin(id), 1.0D) AS embedding")
    assert len(E.centres_of(rows, 20_000)[3]) == 2000
    monkeypatch.setattr(E, "CENTRE_SIZE", 400)
    monkeypatch.setattr(E, "SAMPLE_SIZE", 4000)
    assert len(E.centres_of(rows, 20_000)[3]) == 100
    assert len(E.centres_of(rows.limit(1), 1)[3]) == 1 and E.centres_of(rows.limit(0), 0) == {}


@pytest.mark.parametrize("block", [16, 200])
def test_bundles_of_cells_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "CELL", 8)
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 12))
    x = np.concatenate([base[rng.integers(0, 60, 500)] + rng.normal(size=(500, 12)) * 0.2, rng.normal(size=(150, 12)), base[:1] + rng.normal(size=(150, 12)) * 0.1])
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_duplicates(df).collect()}
    hit = brute_vectors(x)
    want = roots(list(range(len(x))), lambda k: np.flatnonzero(hit[k]).tolist())
    assert got == {k: (hit[k].sum(), want[k]) for k in range(len(x))}


def test_threads_remove_their_own_tables_only(spark):
    import os
    import threading

    began, ended, told = threading.Event(), threading.Event(), []

    def other():
        with scratch(spark):
            kept = written(spark.range(3).toDF("v"), "theirs")
            began.set()
            ended.wait(60)
            told.append(kept.count())

    thread = threading.Thread(target=other)
    thread.start()
    began.wait(60)
    with scratch(spark):
        with scratch(spark):
            outer = settled(spark.range(2), "outer")
            inner = written(spark.range(2), "inner").inputFiles()[0].removeprefix("file:")
        assert outer.count() == 2 and not os.path.exists(inner)
        place = outer.inputFiles()[0].removeprefix("file:")
    ended.set()
    thread.join()
    assert told == [3] and not os.path.exists(place)
