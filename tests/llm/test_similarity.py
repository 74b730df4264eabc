"""Operators 5, 6 and 10 against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.llm import multiindex, ngrams, topk
from reelquery.llm.queries import QUERIES
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_op5_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(256 * np.array([r[1] for r in rows], dtype=np.float64)).astype(np.int64)
    ids = np.array([r[0] for r in rows])
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q]
        order = [i for i in np.lexsort((ids, -s)) if i != q][:5]
        want |= {(int(ids[q]), k + 1, int(ids[i]), int(s[i])) for k, i in enumerate(order)}
    assert {tuple(r) for r in QUERIES["op5_topk"](spark, SF).collect()} == want


def test_op5_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [0.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0]), (1, [1.0, 0.0]), (50, [])]
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], "vec_id long, embedding array<float>, score string")
    v = topk.valid(df)
    got = [tuple(r) for r in topk.top_k(v.filter("vec_id % 50 = 0"), v).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, 65536), (0, 4, None, 65536), (0, 5, 6, 0)]
    assert topk.top_k(v.limit(0), v).count() == 0


def test_op5_large_components(spark):
    """Integers of any size, against Python's own."""
    rng = np.random.default_rng(12)
    for scale in (1e8, 3e38, 1e300):
        v = rng.normal(size=(300, 6)) * np.where(rng.random((300, 6)) < 0.5, scale, 1.0)
        v[10:20] = v[0]
        v[7] = [scale, 0, 0, 0, 0, 0]
        df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "vec_id long, embedding array<double>")
        x = [[math.floor(256 * Fraction(c)) for c in r] for r in v.tolist()]
        want = []
        for q in range(0, 300, 50):
            s = [sum(a * b for a, b in zip(x[q], r, strict=True)) for r in x]
            best = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
            want += [(q, k + 1, i, min(max(s[i], -(2**63)), 2**63 - 1)) for k, i in enumerate(best)]
        t = topk.valid(df)
        assert sorted(tuple(r) for r in topk.top_k(t.filter("vec_id % 50 = 0"), t).collect()) == want


def test_lists_are_exact():
    rng = np.random.default_rng(3)
    for n, d in ((500, 8), (3000, 16), (300, 1)):
        x = rng.integers(-40, 40, (n, d))
        x[rng.integers(0, n, n // 3)] = x[0]
        lists = topk.Lists(np.arange(n), x)
        for q in (x[0], rng.integers(-5, 5, d), np.zeros(d, np.int64)):
            s = x @ q
            order = [i for i in np.lexsort((np.arange(n), -s)) if i != 3][:5]
            ids, score = lists.best(q, 5, 3)
            assert ids.tolist() == order and score.tolist() == s[order].tolist()


def check_vectors(spark, ids, vectors):
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r for r in multiindex.near_duplicates(df).collect()}
    links = brute.cosine_links(np.array(vectors, np.float32))
    n = np.bincount(np.array(links).ravel(), minlength=len(ids)) if links else np.zeros(len(ids), int)
    comp = brute.smallest_reachable(ids, links)
    found = sum(r["n_links"] for r in got.values())
    assert found >= 0.99 * n.sum() and all(got[i]["n_links"] <= k for i, k in zip(ids, n.tolist(), strict=True))
    if found == n.sum():
        assert [got[i]["component_id"] for i in ids] == comp
    return found, n.sum()


def test_op6_planted(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    near = base[rng.integers(0, 400, 300)] + rng.normal(size=(300, 16)) * 0.08
    hot = base[0] + rng.normal(size=(1500, 16)) * 0.05
    v = np.vstack([base, near, hot, np.tile(base[1], (50, 1)), base[1] * 2])
    found, there = check_vectors(spark, list(range(10, 10 + len(v))), v.tolist())
    assert there > 10_000


def test_op6_calibration_without_links(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(multiindex.SAMPLE, 64))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    grid = multiindex.Grid(m, 200)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(m[:3000].tolist())], "class_id long, embedding array<double>")
    probes, _ = multiindex.calibrate(df.withColumn("copies", F.lit(1).cast("long")), grid, m, np.arange(len(m)))
    u = rng.normal(size=(1000, 64))
    a = m[5000:6000]
    u -= (u * a).sum(1, keepdims=True) * a
    b = 0.9 * a + 0.19**0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
    of_a, of_b = grid.visits(a, probes), grid.visits(b, probes)
    found = (of_a == of_b[:, :1]).any(axis=1) | (of_b == of_a[:, :1]).any(axis=1)
    assert found.mean() >= multiindex.TARGET


def test_op6_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("inf"), 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (None, [1.0, 0.0]), (8, [1.0]), (9, [0.0, 1.0]), (1, [1.0, 0.0]), (10, []), (11, [2.5]), (12, [-2.5])]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "vec_id long, embedding array<float>, n_links int")
    got = sorted((tuple(r) for r in multiindex.near_duplicates(df).collect()), key=str)
    linked = {r[0]: r for r in got}
    assert len(got) == len(rows)
    assert linked[1][1:] == (4, 1, True) and linked[2][1:] == (4, 1, False) and linked[7][1:] == (4, 1, False) and linked[None][1:] == (4, 1, True)
    assert linked[8][1:] == (1, 8, True) and linked[11][1:] == (1, 8, False)
    assert all(linked[i][1] == 0 and linked[i][2] == i and linked[i][3] for i in (3, 4, 5, 6, 9, 10, 12))
    assert multiindex.near_duplicates(df.limit(0)).count() == 0


def test_op6_lengths_and_shared_ids(spark):
    rng = np.random.default_rng(15)
    vectors = []
    for d, n in ((3, 900), (2, 40), (1, 6), (5, 700)):
        base = rng.normal(size=(n // 3 + 1, d))
        vectors += (base[rng.integers(0, len(base), n)] + rng.normal(size=(n, d)) * 0.03).astype(np.float32).tolist()
    # a table of mixed lengths, where half of the ids are shared by vectors that have nothing in common
    ids = [i // 2 * 2 for i in range(len(vectors))]
    order = rng.permutation(len(vectors))
    vectors = [vectors[i] for i in order]
    df = spark.createDataFrame(list(zip(ids, vectors, strict=True)), "vec_id long, embedding array<float>")
    links = []
    for d in (1, 2, 3, 5):
        at = [i for i, v in enumerate(vectors) if len(v) == d]
        links += [(at[a], at[b]) for a, b in brute.cosine_links([vectors[i] for i in at])]
    n = np.bincount(np.array(links).ravel(), minlength=len(ids))
    name = brute.smallest_reachable(ids, links)
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in multiindex.near_duplicates(df).collect())
    want = sorted(zip(ids, n.tolist(), name, strict=True))
    found = sum(g[1] for g in got)
    assert found >= 0.99 * n.sum() and (found < n.sum() or got == want)


def test_multi_sequence_order():
    rng = np.random.default_rng(16)
    m = rng.normal(size=(400, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    grid = multiindex.Grid(m, 9)
    d1, d2 = grid.distances(m)
    every = np.sort((d1[:, :, None] + d2[:, None, :]).reshape(len(m), -1), axis=1)
    for probes in (1, 7, 81, 200):
        got = grid.visits(m, probes)
        d = d1[np.arange(len(m))[:, None], got // 9] + d2[np.arange(len(m))[:, None], got % 9]
        assert np.allclose(d, every[:, :probes]) and all(len(set(r)) == got.shape[1] for r in got.tolist())


def near_texts(rng, n=120):
    words = ["w%d" % i for i in range(400)]
    out = []
    for _ in range(n):
        t = [words[i] for i in rng.integers(0, 400, rng.integers(20, 200))]
        out.append(t)
        for _ in range(rng.integers(0, 4)):
            u = list(t)
            for _ in range(rng.integers(0, 4)):
                u[rng.integers(0, len(u))] = words[rng.integers(0, 400)]
            out.append(u)
    return [" ".join(t) for t in out]


def check_texts(spark, ids, texts):
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in ngrams.near_duplicates(df).collect()}
    links = brute.jaccard_links(texts)
    n = np.bincount(np.array(links).ravel(), minlength=len(ids)) if links else np.zeros(len(ids), int)
    assert {i: got[i]["n_links"] for i in ids} == dict(zip(ids, n.tolist(), strict=True))
    assert {i: got[i]["class_id"] for i in ids} == dict(zip(ids, brute.smallest_reachable(ids, links), strict=True))
    return len(links)


def test_op10_planted(spark):
    assert check_texts(spark, list(range(100, 100 + len(t))), t) > 50 if (t := near_texts(np.random.default_rng(8))) else False


def test_op10_hot_group(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "SMALL", 20)
    monkeypatch.setattr(ngrams, "BLOCK", 16)
    rng = np.random.default_rng(9)
    base = ["w%d" % i for i in rng.integers(0, 500, 150)]
    texts = near_texts(rng, 20)
    for i in range(90):
        u = list(base)
        for _ in range(i % 3):
            u[rng.integers(0, 150)] = "x%d" % rng.integers(0, 900)
        texts.append(" ".join(u))
    assert check_texts(spark, list(range(len(texts))), texts) > 1000


def test_op10_large_group(spark):
    """5,000 near copies with the real sizes of nodes and blocks, against all pairs."""
    rng = np.random.default_rng(19)
    base = [f"w{i}" for i in rng.integers(0, 5000, 130)]
    texts = []
    for i in range(5000):
        u = list(base)
        for _ in range(rng.choice([0, 1, 1, 1, 2, 3])):
            u[rng.integers(0, len(u))] = f"x{rng.integers(0, 3000)}"
        texts.append(" ".join(u))
    texts += near_texts(rng, 40)
    sets = brute.word_sets(texts)
    number = {}
    rows, cols = zip(*[(i, number.setdefault(g, len(number))) for i, s in enumerate(sets) for g in s], strict=True)
    both, rows, cols = np.zeros((len(texts), len(texts)), np.float32), np.array(rows), np.array(cols)
    for lo in range(0, len(number), 4000):
        m = np.zeros((len(texts), 4000), np.float32)
        at = (cols >= lo) & (cols < lo + 4000)
        m[rows[at], cols[at] - lo] = 1
        both += m @ m.T
    size = np.diagonal(both)
    links = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-3
    np.fill_diagonal(links, False)
    name = np.arange(len(texts))
    while True:
        low = np.minimum(name, np.where(links, name[None, :], len(name)).min(axis=1))
        if (low == name).all():
            break
        name = low
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in ngrams.near_duplicates(df).collect())
    assert got == list(zip(range(len(texts)), links.sum(axis=1).tolist(), name.tolist(), strict=True))


def sketches_around(rng, center, n, own):
    """n sketches that differ from a center in ``own`` coordinates drawn for each."""
    sk = np.tile(center, (n, 1))
    for row in sk:
        at = rng.choice(ngrams.T, own, replace=False)
        row[at] = rng.integers(0, 1 << 32, own)
    return sk


def of_sketches(spark, sk, node=5):
    return spark.createDataFrame([(node, i, x.tobytes()) for i, x in enumerate(sk)], "node long, id long, sketch binary")


def test_op10_passage_shared_by_many(spark):
    """Where no class ends at the pivot, none is written as a candidate of such: only children are made."""
    rng = np.random.default_rng(21)
    large = of_sketches(spark, sketches_around(rng, rng.integers(0, 1 << 32, ngrams.T).astype(np.uint32), 1500, 36))
    assert ngrams.around(large.join(ngrams.pivots(large), "node")).filter("kind < 2").count() == 0


def test_op10_nodes_in_one_task(spark):
    """A node of some hundred classes, put around pivots first, joins what brute force over the estimates joins."""
    rng = np.random.default_rng(22)
    center = rng.integers(0, 1 << 32, (3, ngrams.T)).astype(np.uint32)
    sk = np.concatenate([sketches_around(rng, center[0], 400, 6), sketches_around(rng, center[0], 150, 17), sketches_around(rng, center[1], 200, 5), sketches_around(rng, center[2], 200, 40)])
    sk = sk[rng.permutation(len(sk))]
    agree = sum((sk[:, j][:, None] == sk[:, j][None, :]).astype(int) for j in range(ngrams.T))
    want = brute.smallest_reachable(list(range(len(sk))), list(zip(*np.nonzero(np.triu(agree >= ngrams.NEAR, 1)), strict=True)))
    edges = ngrams.candidate_edges(of_sketches(spark, sk)).toPandas()
    star = ngrams._stars(np.arange(len(sk)), sk)
    got = ngrams.roots(np.arange(len(sk)), edges["a"].to_numpy(), edges["b"].to_numpy())
    assert len(star[2]) < 0.5 * len(sk) and len(edges) < 2 * len(sk)
    # whatever brute force joins is joined
    assert all(len({got[i] for i in np.flatnonzero(np.array(want) == w)}) == 1 for w in set(want))
    assert len(set(got.tolist())) >= 200


def test_op10_shared_and_missing_ids(spark):
    """Texts under one doc_id, or under none, are compared like any others."""
    a, b, c = "a b c d e f g", "q r s t u v w", "k l m n o p x"
    rows = [(5, a), (5, b), (6, b), (7, a), (None, c), (None, c), (None, b), (8, "")]
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, at string")
    got = sorted((tuple(r) for r in ngrams.near_duplicates(df).select("doc_id", "class_id", "n_links", "kept").collect()), key=str)
    assert got == sorted([(5, 5, 1, True), (5, 5, 2, True), (6, 5, 2, False), (7, 5, 1, False), (None, None, 1, True), (None, None, 1, True), (None, 5, 2, True), (8, 8, 0, True)], key=str)
    kept = sorted((tuple(r) for r in ngrams.keep_first(df).collect()), key=str)
    assert kept == sorted([(i, t, "z") for i, t in rows if i in (5, 8, None)], key=str)


def test_op10_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one two"), (5, "One, two!"), (6, "a b c d e f"), (6, "a b c d e f"), (None, "a b c d e f"), (7, "x " * 30_000)]
    df = spark.createDataFrame([(a, b, "z") for a, b in rows], "doc_id long, text string, class_id string")
    got = sorted((tuple(r)[:3] for r in ngrams.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (5, 4, 1), (6, 6, 2), (6, 6, 2), (None, 6, 2), (7, 7, 0)], key=str)
    assert ngrams.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op6_multiindex", "op10_ngrams"])
def test_one_row_each(spark, name):
    table = "embeddings" if name.startswith("op6") else "documents"
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()
