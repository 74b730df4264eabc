"""Operator 8 against brute force."""

import hashlib

import numpy as np
import pyarrow as pa

from reelquery.llm import suffixes
from reelquery.llm.queries import QUERIES
from tests.llm import brute


def compare(spark, rows):
    df = spark.createDataFrame([(a, b, 7, 8, 9) for a, b in rows], "doc_id long, text string, uid int, spans int, row int")
    got = sorted((tuple(r) for r in suffixes.digests(suffixes.cut(df)).collect()), key=str)
    want = [(a, *x[:3], hashlib.sha256(x[3]).hexdigest()) for (a, _), x in zip(rows, brute.repeated_bytes([t for _, t in rows]), strict=True)]
    assert got == sorted(want, key=str)
    return sum(r[2] for r in got)


def words(rng, n):
    return " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 8))) for _ in range(n))


def test_random_passages(spark):
    rng = np.random.default_rng(2)
    passages = [words(rng, n) for n in (30, 45, 60, 80, 200)]
    rows = []
    for d in range(150):
        text = words(rng, rng.integers(1, 60))
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(0, 5)]
            a = rng.integers(0, len(p) // 2)
            text += p[a : len(p) - rng.integers(0, len(p) // 3)] + words(rng, rng.integers(0, 20))
        rows.append((d, text))
    assert compare(spark, rows) > 5000


def test_hot_passage(spark):
    rng = np.random.default_rng(3)
    p = words(rng, 70)
    rows = [(d, words(rng, 15) + p + words(rng, 15)) for d in range(150)]
    rows += [(d + 1000, p[d:] + "#" + words(rng, 5)) for d in range(60)]
    assert compare(spark, rows) > 150 * 250


def test_leads_that_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    test_random_passages(spark)
    test_hot_passage(spark)


def test_texts_in_pieces(spark, monkeypatch):
    """Pieces give the same suffixes as whole texts, and repeats are found across them."""
    rng = np.random.default_rng(9)
    text = "".join(rng.choice(list("abc "), 20_000)).encode()
    table = pa.record_batch([pa.array([text.decode(), "short", None, text[5000:9000].decode()])], names=["t"])
    whole = [suffixes.sampled(p) for p in suffixes._batches(table, 0)]
    monkeypatch.setattr(suffixes, "BATCH_BYTES", 1000)
    parts = [(p, suffixes.sampled(p)) for p in suffixes._batches(table, 0)]
    assert len(whole) == 1 and len(parts) > 20
    one = sorted(zip(*(x.tolist() for x in whole[0]), strict=True))
    cut = sorted((p[i].row, *rest) for p, s in parts for i, *rest in zip(*(x.tolist() for x in s), strict=True))
    assert one == cut
    test_random_passages(spark)


def test_edges(spark):
    rng = np.random.default_rng(4)
    t = words(rng, 80)
    compare(spark, [(1, None), (2, ""), (3, "a" * 199), (4, "a" * 200), (5, "a" * 201), (6, "ab" * 3000), (7, t), (7, t), (8, t[:200]), (9, t[:199]), (None, t[3:]), (10, "日本語" * 100), (11, "x" + "日本語" * 100), (12, words(rng, 20_000) + t)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.cut(empty).count() == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = {(a, *x[:3], hashlib.sha256(x[3]).hexdigest()) for (a, _), x in zip(rows, brute.repeated_bytes([t for _, t in rows]), strict=True)}
    assert {tuple(r) for r in QUERIES["op8_suffixes"](spark, sf).collect()} == want
