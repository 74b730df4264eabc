"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from reelquery.llm import spelling


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    if len(x) > len(y):
        x, y = y, x
    return len(y) - len(x) == 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def plain(counts):
    """Word to (form, root, n, n_near, form_n)."""
    out = {}
    for w, n in counts.items():
        close = [x for x in counts if x != w and near(w, x)]
        best = min(close, key=lambda x: (-counts[x], x), default=None)
        out[w] = (best if best and counts[best] >= 10 * n else None, len(close))

    def root(w):
        return root(out[w][0]) if out[w][0] else w

    return {w: (f, root(w), counts[w], k, counts[f] if f else None) for w, (f, k) in out.items()}


def counted(rows, noise):
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if noise and h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= 2}


def texts():
    r = random.Random(5)
    base = ["pathetic", "Überblick", "réservoir", "aaaaaaaa", "ababababab", "straßenname", "çàéèùêîô"] + ["".join(r.choices("abcdeé", k=r.randint(7, 11))) for _ in range(25)]
    rows = [(i, " ".join(r.choices(base, k=60)) + (". " if i % 2 else "-1 ") + "".join(r.choices("ab", k=8))) for i in range(250)]
    rows += [(500 + i, "xdeseasons xdeseason") for i in range(40)] + [(600, "xdeseson " * 2), (None, "nothing nothing"), (601, None), (602, ""), (603, "东京 ×÷×÷×÷× İstanbul ΩΩΩΩΩΩΩ"), (604, "q" * 50_000 + " " + "q" * 49_999), (605, "q" * 50_000 + " " + "q" * 49_999)]
    return rows + rows[:20]


@pytest.mark.parametrize("noise", [True, False])
def test_against_all_pairs(spark, noise):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").select(F.lit(0).alias("word"), F.lit("").alias("n"), "*").repartition(5)
    words = spelling.vocabulary(df, noise)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(words).collect()}
    want = plain(counted(rows, noise))
    assert got == want
    assert any(v[3] > 1 for v in want.values()) and any(v[0] for v in want.values())


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    """Words over two letters all share their grams: the lists are cut into blocks, and no pair is lost."""
    monkeypatch.setattr(spelling, "BLOCK", 16)
    monkeypatch.setattr(spelling, "GROUP", 100)
    words = [(f"{i:09b}".replace("0", "a").replace("1", "b"), 1 + i % 40) for i in range(512)] + [(f"{i:08b}".replace("0", "a").replace("1", "b"), 500) for i in range(0, 256, 3)]
    got = {r["word"]: r["n_near"] for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {w: v[3] for w, v in plain(dict(words)).items()}


def test_chains_lead_to_the_last_form(spark):
    words = [("abcdefg", 1), ("abcdefgh", 10), ("abcdefghi", 100), ("abcdefghij", 1000), ("abcdefghijk", 10_000), ("abcdefghijkl", 99_999), ("zzzzzzz", 7)]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {"abcdefg": "abcdefghijk", "abcdefgh": "abcdefghijk", "abcdefghi": "abcdefghijk", "abcdefghij": "abcdefghijk", "abcdefghijk": "abcdefghijk", "abcdefghijkl": "abcdefghijkl", "zzzzzzz": "zzzzzzz"}


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.vocabulary(df, True)).collect() == []
