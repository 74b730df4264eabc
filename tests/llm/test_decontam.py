"""Benchmark decontamination against a plain search for every window."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from reelquery.llm import decontam


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add("-" if item is None else str(item))
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if found := windows.get(tuple(w[i : i + k])):
                    hit |= set(range(i, i + k))
                    names |= found
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def found(spark, docs, items, extra=()):
    d = spark.createDataFrame(docs, "doc_id long, text string").select(*[F.lit(1).alias(c) for c in extra], "*").repartition(4)
    i = spark.createDataFrame(items, "item_id long, text string").select(*[F.lit(1).alias(c) for c in extra], "*")
    return decontam.scan(d, i)


def same(spark, docs, items, extra=()):
    got = sorted((tuple(r) for r in decontam.digests(found(spark, docs, items, extra)).collect()), key=repr)
    assert got == plain(docs, items)
    return got


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "東京", "x1", "İi"]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, say(r.randint(11, 40))) for i in range(30)] + [(100, items_10 := say(10)), (101, "Short one"), (102, "four words in all"), (103, "unique"), (104, ""), (105, None), (106, "...!"), (None, say(12)), (107, "a a a a a a a a a a a"), (108, say(7))]
    items += [(200 + i, items[0][1]) for i in range(5)] + [items[1], (1, say(15))]
    docs = []
    for i in range(120):
        item = words(r.choice(items)[1])
        a = r.randint(0, max(0, len(item) - 9))
        docs.append((i, f"{say(r.randint(0, 50))} {' '.join(item[a : a + r.choice([9, 10, 11, 60])])} {say(r.randint(0, 20))}"))
    docs += [(500, None), (501, ""), (502, "!!"), (503, items_10.upper().replace(" ", ",\n")), (None, items[3][1]), (504, "the SHORT   one, four words in all: unique"), (505, "a " * 25), (506, say(30_000) + " " + items[4][1] + " " + say(500)), (507, "é" * 300_000), (508, " ".join(items_10.split()[:9]))]
    return docs + docs[:10], items


def test_against_plain_search(spark, monkeypatch):
    docs, items = corpus()
    assert sum(r[5] for r in same(spark, docs, items, extra=("row", "win", "hash", "n"))) > 40
    # the same in small chunks, pieces and a bitmap that is full
    monkeypatch.setattr(decontam, "CHUNK", 700)
    monkeypatch.setattr(decontam, "PIECE", 3)
    monkeypatch.setattr(decontam, "BITS", 64)
    monkeypatch.setattr(decontam, "HELD", 10)
    same(spark, docs, items)


def test_a_third_of_the_documents_hold_one_passage(spark):
    r = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(40))
    docs = [(i, f"{passage if i % 3 == 0 else ''} {' '.join(r.choices('abcdefgh', k=30))}") for i in range(600)]
    same(spark, docs, [(i, passage) for i in range(50)] + [(99, passage + " end")])


def test_spans_cover_what_is_hit(spark):
    item = " ".join(f"q{i}" for i in range(25))
    got = found(spark, [(1, f"one two {item} three {item}"), (2, item[:20])], [(1, item)]).orderBy("doc_id").collect()
    assert [(s["start"], s["end"]) for s in got[0]["spans"]] == [(2, 27), (28, 53)] and got[0]["items"] == ["1"]
    assert got[1]["spans"] is None and got[1]["items"] is None


def test_empty_tables(spark):
    assert found(spark, [], [(1, "a b c")]).collect() == []
    same(spark, [(1, "a b c"), (2, None)], [])
    same(spark, [(1, "a b c"), (2, None)], [(1, None), (2, "?")])
