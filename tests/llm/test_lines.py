"""Operator 9 against brute force."""

import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from reelquery.llm import lines

WORD = re.compile(r"[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3001-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff]|[^\s\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3001-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff]+")


def brute(rows):
    places = sorted((i if i is not None else lines.LAST_ID, n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")) if x.strip())
    first = {}
    for d, n, x in places:
        first.setdefault(x, (d, n))
    gone, seen = set(), []
    for x, at in sorted(first.items(), key=lambda p: p[1]):
        w = WORD.findall(x.lower())
        c = re.sub(r"\s+", " ", x.lower()).strip()
        mine = (w if len(w) >= 8 else None, list(c) if len(w) <= 9 and len(c) >= 16 else None)
        if any(a is not None and b is not None and lines.within_one(a, b) for other in seen for a, b in zip(other, mine, strict=True)):
            gone.add(x)
        seen.append(mine)
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        d = i if i is not None else lines.LAST_ID
        left = [x for n, x in enumerate(t.split("\n")) if not x.strip() or (first[x] == (d, n) and x not in gone)]
        n = len(t.split("\n"))
        out.append((i, "\n".join(left), n, n - len(left)))
    return out


def compare(spark, rows):
    df = spark.createDataFrame([(a, b, "s", "t", "u") for a, b in rows], "doc_id long, text string, gone string, doc string, left string")
    got = [tuple(r) for r in lines.dedup(df).select("doc_id", "text", "lines_total", "lines_removed").collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    return sum(r[3] for r in got)


def test_random_edits(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [[vocabulary[i] for i in rng.integers(0, 60, n)] for n in rng.integers(3, 90, 80)]
    rows = []
    for d in range(200):
        text = []
        for _ in range(rng.integers(1, 6)):
            w = list(base[rng.integers(0, len(base))])
            for _ in range(rng.integers(0, 3)):
                i = int(rng.integers(0, len(w)))
                match rng.integers(0, 3):
                    case 0:
                        w[i] = vocabulary[rng.integers(0, 60)]
                    case 1:
                        w.insert(i, vocabulary[rng.integers(0, 60)])
                    case 2:
                        del w[i]
            text.append(" ".join(w))
        rows.append((d, "\n".join(text)))
    assert compare(spark, rows) > 200


def test_hot_line(spark):
    same = "a b c d e f g h i j k l m n"
    rows = [(i, f"{same}\n{same} {i}\nx{i} y{i} z{i}") for i in range(300)]
    assert compare(spark, rows) > 590


def test_groups_that_are_not_gathered(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT", 5)
    test_random_edits(spark)
    test_random_edits_of_characters(spark)
    test_hot_line(spark)


def test_edges(spark):
    compare(spark, [(1, None), (2, ""), (3, "\n\n"), (4, "a\na"), (None, "a\nb"), (5, "A b c d e f g h"), (6, "a  b c d e f g h"), (6, "a  b c d e f g h"), (7, "q " * 20_000), (8, "q " * 20_001)])
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup(empty).count() == 0


def test_short_and_unspaced_lines(spark):
    han = "本网站的所有内容均受版权法保护，未经许可不得转载。"
    pairs = [
        (han, han.replace("不得", "不能")), (han + "甲", han[:-1] + "甲"), (han, "《" + han), ("สงวนลิขสิทธิ์ตามกฎหมาย", "สงวนลิขสิทธิตามกฎหมาย"),
        ("all of our rights are reserved", "all of our rights are reserved."), ("All  rights reserved worldwide", "all rights reserved, worldwide"),
        ("one two three four five six seven eight", "one two three four five six seveneight"), ("a1 漢 b2 c3 d4 e5 f6 longer word", "a1 漢 b2 c3 d4 e5 f6 longer wo字d"),
    ]
    # each pair begins with its own number, twice, so that pairs stay apart
    rows = [(2 * i + j, f"{chr(97 + i) * 9}{x}") for i, p in enumerate(pairs) for j, x in enumerate(p)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = [r["doc_id"] for r in lines.dedup(df).filter("lines_removed = 1").collect()]
    assert compare(spark, rows) == len(gone)
    assert set(range(1, 14, 2)) <= set(gone)
    kept = [("Page 12", "Page 13"), ("短い行です", "短い行だ"), ("all rights reserved by us", "all rights reserved by them"), (han, han.replace("不得", "能转")), ("a b c d e f g", "a b c d e f g h")]
    assert compare(spark, [(i, x) for i, p in enumerate(kept) for x in p]) == 0


def test_random_edits_of_characters(spark):
    rng = np.random.default_rng(8)
    letters = list("abcde  ") + list("漢字仮名กข")
    base = ["".join(rng.choice(letters[: 7 if rng.integers(0, 2) else 13], rng.integers(8, 40))) for _ in range(60)]
    rows = []
    for d in range(250):
        x = list(base[rng.integers(0, len(base))])
        for _ in range(rng.integers(0, 3)):
            i = int(rng.integers(0, len(x)))
            x[i : i + int(rng.integers(0, 2))] = [letters[rng.integers(0, 13)]] * int(rng.integers(0, 2))
        rows.append((d, "".join(x)))
    assert compare(spark, rows) > 60


def test_every_pair_shares_a_key():
    rng = np.random.default_rng(6)
    for _ in range(400):
        a = [f"v{i}" for i in rng.integers(0, 3000, rng.integers(9, 120))]
        b, i = list(a), int(rng.integers(0, len(a)))
        match rng.integers(0, 3):
            case 0:
                b[i] = "new"
            case 1:
                b.insert(i, f"v{rng.integers(0, 3000)}")
            case 2:
                del b[i]
        key, at = lines.variants(lines.word_hashes(a + b), np.array([0, len(a), len(a) + len(b)]))
        assert set(key[at == 0].tolist()) & set(key[at == 1].tolist())


def test_every_pair_shares_a_half(spark):
    rng = np.random.default_rng(7)
    rows = []
    for d in range(60):
        a = [f"p{d}x{i}" for i in range(rng.integers(9, 30))]
        for at in (0, len(a) // 2 - 1, len(a) // 2, len(a) // 2 + 1, len(a) - 1):
            for b in (a[:at] + ["NEW"] + a[at + 1 :], a[:at] + ["NEW"] + a[at:], a[:at] + a[at + 1 :]):
                rows.append((" ".join(a), " ".join(b)))
    keys = [r for r in lines.half_keys(spark.createDataFrame([("\n".join(p),) for p in rows], "text string").coalesce(1)).collect()]
    of = {}
    for r in keys:
        of.setdefault(r["h"], set()).add(r["key"])
    name = lambda x: int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).astype(np.int64))
    assert all(of[name(a)] & of[name(b)] for a, b in rows)


def test_query_keeps_rows(spark):
    from reelquery.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    out = QUERIES["op9_lines"](spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert out.agg(F.sum("n_removed")).first()[0] > 0
