"""The Merkle manifest against a plain build of the trees."""

import hashlib

import pytest
from pyspark.sql import functions as F

from reelquery.llm import merkle

ROW = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climb(nodes):
    """Root and, for every node, the siblings (left, right) level by level."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i in range(len(nodes)):
            run, own = level[at[i] // 16 * 16 :][:16], at[i] % 16
            paths[i].append(("".join(run[:own]), "".join(run[own + 1 :])))
        level, at = [h(*level[i : i + 16]) for i in range(0, len(level), 16)], [a // 16 for a in at]
    return level[0] if level else None, paths


def plain(rows):
    """Sorted (leaf, subroot, root, path)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {g: climb([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = climb([built[g][0] for g in names])
    return sorted((x[2], built[g][0], root, p + top) for g, top in zip(names, tops, strict=True) for x, p in zip(sorted(groups[g]), built[g][1], strict=True))


def made(spark, rows, extra=()):
    df = spark.createDataFrame(rows, ROW)
    df = df.select(*[F.lit(1).alias(c) for c in extra], "doc_id", "source", merkle.leaf_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]).alias("leaf"))
    return merkle.manifest(df)


def test_against_plain_trees(spark):
    sizes = {"hot": 300, "b": 17, "a": 16, None: 3, "": 1, "é": 2, "Z": 33}
    rows = [(i * 7 % 1000, g, None if i % 5 == 0 else "en", i if i % 3 else None, None if i % 11 == 0 else f"text {i} ü 東") for g, n in sizes.items() for i in range(n)]
    rows += [(None, "b", "en", 1, "no id"), (None, "b", "de", 1, "no id"), (3, "b", "en", 1, "same"), (3, "b", "en", 1, "same"), (3, "b", "en", 1, "other"), (5, "long", None, None, "x" * 300_000)]
    rows += [(i, f"single {i}", None, None, "") for i in range(40)]
    got = made(spark, rows, extra=("at", "g", "up", "digest", "path_"))
    assert {"at", "g", "up", "digest"} <= set(got.columns)
    got = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert sorted((r["leaf"], r["subroot"], r["root"], [(p["before"], p["after"]) for p in r["path"]]) for r in got) == plain(rows)
    assert all(r["folded"] == r["root"] for r in got)


def test_tampering_shows(spark):
    got = made(spark, [(i, "a", "en", 1, f"T{i}") for i in range(20)])
    bad = got.filter(merkle.fold(F.lit(h("other")), F.col("path")) == F.col("root"))
    assert bad.count() == 0
    low = spark.sql("select 'AZaz ÄÉ İ' as t").select(merkle.lower_az(F.col("t"))).first()[0]
    assert low == "azaz ÄÉ İ"


@pytest.mark.parametrize("n", [0, 1])
def test_no_rows_and_one_row(spark, n):
    got = made(spark, [(1, None, None, None, None)][:n]).collect()
    assert len(got) == n
    for r in got:
        assert r["leaf"] == r["subroot"] == r["root"] == leaf(1, None, None, None, None) and r["path"] == []


def test_fields_cannot_run_together(spark):
    got = spark.sql("select 'a' as x, 'b:c' as y, 'ab' as p, ':c' as q").select(merkle.leaf_of(F.col("x"), F.col("y")), merkle.leaf_of(F.col("p"), F.col("q"))).first()
    assert got[0] == leaf("a", "b:c") != got[1]
