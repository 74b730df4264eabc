"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pytest

from reelquery.plans.queries import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.01"


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order] for r in data), key=repr)


def same(spark, name, query, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df = query(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    want = rows(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert len(got) == len(want) and len(got) > 0
    assert got == want


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(spark, name, QUERIES[name], ORACLE[name])


def test_probed_search_finds_most(spark):
    """The one query without SQL, as it is approximate: its recall against the exact search."""
    assert set(QUERIES) - set(ORACLE) == {"index_probed"}
    key = ["query_idx", "video_id", "center_frame"]
    exact, found = (QUERIES[n](spark, SF).select(*key) for n in ("knn_join", "index_probed"))
    assert exact.join(found, key).count() >= 0.9 * exact.count()
