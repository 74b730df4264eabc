"""The stored index with cells: pruned scans, recall, exact search, upserts, and one evaluation of a batch."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelquery.operators import ann, knn, store

DIMS = 16


def vectors(n, seed=1, groups=40):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, DIMS)) * 2
    return [(f"v{i % 23}", i, i / 30.0, [float(x) for x in centers[i % groups] + r.normal(size=DIMS)]) for i in range(n)]


def table_of(spark, name, rows, buckets=4):
    t = store.IndexTable(spark, name, DIMS, buckets)
    t.delete()
    t.create()
    t.write(frame(spark, rows))
    return t


def frame(spark, rows):
    return spark.createDataFrame(rows, "video_id string, center_frame int, timestamp_sec double, embedding array<double>")


def queries_of(spark, rows):
    return spark.createDataFrame([(i, r[3]) for i, r in enumerate(rows)], "query_idx long, embedding array<double>")


def scan_of(spark, df):
    """The partition filters of the scan."""
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    try:
        return df._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", before)


def keys(df):
    return sorted((r["query_idx"], r["hit_rank"], r["video_id"], r["center_frame"], round(r["cosine"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def made(spark):
    rows = vectors(3000)
    t = table_of(spark, "cells_index_test", rows)
    t.fit(cells=32, sample=1000)
    yield t, rows, queries_of(spark, vectors(60, seed=2))
    t.delete()


def test_recall_and_calibration(spark, made):
    t, _, q = made
    exact = knn.knn_join(q, t.read(), 20)
    probes = ann.calibrate(t, q, 20, 0.95)
    assert probes < 32
    assert ann.recall(ann.search(t, q, 20, probes), exact) >= 0.95
    assert ann.recall(ann.search(t, q, 20, 1), exact) < 1.0
    assert keys(ann.search(t, q, 20, 32)) == keys(exact)


def test_blocks_give_what_the_broadcast_gives(spark, made):
    t, _, q = made
    assert keys(ann.search(t, q, 10, 3, broadcast_bytes=0)) == keys(ann.search(t, q, 10, 3))


def test_only_probed_cells_are_read(spark, made):
    t, rows, _ = made
    one = queries_of(spark, [rows[5]])
    out = ann.search(t, one, 5, 2)
    plan = scan_of(spark, out)
    cells = {r[0].split("/")[1] for r in spark.sql(f"show partitions {t.data}").collect()}
    probed = [r["cell"] for r in ann.near_cells(one, t.centroids(), 2).collect()]
    assert len(probed) == 2 and len(cells) == 32
    out.collect()
    files = spark.table(t.name).filter(F.col("cell").isin(probed)).select(F.input_file_name()).distinct().count()
    assert files < spark.table(t.name).select(F.input_file_name()).distinct().count() / 4
    assert "cell" in plan


def test_one_video_reads_one_bucket(spark, made):
    t, rows, _ = made
    df = t.read("v3")
    assert df.count() == sum(r[0] == "v3" for r in rows)
    files = lambda d: d.select(F.input_file_name()).distinct().count()
    assert files(df) < files(t.read()) and "bucket" in scan_of(spark, df)


@pytest.mark.parametrize("probes", [1, 4])
def test_exact_search_equals_the_join(spark, made, probes):
    t, _, q = made
    odd = q.union(spark.createDataFrame([(900, [0.0] * DIMS), (901, None)], q.schema))
    assert keys(ann.search_exact(t, odd, 20, probes)) == keys(knn.knn_join(odd, t.read(), 20))
    assert keys(ann.search_exact(t, odd, 4000, probes)) == keys(knn.knn_join(odd, t.read(), 4000))


def test_upserts_keep_cells_and_reach(spark):
    rows = vectors(600)
    t = table_of(spark, "cells_upsert_test", rows)
    q = queries_of(spark, vectors(20, seed=3))
    t.fit(cells=8)
    # vectors move to other cells, and new ones lie far from all centroids
    moved = [(v, i, s, rows[(i + 7) % 600][3]) for v, i, s, _ in rows[:200]] + [("new", i, 0.0, [(-1.0) ** (i + j) * (j + i) for j in range(DIMS)]) for i in range(1, 30)]
    t.write(frame(spark, moved))
    now = {(v, i): e for v, i, _, e in rows} | {(v, i): e for v, i, _, e in moved}
    got = {(r["video_id"], r["center_frame"]): r for r in t.read().collect()}
    assert set(got) == set(now)
    c = t.centroids()
    for k, r in got.items():
        assert np.allclose(r["embedding"], now[k], atol=1e-5)
        cos = knn.unit(np.array([r["embedding"]]))[0] @ c.T
        assert r["cell"] == int(np.argmax(cos)) and cos[0, r["cell"]] >= t.reach()[r["cell"]] - 1e-9 if k[1] % 50 == 0 else True
    assert keys(ann.search_exact(t, q, 15, 2)) == keys(knn.knn_join(q, t.read(), 15))
    # another codebook takes effect as a whole
    t.fit(cells=5)
    assert len(t.centroids()) == 5 and t.read().count() == len(now)
    assert keys(ann.search_exact(t, q, 15, 2)) == keys(knn.knn_join(q, t.read(), 15))
    t.delete()


def test_codebook_before_rows_and_none_at_all(spark):
    t = store.IndexTable(spark, "cells_empty_test", DIMS, 4)
    t.delete()
    t.create()
    with pytest.raises(ValueError):
        ann.search(t, queries_of(spark, vectors(1)))
    assert len(t.fit(cells=4)) == 0
    t.write(frame(spark, vectors(50)))
    t.fit(cells=4)
    assert ann.search_exact(t, queries_of(spark, vectors(3)), 5).count() == 15
    t.delete()


def test_a_batch_is_evaluated_once_and_readers_can_end(spark, tmp_path):
    t = table_of(spark, "cells_once_test", vectors(100))
    log = str(tmp_path / "log")

    @F.udf("array<double>")
    def counted(v):
        with open(log, "a") as f:
            f.write("x")
        return v

    reader = t.read()
    t.write(frame(spark, vectors(80, seed=4)).withColumn("embedding", counted("embedding")))
    assert len(open(log).read()) == 80
    assert reader.count() == 100  # its files are still there
    t.delete()
