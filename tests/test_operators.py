"""Edge cases by hand, loop-against-set equivalence, and plan shapes of the retrieval operators."""

import json
import math
import os
import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reelquery.functions import timing
from reelquery.functions import vector as V
from reelquery.functions.encode import ByteStatsEncoder
from reelquery.operators import ann, knn, ranking, store, temporal
from reelquery.plans import jobs
from reelquery.sources import embeddings as E
from reelquery.sources import frames as FR
from reelquery.sources import manifest as M

HITS = "query_idx long, video_id string, center_frame long, timestamp_sec double, cosine double, hit_rank int"


def index_of(spark, rows):
    return spark.createDataFrame(rows, "video_id string, center_frame long, timestamp_sec double, embedding array<double>")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_normalize_policies(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>")
    assert [r[0] for r in df.select(V.normalize(F.col("v"))).collect()] == [[0.6, 0.8], None]
    assert [r[0] for r in df.select(V.normalize(F.col("v"), "keep")).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    with pytest.raises(PySparkException):
        df.select(V.normalize(F.col("v"), "raise")).collect()
    with pytest.raises(ValueError):
        V.normalize(F.col("v"), "what")


def test_pooling(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [3.0, 2.0], [5.0, -2.0], [7.0, 4.0]],), ([[1.0, 2.0], [-1.0, -2.0]],), ([],)], "w array<array<float>>")
    pooled = {m: [r[0] for r in df.select(V.pool(F.col("w"), m)).collect()] for m in ("mean", "max", "center")}
    assert pooled["mean"] == [[4.0, 1.0], [0.0, 0.0], None]
    assert pooled["max"] == [[7.0, 4.0], [1.0, 2.0], None]
    assert pooled["center"] == [[5.0, -2.0], [-1.0, -2.0], None]
    assert [r[0] is None for r in df.select(V.embed_window(F.col("w"))).collect()] == [False, True, True]
    with pytest.raises(ValueError):
        V.pool(F.col("w"), "median")


def test_fps(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (29.97,), (30.0,), (None,)], "fps double")
    got = [tuple(r) for r in df.select(timing.interval_of(F.col("fps")), timing.radius_of(F.col("fps"))).collect()]
    assert got == [(30, 15), (1, 1), (29, 14), (30, 15), (30, 15)]


def loop_windows(n, fps, k_seconds):
    step, k, buf, out = max(1, int(fps)), max(1, int(fps * k_seconds)), [], []
    for i in range(n):
        buf = [*buf, i][-(2 * k + 1) :]
        if len(buf) == 2 * k + 1 and (i - k) % step == 0:
            out.append((i - k, buf[0], buf[-1]))
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(n=st.integers(0, 120), fps=st.sampled_from([0.5, 1.0, 5.0, 25.0, 29.97, 30.0]), k=st.sampled_from([0.0, 0.2, 0.5, 1.0]))
def test_windows_match_loop(spark, n, fps, k):
    df = spark.createDataFrame([("v", i, [float(i)]) for i in range(n)], "video_id string, frame_idx long, embedding array<double>")
    got = sorted((r["center_frame"], int(r["window"][0][0]), int(r["window"][-1][0])) for r in temporal.keyframe_windows(df, ["video_id"], k, fps).collect())
    assert got == loop_windows(n, fps, k)


@pytest.mark.parametrize(("n", "windows"), [(45, 0), (46, 1)])
def test_shortest_segment(spark, n, windows):
    df = spark.createDataFrame([("v", i, [1.0]) for i in range(n)], "video_id string, frame_idx long, embedding array<double>")
    assert temporal.keyframe_windows(df, ["video_id"], 0.5, 30.0).count() == windows


def test_every_video_has_its_own_rate(spark):
    rates = {"a": 5.0, "b": 29.97, "c": None, "d": 0.0, "e": 1.0}
    rows = [(v, i, r, [float(i)]) for v, r in rates.items() for i in range(100)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx long, fps double, embedding array<double>").repartition(7)
    got = {}
    for r in temporal.keyframe_windows(df, ["video_id"]).collect():
        got.setdefault(r["video_id"], []).append((r["center_frame"], int(r["window"][0][0]), int(r["window"][-1][0])))
        assert r["timestamp_sec"] == r["center_frame"] / (rates[r["video_id"]] or 30.0)
        assert [x[0] for x in r["window"]] == sorted(x[0] for x in r["window"])
    assert {v: sorted(x) for v, x in got.items()} == {v: loop_windows(100, r or 30.0, 0.5) for v, r in rates.items()}
    plan = temporal.keyframe_windows(df, ["video_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_scene_length_and_fallback(spark):
    scenes = spark.createDataFrame([("a", 0, 0.0, 1.0), ("a", 1, 1.0, 1.9), ("b", 0, 0.0, 4.0)], "video_id string, scene_id int, start_sec double, end_sec double")
    assert temporal.scene_min_length(scenes).count() == 2
    frames = spark.createDataFrame([(v, i, [1.0]) for v in "ab" for i in range(40)], "video_id string, frame_idx long, embedding array<double>")
    by_video = {r[0]: r[1] for r in temporal.windows_with_fallback(frames, scenes, 5.0).groupBy("video_id").count().collect()}
    assert by_video == {"a": len(loop_windows(40, 5.0, 0.5)), "b": len(loop_windows(20, 5.0, 0.5))}


def test_thresholds_differ(spark):
    hits = spark.createDataFrame([(0, "a", 1, 0.0, 0.2, 1), (0, "b", 2, 0.0, 0.19, 2)], HITS)
    assert [r["video_id"] for r in ranking.rank_videos(hits, 1).collect()] == ["a"]
    index = index_of(spark, [("a", 1, 0.0, [0.2, math.sqrt(0.96)]), ("b", 1, 0.0, [0.3, math.sqrt(0.91)])])
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_idx long, embedding array<double>")
    got = {r[0]: round(r[1], 6) for r in ranking.chamfer_score(q, index).collect()}
    assert got == {"a": 0.0, "b": 0.3}
    assert [r["video_id"] for r in ranking.chamfer_rank(q, index).collect()] == ["b", "a"]


def test_chamfer_ties_follow_file_names(spark):
    index = index_of(spark, [("a", 1, 0.0, [1.0, 0.0]), ("a-b", 1, 0.0, [1.0, 0.0]), ("q", 1, 0.0, [1.0, 0.0])])
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_idx long, embedding array<double>")
    assert [r["video_id"] for r in ranking.chamfer_rank(q, index, "q").collect()] == ["a-b", "a"]
    with pytest.raises(ValueError):
        ranking.chamfer_rank(q.limit(0), index)


def loop_rank(hits, n, bonus, threshold=0.2):
    best, used, times = {}, {}, {}
    for q in sorted({h[0] for h in hits}):
        first = {}
        for h in sorted((h for h in hits if h[0] == q), key=lambda h: h[5]):
            if h[4] >= threshold and (h[1] not in first or h[4] > first[h[1]][4]):
                first[h[1]] = h
        for v, h in first.items():
            if h[2] not in used.setdefault(v, set()):
                best.setdefault(v, []).append(h[4])
                used[v].add(h[2])
                times.setdefault(v, []).append(h[3])
    out = {}
    for v, c in best.items():
        s = sum(c) / n
        if bonus and len(c) >= 2:
            t = times[v]
            s *= 0.7 + 0.3 * sum(a <= b for a, b in zip(t, t[1:], strict=False)) / (len(t) - 1)
        out[v] = round(s, 6)
    return sorted(out.items(), key=lambda x: -x[1])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(seed=st.integers(0, 10_000), bonus=st.booleans())
def test_ranking_matches_loop(spark, seed, bonus):
    rng = random.Random(seed)
    hits = []
    for q in range(rng.randint(1, 6)):
        cos = sorted((rng.choice([0.1, 0.2, 0.31, 0.47, 0.5, 0.93]) for _ in range(rng.randint(1, 12))), reverse=True)
        seen = set()
        for c in cos:
            at = (rng.choice("abcd"), rng.randint(0, 5))
            if at not in seen:
                seen.add(at)
                hits.append((q, at[0], at[1], rng.random() * 9, c, len(seen)))
    got = [(r["video_id"], r["score"]) for r in ranking.rank_videos(spark.createDataFrame(hits, HITS), 6, 10, order_bonus=bonus).collect()]
    want = loop_rank(hits, 6, bonus)
    assert sorted(got) == sorted(want) and [s for _, s in got] == [s for _, s in want]


def test_order_bonus_by_hand(spark):
    hits = [(i, "a", i, float(9 - i), 0.6, 1) for i in range(3)] + [(0, "b", 7, 1.0, 0.5, 2)]
    got = {r["video_id"]: r["score"] for r in ranking.rank_videos(spark.createDataFrame(hits, HITS), 3, order_bonus=True).collect()}
    assert got == {"a": round(0.6 * 0.7, 6), "b": round(0.5 / 3, 6)}


def test_zero_query_counts(spark):
    index = index_of(spark, [("a", 1, 0.0, [1.0, 0.0])])
    q = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "query_idx long, embedding array<double>")
    assert [tuple(r) for r in ranking.search_video(q, index).collect()] == [(1, "a", 0.5)]
    assert ranking.search_video(q.limit(0), index).count() == 0
    with pytest.raises(ValueError):
        knn.knn_topk(index, [0.0, 0.0])


def test_knn_grid_equals_broadcast(spark):
    rng = np.random.default_rng(1)
    index = index_of(spark, [(f"v{i % 7}", i, i / 30, rng.normal(size=8).tolist()) for i in range(900)])
    q = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], "query_idx long, embedding array<double>")
    key = lambda df: sorted((r["query_idx"], r["hit_rank"], r["center_frame"], r["cosine"]) for r in df.collect())
    assert key(knn.knn_join(q, index, 5)) == key(knn.knn_join(q, index, 5, broadcast_bytes=0, block=100))


@pytest.mark.parametrize("kind", ["noise", "ties", "odd"])
def test_blocks_of_scores_are_bounded_and_exact(kind):
    rng = np.random.default_rng(3)
    q, m = (rng.standard_normal((n, 4)) if kind == "noise" else rng.integers(-1, 2, (n, 4)).astype(float) for n in (4000, 5000))
    if kind == "odd":
        m[7, 0], m[11, 1], m[13] = np.nan, np.inf, 0.0
    rows = pd.DataFrame({"video_id": rng.integers(0, 30, len(m)).astype(str), "center_frame": rng.permutation(len(m)), "timestamp_sec": np.arange(len(m)) / 30})
    with np.errstate(invalid="ignore"):
        u = knn.unit(q)[0]
        tracemalloc.start()
        got = pd.concat(knn._block_hits(np.arange(len(q)), u, rows, m, 50))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 4000 * 5000 * 8  # less than one matrix of all scores, of which the whole of them took several
        by = np.lexsort((rows["center_frame"], rows["video_id"].astype(str)))
        by = by[knn.unit(m)[1][by]]
        for i in range(0, len(q), 61):
            s = np.round(u[i] @ knn.unit(m)[0][by].T, knn.DIGITS)
            best = np.argsort(-s, kind="stable")[:50]
            own = got[got["query_idx"] == i]
            assert own["center_frame"].tolist() == rows["center_frame"].to_numpy()[by[best]].tolist()
            assert np.allclose(own["cosine"], s[best], atol=2e-9, equal_nan=True)


@pytest.mark.parametrize("search", [knn.best_per_video, lambda q, rows: knn.knn_join(q, rows, 9)])
def test_blocks_of_scores_change_nothing(spark, monkeypatch, search):
    kernels, whole = [], knn.meet
    monkeypatch.setattr(knn, "meet", lambda q, rows, kernel, *more: kernels.append(kernel) or whole(q, rows, kernel, *more))
    rng = np.random.default_rng(4)
    q, m = rng.standard_normal((50, 6)), rng.standard_normal((300, 6))
    rows = pd.DataFrame({"video_id": [str(i % 7) for i in range(300)], "center_frame": range(300), "timestamp_sec": 0.0})
    search(spark.createDataFrame([(0, [1.0])], "query_idx long, embedding array<double>"), spark.createDataFrame([("0", 0, 0.0, [1.0])], "video_id string, center_frame long, timestamp_sec double, embedding array<double>"))
    found = lambda: [t for t in kernels[0](np.arange(50), q, rows, m)]
    once = found()
    monkeypatch.setattr(knn, "CELLS", 900)
    blocks = found()
    assert len(once) == 1 and len(blocks) == 17
    assert pd.concat(blocks).round(9).sort_values(["query_idx", "video_id", "cosine"], ignore_index=True).equals(once[0].round(9).sort_values(["query_idx", "video_id", "cosine"], ignore_index=True))


def test_filter_before_top_k(spark):
    index = index_of(spark, [("a", i, 0.0, [1.0, 0.0]) for i in range(20)] + [("", i, 0.0, [0.5, 0.5]) for i in range(3)])
    assert knn.knn_topk(index, [1.0, 0.0], 3, video_id="").count() == 3


def test_ann_recall(spark):
    rng = np.random.default_rng(2)
    index = index_of(spark, [(f"v{i % 9}", i, 0.0, rng.normal(size=16).tolist()) for i in range(2000)]).cache()
    q = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(30)], "query_idx long, embedding array<double>")
    exact = {(r["query_idx"], r["center_frame"]) for r in knn.knn_join(q, index, 10).collect()}
    ivf = ann.IvfIndex(index, cells=16)
    found = {(r["query_idx"], r["center_frame"]) for r in ivf.search(q, 10, probes=12).collect()}
    assert len(exact & found) >= 0.9 * len(exact)
    assert {(r["query_idx"], r["center_frame"]) for r in ivf.search(q, 10, probes=16).collect()} == exact


def test_plan_shapes(spark, tmp_path):
    rng = np.random.default_rng(3)
    index_of(spark, [(f"v{i % 5}", i, 0.0, rng.normal(size=4).tolist()) for i in range(200)]).write.parquet(str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0])], "query_idx long, embedding array<double>")
    assert plan_of(knn.knn_join(q, index, 5)).count("WindowGroupLimit") == 2
    one = plan_of(knn.knn_topk(index, [1.0, 0.0, 0.0, 0.0], 5, "v1"))
    assert "TakeOrderedAndProject" in one and "EqualTo(video_id,v1)" in one


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, 0.0), ("b", 1, 0.0)], "video_id string, center_frame int, timestamp_sec double")
    batch = spark.createDataFrame([("a", 1, 1.0, 1), ("a", 1, 2.0, 2), ("c", 1, 3.0, 1)], "video_id string, center_frame int, timestamp_sec double, ord int")
    once = store.upsert(base, batch, ["video_id", "center_frame"], "ord")
    want = [("a", 1, 2.0), ("b", 1, 0.0), ("c", 1, 3.0)]
    assert sorted(tuple(r) for r in once.collect()) == want
    assert sorted(tuple(r) for r in store.upsert(once, batch, ["video_id", "center_frame"], "ord").collect()) == want


def test_index_table_and_jobs(spark):
    t = store.IndexTable(spark, "video_index_test", dims=4)
    t.delete()
    assert t.create() and not t.create()
    rows = [("a", 1, 0.1, [1.0, 0, 0, 0]), ("a", 2, 0.2, [0.0, 0, 0, 0]), ("b", 1, 0.3, [1.0, 0, 0]), ("b", 2, 0.4, None)]
    bad = t.write(index_of(spark, [(v, c, s, e if e is None else [float(x) for x in e]) for v, c, s, e in rows]))
    assert sorted(r["reason"] for r in bad.collect()) == ["dims", "missing", "zero"]
    assert t.read().count() == 1 and t.indexed("a") and not t.indexed("b")
    frames = spark.createDataFrame([(v, i, [1.0, float(i), 2.0, 0.0]) for v in ("a", "c") for i in range(40)], "video_id string, frame_idx long, embedding array<double>")
    jobs.index_videos(t, frames, None, 5.0)
    assert t.indexed("c") and t.read().filter("video_id = 'a'").count() == 1
    top = jobs.search_by_video(t, frames.filter("video_id = 'c'"), 5.0).collect()
    assert top[0]["video_id"] == "c"
    assert t.delete() and not t.delete()


def test_writes_touch_their_buckets_only(spark):
    t = store.IndexTable(spark, "bucket_index_test", dims=1)
    t.delete()
    t.create()
    row = lambda v, c, s: (v, c, s, [1.0])
    t.write(index_of(spark, [row(f"v{i}", 1, 0.0) for i in range(40)]))
    before = t.versions()
    t.write(index_of(spark, [row("v3", 1, 9.0), row("v3", 1, 8.0), row("v3", 2, 1.0)]))
    after = t.versions()
    changed = {b for b in after if after[b] != before.get(b)}
    assert len(changed) == 1 and len(before) > 5
    got = {(r["video_id"], r["center_frame"]): r["timestamp_sec"] for r in t.read().collect()}
    assert len(got) == 41 and got["v3", 1] == 9.0 and got["v4", 1] == 0.0
    plan = t._buckets({b: before[b] for b in changed})._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters")[1]
    # the version replaced last stays for readers that began before, and goes with the next write
    assert len(spark.sql(f"SHOW PARTITIONS {t.data}").collect()) == len(after) + 1
    t.write(index_of(spark, [row("v3", 1, 7.0)]))
    assert len(spark.sql(f"SHOW PARTITIONS {t.data}").collect()) == len(after) + 1
    assert t.delete() and not t.delete()


@pytest.mark.parametrize("step", ["_show", "_drop_old"])
def test_a_write_that_dies_loses_nothing(spark, monkeypatch, step):
    t = store.IndexTable(spark, "crash_index_test", dims=1)
    t.delete()
    t.create()
    t.write(index_of(spark, [("a", 1, 0.0, [1.0]), ("b", 1, 0.0, [1.0])]))
    with monkeypatch.context() as m:
        m.setattr(store.IndexTable, step, lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            t.write(index_of(spark, [("a", 1, 5.0, [1.0]), ("c", 1, 5.0, [1.0])]))
    seen = {r["video_id"]: r["timestamp_sec"] for r in store.IndexTable(spark, "crash_index_test", 1).read().collect()}
    assert seen == ({"a": 0.0, "b": 0.0} if step == "_show" else {"a": 5.0, "b": 0.0, "c": 5.0})
    before = t.versions()
    t.write(index_of(spark, [("c", 1, 7.0, [1.0])]))
    assert {r["video_id"]: r["timestamp_sec"] for r in t.read().collect()} == seen | {"c": 7.0}
    # what the dead write left is gone; the versions of the views before and now are there
    there = {tuple(int(x.split("=")[1]) for x in r[0].split("/"))[::2] for r in spark.sql(f"SHOW PARTITIONS {t.data}").collect()}
    assert there == set(t.versions().items()) | set(before.items())
    t.delete()


def test_manifest_to_index(spark, tmp_path):
    """From a manifest to the index, with scenes, two rates, a missing file and one that cannot be decoded."""
    ids = {"a": "validation", "b": "validation", "c": "training", "gone": "validation", "bad": "validation"}
    (tmp_path / "m.json").write_text(json.dumps({"database": {k: {"subset": v} for k, v in ids.items()}}))
    for v in ("a", "b", "c", "bad"):
        (tmp_path / f"{v}.mp4").write_bytes(v.encode())

    def decoder(path):
        video = os.path.basename(path)[:-4]
        if video == "bad":
            raise OSError("not a video")
        for i in range(60):
            shade = 200 if video == "a" and i >= 30 else 10  # one cut
            yield i, 5.0 if video == "a" else 10.0, bytes([shade + i % 3, 1, 2, 3])

    t = store.IndexTable(spark, "corpus_index_test", dims=16)
    t.delete()
    job = lambda: jobs.index_corpus(spark, t, str(tmp_path / "m.json"), "validation", str(tmp_path), M.LocalFetcher(), decoder, lambda: ByteStatsEncoder(16), "stats16c")
    assert job().count() == 0
    got = {}
    for r in t.read().collect():
        got.setdefault(r["video_id"], []).append(r["center_frame"])
    want_a = [c for c, _, _ in loop_windows(30, 5.0, 0.5)]
    assert {v: sorted(c) for v, c in got.items()} == {"a": want_a + [30 + c for c in want_a], "b": [c for c, _, _ in loop_windows(60, 10.0, 0.5)]}
    before = t.versions()
    job()
    assert t.versions() == before
    t.delete()


def test_encoder_and_search_by_image(spark, tmp_path):
    t = store.IndexTable(spark, "image_index_test", dims=16)
    t.delete()
    t.create()
    frames = spark.createDataFrame([("a", 1, bytes(range(40))), ("b", 1, b"zzz" * 9), ("c", 1, b"")], "video_id string, center_frame int, data binary")
    make = lambda: ByteStatsEncoder(16)
    enc = jobs.encode_frames(frames, make, "stats16").withColumn("timestamp_sec", F.lit(0.0))
    assert enc.count() == 2
    t.write(enc)
    (tmp_path / "q.jpg").write_bytes(b"zzz" * 9)
    assert jobs.search_by_image_path(spark, t, str(tmp_path / "q.jpg"), make, "stats16").first()["video_id"] == "b"
    with pytest.raises(ValueError):
        jobs.search_by_image_path(spark, t, str(tmp_path / "none.jpg"), make, "stats16")
    t.delete()


def test_manifest_files_and_json(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"database": {"z": {"subset": "validation", "x": 1}, "a": {"subset": "training"}, "b": {"subset": "validation"}}}))
    m = M.read_manifest(spark, M.ensure_manifest(str(tmp_path / "m.json")))
    assert [r["video_id"] for r in M.manifest_subset(m).orderBy("ord").collect()] == ["z", "b"]
    with pytest.raises(RuntimeError):
        M.ensure_manifest(str(tmp_path / "none.json"))
    videos = tmp_path / "v"
    videos.mkdir()
    for n in ("b.mp4", "a.mp4.mp4", "c.MP4", "d.txt"):
        (videos / n).write_bytes(b"x" * 200)
    assert sorted(r["video_id"] for r in M.list_videos(spark, str(videos)).collect()) == ["a", "b"]
    assert M.count_videos(spark, str(videos)) == 2 and M.count_videos(spark, str(tmp_path / "no")) == 0
    FR.register(spark)
    f = spark.read.format("frames").option("path", str(videos)).option("start_frame", 1).load()
    assert sorted((r["video_id"], r["frame_idx"]) for r in f.collect()) == [(v, i) for v in ("a", "b") for i in (1, 2, 3)]
    rows = index_of(spark, [("v1", 1, 0.5, [0.0, 0.0]), ("v1", 2, 1.0, [3.0, 4.0])])
    out = tmp_path / "json"
    assert E.export_embeddings_json(rows, "v1", str(out / "v1.json")) == 2
    back = E.read_embeddings_unit(spark, str(out)).orderBy("center_frame").collect()
    assert [(r["video_id"], r["center_frame"]) for r in back] == [("v1", 1), ("v1", 2)]
    assert list(back[0]["embedding"]) == [0.0, 0.0] and np.allclose(back[1]["embedding"], [0.6, 0.8])


def test_fixed_random_indices():
    a = M.fixed_random_indices()
    assert a == sorted(a) == M.fixed_random_indices() and len(set(a)) == 10
    with pytest.raises(ValueError):
        M.fixed_random_indices(11, 10)


def test_streams(spark, tmp_path):
    from reelquery.streaming.ingest import ring_buffer_windows, upsert_stream

    src = tmp_path / "frames"
    rows = [("v", i, 5.0, bytes([i])) for i in range(60)] + [("w", i, 12.5, bytes([i])) for i in range(60)]
    spark.createDataFrame(rows, "video_id string, frame_idx long, fps double, data binary").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("video_id string, frame_idx long, fps double, data binary").parquet(str(src))
    q = ring_buffer_windows(stream).writeStream.format("memory").queryName("ring").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    for video, rate in (("v", 5.0), ("w", 12.5)):
        assert sorted(r["center_frame"] for r in spark.table("ring").filter(F.col("video_id") == video).collect()) == [c for c, _, _ in loop_windows(60, rate, 0.5)]
    t = store.IndexTable(spark, "stream_index_test", dims=2)
    t.delete()
    t.create()
    index_of(spark, [("a", 1, 0.0, [1.0, 0.0])]).write.parquet(str(tmp_path / "e"))
    emb = spark.readStream.schema("video_id string, center_frame long, timestamp_sec double, embedding array<double>").parquet(str(tmp_path / "e"))
    q = upsert_stream(emb, t, str(tmp_path / "c2"))
    q.awaitTermination()
    assert t.read().count() == 1
    t.delete()


def test_command_line_and_fetch(spark, tmp_path, capsys):
    from reelquery.plans import cli

    frames = [(v, i, [1.0, float(i % 7) * (1 + ord(v) % 3), 2.0]) for v in ("a", "b") for i in range(40)]
    spark.createDataFrame(frames, "video_id string, frame_idx long, embedding array<double>").write.parquet(str(tmp_path / "f"))
    store.IndexTable(spark, "cli_index_test").delete()
    common = ["--frames", str(tmp_path / "f"), "--fps", "5", "--table", "cli_index_test", "--dims", "3"]
    assert cli.main(["index", *common], spark).select("video_id").distinct().count() == 2
    before = store.IndexTable(spark, "cli_index_test", 3).read().count()
    assert cli.main(["index", *common], spark).count() == before
    cli.main(["search", *common, "--video", "a", "--order-bonus"], spark)
    assert "a  score=" in capsys.readouterr().out
    (tmp_path / "c.mp4").write_bytes(b"x")
    manifest = spark.createDataFrame([("a",), ("c",), ("d",)], "video_id string")
    got = jobs.fetch_pending(manifest, store.IndexTable(spark, "cli_index_test", 3), M.LocalFetcher(), str(tmp_path)).collect()
    assert [r["video_id"] for r in got] == ["c"]
    assert cli.main(["list", "--directory", str(tmp_path)], spark).count() == 1
    store.IndexTable(spark, "cli_index_test").delete()
