"""Scenes as a fold over frames, the join of frames and scenes, and the cost of normalising."""

import random
import time

from pyspark.sql import functions as F

from reelquery.functions import vector as V
from reelquery.operators import temporal


def loop_scenes(scores, threshold, least):
    """The frame-at-a-time rule: cuts, then scenes; no cut gives none."""
    first = min(i for i, _ in scores)
    cuts, last = [], first
    for i, s in sorted(scores):
        if s >= threshold and i - last >= least:
            cuts.append(i)
            last = i
    edges = [first, *cuts, max(i for i, _ in scores) + 1]
    return list(zip(edges, edges[1:], strict=False)) if cuts else []


def test_scenes_follow_the_loop(spark):
    r = random.Random(4)
    rows, want = [], {}
    for v in range(60):
        n, first = r.randint(1, 120), r.choice([0, 7])
        scores = [(first + i, r.choice([0.0, 29.9, 30.0, 80.0]) if r.random() < v / 60 else 0.0) for i in range(n)]
        rows += [(str(v), i, 10.0, s) for i, s in scores]
        want[str(v)] = [(k, a / 10, b / 10) for k, (a, b) in enumerate(loop_scenes(scores, 30.0, 15))]
    got = {v: [] for v in want}
    for x in temporal.scenes_of(spark.createDataFrame(rows, "video_id string, frame_idx long, fps double, score double").repartition(7)).collect():
        got[x["video_id"]].append((x["scene_id"], x["start_sec"], x["end_sec"]))
    assert {v: sorted(s) for v, s in got.items()} == want
    assert any(len(s) > 2 for s in want.values()) and any(not s for s in want.values())


def test_cut_at_the_first_frame_and_no_scores(spark):
    df = spark.createDataFrame([("a", 0, 99.0), ("a", 1, 99.0), ("b", 0, None)], "video_id string, frame_idx long, score double")
    assert temporal.scenes_of(df).collect() == []
    assert temporal.scenes_of(df, min_frames=1).count() == 2
    assert temporal.scenes_of(df.limit(0)).collect() == []


def joined_rows(df):
    """Rows that the joins of an executed plan have put out, the largest number."""
    plan = df._jdf.queryExecution().executedPlan()
    most, left = 0, [plan]
    while left:
        p = left.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            left.append(p.executedPlan())
            continue
        if "QueryStage" in p.getClass().getSimpleName():
            left.append(p.plan())
        if "Join" in p.getClass().getSimpleName():
            most = max(most, p.metrics().apply("numOutputRows").value())
        left += [p.children().apply(i) for i in range(p.children().size())]
    return most


def test_a_frame_meets_its_scenes_only(spark):
    """One video with 10,000 scenes: the joins put out the rows that are kept, not frames times scenes."""
    n = 10_000
    frames = spark.range(n * 4).select(F.lit("v").alias("video_id"), F.col("id").alias("frame_idx"), F.lit(2.0).alias("fps"))
    scenes = spark.range(n).select(F.lit("v").alias("video_id"), F.col("id").alias("scene_id"), (F.col("id") * 2.0).alias("start_sec"), (F.col("id") * 2.0 + 2.0).alias("end_sec"))
    out = temporal.scene_frames(frames, scenes)
    assert len(out.collect()) == 4 * n
    assert joined_rows(out) == 4 * n


def test_scenes_may_overlap_and_end_beyond_the_video(spark):
    frames = spark.createDataFrame([("v", i, 1.0) for i in range(10)] + [("w", 5, 1.0)], "video_id string, frame_idx long, fps double")
    scenes = spark.createDataFrame([("v", 0, 0.0, 3.0), ("v", 1, 2.0, 1e12), ("v", 2, 5.0, 5.0), ("v", 3, -2.0, 1.0), ("x", 0, 0.0, 9.0)], "video_id string, scene_id long, start_sec double, end_sec double")
    got = sorted((r["scene_id"], r["frame_idx"]) for r in temporal.scene_frames(frames, scenes).collect())
    assert got == [(0, i) for i in range(3)] + [(1, i) for i in range(2, 10)] + [(3, 0)]


def test_normalising_is_linear_in_the_dimensions(spark):
    def took(dims):
        df = spark.range(20_000 // dims * 64).select(F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: i + F.rand(1)).alias("v")).cache()
        df.count()
        best = 1e9
        for _ in range(3):
            began = time.perf_counter()
            df.select(V.normalize(F.col("v"))).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        df.unpersist()
        return best

    took(64)
    assert took(512) < 4 * took(64)  # as many components in all; a norm for every component would take eight times as long
