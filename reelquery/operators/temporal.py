"""Temporal operators: synchronised indices, centred windows, scene cuts and the scene/whole-video fallback.

Frames are rows ``(video_id, frame_idx, fps, embedding)``.  For centred windows a frame is sent to the centres it belongs to (one or
two at the usual radius) and the windows are put together there, so the work of a long video is spread over its windows.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.functions.timing import DEFAULT_FPS, fps_or_default, interval_of, radius_of
from reelquery.functions.vector import embed_window


def sync_indices(videos: DataFrame) -> DataFrame:
    """``(video_id, fps, total_frames)`` to one row per second: 0, interval, 2*interval, ... below total."""
    step = interval_of(F.col("fps"))
    idx = F.when(F.col("total_frames") > 0, F.sequence(F.lit(0).cast("long"), F.col("total_frames").cast("long") - 1, step))
    return videos.select("video_id", F.explode(idx).alias("frame_idx"))


def clipped_windows(frames: DataFrame, k: int, payload: str = "embedding") -> DataFrame:
    """The 2k+1 frames around every frame, cut at the ends without padding."""
    w = Window.partitionBy("video_id").orderBy("frame_idx").rowsBetween(-k, k)
    return frames.select("video_id", "frame_idx", F.collect_list(payload).over(w).alias("window"))


def rate_of(frames: DataFrame, fps: float | None = None) -> Column:
    """The frame rate of each row: ``fps`` if given, else the column of that name, else the default."""
    if fps is None and "fps" in frames.columns:
        return fps_or_default(F.col("fps"))
    return F.lit(float(fps or DEFAULT_FPS))


def keyframe_windows(frames: DataFrame, keys: list[str], k_seconds: float = 0.5, fps: float | None = None, payload: str = "embedding") -> DataFrame:
    """Complete centred windows, one a second from each segment's first frame.

    ``keys`` identify a segment; ``frame_idx`` must be consecutive inside it.  Every segment has its own rate (``rate_of``; the
    largest, should its rows differ).
    """
    rows = frames.select(*keys, "frame_idx", F.col(payload).alias("_payload"), rate_of(frames, fps).alias("_rate"))
    segments = rows.groupBy(*keys).agg(F.min("frame_idx").alias("_first"), F.max("_rate").alias("_fps"))
    segments = segments.select(*[F.col(k).alias(f"_{k}") for k in keys], "_first", "_fps", interval_of(F.col("_fps")).alias("_step"), radius_of(F.col("_fps"), k_seconds).alias("_radius"))
    joined = rows.join(segments, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    # the n-th centre is n steps from the first frame; a frame belongs to those within the radius
    at = F.col("frame_idx") - F.col("_first")
    low = F.greatest(F.ceil((at - F.col("_radius")) / F.col("_step")).cast("long"), F.lit(0).cast("long"))
    high = F.floor((at + F.col("_radius")) / F.col("_step")).cast("long")
    sent = joined.withColumn("_n", F.explode(F.when(low <= high, F.sequence(low, high))))
    center = F.col("_first") + F.col("_n") * F.col("_step")
    made = sent.groupBy(*keys, center.alias("center_frame"), "_fps", "_radius").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "_payload"))).alias("_w"))
    whole = made.filter(F.size("_w") == 2 * F.col("_radius") + 1)
    return whole.select(*keys, "center_frame", (F.col("center_frame") / F.col("_fps")).alias("timestamp_sec"), F.col("_w._payload").alias("window"))


def window_bounds(fps: Column, start_sec: Column, end_sec: Column, total: Column) -> tuple[Column, Column]:
    """First frame and end (exclusive) of a segment; a null start is 0, a null end the whole video."""
    rate = fps_or_default(fps)
    return F.coalesce((start_sec * rate).cast("long"), F.lit(0).cast("long")), F.least(total.cast("long"), F.coalesce((end_sec * rate).cast("long"), total.cast("long")))


def scene_segments(scored: DataFrame, threshold: float, key: str = "video_id", order: tuple[str, ...] = ("ts",), value: str = "value") -> DataFrame:
    """Gaps and islands: a new scene starts where ``abs(value - previous) >= threshold``."""
    w = Window.partitionBy(key).orderBy(*order)
    cut = (F.abs(F.col(value) - F.lag(value).over(w)) >= threshold).cast("int")
    return scored.withColumn("_cut", F.coalesce(cut, F.lit(0))).withColumn("scene_id", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut")


def scene_min_length(scenes: DataFrame, seconds: float = 1.0) -> DataFrame:
    return scenes.filter(F.col("end_sec") - F.col("start_sec") >= seconds)


def scenes_of(scored: DataFrame, threshold: float = 30.0, min_frames: int = 15) -> DataFrame:
    """``(video_id, frame_idx, score[, fps])`` to scenes ``(video_id, scene_id, start_sec, end_sec)``.

    A frame with a score from the threshold on begins a scene if the scene before has ``min_frames`` frames by then; a video without a cut has
    no scenes.  Only frames at or above the threshold are gathered, in order, and folded; the others are counted.
    """
    high = F.when(F.col("score") >= threshold, F.col("frame_idx"))
    videos = scored.withColumn("_rate", rate_of(scored)).groupBy("video_id").agg(F.min("frame_idx").alias("_first"), (F.max("frame_idx") + 1).alias("_end"), F.max("_rate").alias("_rate"), F.array_sort(F.collect_list(high)).alias("_high"))
    far = lambda cuts, i: i - F.element_at(cuts, -1) >= min_frames
    starts = F.aggregate("_high", F.array("_first"), lambda cuts, i: F.when(far(cuts, i), F.array_append(cuts, i)).otherwise(cuts))
    cut = videos.withColumn("_starts", starts).filter(F.size("_starts") > 1)
    ends = F.array_append(F.slice("_starts", 2, F.size("_starts")), F.col("_end"))
    scenes = cut.select("video_id", "_rate", F.posexplode(F.arrays_zip(F.col("_starts").alias("a"), ends.alias("b"))).alias("scene_id", "s"))
    return scenes.select("video_id", F.col("scene_id").cast("long").alias("scene_id"), (F.col("s.a") / F.col("_rate")).alias("start_sec"), (F.col("s.b") / F.col("_rate")).alias("end_sec"))


def scene_frames(frames: DataFrame, scenes: DataFrame, fps: float | None = None) -> DataFrame:
    """Frames with the ``scene_id`` of each scene ``(video_id, scene_id, start_sec, end_sec)`` they lie in; scenes may overlap or be empty.

    A scene names its frames, cut at the video's last one, so frames and scenes meet by an equi-join on (video, frame): every row joined
    is kept, whatever the number of scenes of a video, and one long video is spread over its frames.
    """
    videos = frames.groupBy(F.col("video_id").alias("_v")).agg(F.max("frame_idx").alias("_last"), F.max(rate_of(frames, fps)).alias("_rate"))
    at = scenes.join(videos, F.col("video_id") == F.col("_v"))
    first, last = F.greatest((F.col("start_sec") * F.col("_rate")).cast("long"), F.lit(0)), F.least((F.col("end_sec") * F.col("_rate")).cast("long") - 1, F.col("_last"))
    members = at.select("_v", "scene_id", F.explode(F.when(first <= last, F.sequence(first, last))).alias("_i"))
    return frames.join(members, (F.col("video_id") == F.col("_v")) & (F.col("frame_idx") == F.col("_i"))).drop("_v", "_i")


def scene_windows(frames: DataFrame, scenes: DataFrame, fps: float | None = None, k_seconds: float = 0.5, min_seconds: float = 1.0) -> DataFrame:
    """Windows of every scene of at least ``min_seconds``, at the video's own rate."""
    inside = scene_frames(frames, scene_min_length(scenes, min_seconds), fps)
    return keyframe_windows(inside, ["video_id", "scene_id"], k_seconds, fps)


def windows_with_fallback(frames: DataFrame, scenes: DataFrame, fps: float | None = None, k_seconds: float = 0.5) -> DataFrame:
    """Scene windows, or whole-video windows for the videos whose scenes give none at all."""
    by_scene = scene_windows(frames, scenes, fps, k_seconds).drop("scene_id")
    missing = frames.join(by_scene.select("video_id").distinct(), "video_id", "left_anti")
    return by_scene.unionByName(keyframe_windows(missing, ["video_id"], k_seconds, fps))


def embed_windows(windows: DataFrame, method: str = "mean") -> DataFrame:
    """Pooled, renormalised embedding per window; windows that pool to zero are dropped."""
    return windows.withColumn("embedding", embed_window(F.col("window"), method)).drop("window").filter(F.col("embedding").isNotNull())


__all__ = ["clipped_windows", "embed_windows", "keyframe_windows", "radius_of", "rate_of", "scene_frames", "scene_min_length", "scene_segments", "scene_windows", "scenes_of", "sync_indices", "window_bounds", "windows_with_fallback"]
