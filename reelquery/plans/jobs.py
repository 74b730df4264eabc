"""The end-to-end jobs: index pending videos, search by video, frame or image."""

import logging
import os
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reelquery.functions.encode import frame_encoder, loaded, unit_vectors
from reelquery.operators.knn import knn_topk
from reelquery.operators.ranking import chamfer_rank, search_video
from reelquery.operators.staging import stage, staged
from reelquery.operators.store import IndexTable, pending
from reelquery.operators.temporal import embed_windows, keyframe_windows, scenes_of, windows_with_fallback
from reelquery.sources.manifest import manifest_subset, read_manifest


def setup_logger(name: str = "reelquery", file: str | None = None, level: int = logging.INFO) -> logging.Logger:
    """Console and optional file handler; asking again adds none."""
    log = logging.getLogger(name)
    log.setLevel(level)
    if not log.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if file:
            if os.path.dirname(file):
                os.makedirs(os.path.dirname(file), exist_ok=True)
            handlers.append(logging.FileHandler(file, encoding="utf-8"))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
            log.addHandler(h)
    return log


def encode_frames(frames: DataFrame, factory: Callable[[], object], name: str) -> DataFrame:
    """``data`` to unit ``embedding``; frames the encoder cannot take are dropped."""
    return frames.withColumn("embedding", frame_encoder(factory, name)("data")).drop("data").filter(F.col("embedding").isNotNull())


def decode_frames(paths: DataFrame, decoder: Callable[[str], Iterator[tuple[int, float, bytes]]], batch: int = 64) -> DataFrame:
    """``(video_id, path)`` to ``(video_id, frame_idx, fps, data)``, some frames at a time; a file that cannot be decoded gives none.

    ``decoder`` runs on the executors and yields ``(frame_idx, fps, bytes)``; each video keeps its own rate.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for video, path in zip(rows["video_id"], rows["path"], strict=True):
                held: list[tuple] = []
                try:
                    for i, fps, data in decoder(path):
                        held.append((video, i, float(fps or 0.0), data))
                        if len(held) == batch:
                            yield pd.DataFrame(held, columns=["video_id", "frame_idx", "fps", "data"])
                            held = []
                except Exception:  # as in the other steps, one bad file must not end the job
                    logging.getLogger("reelquery").warning("cannot decode %s", path)
                if held:
                    yield pd.DataFrame(held, columns=["video_id", "frame_idx", "fps", "data"])

    return paths.select("video_id", "path").mapInPandas(run, "video_id string, frame_idx long, fps double, data binary")


def byte_change(before: bytes, after: bytes) -> float:
    """STAND-IN, NOT A VIDEO METRIC: the mean difference of the bytes of two frames."""
    n = min(len(before), len(after))
    return sum(abs(a - b) for a, b in zip(before, after, strict=False)) / n if n else 0.0


def frame_features(
    paths: DataFrame, decoder: Callable[[str], Iterator[tuple]], factory: Callable[[], object], name: str, scorer: Callable = byte_change, frames: int = 64, size: int = 16 << 20,
) -> DataFrame:
    """``(video_id, path)`` to ``(video_id, frame_idx, fps, score, embedding)`` in one pass: each video is decoded once, each frame scored against
    the one before it as it comes (0 for the first) and encoded once.

    ``decoder`` yields ``(frame_idx, fps, data)`` in order; data may be bytes or an array, as ``scorer`` and the encoder take it.  At most
    ``frames`` frames of some ``size`` bytes are held, so a video's length does not matter.  Frames that cannot be encoded have a null
    vector; a file that cannot be decoded gives the frames before the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def out(video: str, held: list[tuple]) -> pd.DataFrame:
            vectors = unit_vectors(loaded(factory, name), [x[3] for x in held])
            return pd.DataFrame([(video, i, fps, score, v) for (i, fps, score, _), v in zip(held, vectors, strict=True)], columns=["video_id", "frame_idx", "fps", "score", "embedding"])

        for rows in batches:
            for video, path in zip(rows["video_id"], rows["path"], strict=True):
                held, weight, before = [], 0, None
                try:
                    for i, fps, data in decoder(path):
                        held.append((i, float(fps or 0.0), 0.0 if before is None else float(scorer(before, data)), data))
                        weight, before = weight + getattr(data, "nbytes", len(data)), data
                        if len(held) == frames or weight >= size:
                            yield out(video, held)
                            held, weight = [], 0
                except Exception:  # as in the other steps, one bad file must not end the job
                    logging.getLogger("reelquery").warning("cannot decode %s", path)
                if held:
                    yield out(video, held)

    return paths.select("video_id", "path").mapInPandas(run, "video_id string, frame_idx long, fps double, score double, embedding array<float>")


class VideoStage:
    """Frames of videos between decoding and indexing, in waves: ``<name>_frames``, and ``<name>_waves`` with every video that was tried.

    A wave counts once its videos are in ``<name>_waves``; its frames lie in a partition of their own until they are indexed.  A run that is
    stopped leaves whole waves, which the next run indexes without decoding, and a part of one, which it overwrites.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.frames, self.waves = spark, f"{name}_frames", f"{name}_waves"

    def create(self) -> None:
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.frames} (video_id string, frame_idx bigint, fps double, score double, embedding array<float>, wave bigint) USING parquet PARTITIONED BY (wave)")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.waves} (video_id string, wave bigint, frames bigint) USING parquet")

    def delete(self) -> None:
        for name in (self.frames, self.waves):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def last(self) -> int:
        return self.spark.table(self.waves).agg(F.max("wave")).first()[0] or 0

    def tried(self, since: int) -> DataFrame:
        """Videos that need no decoding: those decoded in any wave, and those that could not be fetched in a wave after ``since``."""
        return self.spark.table(self.waves).filter(F.col("frames").isNotNull() | (F.col("wave") > since)).select("video_id")

    def left(self) -> list[int]:
        """Waves that are staged and not yet indexed."""
        whole = {r["wave"] for r in self.spark.table(self.waves).select("wave").distinct().collect()}  # a row a wave
        return sorted(whole & {int(r[0].split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.frames}").collect()})

    def add(self, names: DataFrame, paths: DataFrame, features: DataFrame) -> None:
        """Stages one wave: ``features`` is evaluated here and nowhere else."""
        wave = self.last() + 1
        features.createOrReplaceTempView("_features")
        self.spark.sql(f"INSERT OVERWRITE {self.frames} PARTITION (wave = {wave}) SELECT video_id, frame_idx, fps, score, embedding FROM _features")
        self.spark.catalog.dropTempView("_features")
        counts = self.read(wave).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
        fetched = paths.select("video_id").distinct().join(counts, "video_id", "left").select("video_id", F.coalesce("n", F.lit(0)).alias("frames"))
        names.select("video_id").distinct().join(fetched, "video_id", "left").select("video_id", F.lit(wave).cast("long").alias("wave"), F.col("frames").cast("long")).write.insertInto(self.waves)

    def read(self, wave: int) -> DataFrame:
        return self.spark.table(self.frames).filter(F.col("wave") == wave).drop("wave")

    def drop(self, wave: int) -> None:
        self.spark.sql(f"ALTER TABLE {self.frames} DROP IF EXISTS PARTITION (wave = {wave})")


def index_corpus(
    spark: SparkSession, table: IndexTable, manifest: str, subset: str, directory: str, fetcher, decoder, factory: Callable[[], object], name: str,
    scorer: Callable = byte_change, threshold: float = 30.0, method: str = "mean", min_frames: int = 15, wave: int = 1000, limit: int | None = 1000,
) -> DataFrame:
    """From a manifest to the index: the subset's videos that are not indexed are fetched, decoded, cut into scenes and encoded, and their
    window embeddings written.  Returns the quarantined rows.

    ``wave`` videos at a time are staged (``VideoStage``) and indexed, so each is fetched, decoded and encoded once, and a run that was
    stopped goes on where it was.  Videos that gave no windows are not tried again; those that could not be fetched are, in the
    next run.  ``directory`` must be one that the executors share.
    """
    log = logging.getLogger("reelquery")
    table.create()
    stage_of = VideoStage(spark, table.name)
    stage_of.create()
    bad = []

    def index(n: int) -> None:
        frames = stage_of.read(n)
        scenes = scenes_of(frames.select("video_id", "frame_idx", "fps", "score"), threshold, min_frames)
        encoded = frames.filter(F.col("embedding").isNotNull()).drop("score")
        bad.append(stage(table.write(video_embeddings(encoded, scenes, None, method))))
        log.info("wave %d is indexed: %s", n, ", ".join(f"{k} {v}" for k, v in table.counts.items()))
        stage_of.drop(n)

    for n in stage_of.left():
        index(n)
    since = stage_of.last()
    videos = manifest_subset(read_manifest(spark, manifest), subset, limit).select("video_id").distinct()
    while True:
        rest = pending(videos, table.read()).join(stage_of.tried(since), "video_id", "left_anti").orderBy("video_id").limit(wave)
        with staged(rest) as names:
            if names.isEmpty():
                break
            # a video a task: decoding and encoding take far longer than a task's start
            with staged(fetch(names, fetcher, directory)) as paths:
                spread = paths.repartition(max(1, min(wave, paths.count())), "video_id")
                stage_of.add(names, paths, frame_features(spread, decoder, factory, name, scorer))
        index(stage_of.last())
    return reduce(DataFrame.unionByName, bad) if bad else spark.table(f"{table.name}_quarantine") if spark.catalog.tableExists(f"{table.name}_quarantine") else spark.createDataFrame([], "video_id string, reason string")


def video_embeddings(frames: DataFrame, scenes: DataFrame | None, fps: float | None = None, method: str = "mean", k_seconds: float = 0.5) -> DataFrame:
    """Frames with embeddings to window embeddings: per scene with fallback, or whole videos without scenes.

    ``fps``: one rate for all; without it each row's own (column ``fps``).
    """
    windows = keyframe_windows(frames, ["video_id"], k_seconds, fps) if scenes is None else windows_with_fallback(frames, scenes, fps, k_seconds)
    return embed_windows(windows, method)


def fetch(videos: DataFrame, fetcher, directory: str) -> DataFrame:
    """``(video_id, path)``; what cannot be fetched is dropped.  ``fetcher`` runs on the executors; the folder must be one that they share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            paths = [fetcher.fetch(v, directory) for v in rows["video_id"]]
            out = pd.DataFrame({"video_id": rows["video_id"], "path": paths})
            yield out[out["path"].notna()]

    return videos.select("video_id").mapInPandas(run, "video_id string, path string")


def fetch_pending(manifest: DataFrame, table: IndexTable, fetcher, directory: str) -> DataFrame:
    """``(video_id, path)`` of the manifest's videos that are not indexed yet: the anti join comes first, so indexed videos cost nothing."""
    return fetch(pending(manifest, table.read()), fetcher, directory)


def index_videos(table: IndexTable, frames: DataFrame, scenes: DataFrame | None, fps: float | None = None, method: str = "mean") -> DataFrame:
    """Indexes the videos of ``frames`` that have no row in the table, as one plan; returns the quarantined rows."""
    table.create()
    return table.write(video_embeddings(pending(frames, table.read()), scenes, fps, method))


def as_queries(embeddings: DataFrame) -> DataFrame:
    """Window embeddings of one query video numbered in time order."""
    return embeddings.withColumn("query_idx", F.row_number().over(Window.partitionBy("video_id").orderBy("center_frame")) - 1)


def search_by_video(table: IndexTable, frames: DataFrame, fps: float | None = None, top_k: int = 10, order_bonus: bool = False) -> DataFrame:
    return search_video(as_queries(video_embeddings(frames, None, fps)), table.read(), top_k=top_k, order_bonus=order_bonus)


def search_by_embeddings(query: DataFrame, index: DataFrame, query_id: str, top_k: int = 10) -> DataFrame:
    return chamfer_rank(as_queries(query), index, query_id, top_k)


def search_by_frame(spark: SparkSession, table: IndexTable, frame: bytes, factory: Callable[[], object], name: str, video_id: str | None = None, k: int = 5) -> DataFrame:
    got = encode_frames(spark.createDataFrame([(frame,)], "data binary"), factory, name).first()
    if got is None:
        raise ValueError("the frame cannot be encoded")
    return knn_topk(table.read(), list(got["embedding"]), k, video_id)


def search_by_image_path(spark: SparkSession, table: IndexTable, path: str, factory: Callable[[], object], name: str, video_id: str | None = None, k: int = 5) -> DataFrame:
    if not os.path.isfile(path):
        raise ValueError(f"the image cannot be loaded: {path!r}")
    with open(path, "rb") as f:
        return search_by_frame(spark, table, f.read(), factory, name, video_id, k)
