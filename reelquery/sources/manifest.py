"""Manifest, video files, images and fetching."""

import os
import random
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "database map<string, struct<subset: string>>"


def ensure_manifest(path: str) -> str:
    """Checks that the manifest is there; downloading it is outside the engine."""
    if not os.path.isfile(path):
        raise RuntimeError(f"no manifest at {path}; fetch it before the job")
    return path


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``(ord, video_id, subset)`` in file order."""
    raw = spark.read.option("multiLine", True).schema(MANIFEST).json(path)
    entries = F.posexplode(F.map_entries("database")).alias("ord", "entry")
    return raw.select(entries).select("ord", F.col("entry.key").alias("video_id"), F.col("entry.value.subset").alias("subset"))


def manifest_subset(manifest: DataFrame, subset: str = "validation", limit: int | None = 1000) -> DataFrame:
    """The first ``limit`` entries of a subset in file order."""
    out = manifest.filter(F.col("subset") == subset)
    return out if limit is None else out.orderBy("ord").limit(limit)


def video_id_of(path: Column) -> Column:
    """Last path segment with every ``.mp4`` taken out."""
    return F.replace(F.substring_index(path, "/", -1), F.lit(".mp4"), F.lit(""))


def list_videos(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, video_id, length)`` of the .mp4 files; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mp4").load(directory)
    return files.select("path", video_id_of(F.col("path")).alias("video_id"), "length")


def count_videos(spark: SparkSession, directory: str) -> int:
    return list_videos(spark, directory).count() if os.path.isdir(directory) else 0


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image bytes ``(path, content)``; a path without files is an error."""
    out = spark.read.format("binaryFile").load(path).select("path", "content")
    if out.limit(1).count() == 0:
        raise ValueError(f"no image at {path}")
    return out


class VideoFetcher(Protocol):
    """Fetches a video; None means it failed and the manifest row is dropped."""

    def fetch(self, video_id: str, directory: str) -> str | None: ...


class LocalFetcher:
    """Accepts only files that are already there."""

    def fetch(self, video_id: str, directory: str) -> str | None:
        path = os.path.join(directory, f"{video_id}.mp4")
        return path if os.path.exists(path) else None


def fixed_random_indices(n_samples: int = 10, max_range: int = 1000, seed: int = 42) -> list[int]:
    """A seeded sorted sample without replacement; more samples than the range is an error."""
    return sorted(random.Random(seed).sample(range(max_range), n_samples))


def hashed_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows by hash order; distributed, and not the same rows as the seeded list."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
