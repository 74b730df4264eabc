"""Embedding files: one JSON array per video, and Parquet partitioned by video as the native form."""

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.functions.vector import normalize

RECORD = "center_frame int, timestamp_sec double, embedding array<float>"


def read_embeddings_json(spark: SparkSession, path: str) -> DataFrame:
    """``(video_id, center_frame, timestamp_sec, embedding)``; the file name is the video id."""
    rows = spark.read.schema(RECORD).option("multiLine", True).json(path)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return rows.select(name.alias("video_id"), "center_frame", "timestamp_sec", "embedding")


def read_embeddings_unit(spark: SparkSession, path: str) -> DataFrame:
    """The same with unit vectors; zero rows stay zero."""
    return read_embeddings_json(spark, path).withColumn("embedding", normalize(F.col("embedding"), zero="keep"))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.write.partitionBy("video_id").mode("overwrite").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("video_id", F.col("video_id").cast("string"))


def export_embeddings_json(df: DataFrame, video_id: str, path: str) -> int:
    """Writes ONE video's embeddings as a JSON array on the driver; the parent folder is made if the path has one."""
    parent = os.path.dirname(path)
    if parent:
        os.makedirs(parent, exist_ok=True)
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for r in df.filter(F.col("video_id") == video_id).orderBy("center_frame").toLocalIterator():
            out.write(("," if n else "") + json.dumps({"center_frame": r["center_frame"], "timestamp_sec": r["timestamp_sec"], "embedding": [float(x) for x in r["embedding"]]}))
            n += 1
        out.write("]")
    return n
