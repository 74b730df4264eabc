"""Staging folders: a table that several steps read is evaluated once."""

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def staging_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which all executors share.  Unset, it is an error; in local mode a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("staging needs a folder that all executors share: set spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="staging-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame) -> DataFrame:
    """Writes ``df`` and gives the written rows; the folder goes when the process ends."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove_last, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove_last(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session has ended before
        pass


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """Writes ``df`` and gives the written rows; the folder goes at the end of the block."""
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        remove(spark, path)
