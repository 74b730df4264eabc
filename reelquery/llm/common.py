"""Shared working tables and graph components."""

import atexit
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark then deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_TABLES: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.  In local mode, where all is one machine, a temporary one is set if need be."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("working tables need a folder that all executors share: set spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone already
        pass


@contextmanager
def clean_shuffles(spark: SparkSession):
    """Queries that run inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(df: DataFrame, *instead_of: DataFrame) -> DataFrame:
    """Writes a working table to the shared folder and reads it back: cuts lineage, survives lost executors.

    Shuffle files are gone when it is written, and so are the working tables ``instead_of``.  The rest goes when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
    with clean_shuffles(spark):
        df.write.parquet(path)
    discard(*instead_of)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _TABLES[id(out)] = (out, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes working tables that ``saved`` has returned; nothing may be read from them any more."""
    for t in tables:
        held = _TABLES.pop(id(t), None)
        if held is not None:
            _remove(t.sparkSession, held[1])


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``(a long, b long)``: ``(id, component)`` with the smallest id reachable.

    Random-order contraction: each round every vertex hooks to the neighbour with the smallest hash below its own, and the
    edges shrink to those between hooked vertices; the expected number of rounds is logarithmic.  Hot vertices are
    aggregated before the shuffle and the joins can be split.  Only ids that occur in an edge are returned.
    """
    e = saved(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    names, k = None, 0
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, k=k: F.xxhash64(F.col(c), F.lit(k))
        best = both.groupBy("a").agg(F.min(F.struct(order("b").alias("h"), F.col("b").alias("b"))).alias("n"))
        hook = F.when((F.col("n.h") < order("a")) | ((F.col("n.h") == order("a")) & (F.col("n.b") < F.col("a"))), F.col("n.b")).otherwise(F.col("a"))
        hooks = saved(best.select(F.col("a").alias("id"), hook.alias("to")))
        left = e.join(hooks.select(F.col("id").alias("a"), F.col("to").alias("_a")), "a").select("_a", "b")
        e = saved(left.join(hooks.select(F.col("id").alias("b"), F.col("to").alias("_b")), "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), e)
        if names is None:
            names = hooks
        else:
            names = saved(names.join(hooks.select(F.col("id").alias("to"), F.col("to").alias("_t")), "to", "left").select("id", F.coalesce("_t", "to").alias("to")), names, hooks)
        k += 1
    discard(e)
    if names is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).filter("false")
    smallest = names.groupBy("to").agg(F.min("id").alias("_m")).select("to", F.least("to", "_m").alias("component"))
    return saved(names.join(smallest, "to").select("id", "component"), names)


def roots(ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For every position the smallest id it is joined to by the pairs of positions (x, y)."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    x, y, name = place[x], place[y], np.arange(len(ids))
    while True:
        low = np.minimum(name[x], name[y])
        new = name.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, name[x], low)  # roots follow, so that long chains take few rounds
        np.minimum.at(new, name[y], low)
        new = new[new]
        if (new == name).all():
            return ids[order][name][place]
        name = new
