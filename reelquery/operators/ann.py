"""k-NN through the cells of a codebook: nearest cells probed, or as many as an exact answer needs.

``IvfIndex`` keeps its cells for one session; ``store.IndexTable`` stores them as a partition column, so that a search reads the files of
the cells it probes.  Both search by ``probe``: the query side is broadcast while its measured size allows, and rows are scored where they
are read; beyond that, queries and rows meet in blocks of a cell.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.operators import knn
from reelquery.operators.cells import fit_cells, nearest_cell
from reelquery.operators.knn import HIT, _block_hits, _ranked, matrix, together, unit
from reelquery.operators.staging import stage, staged
from reelquery.operators.store import IndexTable

BLOCK = 8192
#: Room for rounding between the stored reach of a cell and a bound derived from it.
SLACK = 1e-6


def near_cells(queries: DataFrame, centers: np.ndarray, probes: int) -> DataFrame:
    """``(query_idx, embedding, cell)`` for the ``probes`` nearest cells of every query; null and zero queries ask nowhere."""
    shared = queries.sparkSession.sparkContext.broadcast(centers)

    @F.pandas_udf("array<int>")
    def near(v: pd.Series) -> pd.Series:
        m, ok = unit(matrix(v))
        order = np.argsort(-(m @ shared.value.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
        return pd.Series([o if k else [] for o, k in zip(order, ok, strict=True)])

    rows = queries.select(F.col("query_idx").cast("long").alias("query_idx"), "embedding").filter(F.col("embedding").isNotNull())
    return rows.withColumn("cell", F.explode(near("embedding")))


def probe(rows: DataFrame, asked: DataFrame, k: int, broadcast_bytes: int | None = None) -> DataFrame:
    """Hits of ``asked`` (query_idx, embedding, cell) among ``rows`` (cell, video_id, center_frame, timestamp_sec, embedding), not yet ranked."""
    size = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    limit = knn.BROADCAST_BYTES if broadcast_bytes is None else broadcast_bytes
    cast = [F.col("video_id").cast("string").alias("video_id"), F.col("center_frame").cast("long").alias("center_frame"), F.col("timestamp_sec").cast("double").alias("timestamp_sec")]
    rows, asked = rows.filter(F.size("embedding") == (size[1] or 0)), asked.filter(F.size("embedding") == (size[1] or 0))
    if size[0] * (size[1] or 0) * 8 <= limit:
        got = asked.toPandas()  # bounded by broadcast_bytes, just measured
        by = {int(c): (g["query_idx"].to_numpy(), unit(matrix(g["embedding"]))[0]) for c, g in got.groupby("cell")}
        shared = asked.sparkSession.sparkContext.broadcast(by)
        names = [f.split()[0] for f in HIT.split(", ")]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for b in batches:
                cells = b.column(4).to_numpy(zero_copy_only=False)
                for c in np.unique(cells).tolist():
                    if c in held:
                        some = b.filter(pa.array(cells == c))
                        m = some.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                        for out in _block_hits(*held[c], some.select([0, 1, 2]).to_pandas(), m, k):
                            yield pa.RecordBatch.from_pandas(out[names], preserve_index=False)

        cells = sorted(by)  # a number a cell: the scan is cut to their partitions
        return rows.filter(F.col("cell").isin(cells) if cells else F.lit(False)).select(*cast, "embedding", "cell").mapInArrow(scan, HIT)

    # a cell's blocks: a row a cell, so this table has as many rows as the codebook
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("long").alias("_n"))
    left = asked.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).drop("_n")
    right = rows.join(F.broadcast(blocks), "cell").select("cell", F.pmod(F.xxhash64("video_id", "center_frame"), F.col("_n")).alias("block"), *cast, "embedding")

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return together(iter(()), HIT)
        return together(_block_hits(left["query_idx"].to_numpy(), unit(matrix(left["embedding"]))[0], right, matrix(right["embedding"]), k), HIT)

    return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInPandas(meet, HIT)


class IvfIndex:
    """An inverted file for one session."""

    def __init__(self, index: DataFrame, cells: int = 16, sample: int = 20_000, rounds: int = 10, seed: int = 7):
        self.centroids = fit_cells(index, cells, sample, rounds, seed)
        self.rows = index.filter(F.col("embedding").isNotNull()).withColumn("cell", nearest_cell(index.sparkSession, self.centroids)("embedding"))

    def search(self, queries: DataFrame, k: int = 50, probes: int = 4) -> DataFrame:
        """Top k of every query among the rows of its ``probes`` nearest cells."""
        return _ranked(probe(self.rows, near_cells(queries, self.centroids, probes), k), k)


def _codebook(table: IndexTable) -> np.ndarray:
    centers = table.centroids()
    if centers is None:
        raise ValueError(f"{table.name} has no cells; call fit first")
    return centers


def search(table: IndexTable, queries: DataFrame, k: int = 50, probes: int = 8, broadcast_bytes: int | None = None) -> DataFrame:
    """Top k of every query among its ``probes`` nearest cells; other cells' files are not read.  Approximate: see ``calibrate``."""
    return _ranked(probe(table.read(), near_cells(queries, _codebook(table), probes), k, broadcast_bytes), k)


def search_exact(table: IndexTable, queries: DataFrame, k: int = 50, probes: int = 8, broadcast_bytes: int | None = None) -> DataFrame:
    """The same hits as ``knn_join``, reading only cells that can hold one.

    The nearest cells give each query its k-th cosine so far.  A row of a cell is within the angle of the cell's reach from its centroid, so
    none can be nearer to the query than the angle to the centroid less the reach; cells that cannot come up to the k-th cosine are left out.
    """
    centers, reach = _codebook(table), table.reach()
    first = stage(probe(table.read(), near_cells(queries, centers, probes), k, broadcast_bytes))
    best = _ranked(first, k).groupBy("query_idx").agg(F.count(F.lit(1)).alias("_n"), F.min("cosine").alias("_least"))
    width = np.array([np.arccos(np.clip(reach.get(c, 1.0), -1, 1)) for c in range(len(centers))])
    shared = queries.sparkSession.sparkContext.broadcast((centers, width, np.array(sorted(reach), np.int64)))

    @F.pandas_udf("array<int>")
    def open_cells(v: pd.Series, least: pd.Series) -> pd.Series:
        """The cells beyond the first ``probes`` that may hold a hit."""
        c, width, used = shared.value
        m, ok = unit(matrix(v))
        cos = m @ c.T
        bound = np.cos(np.minimum(np.maximum(np.arccos(np.clip(cos, -1, 1)) - width, 0), np.pi)) + SLACK
        can = (bound >= least.to_numpy()[:, None]) & ok[:, None]
        np.put_along_axis(can, np.argsort(-cos, axis=1, kind="stable")[:, :probes], False, axis=1)
        return pd.Series([np.intersect1d(np.flatnonzero(r), used).astype(np.int32) for r in can])

    valid = queries.select(F.col("query_idx").cast("long").alias("query_idx"), "embedding").filter(F.col("embedding").isNotNull())
    least = F.when(F.coalesce("_n", F.lit(0)) >= k, F.col("_least")).otherwise(F.lit(-2.0))
    more = valid.join(best, "query_idx", "left").select("query_idx", "embedding", F.explode(open_cells("embedding", least)).alias("cell"))
    return _ranked(first.unionByName(probe(table.read(), more, k, broadcast_bytes)), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_idx, video_id, center_frame) that were found."""
    key = ["query_idx", "video_id", "center_frame"]
    r = exact.select(*key).join(found.select(*key, F.lit(1).alias("_f")), key, "left").agg(F.count(F.lit(1)), F.count("_f")).first()
    return r[1] / r[0] if r[0] else 1.0


def calibrate(table: IndexTable, queries: DataFrame, k: int = 50, target: float = 0.95) -> int:
    """The fewest probes (by doubling) with which the recall of ``queries`` against all rows is ``target``; all cells if need be."""
    n = len(_codebook(table))
    with staged(knn.knn_join(queries, table.read(), k)) as exact:
        probes = 1
        while probes < n and recall(search(table, queries, k, probes), exact) < target:
            probes = min(n, 2 * probes)
    return probes
