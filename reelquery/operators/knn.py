"""Exact k-nearest-neighbour search by cosine.

``knn_topk`` is one query: a projection and ``TakeOrderedAndProject``.  ``knn_join`` is a stated query set against the
whole index.  The query side is broadcast only while its measured size stays below ``broadcast_bytes``; beyond that both
sides are cut into blocks that meet on a grid.  Either way a NumPy block product scores a batch at a time, for as many
queries at once as a bounded block of scores has room for, and only each batch's own top k leaves the Python worker, so the shuffle carries k rows per query and batch and no vectors.

The order of hits is total: cosine (rounded to ``DIGITS``) descending, then video_id, then center_frame.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reelquery.functions.vector import dot, l2_norm, score_of

DIGITS = 9
BROADCAST_BYTES = 32 << 20
#: Scores held at once, 8 bytes each; a worker holds a few times that.
CELLS = 2_000_000
HIT = "query_idx long, video_id string, center_frame long, timestamp_sec double, cosine double"


def knn_topk(index: DataFrame, vector: list[float], k: int = 10, video_id: str | None = None) -> DataFrame:
    """Top k of one query as ``(score, video_id, timestamp_sec, center_frame)`` with score = (1 + cos) / 2.

    A zero query is an error.  The term filter lies below the ranking, so k results remain possible.
    """
    norm = float(np.linalg.norm(np.asarray(vector, dtype=np.float64)))
    if norm == 0:
        raise ValueError("the query vector is zero and cannot be normalised")
    query = F.array(*[F.lit(float(x) / norm) for x in vector])
    rows = index if video_id is None else index.filter(F.col("video_id") == video_id)
    cos = F.round(F.try_divide(dot(F.col("embedding"), query), l2_norm(F.col("embedding"))), DIGITS)
    return (
        rows.withColumn("_cos", cos)
        .filter(F.col("_cos").isNotNull())
        .select(score_of(F.col("_cos")).alias("score"), "video_id", "timestamp_sec", "center_frame")
        .orderBy(F.desc("score"), "video_id", "center_frame")
        .limit(k)
    )


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def unit(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with norm 1 (zero rows stay), and which rows are not zero."""
    n = np.linalg.norm(m, axis=1)
    return m / np.where(n == 0, 1.0, n)[:, None], n > 0


def _query_blocks(queries: int, rows: int) -> Iterator[slice]:
    """Cuts the queries so that a block of scores against ``rows`` rows has about ``CELLS`` cells, whatever the two sizes."""
    step = max(1, CELLS // max(1, rows))
    for lo in range(0, queries, step):
        yield slice(lo, lo + step)


def _block_hits(qid: np.ndarray, q: np.ndarray, rows: pd.DataFrame, m: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """The best k of ``rows`` (with vectors ``m``) for every query; ties go to the smaller (video_id, center_frame)."""
    order = np.lexsort((rows["center_frame"].to_numpy(), rows["video_id"].to_numpy().astype(str)))
    rows, (m, ok) = rows.iloc[order], unit(m[order])
    rows, m = rows[ok], m[ok]
    if not len(rows) or not len(qid) or k < 1:
        return
    k = min(k, len(rows))
    columns = {c: rows[c].to_numpy() for c in ("video_id", "center_frame", "timestamp_sec")}
    for some in _query_blocks(len(qid), len(rows)):
        s = q[some] @ m.T
        np.negative(np.round(s, DIGITS, out=s), out=s)
        last = np.partition(s, k - 1, axis=1)[:, k - 1 : k]
        # every tie with the k-th is looked at; not a number is neither larger nor smaller, and sorts last
        x, y = np.nonzero(~(s > last))
        by = np.lexsort((s[x, y], x))  # stable: of equal cosines the first in order stays first
        x, y = x[by], y[by]
        best = np.arange(len(x)) - np.searchsorted(x, x) < k
        x, y = x[best], y[best]
        yield pd.DataFrame({"query_idx": qid[some][x], **{c: v[y] for c, v in columns.items()}, "cosine": -s[x, y]})


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_idx").orderBy(F.desc("cosine"), "video_id", "center_frame")
    return hits.withColumn("hit_rank", F.row_number().over(w)).filter(F.col("hit_rank") <= k)


def _parse(schema: str) -> StructType:
    return StructType.fromDDL(schema)


def together(tables: Iterator[pd.DataFrame], schema: str) -> pd.DataFrame:
    found = list(tables)
    return pd.concat(found) if found else pd.DataFrame({c: [] for c in _parse(schema).names})


def meet(queries: DataFrame, index: DataFrame, kernel, schema: str, broadcast_bytes: int = BROADCAST_BYTES, block: int = 4096) -> DataFrame:
    """Runs ``kernel(query_idx, query vectors, index rows, index vectors)``, which yields tables, so that every query meets every row once.

    The queries are broadcast while their measured size is within ``broadcast_bytes``; beyond that, both sides are cut into
    blocks of about ``block`` rows that meet on a grid.  Rows without a vector, or with one of another
    length than the longest query, are left out.
    """
    index = index.select(F.col("video_id").cast("string").alias("video_id"), F.col("center_frame").cast("long").alias("center_frame"), F.col("timestamp_sec").cast("double").alias("timestamp_sec"), "embedding").filter(F.col("embedding").isNotNull())
    queries = queries.select(F.col("query_idx").cast("long").alias("query_idx"), "embedding").filter(F.col("embedding").isNotNull())
    size = queries.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    n, dims = size[0], size[1] or 0
    queries, index = queries.filter(F.size("embedding") == dims), index.filter(F.size("embedding") == dims)
    if n * dims * 8 <= broadcast_bytes:
        got = queries.toPandas().sort_values("query_idx")  # bounded by broadcast_bytes, just measured
        shared = queries.sparkSession.sparkContext.broadcast((got["query_idx"].to_numpy(), matrix(got["embedding"])))

        names = [f.name for f in _parse(schema)]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            for b in batches:
                if len(qid) and b.num_rows:
                    # vectors come as one flat buffer: no object per row
                    m = b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    for out in kernel(qid, q, b.select([0, 1, 2]).to_pandas(), m):
                        yield pa.RecordBatch.from_pandas(out[names], preserve_index=False)

        return index.mapInArrow(scan, schema)

    gq, gi = max(1, -(-n // block)), max(1, -(-index.count() // block))
    each = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    left = queries.select(F.pmod(F.xxhash64("query_idx"), F.lit(gq)).alias("_q"), each(gi).alias("_i"), "query_idx", "embedding")
    right = index.select(each(gq).alias("_q"), F.pmod(F.xxhash64("video_id", "center_frame"), F.lit(gi)).alias("_i"), "video_id", "center_frame", "timestamp_sec", "embedding")

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return together(kernel(left["query_idx"].to_numpy(), matrix(left["embedding"]), right, matrix(right["embedding"])), schema)

    return left.groupBy("_q", "_i").cogroup(right.groupBy("_q", "_i")).applyInPandas(cell, schema)


def knn_join(queries: DataFrame, index: DataFrame, k: int = 50, broadcast_bytes: int = BROADCAST_BYTES, block: int = 4096) -> DataFrame:
    """Top k index rows of every query ``(query_idx, embedding)``, ranked; zero queries and zero rows give nothing."""

    def kernel(qid: np.ndarray, q: np.ndarray, rows: pd.DataFrame, m: np.ndarray) -> Iterator[pd.DataFrame]:
        u, ok = unit(q)
        return _block_hits(qid[ok], u[ok], rows, m, k)

    return _ranked(meet(queries, index, kernel, HIT, broadcast_bytes, block), k)


BEST = "video_id string, query_idx long, cosine double"


def best_per_video(queries: DataFrame, index: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, block: int = 4096) -> DataFrame:
    """``(video_id, query_idx, cosine)``: each query's best cosine in each video; zero vectors have cosine 0.

    A block sends one row per query and video, so the shuffle does not grow with the frames of a video.
    """

    def kernel(qid: np.ndarray, q: np.ndarray, rows: pd.DataFrame, m: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(rows) or not len(qid):
            return
        order = np.argsort(rows["video_id"].to_numpy().astype(str), kind="stable")
        video, q, m = rows["video_id"].to_numpy()[order], unit(q)[0], unit(m[order])[0]
        start = np.flatnonzero(np.concatenate([[True], video[1:] != video[:-1]]))
        for some in _query_blocks(len(qid), len(m)):
            best = np.maximum.reduceat(q[some] @ m.T, start, axis=1)
            yield pd.DataFrame({"video_id": np.tile(video[start], len(best)), "query_idx": np.repeat(qid[some], len(start)), "cosine": best.ravel()})

    return meet(queries, index, kernel, BEST, broadcast_bytes, block).groupBy("video_id", "query_idx").agg(F.max("cosine").alias("cosine"))


def cosine_pairs(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Cosine of the two vectors that share a key."""
    x = a.select(on, F.col("embedding").alias("_a"))
    y = b.select(on, F.col("embedding").alias("_b"))
    return x.join(y, on).select(on, F.try_divide(dot(F.col("_a"), F.col("_b")), l2_norm(F.col("_a")) * l2_norm(F.col("_b"))).alias("cosine"))
