"""Exact top-k inner products by sorted lists without random access.

Vectors become integers, floor(256 * x) per component.  Rows lie in blocks; a block keeps, per component, its rows in ascending
order.  A query reads every list from its good end, ``STEP`` entries of each list at first and twice as many each time; a row's
lower bound takes the worst value of each list it has not been met in, its upper bound the list's last value read.
When at most ``RESOLVE`` rows can still reach the k-th lower bound, no outsider qualifies: those rows' scores are resolved
in whole.  The blocks' results, k per query, are merged by rank.

Queries and rows meet on a grid of blocks (``QUERIES`` by ``ROWS``), a stated query set against all rows; a row is copied
once per ``QUERIES`` queries.  Blocks are dealt by a hash of the id, so labels and copies do not matter.

Vectors that are null or hold null or non-finite components take no part.  Every other row does: rows that share a ``vec_id`` are
candidates of each other, and rows without one are candidates (last among ties), not queries.  Vectors of different lengths do not
meet.  Ties go to the smaller vec_id.  Other columns are ignored; an empty table gives no rows.

Where a score could leave 63 bits, which the largest component shows, all integers and scores are Python's, of any size, and are
ranked as such; a ``score`` beyond 63 bits is given as the nearest long.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import saved

SCALE, STEP, RESOLVE, ROWS, QUERIES = 256, 64, 64, 8192, 2048
NO_ID = 2**63 - 1
#: Scores of any size as numbers that sort alike: digits of 62 bits, the first one signed.
DIGITS = 36


def valid(vectors: DataFrame) -> DataFrame:
    """``(row, vec_id, embedding)`` of the rows that take part, as a working table; ``row`` tells rows of one id apart."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(ok)
    return saved(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=np.float64) for x in column])


def integers(m: np.ndarray, wide: bool) -> np.ndarray:
    """floor(256 * x); from 2**52 on, where x is an integer itself, in Python's integers."""
    if not wide:
        return np.floor(SCALE * m).astype(np.int64)
    out = [int(x) * SCALE if abs(x) >= 2**52 else int(np.floor(SCALE * x)) for x in m.ravel().tolist()]
    return np.array([*out, None], dtype=object)[:-1].reshape(m.shape)


def digits(score: int) -> list[int]:
    return [score >> 62 * (DIGITS - 1), *(score >> 62 * i & 2**62 - 1 for i in range(DIGITS - 2, -1, -1))]


class Lists:
    """One block's rows and its sorted lists: per component the rows and values in ascending order, side by side."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, names: np.ndarray | None = None):
        self.ids, self.rows, self.names = ids, rows, ids if names is None else names
        columns = np.ascontiguousarray(rows.T)
        if rows.dtype == object:  # the bounds only need values in proportion
            peak = max((abs(x) for x in rows.ravel()), default=1) or 1
            columns = np.array([x / peak for x in columns.ravel()], dtype=np.float64).reshape(columns.shape)
        self.order = np.argsort(columns, axis=1, kind="stable")
        self.values = np.take_along_axis(columns, self.order, axis=1).astype(np.float64)

    def best(self, q: np.ndarray, k: int, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows but the one whose name is ``own``."""
        able = np.arange(len(self.ids)) if own is None else np.flatnonzero(self.names != own)
        if q.any() and len(able) > max(RESOLVE, k):
            able = self._able(q, k, able)
        score = self.rows[able] @ q
        ids = self.ids[able]
        top = np.lexsort((ids, -score))[:k] if score.dtype != object else np.array(sorted(range(len(able)), key=lambda i: (-score[i], ids[i]))[:k], dtype=np.int64)
        return ids[top], score[top]

    def _able(self, q: np.ndarray, k: int, able: np.ndarray) -> np.ndarray:
        """Reads the lists until few rows can still be among the k best, and returns those."""
        n = len(self.ids)
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)  # lists read from their end, and from their start
        dims = np.concatenate([up, down])
        w = q[dims].astype(np.float64) if q.dtype != object else np.array([x / max(abs(y) for y in q) for x in q[dims]], dtype=np.float64)
        worst = np.concatenate([self.values[up, 0], self.values[down, -1]]) * w
        best = np.concatenate([self.values[up, -1], self.values[down, 0]]) * w
        slack = 1e-5 * np.maximum(np.abs(worst), np.abs(best)).sum()  # the bounds are sums of 32-bit numbers
        known, seen = np.zeros(n), np.zeros((len(w), n), np.float32)
        flat, offset = seen.reshape(-1), (np.arange(len(w)) * n)[:, None]
        at, step = 0, STEP
        while at < n and len(able) > RESOLVE:
            end = min(at + step, n)
            met = np.concatenate([self.order[up, n - end : n - at], self.order[down, at:end]])
            value = np.concatenate([self.values[up, n - end : n - at], self.values[down, at:end]])
            value *= w[:, None]
            known += np.bincount(met.ravel(), value.ravel(), minlength=n)
            met += offset
            flat[met.ravel()] = 1
            at, step = end, min(step * 2, max(STEP, n // 8))
            last = np.concatenate([value[: len(up), 0], value[len(up) :, -1]])
            # no row's upper bound is below last.sum(), and no lower bound above known and what is never negative
            if last.sum() >= np.partition(known[able], len(able) - k)[len(able) - k] + np.maximum(worst, 0).sum():
                continue
            lower = known[able] + worst.sum() - (worst.astype(np.float32) @ seen)[able]
            bar = np.partition(lower, len(able) - k)[len(able) - k] - slack
            able = able[known[able] + last.sum() - (last.astype(np.float32) @ seen)[able] >= bar]
        return able


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for every query row the k best rows but its own.

    Both sides are ``(row, vec_id, embedding)`` as ``valid`` gives them; a query's own row has its number.
    """
    peak = F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x).cast("double"))))
    n, dims, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("embedding")), peak).first()
    wide = bool(n) and dims * (SCALE * int(most) + SCALE) ** 2 >= 2**63
    m = queries.count()
    blocks, groups = max(1, -(-n // ROWS)), max(1, -(-m // QUERIES))
    all_of = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    columns = [F.size("embedding").alias("dims"), "row", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "embedding"]
    left = queries.select(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(groups)).alias("g"), all_of(blocks).alias("b"), *columns)
    right = vectors.select(all_of(groups).alias("g"), F.pmod(F.xxhash64("row", F.lit(2)), F.lit(blocks)).alias("b"), *columns)

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            lists = Lists(right["vec_id"].to_numpy(), integers(matrix(right["embedding"]), wide), right["row"].to_numpy())
            for row, own, q in zip(left["row"].to_numpy(), left["vec_id"].to_numpy(), integers(matrix(left["embedding"]), wide), strict=True):
                ids, score = lists.best(q, k, row)
                given = [min(max(x, -(2**63)), 2**63 - 1) for x in score] if wide else score
                found = pd.DataFrame({"row": row, "query_id": own, "vec_id": ids, "score": given})
                if wide:
                    found["digits"] = [digits(x) for x in score]
                out.append(found)
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("row", "query_id", "vec_id", "score", *["digits"] * wide)}, dtype="int64")

    schema = "row long, query_id long, vec_id long, score long" + ", digits array<long>" * wide
    found = left.groupBy("g", "b", "dims").cogroup(right.groupBy("g", "b", "dims")).applyInPandas(cell, schema)
    w = Window.partitionBy("row").orderBy(F.desc("digits" if wide else "score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
