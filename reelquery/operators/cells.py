"""The codebook of a vector index: fitted on a bounded sample, then one cell for every row."""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.operators.knn import matrix, unit


def fit_cells(rows: DataFrame, cells: int = 256, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Spherical k-means on ``sample`` rows chosen by the hash of their vectors: unit centroids, fewer if there are fewer vectors."""
    got = rows.select("embedding").filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64("embedding", F.lit(seed))).limit(sample).toPandas()
    m, ok = unit(matrix(got["embedding"]))
    m = np.unique(m[ok], axis=0)
    c = m[np.random.default_rng(seed).choice(len(m), min(cells, len(m)), replace=False)] if len(m) else np.zeros((0, 1))
    for _ in range(rounds if len(c) else 0):
        home = np.argmax(m @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, home, m)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 0, total / np.where(norm > 0, norm, 1.0)[:, None], c)
    return c


def nearest_cell(spark: SparkSession, centers: np.ndarray) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(centers)

    @F.pandas_udf("int")
    def cell(v: pd.Series) -> pd.Series:
        return pd.Series(np.argmax(unit(matrix(v))[0] @ shared.value.T, axis=1).astype(np.int32) if len(v) else np.zeros(0, np.int32))

    return cell


def cell_cosine(spark: SparkSession, centers: np.ndarray) -> Callable[[Column, Column], Column]:
    """The cosine between a row and the centroid of its cell."""
    shared = spark.sparkContext.broadcast(centers)

    @F.pandas_udf("double")
    def cosine(v: pd.Series, cell: pd.Series) -> pd.Series:
        return pd.Series(np.einsum("ij,ij->i", unit(matrix(v))[0], shared.value[cell.to_numpy()]) if len(v) else np.zeros(0))

    return cosine
