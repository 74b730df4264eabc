"""The index store: key, upsert, quarantine, incremental planning, and table life cycle over Parquet tables."""

import base64
import json

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from reelquery.functions.vector import l2_norm
from reelquery.operators.cells import cell_cosine, fit_cells, nearest_cell
from reelquery.operators.staging import staged

#: Why rows are set aside, in the order in which they are looked at.
REASONS = ("missing", "dims", "value", "zero")
INDEX_DDL = "doc_id string, video_id string, timestamp_sec double, center_frame int, embedding array<float>, norm double"


def doc_id(video_id: Column, center_frame: Column) -> Column:
    return F.concat_ws("_", video_id.cast("string"), center_frame.cast("string"))


def last_write(batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row per key; of rows with equal keys and order the one that sorts last by all other columns, so that any plan agrees."""
    rest = [c for c in batch.columns if c not in keys and c != order]
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc(c) for c in rest])
    return batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``existing`` whose key is not in ``batch``, and the last row per key of ``batch``."""
    fresh = last_write(batch, keys, order).drop(order)
    return existing.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def with_reason(batch: DataFrame, dims: int) -> DataFrame:
    """Adds ``reason``: why a row cannot be indexed, or null."""
    reason = (
        F.when(F.col("embedding").isNull(), "missing")
        .when(F.size("embedding") != dims, "dims")
        .when(F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "value")
        .when(l2_norm(F.col("embedding")) == 0, "zero")
    )
    return batch.withColumn("reason", reason)


def split_valid(batch: DataFrame, dims: int) -> tuple[DataFrame, DataFrame]:
    """Rows that can be indexed, and the quarantined rows with their reason."""
    judged = with_reason(batch, dims)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def pending(manifest: DataFrame, index: DataFrame, key: str = "video_id") -> DataFrame:
    """Manifest rows with no row in the index; one anti join instead of a look-up per video."""
    return manifest.join(index.select(key).distinct(), key, "left_anti")


class IndexTable:
    """An index in the session catalog: a view over a Parquet table of versioned buckets, cut into the cells of a codebook.

    Rows lie in ``buckets`` buckets by a hash of their video, and inside a bucket by cell: the nearest centroid (0 before ``fit``).  A write
    evaluates its batch once, into a staging folder; it reads and rewrites the buckets it touches, as new versions beside the old ones; then one
    statement replaces the view, which lists the versions that count and names the codebook.  A crash before it leaves the
    old table, one after it the new.  A version that a write replaces goes with the write after it, so readers that began before have time to
    end.  One writer at a time.

    Bucket, cell and version are partition columns: a search that names cells (``ann.search``), and one that names a video, reads their files only.
    ``<name>_cells`` holds the codebooks, ``<name>_reach`` for every (bucket, version, cell) the number of rows and the smallest cosine to the centroid.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, name: str = "video_index", dims: int = 512, buckets: int = BUCKETS):
        self.spark, self.name, self.dims, self.data, self.buckets = spark, name, dims, f"{name}_data", buckets
        self.counts: dict[str, int] = {}

    def create(self) -> bool:
        """Creates the table unless it is there (whatever its dims); True if it was created."""
        if self.spark.catalog.tableExists(self.name):
            return False
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.data} ({INDEX_DDL}, bucket int, cell int, version bigint) USING parquet PARTITIONED BY (bucket, cell, version)")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_cells (codebook bigint, cell int, center array<double>) USING parquet")
        self.spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name}_reach (bucket int, version bigint, cell int, n bigint, reach double) USING parquet")
        self._show({}, 0, {})
        return True

    def delete(self) -> bool:
        there = self.spark.catalog.tableExists(self.name)
        self.spark.sql(f"DROP VIEW IF EXISTS {self.name}")
        for name in (self.data, f"{self.name}_quarantine", f"{self.name}_cells", f"{self.name}_reach"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return there

    def read(self, video_id: str | None = None) -> DataFrame:
        """The index, with the column ``cell``; of one video only its bucket is read."""
        rows = self.spark.table(self.name)
        if video_id is None:
            return rows
        bucket = self.spark.range(1).select(self._bucket(F.lit(video_id))).first()[0]
        return rows.filter((F.col("bucket") == bucket) & (F.col("video_id") == video_id)).drop("bucket")

    def indexed(self, video_id: str) -> bool:
        return self.read(video_id).limit(1).count() > 0

    def _bucket(self, video: Column) -> Column:
        return F.pmod(F.xxhash64(video), F.lit(self.buckets)).cast("int")

    def _property(self, key: str) -> str:
        return self.spark.sql(f"SHOW TBLPROPERTIES {self.name} ('{key}')").first()["value"]

    def versions(self) -> dict[int, int]:
        """The version of each bucket that counts; buckets without rows have none."""
        return {int(b): int(v) for b, v in (x.split(":") for x in self._property("versions").split(",") if x)}

    def centroids(self) -> np.ndarray | None:
        """The codebook in use, a row a cell; None before ``fit``."""
        book = int(self._property("codebook"))
        got = self.spark.table(f"{self.name}_cells").filter(F.col("codebook") == book).orderBy("cell").collect() if book else []  # a row a cell
        return np.array([r["center"] for r in got]) if got else None

    def reach(self) -> dict[int, float]:
        """For every cell with rows the smallest cosine between one of them and the centroid."""
        now = self.spark.createDataFrame(list(self.versions().items()), "bucket int, version bigint")
        got = self.spark.table(f"{self.name}_reach").join(F.broadcast(now), ["bucket", "version"]).groupBy("cell").agg(F.min("reach").alias("reach"))  # a row a bucket
        return {r["cell"]: r["reach"] for r in got.collect()}  # a row a cell

    def ledger(self) -> dict[str, int]:
        """For each stream that writes here the last micro-batch that took effect."""
        return json.loads(base64.b64decode(self._property("ledger")))

    def _show(self, versions: dict[int, int], codebook: int, ledger: dict[str, int]) -> None:
        """Replaces the view: the one step by which a write takes effect."""
        streams = base64.b64encode(json.dumps(ledger).encode()).decode()
        now = " OR ".join(f"(bucket = {b} AND version = {v})" for b, v in sorted(versions.items())) or "false"
        columns = ", ".join([*(c.split()[0] for c in INDEX_DDL.split(", ")), "bucket", "cell"])
        text = ",".join(f"{b}:{v}" for b, v in sorted(versions.items()))
        self.spark.sql(f"CREATE OR REPLACE VIEW {self.name} TBLPROPERTIES ('dims' = '{self.dims}', 'versions' = '{text}', 'codebook' = '{codebook}', 'ledger' = '{streams}') AS SELECT {columns} FROM {self.data} WHERE {now}")

    def write(self, batch: DataFrame, stream: tuple[str, int] | None = None) -> DataFrame:
        """Upserts ``(video_id, center_frame, timestamp_sec, embedding[, ord])``; returns the quarantined rows.

        Without ``ord``, of rows with one key the one that sorts last counts.  The quarantined rows of the last batch stay in
        ``<name>_quarantine``; ``counts`` has the rows of the batch and how many were set aside for each reason, counted while it was evaluated.
        ``stream``: a stream's name and the number of its micro-batch, noted by the same step that shows the rows; a
        number that is noted already, or an earlier one, changes nothing.
        """
        ledger = self.ledger()
        if stream is not None:
            if stream[1] <= ledger.get(stream[0], -1):
                return self.spark.table(f"{self.name}_quarantine")
            ledger[stream[0]] = stream[1]
        if "ord" not in batch.columns:
            batch = batch.withColumn("ord", F.lit(0).cast("long"))
        seen = Observation()
        counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS]]
        with staged(with_reason(batch, self.dims).observe(seen, *counts)) as judged:
            self.counts = seen.get
            bad = judged.filter(F.col("reason").isNotNull())
            bad.write.format("parquet").mode("overwrite").saveAsTable(f"{self.name}_quarantine")
            video = F.col("video_id").cast("string")
            good = judged.filter(F.col("reason").isNull()).select(
                doc_id(F.col("video_id"), F.col("center_frame")).alias("doc_id"), video.alias("video_id"), F.col("timestamp_sec").cast("double").alias("timestamp_sec"),
                F.col("center_frame").cast("int").alias("center_frame"), F.col("embedding").cast("array<float>").alias("embedding"), l2_norm(F.col("embedding")).alias("norm"), "ord",
                self._bucket(video).alias("bucket"),
            )
            touched = sorted(r["bucket"] for r in good.select("bucket").distinct().collect())  # a row a bucket
            versions, codebook = self.versions(), int(self._property("codebook"))
            if touched:
                there = self._buckets({b: versions[b] for b in touched if b in versions}).drop("cell")
                self._rewrite(upsert(there, good, ["video_id", "center_frame"], "ord"), touched, versions, codebook, ledger, self.centroids())
            elif stream is not None:
                self._show(versions, codebook, ledger)
        return self.spark.table(f"{self.name}_quarantine")

    def fit(self, cells: int = 256, sample: int = 20_000, rounds: int = 10, seed: int = 7) -> np.ndarray:
        """Fits a codebook on ``sample`` rows by hash, or on all if they are fewer, and puts every row into its cell; returns the centroids."""
        centers = fit_cells(self.read(), cells, sample, rounds, seed)
        codebook = 1 + max([int(self._property("codebook")), *[r[0] or 0 for r in self.spark.table(f"{self.name}_cells").agg(F.max("codebook")).collect()]])
        rows = self.spark.createDataFrame([(codebook, i, [float(x) for x in c]) for i, c in enumerate(centers)], "codebook bigint, cell int, center array<double>")
        rows.write.insertInto(f"{self.name}_cells")
        versions = self.versions()
        if versions:
            self._rewrite(self._buckets(versions).drop("cell"), sorted(versions), versions, codebook, self.ledger(), centers)
        else:
            self._show(versions, codebook, self.ledger())
        return centers

    def _rewrite(self, rows: DataFrame, touched: list[int], versions: dict[int, int], codebook: int, ledger: dict[str, int], centers: np.ndarray | None) -> None:
        """Writes ``rows`` as the new version of the buckets ``touched``, then shows them."""
        new = 1 + max((int(x.split("=")[1]) for r in self.spark.sql(f"SHOW PARTITIONS {self.data}").collect() for x in r[0].split("/") if x.startswith("version=")), default=0)
        out = rows.withColumn("cell", nearest_cell(self.spark, centers)(F.col("embedding")) if centers is not None else F.lit(0)).withColumn("version", F.lit(new).cast("long"))
        # a cell of a bucket is written by one task, unless it is long: then AQE cuts it
        out.select(self.spark.table(self.data).columns).hint("rebalance", "bucket", "cell").write.insertInto(self.data)
        if centers is not None:
            written = self.spark.table(self.data).filter(F.col("version") == new)
            cosine = cell_cosine(self.spark, centers)(F.col("embedding"), F.col("cell"))
            written.groupBy("bucket", "version", "cell").agg(F.count(F.lit(1)).alias("n"), F.min(cosine).alias("reach")).select("bucket", "version", "cell", "n", "reach").write.insertInto(f"{self.name}_reach")
        before = dict(versions)
        versions |= dict.fromkeys(touched, new)
        self._show(versions, codebook, ledger)
        self._drop_old(versions, before)

    def _buckets(self, versions: dict[int, int]) -> DataFrame:
        """The rows of some buckets; others are not read, as bucket and version are partition columns."""
        now = F.lit(False)
        for b, v in versions.items():
            now = now | ((F.col("bucket") == b) & (F.col("version") == v))
        return self.spark.table(self.data).filter(now).drop("version")

    def _drop_old(self, versions: dict[int, int], before: dict[int, int]) -> None:
        """Drops versions that neither the view nor the view before it lists."""
        old = []
        for r in self.spark.sql(f"SHOW PARTITIONS {self.data}").collect():
            at = {k: int(v) for k, v in (x.split("=") for x in r[0].split("/"))}
            if at["version"] not in (versions.get(at["bucket"]), before.get(at["bucket"])):
                old.append(f"PARTITION ({', '.join(f'{k} = {v}' for k, v in at.items())})")
        for i in range(0, len(old), 500):
            self.spark.sql(f"ALTER TABLE {self.data} DROP IF EXISTS {', '.join(old[i : i + 500])}")
        self.spark.catalog.refreshTable(self.name)
