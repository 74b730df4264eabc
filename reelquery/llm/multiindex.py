"""Embedding near-duplicates by an inverted multi-index.

Each half of the unit vectors has its own codebook; the pairs of codes are a grid of cells.  A vector lives in the cell of its
nearest codes and visits the ``probes`` cells whose codes are nearest in sum, in the order of the multi-sequence
algorithm.  A pair is compared, by cosine in double precision, in the home cell of one that the other visits.

The codebooks are fitted on a bounded sample (``SAMPLE`` rows by hash); every row is indexed.  ``probes`` is calibrated:
``ASKED`` sampled vectors, or as many more as it takes for ``ENOUGH`` of them to have a link, are compared with all rows by brute
force, and the traversal goes as far as ``TARGET`` of their links (at 0.9 or above) would need, and half as far again.  If
the sample has too few, it goes as far as pairs planted at a cosine of 0.9 need as well: those are the hardest links.  The result's
recall is then counted on the same sampled vectors, and below ``LEAST_RECALL`` the search is done again with twice the probes.

Equal vectors are one class with a count.  A linked pair that two cells could see is counted in the smaller one, so counts add up;
cells give counts and one edge per vector, never pairs.  Cells with many rows are cut into blocks, and the blocks of those that
live there meet all others.

Vectors that are null, zero, or hold null or non-finite components link with nothing.  Every length has an index of its own;
lengths of up to ``FEW`` different vectors are compared whole.  Rows that share a ``vec_id``, or have none, are compared like any
others; components are named by the smallest id (null if there is none).  Other columns are ignored; an empty table gives no rows.
"""

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import components, discard, roots, saved
from reelquery.llm.ngrams import grouped

THRESHOLD, TARGET, SAMPLE, ASKED, CELL_ROWS, BLOCK, SEED = 0.9, 0.995, 20_000, 1024, 16, 1024, 11
LEAST_PROBES, MANY_PROBES, LEAST_RECALL, FEW = 4, 256, 0.97, 512
#: Linked vectors for a calibration: with 600, the furthest seen is beyond the 0.995 quantile in 95 % of the draws.
ENOUGH = 600
#: Codes a half that the sample can train, some 40 vectors each; beyond 4 million vectors cells grow instead, and are cut into blocks.
MOST_CODES = 512


def matrix(column) -> np.ndarray:
    """Unit vectors in double precision from an Arrow list column."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def k_means(m: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = m[rng.choice(len(m), min(k, len(m)), replace=False)].copy()
    for _ in range(rounds):
        home = np.argmin((c * c).sum(1)[None, :] - 2 * m @ c.T, axis=1)
        for j in range(len(c)):
            own = home == j
            if own.any():
                c[j] = m[own].mean(axis=0)
    return c


class Grid:
    def __init__(self, sample: np.ndarray, codes: int):
        self.half = sample.shape[1] // 2
        self.a, self.b = k_means(sample[:, : self.half], codes), k_means(sample[:, self.half :], codes)

    def distances(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x, y = m[:, : self.half], m[:, self.half :]
        d1 = (x * x).sum(1)[:, None] + (self.a * self.a).sum(1)[None, :] - 2 * x @ self.a.T
        d2 = (y * y).sum(1)[:, None] + (self.b * self.b).sum(1)[None, :] - 2 * y @ self.b.T
        return d1, d2

    def visits(self, m: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells of each row, nearest first, by the multi-sequence algorithm, for all rows step by step.

        Both halves' codes are sorted by distance.  ``done[i]`` cells have been taken along the i-th nearest first code; its next
        one is open once the code before is further on.  Each step takes the nearest open cell.
        """
        d1, d2 = self.distances(m)
        o1, o2 = np.argsort(d1, axis=1, kind="stable")[:, :probes], np.argsort(d2, axis=1, kind="stable")[:, :probes]
        s1, s2 = np.take_along_axis(d1, o1, 1), np.take_along_axis(d2, o2, 1)
        n, k1, k2 = len(m), o1.shape[1], o2.shape[1]
        probes = min(probes, len(self.a) * len(self.b))
        row, out = np.arange(n), np.empty((n, probes), np.int64)
        done = np.zeros((n, k1 + 1), np.int64)
        open_ = np.full((n, k1 + 1), np.inf)
        s1, s2 = np.hstack([s1, np.full((n, 1), np.inf)]), np.hstack([s2, np.full((n, 1), np.inf)])
        open_[:, 0] = s1[:, 0] + s2[:, 0]
        for t in range(probes):
            i = np.argmin(open_[:, : min(t + 1, k1)], axis=1)
            j = done[row, i]
            out[:, t] = o1[row, i] * len(self.b) + o2[row, np.minimum(j, k2 - 1)]
            done[row, i] = j + 1
            before = np.where(i == 0, k2 + 1, done[row, i - 1])
            open_[row, i] = np.where(before > j + 1, s1[row, i] + s2[row, j + 1], np.inf)
            after = done[row, i + 1]
            ready = after == j  # the code behind waited for this cell
            open_[row[ready], i[ready] + 1] = s1[row[ready], i[ready] + 1] + s2[row[ready], j[ready]]
        return out

    def rank(self, m: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """How many cells a row would visit before ``cell``."""
        d1, d2 = self.distances(m)
        row = np.arange(len(m))
        d = d1[row, cell // len(self.b)] + d2[row, cell % len(self.b)]
        return np.array([(x[:, None] + y[None, :] < z - 1e-12).sum() for x, y, z in zip(d1, d2, d, strict=True)], dtype=np.int64)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(vec_id, embedding, ok)`` of all rows, and classes ``(class_id, low, copies, embedding)`` of equal valid vectors."""
    ok = F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(ok, F.lit(False)).alias("ok"))
    same = rows.filter("ok").groupBy("embedding").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"))
    return rows, saved(same.select(F.monotonically_increasing_id().alias("class_id"), "low", "copies", "embedding"))


def planted(grid: Grid, asked: np.ndarray) -> np.ndarray:
    """The ranks at which ``asked`` and vectors planted at a cosine of THRESHOLD to them are found, from either side."""
    u = np.random.default_rng(SEED).normal(size=asked.shape)
    u -= (u * asked).sum(1, keepdims=True) * asked
    near = THRESHOLD * asked + (1 - THRESHOLD**2) ** 0.5 * u / np.linalg.norm(u, axis=1, keepdims=True)
    return np.minimum(grid.rank(asked, grid.visits(near, 1)[:, 0]), grid.rank(near, grid.visits(asked, 1)[:, 0]))


def calibrate(classes: DataFrame, grid: Grid, sample: np.ndarray, ids: np.ndarray) -> tuple[int, dict[int, int]]:
    """The probes that would find TARGET of the sampled vectors' links, or of planted ones if those are too few, and those links."""
    asked = min(ASKED, len(sample))
    need, there = seen_links(classes, grid, sample[:asked], ids[:asked])
    more = -(-asked * ENOUGH * 5 // (len(there) * 4)) if there else len(sample) + 1
    if len(there) < ENOUGH and asked < more <= len(sample):
        asked = more
        need, there = seen_links(classes, grid, sample[:asked], ids[:asked])
    if len(there) < ENOUGH and not asked == len(sample) < SAMPLE:  # unless every class was asked
        rank = np.sort(planted(grid, sample[: 2 * ASKED]))
        need = max(need, int(rank[min(len(rank) - 1, int(np.ceil(TARGET * len(rank))))]) + 1)
    probes = max(LEAST_PROBES, need + (need + 1) // 2)
    if probes > MANY_PROBES:
        logging.getLogger(__name__).warning("%d probes a vector for a recall of %s: more than %d, expect large working tables", probes, TARGET, MANY_PROBES)
    return probes, there


def seen_links(classes: DataFrame, grid: Grid, asked: np.ndarray, ids: np.ndarray) -> tuple[int, dict[int, int]]:
    """The probes that TARGET of the links of ``asked`` need, and the number of linked rows of those of ``asked`` that have any."""
    shared = classes.sparkSession.sparkContext.broadcast((grid, asked, ids))  # SAMPLE vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, asked, ids = shared.value
        hist: dict[tuple[int, int], int] = {}
        step = max(64, 2048 * ASKED // len(asked))
        for b in batches:
            if not b.num_rows:
                continue
            m, copies = matrix(b.column(1)), b.column(2).to_numpy()
            for lo in range(0, len(m), step):
                part = m[lo : lo + step]
                x, y = np.nonzero(asked @ part.T >= THRESHOLD)
                other = ids[x] != b.column(0).to_numpy()[lo + y]
                x, y = x[other], y[other]
                if len(x):
                    there, at = np.unique(y, return_inverse=True)
                    cell = grid.visits(part[there], 1)[:, 0][at]
                    pair, of = np.unique(np.stack([x, cell]), axis=1, return_inverse=True)
                    weight = np.bincount(of.ravel(), copies[lo + y]).astype(np.int64)
                    for *key, n in zip(pair[0].tolist(), grid.rank(asked[pair[0]], pair[1]).tolist(), weight.tolist(), strict=True):
                        hist[tuple(key)] = hist.get(tuple(key), 0) + n
        keys = np.array(list(hist), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(list(hist.values()), pa.int64())], names=["asked", "rank", "n"])

    seen = saved(classes.select("class_id", "embedding", "copies").mapInArrow(run, "asked long, rank long, n long"))
    there = {int(ids[r["asked"]]): r["n"] for r in seen.groupBy("asked").agg(F.sum("n").alias("n")).collect()}  # at most SAMPLE rows
    got = seen.groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").toPandas()  # at most one row a cell
    discard(seen)
    if not there:
        return 0, {}
    share = got["n"].cumsum() / got["n"].sum()
    return int(got["rank"][int(np.searchsorted(share.to_numpy(), TARGET))]) + 1, there


VISIT = "cell long, class_id long, copies long, home long, probes binary, vector binary"


def visits(classes: DataFrame, grid: Grid, probes: int) -> DataFrame:
    """A row for every cell that a class visits; the first is its home, and only its row lists the cells."""
    shared = classes.sparkSession.sparkContext.broadcast(grid)
    step = min(1024, max(16, 32_768 // probes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, step):
                b = whole.slice(lo, step)
                m = b.column(2)
                cells = grid.visits(matrix(m), probes).astype(np.int64)
                n, t = cells.shape
                raw = m.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                rep = lambda x, t=t: np.repeat(x, t)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(cells.ravel()), pa.array(rep(b.column(0).to_numpy())), pa.array(rep(b.column(1).to_numpy())), pa.array(rep(cells[:, 0])),
                        pa.array([x for row in cells.astype(np.int32) for x in [row.tobytes(), *[b""] * (t - 1)]], pa.binary()), pa.array([x for row in raw for x in [row.tobytes()] * t], pa.binary()),
                    ],
                    names=["cell", "class_id", "copies", "home", "probes", "vector"],
                )

    return classes.select("class_id", "copies", "embedding").mapInArrow(run, VISIT)


def dealt(seen: DataFrame) -> DataFrame:
    """Adds ``key`` and ``side``.  A cell of up to BLOCK rows is one key (side 2).  Of a larger one, blocks of those that live there (0) meet
    blocks of all its rows (1)."""
    home = F.col("home") == F.col("cell")
    sizes = seen.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(home, 1)).alias("h")).filter("n > 1 and h > 0")
    parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("long")
    sized = seen.join(sizes, "cell").withColumn("_h", parts("h")).withColumn("_n", parts("n"))
    own = lambda c, seed: F.pmod(F.xxhash64("class_id", F.lit(seed)), F.col(c))
    every = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    at = lambda side, i, j: F.struct(F.lit(side).alias("side"), i.alias("i"), j.alias("j"))
    zero = F.lit(0).cast("long")
    right = F.transform(every("_h"), lambda i: at(1, i, own("_n", 4)))
    both = F.when(home, F.concat(F.transform(every("_n"), lambda j: at(0, own("_h", 3), j)), right)).otherwise(right)
    one = F.array(at(2, zero, zero))
    rows = sized.withColumn("_at", F.explode(F.when(F.col("n") <= BLOCK, one).otherwise(both)))
    return rows.select(F.xxhash64("cell", "_at.i", "_at.j").alias("key"), "cell", "class_id", "copies", "home", "_at.side", "probes", "vector")


def compare(cells: DataFrame) -> DataFrame:
    """``(class_id, links, root)``: documents linked in a cell, and the smallest class joined to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches):
            cell, ids, copies, home, side = (g.column(i).to_numpy() for i in (1, 2, 3, 4, 5))
            at_home = home == cell
            h, r = np.flatnonzero(at_home & (side != 1)), np.flatnonzero(side != 0)
            if not len(h) or not len(r):
                continue
            unit = lambda at: (v := np.frombuffer(b"".join(g.column(7).take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1)) / np.linalg.norm(v, axis=1, keepdims=True)
            x, y = np.nonzero(unit(h) @ unit(r).T >= THRESHOLD)
            x, y = h[x], r[y]
            # between two at home in this cell only, for each where it is on the left; between one at home and a visitor always here,
            # unless the other's cell counts it
            keep = ids[x] != ids[y]
            x, y = x[keep], y[keep]
            probes = np.frombuffer(b"".join(g.column(6).take(pa.array(h)).to_pylist()), np.int32).reshape(len(h), -1)
            at = np.zeros(len(ids), np.int64)
            at[h] = np.arange(len(h))
            mine = np.ones(len(x), bool)
            for lo in range(0, len(x), 50_000):
                i, j = x[lo : lo + 50_000], y[lo : lo + 50_000]
                mine[lo : lo + 50_000] = ~((home[j] < home[i]) & (probes[at[i]] == home[j][:, None]).any(axis=1))
            x, y = x[mine], y[mine]
            if not len(x):
                continue
            back = ~at_home[y]
            links = np.bincount(x, copies[y], minlength=len(ids)) + np.bincount(y[back], copies[x[back]], minlength=len(ids))
            _, first, one = np.unique(ids, return_index=True, return_inverse=True)
            root = roots(ids[first], one[x], one[y])[one]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["class_id", "links", "root"])

    return cells.repartition("key").sortWithinPartitions("key").mapInArrow(run, LINKED)


LINKED = "class_id long, links long, root long"


def compared_whole(classes: DataFrame) -> DataFrame:
    """The same for lengths of few vectors: each with all others of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches):
            ids, copies = g.column(1).to_numpy(), g.column(2).to_numpy()
            m = matrix(g.column(3).combine_chunks())
            x, y = np.nonzero(np.triu(m @ m.T >= THRESHOLD, 1))
            links = np.bincount(x, copies[y], minlength=len(ids)) + np.bincount(y, copies[x], minlength=len(ids))
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(roots(ids, x, y)[some])], names=["class_id", "links", "root"])

    rows = classes.select(F.size("embedding").cast("long").alias("d"), "class_id", "copies", "embedding")
    return rows.repartition("d").sortWithinPartitions("d").mapInArrow(run, LINKED)


def indexed(classes: DataFrame, n: int) -> DataFrame:
    """The same for the ``n`` classes of one length, by the index."""
    got = classes.orderBy(F.xxhash64("embedding", F.lit(SEED)), "class_id").limit(SAMPLE).select("class_id", "embedding").toArrow()
    sample = matrix(got.column(1).combine_chunks())
    grid = Grid(sample, max(2, round((n / CELL_ROWS) ** 0.5)) if n <= CELL_ROWS * MOST_CODES**2 else MOST_CODES)
    probes, there = calibrate(classes, grid, sample, got.column(0).to_numpy())
    while True:
        probes = min(probes, len(grid.a) * len(grid.b))
        seen = saved(visits(classes, grid, probes))
        out = saved(compare(dealt(seen)), seen)
        asked = classes.sparkSession.createDataFrame([(i,) for i in there], "class_id long") if there else None
        found = out.join(F.broadcast(asked), "class_id").agg(F.sum("links")).first()[0] or 0 if there else 0  # SAMPLE ids at most
        logging.getLogger(__name__).info("%d probes, recall %d of %d links of sampled vectors", probes, found, sum(there.values()))
        if found >= LEAST_RECALL * sum(there.values()) or probes == len(grid.a) * len(grid.b):
            return out
        discard(out)
        probes *= 2


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors`` (vec_id, embedding)."""
    rows, same = classes_of(vectors)
    sizes = same.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    many = sizes.filter(F.col("n") > FEW).orderBy("d").collect()  # a row a length
    checked = compared_whole(same.join(sizes.filter(F.col("n") <= FEW), F.size("embedding") == F.col("d")))
    for r in many:
        checked = checked.unionByName(indexed(same.filter(F.size("embedding") == r["d"]), r["n"]))
    checked = saved(checked)
    linked = checked.groupBy("class_id").agg(F.sum("links").alias("links"))
    parts = components(checked.select(F.col("class_id").alias("a"), F.col("root").alias("b")))
    known = same.join(linked, "class_id", "left").join(parts.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    known = known.select("embedding", F.coalesce("component", "class_id").alias("component"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), "copies", "low")
    lowest = known.groupBy("component").agg(F.min("low").alias("component_id"))
    known = saved(known.drop("low").join(lowest, "component").drop("component"), checked, parts)
    out = rows.filter("ok").join(known, "embedding", "left").select("vec_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    out = out.unionByName(rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
