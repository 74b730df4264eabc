"""Merkle manifest of a data set: a digest a row, a tree a group, a tree over the groups, and a proof for every row.

1. ``leaf_of`` hashes the stated fields of a row.
2. ``numbered``: rows are range-partitioned by (group, order, leaf) and get their place in their group from counts of the ranges
   before, so a group of any size is spread over tasks.
3. Levels by windows: the nodes of a group whose places share a quotient by ``FANOUT`` are a run.  The whole run, in order, collected
   over a window of at most ``FANOUT`` rows, gives both the parent (its digest) and each node's siblings; the first node of a
   run stands for it, so each parent goes to the next level once.  A level has a ``FANOUT``-th of the rows of the one below.
4. The roots of the groups are the leaves of the upper tree, in the order of the groups (null first, then by UTF-8 bytes).
5. Paths come from above: a node's path is its own siblings and its parent's path, by one join a level.

A path is ``array<struct<before, after>>``, level by level from the leaf to the root: the siblings on the left and those on the right, each side
concatenated.  ``fold`` recomputes the root from a leaf and a path; ``proof`` is the digest of all siblings.

Null fields hash as ``-``; null and empty texts therefore differ.  Rows with a null group form one group, the first.  Rows with a null
order come first in their group; rows with equal order are placed by their digests, and repeated rows are leaves beside each
other.  An empty table gives no rows.  Columns are carried as they are and no name can clash, as they travel in one struct.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import discard, saved

FANOUT = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value; numbers in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def lower_az(text: Column) -> Column:
    """Only A-Z become a-z."""
    return F.translate(text, UPPER, LOWER)


def _runs(nodes: DataFrame) -> DataFrame:
    """Nodes with the siblings to the left and right and the digest of the run: one window of at most FANOUT rows a run."""
    keep = nodes.columns
    nodes = nodes.withColumn("up", F.floor(F.col("at") / FANOUT).cast("long"))
    w = Window.partitionBy("g", "up").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = nodes.withColumn("run", F.collect_list("digest").over(w)).withColumn("i", (F.col("at") % FANOUT).cast("int"))
    side = lambda first, count: F.array_join(F.slice("run", first, count), "")
    siblings = F.struct(side(F.lit(1), F.col("i")).alias("before"), side(F.col("i") + 2, F.lit(FANOUT)).alias("after"))
    return rows.select(*keep, "up", siblings.alias("siblings"), digest(F.array_join("run", "")).alias("parent"))


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """The nodes ``(g, at, size, digest)`` of every level, leaves first; a group's last node is the one of a level where its size is 1."""
    levels = [leaves]
    left = leaves.agg(F.max("size")).first()[0] or 0
    while left > 1:
        parents = _runs(levels[-1].filter("size > 1").select("g", "at", "size", "digest")).filter(F.col("at") % FANOUT == 0)
        levels.append(saved(parents.select("g", F.col("up").alias("at"), F.ceil(F.col("size") / FANOUT).cast("long").alias("size"), F.col("parent").alias("digest"))))
        left = -(-left // FANOUT)
    return levels


def _paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The nodes of the lowest level with ``path`` and ``top``; ``tops`` has ``(g, path, top)``: what stands above the root of each group."""
    found = None
    for nodes in reversed(levels):
        keep = nodes.columns
        ends = nodes.filter("size = 1").join(tops, "g").select(*keep, "path", "top")
        if found is not None:
            above = found.select("g", F.col("at").alias("up"), F.col("path").alias("_path"), "top")
            path = F.concat(F.array("siblings"), F.col("_path"))
            ends = ends.unionByName(_runs(nodes.filter("size > 1")).join(above, ["g", "up"]).select(*keep, path.alias("path"), "top"))
        found = ends if nodes is levels[0] else saved(ends, *([found] if found is not None else []))
    return found


def _roots(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [nodes.filter("size = 1").select("g", "digest") for nodes in levels])


def numbered(rows: DataFrame, order: list[str], group: str | None = None, names: DataFrame | None = None) -> DataFrame:
    """Adds ``at`` (place in the group, from 0) and ``size`` (rows of the group); ``rows`` is a written table.

    Rows are put in order over the whole table, in ranges, so that no group lies in one task; counts of a group's rows in each range
    shift the places.  ``names``: ``(grp, g)``, a number for each group to be added.
    """
    by = [F.asc_nulls_first(c) for c in ([group] if group else []) + order]
    placed = saved(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_id", 33)).withColumn("_group", F.col(group) if group else F.lit(None).cast("string"))
    heads = placed.groupBy(F.col("_part").alias("_p"), F.col("_group").alias("_g")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    of = Window.partitionBy("_g")
    before = F.coalesce(F.sum("_n").over(of.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heads = heads.select("_p", "_g", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("size"))
    more = []
    if names is not None:
        heads, more = heads.join(names, F.col("_g").eqNullSafe(F.col("grp"))).drop("grp"), ["g"]
    out = placed.join(heads, (F.col("_part") == F.col("_p")) & F.col("_group").eqNullSafe(F.col("_g")))
    return out.select(*rows.columns, (F.col("_id") + F.col("_shift")).alias("at"), "size", *more)


def manifest(rows: DataFrame, leaf: str = "leaf", group: str = "source", order: str = "doc_id") -> DataFrame:
    """Adds ``subroot``, ``root`` and ``path`` to every row."""
    held = saved(rows.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("ord"), F.col(leaf).alias("digest"), F.struct(*[F.col(c) for c in rows.columns]).alias("row")))
    # groups are known by their place in the order from here on
    groups = saved(held.select("grp").distinct())
    names = saved(numbered(groups, ["grp"]).select("grp", F.col("at").alias("g")), groups)
    leaves = saved(numbered(held, ["ord", "digest"], "grp", names).select("g", "at", "size", "digest", "row"))
    discard(held)
    levels = _levels(leaves)
    one = F.lit(0).cast("long")
    upper = _levels(saved(_roots(levels).select(one.alias("g"), F.col("g").alias("at"), F.lit(names.count()).cast("long").alias("size"), "digest")))
    none = F.array().cast("array<struct<before:string,after:string>>")
    crown = upper[-1].filter("size = 1").select("g", none.alias("path"), F.col("digest").alias("top"))
    tops = saved(_paths(upper, crown).select(F.col("at").alias("g"), "path", F.struct(F.col("digest").alias("subroot"), F.col("top").alias("root")).alias("top")))
    return _paths(levels, tops).select("row.*", F.col("top.subroot").alias("subroot"), F.col("top.root").alias("root"), "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda below, p: digest(F.concat(p["before"], below, p["after"])))


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), ""))
