"""Mixing sources to target weights, with DataFrame functions only.

A tree of three levels (domain, language, source) gets a token budget.  At each node the budget is divided among the children by
weight; a child whose subtree holds fewer tokens (times ``max_epochs``) takes what it has, and the rest is divided
among its siblings in proportion to their weights.  A shortage leaves a node only as a whole, so siblings come before
ancestors.  Fractions of a token are cut off.

A leaf takes its documents epoch by epoch, each epoch in its own seeded order (md5 of seed, epoch, id and text), as the longest
run of documents that starts before the budget is reached: the last one may exceed it.  Documents without tokens are never
chosen; the repetitions of a document are rows ``epoch`` 0, 1, ....

Token sums per leaf and hash bucket are aggregated first; only the bucket in which a leaf's budget ends is ordered
by document, so a leaf may hold any share of the rows.  With more than ``BUCKETS`` documents in a leaf that bucket is
a 1/BUCKETS part of them.  What a leaf takes is told by one row, its last epoch, bucket and key: the tables joined with the documents
have a row a leaf, and Spark broadcasts them only while they are small.

A weight of 0 switches a domain, language or source off: nothing is taken from it, and its siblings' budget is divided as if it were not
there (the root's budget is still a fraction of all tokens).  A null or negative weight is an error.

Columns ``epoch`` and ``mix_tokens`` of the input are replaced, and others travel along.  Texts are read whole.
Null domains, languages and sources are nodes of their own; a null text has no tokens; repeated rows with one id and text share
their place in the order and are taken together.  An empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import saved

LEVELS = ("domain", "lang", "source")
DIGITS = 3
BUCKETS = 16**DIGITS
NONE = "∅"
TOKEN = r"[^ \t\r\n]"


def n_tokens(text: Column) -> Column:
    """Runs of anything but blanks, tabs and line ends."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN + "+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The query's domains: four groups of sources by the number in their name."""
    n = F.regexp_extract(source, r"([0-9]{1,9})", 1)
    return F.when(F.coalesce(n, F.lit("")) == "", F.lit("other")).otherwise(F.concat(F.lit("d"), (n.cast("long") % 4).cast("string")))


def weight_of(level: str, name: Column) -> Column:
    """Default target weights: English counts four, everything else one; named domains fall from 4 to 1."""
    if level == "lang":
        return F.when(name == "en", 4).otherwise(1).cast("long")
    if level == "domain":
        return F.when(name == "d0", 4).when(name == "d1", 3).when(name == "d2", 2).otherwise(1).cast("long")
    return F.lit(1).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, order: str) -> DataFrame:
    """Adds ``share``: ``min(capacity, level * weight)``, with one level per parent that uses up the budget.

    In ascending order of capacity per weight, those before the break take their capacity; the level is what is left over the
    weights that are left.  One row per child, so windows over a parent see an aggregated table.
    """
    by = Window.partitionBy(*parent).orderBy(F.col(capacity) / F.col(weight), order)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    w = nodes.withColumn("_c", F.coalesce(F.sum(capacity).over(before), F.lit(0).cast("long"))).withColumn("_w", F.sum(weight).over(rest))
    w = w.withColumn("_level", (F.col(budget) - F.col("_c")) / F.col("_w"))
    # the level that holds for all is the first that its own child can bear
    first = F.min(F.when(F.col("_level") <= F.col(capacity) / F.col(weight), F.struct((F.col(capacity) / F.col(weight)).alias("r"), F.col(order).alias("o"), F.col("_level").alias("l")))).over(Window.partitionBy(*parent))
    w = w.withColumn("_at", first["l"])
    share = F.when(F.col("_at").isNull(), F.col(capacity)).otherwise(F.least(F.col(capacity), F.floor(F.col("_at") * F.col(weight)).cast("long")))
    return w.withColumn("share", F.greatest(share, F.lit(0).cast("long"))).drop("_c", "_w", "_level", "_at")


def keyed(docs: DataFrame, seed: int, epochs: int, domain: Column | None = None, light: bool = False) -> DataFrame:
    """One row per document with tokens and epoch: leaf, seeded key and bucket, and the row's own columns as ``row``.

    ``light``: token counts instead of the row's own columns.
    """
    text = F.col("row.text")
    named = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    rows = docs.select(F.struct(*docs.columns).alias("row")).filter(F.coalesce(text.rlike(TOKEN), F.lit(False)))
    own = n_tokens(text).alias("tokens") if light else F.col("row")
    rows = rows.select(
        own, named(domain_of(F.col("row.source")) if domain is None else domain).alias("domain"), named(F.col("row.lang")).alias("lang"), named(F.col("row.source")).alias("source"),
        F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("_id"), F.md5(text.cast("binary")).alias("_digest"),
    )
    rows = rows.withColumn("epoch", F.lit(0) if epochs == 1 else F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), "_id", "_digest").cast("binary"))
    return rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS)).drop("_id", "_digest")


def mix(docs: DataFrame, fraction: tuple[int, int] = (1, 2), max_epochs: int = 1, seed: int = 42, weights=weight_of, domain: Column | None = None) -> DataFrame:
    """The chosen rows of ``docs`` (columns text, lang, source, doc_id and any others) with ``epoch`` and ``mix_tokens``.

    The budget is ``fraction`` (numerator, denominator) of all tokens.  ``domain`` is a Column over ``row.<column>``.
    """
    docs = docs.drop("epoch", "mix_tokens")
    leaf, place = list(LEVELS), [*LEVELS, "epoch", "bucket"]
    light = saved(keyed(docs, seed, max_epochs, domain, light=True))  # keys and counts, no text
    plan = light.groupBy(*place).agg(F.sum("tokens").alias("t"))
    leaves = light.filter("epoch = 0").groupBy(*leaf).agg(F.sum("tokens").alias("tokens"))
    amount = F.floor(F.col("all") * fraction[0] / fraction[1]).cast("long")
    wanted = budgets(leaves, leaves.agg(F.sum("tokens").alias("all")), amount, max_epochs, weights)
    before = Window.partitionBy(*leaf).orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = plan.withColumn("start", F.coalesce(F.sum("t").over(before), F.lit(0).cast("long")))
    # where a leaf's budget ends: its last bucket that starts before; one row a leaf
    ends = starts.join(wanted, leaf).filter("start < budget").groupBy(*leaf).agg(F.max(F.struct("epoch", "bucket", "start", "budget", "t")).alias("e")).select(*leaf, "e.*")
    ends = saved(ends.withColumnsRenamed({"epoch": "_epoch", "bucket": "_bucket"}))
    # in that bucket: the last key that starts before the budget is reached
    there = (F.col("epoch") == F.col("_epoch")) & (F.col("bucket") == F.col("_bucket"))
    keys = light.join(ends.filter("start + t > budget"), leaf).filter(there).groupBy(*place, "start", "budget", "key").agg(F.sum("tokens").alias("t"))
    order = Window.partitionBy(*place).orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    inside = keys.filter("t > 0").withColumn("_s", F.col("start") + F.coalesce(F.sum("t").over(order), F.lit(0).cast("long"))).filter("_s < budget")
    last = inside.groupBy(*leaf).agg(F.max("key").alias("_last"))
    taken = saved(ends.join(last, leaf, "left").select(*leaf, "_epoch", "_bucket", "_last"), light, ends)
    before_end = F.struct("epoch", "bucket") < F.struct(F.col("_epoch"), F.col("_bucket"))
    chosen = keyed(docs, seed, max_epochs, domain).join(taken, leaf).filter(before_end | (there & (F.col("_last").isNull() | (F.col("key") <= F.col("_last")))))
    return chosen.select("row.*", "epoch", n_tokens(F.col("row.text")).alias("mix_tokens"))


def budgets(leaves: DataFrame, total: DataFrame, amount: Column, max_epochs: int, weights=weight_of) -> DataFrame:
    """``(domain, lang, source, tokens)`` to ``(domain, lang, source, budget)``: weights propagated down, shortages settled.

    ``amount`` is the root's budget, from the one-row table ``total``.
    """
    for level in LEVELS:
        w = weights(level, F.col(level))
        bad = F.raise_error(F.concat(F.lit(f"the weight of a {level} must be 0 or more: "), F.col(level))).cast("boolean")
        leaves = leaves.filter(F.when(w >= 0, w > 0).otherwise(bad))
    joined = leaves.crossJoin(F.broadcast(total.select(amount.alias("_total"))))  # one row
    out, up = None, joined.withColumn("cap", F.col("tokens") * max_epochs)
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = up.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.first("_total").alias("_total")).withColumn("weight", weights(level, F.col(level)))
        parent = keys[:-1]
        nodes = nodes.withColumn("budget", F.col("_total")).withColumn("_root", F.lit(0)) if out is None else nodes.join(out, parent)
        out = water_fill(nodes, parent or ["_root"], "budget", "weight", "cap", level).select(*keys, F.col("share").alias("budget"))
    return out


def oracle_sql(fraction: tuple[int, int], max_epochs: int, seed: int) -> str:
    """The query's rows in DuckDB: the same plan, with one window over every leaf's documents in order."""

    def fill(name: str, source: str, keys: str, parent: str, weight: str, order: str) -> str:
        w = f"PARTITION BY {parent} ORDER BY cap / weight, {order}"
        return f"""{name}0 AS (SELECT *, {weight} AS weight FROM {source}),
{name}1 AS (SELECT *, (budget - coalesce(sum(cap) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT) / (sum(weight) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lvl FROM {name}0),
{name}2 AS (SELECT *, min(CASE WHEN lvl <= cap / weight THEN struct_pack(r := cap / weight, o := {order}, l := lvl) END) OVER (PARTITION BY {parent}) AS f FROM {name}1),
{name} AS (SELECT {keys}, greatest(0, CASE WHEN f IS NULL THEN cap ELSE least(cap, floor(f.l * weight)::BIGINT) END)::BIGINT AS budget FROM {name}2)"""

    return f"""WITH d0 AS (SELECT doc_id, text, lang, source, regexp_extract(source, '([0-9]{{1,9}})', 1) AS num FROM documents),
d AS (SELECT doc_id, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source, CASE WHEN coalesce(num, '') = '' THEN 'other' ELSE 'd' || (num::BIGINT % 4) END AS domain,
  len(regexp_extract_all(text, '[^ \\t\\r\\n]+')) AS tokens, md5(text) AS digest FROM d0),
e AS (SELECT d.*, epoch, md5('{seed}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest) AS key FROM d, range(0, {max_epochs}) t(epoch) WHERE tokens > 0),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT * {max_epochs} AS cap FROM e WHERE epoch = 0 GROUP BY ALL),
tot AS (SELECT floor(sum(tokens)::BIGINT * {fraction[0]} / {fraction[1]})::BIGINT AS budget FROM e WHERE epoch = 0),
n1 AS (SELECT domain, sum(cap)::BIGINT AS cap, (SELECT budget FROM tot) AS budget, 0 AS root FROM leaf GROUP BY ALL),
{fill('b1', 'n1', 'domain', 'root', "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END", 'domain')},
n2 AS (SELECT x.*, budget FROM (SELECT domain, lang, sum(cap)::BIGINT AS cap FROM leaf GROUP BY ALL) x JOIN b1 USING (domain)),
{fill('b2', 'n2', 'domain, lang', 'domain', "CASE lang WHEN 'en' THEN 4 ELSE 1 END", 'lang')},
n3 AS (SELECT leaf.*, budget FROM leaf JOIN b2 USING (domain, lang)),
{fill('b3', 'n3', 'domain, lang, source', 'domain, lang', '1', 'source')},
k AS (SELECT domain, lang, source, epoch, key, sum(tokens)::BIGINT AS t FROM e GROUP BY ALL),
s AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY domain, lang, source ORDER BY epoch, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM k)
SELECT e.doc_id, e.epoch::INTEGER AS epoch, e.tokens::BIGINT AS n_tokens, e.lang, e.source FROM e JOIN s USING (domain, lang, source, epoch, key) JOIN b3 USING (domain, lang, source) WHERE s.start < b3.budget"""
