"""Exact substring dedup over suffixes.

A byte is removed if some 200-byte string that covers it also starts anywhere else, in this text or another; strings are judged
on the input, and none crosses texts.

Sorting every suffix would move hundreds of bytes per byte of text, so the suffixes are sampled by content: of every
200-byte window the suffix at its smallest 32-byte hash is taken (about 1 in 85).  Equal windows take the same place, so
every repeated string is seen through suffixes with equal leading bytes.

1. Suffixes are dealt by sampled splitters over their leading 32 bytes (their hash, so that the ranges are even) and sorted; the
   ranges never part equal leads, so no comparison crosses a range's end.  A lead met once is dropped.
2. A suffix whose whole context (168 bytes before and 200 after, or to the text's ends) is met twice is repeated
   throughout it; hot passages end here, however frequent.
3. The other contexts of a lead are compared byte by byte, to the left and right; over ``PAIRWISE`` of them, column by column:
   the windows at one offset are sorted by hash and equal neighbours found.  Leads of more than ``HOT`` different contexts
   are not gathered: their windows are counted by hash in the cluster.  A match of L bytes before and R after
   the suffix, with L + R >= 200, covers [-L, R).
4. The intervals of a text are joined and cut out.

Texts are read whole, as UTF-8, and long ones in overlapping pieces, so that memory does not grow with a text's length beyond a few
copies of its bytes; null counts as empty.  An empty table gives no rows.  Rows are told apart by doc_id, or where ids are missing or shared by a
hash of (doc_id, text): repeated rows are each other's copies, and each gives a row.  Nothing is collected on the driver.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from reelquery.llm.common import saved
from reelquery.llm.ngrams import _mixed, grouped

LENGTH, GRAM, PAIRWISE, HOT = 200, 32, 40, 5000
BEFORE = LENGTH - GRAM  # how far a window that holds the suffix's lead can begin before it
WINDOW = BEFORE + 1
BATCH_BYTES = 1 << 19
#: Enough for the bytes of a batch and the overlaps of its pieces.
PLACE_BITS = np.uint64(21)
SPLIT_TEXTS, SPLIT_LEADS = 500, 100_000
_rng = np.random.default_rng(77)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n modulo 2**64, kept per process and grown by doubling."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        out = np.full(max(n + 1, 2 * BATCH_BYTES), base, dtype=np.uint64)
        out[0] = 1
        with np.errstate(over="ignore"):
            have = _POWERS[base] = np.multiply.accumulate(out)
    return have[: n + 1]


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """The smallest of every w neighbours, in time that does not depend on w."""
    n = len(v) - w + 1
    pad = -len(v) % w
    full = np.concatenate([v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def sampled(pieces: list["Piece"]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(piece, place, lead, context)`` of the sampled suffixes: hashes of the leading bytes and of the whole context."""
    size = np.array([len(p.raw) for p in pieces], dtype=np.int64)
    start = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(p.raw for p in pieces), np.uint8)
    n = len(raw)
    if n < LENGTH:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    with np.errstate(over="ignore"):
        up, down = _powers(_BASE, n), _powers(_BACK, n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[:n], out=total[1:])
        lead = _mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
        # the place in the low bits, as many of them whatever the batch: the leftmost of equal leads is the smallest
        key = (lead >> PLACE_BITS << PLACE_BITS) | np.arange(len(lead), dtype=np.uint64)
        low = sliding_min(key, WINDOW) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))
        end_of = np.repeat(start[1:], size)
        inside = np.arange(len(low)) + LENGTH <= end_of[: len(low)]
        at = low[inside].astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        piece = np.searchsorted(start, at, side="right") - 1
        first, last, begin = (np.array([p[i] for p in pieces], dtype=np.int64)[piece] for i in (3, 4, 2))
        own = (at - start[piece] + begin >= first) & (at - start[piece] + begin < last)
        at, piece, begin = at[own], piece[own], begin[own]
        a, b = np.maximum(at - BEFORE, start[piece]), np.minimum(at + LENGTH, start[piece + 1])
        context = _mixed((total[b] - total[a]) * down[a] + ((at - a) * 1024 + (b - at)).astype(np.uint64))
    return piece, at - start[piece] + begin, lead[at], context


class Piece(NamedTuple):
    """Part of a text: the bytes from ``begin`` on, which has the suffixes at ``first`` to ``last`` and all they are judged by."""

    row: int
    raw: bytes
    begin: int
    first: int
    last: int


def uid(text: str = "text") -> Column:
    return F.xxhash64(F.col("doc_id"), F.col(text))


def name_of(docs: DataFrame, text: str = "text") -> Column:
    """What tells rows apart: doc_id if every row has one of its own, else a hash of it and the text."""
    if isinstance(docs.schema["doc_id"].dataType, IntegralType):
        odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
        if odd.isEmpty():
            return F.col("doc_id").cast("long")
    return uid(text)


SUFFIX = "part int, times int, lead long, context long, uid long, place int"


def _batches(batch: pa.RecordBatch, column: int) -> Iterator[list[Piece]]:
    """The texts of a batch as bytes, some BATCH_BYTES at a time; longer texts in pieces that overlap."""
    held, size = [], 0
    for i, t in enumerate(batch.column(column)):
        raw = (t.as_py() or "").encode()
        for lo in range(0, max(len(raw), 1), BATCH_BYTES):
            hi, a = min(lo + BATCH_BYTES, len(raw)), max(lo - BEFORE, 0)
            if held and size + hi - lo > BATCH_BYTES:
                yield held
                held, size = [], 0
            held.append(Piece(i, raw[a : hi + LENGTH], a, lo, hi))
            size += hi - lo
    if held:
        yield held


def splitters(docs: DataFrame, parts: int, text: str = "text") -> np.ndarray:
    """Ends of ``parts`` ranges of leads: quantiles of the different leads of some SPLIT_TEXTS texts chosen by hash.

    They set the ranges' sizes, not the results.
    """
    n = docs.count()
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(1 << 30)) < int(min(1.0, SPLIT_TEXTS / max(n, 1)) * (1 << 30)))
    got = np.unique(suffixes(some, np.zeros(0, np.uint64), text).select("lead").limit(SPLIT_LEADS).toPandas()["lead"].to_numpy().view(np.uint64))
    return got[np.unique(np.linspace(0, len(got) - 1, parts + 1).astype(int)[1:-1])] if len(got) else got


def dealing(docs: DataFrame, parts: int) -> np.ndarray:
    """For each of ``parts`` partitions a number that is dealt to it, so that every range has a task of its own."""
    numbers = docs.sparkSession.range(int(parts * (np.log(parts) + 16))).select(F.col("id").cast("int").alias("i"))
    got = numbers.groupBy(F.pmod(F.hash("i"), F.lit(parts)).alias("p")).agg(F.min("i").alias("i")).collect()  # a row a partition
    out = np.arange(parts, dtype=np.int32)
    for r in got:
        out[r["p"]] = r["i"]
    return out


def suffixes(docs: DataFrame, ends: np.ndarray, text: str = "text", deal: np.ndarray | None = None, name: Column | None = None) -> DataFrame:
    """The sampled suffixes with the range of leads they belong to, as the number that ``deal`` has for it.

    ``times``: how often the batch met the context (2 stands for more); 0 for rows that another row of the batch speaks
    for, which are dealt by text.
    """
    rows = docs.select((uid(text) if name is None else name).alias("uid"), F.col(text).alias("text")).filter(F.length("text") > LENGTH // 4 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            for pieces in _batches(b, 1):
                at, place, lead, context = sampled(pieces)
                # a context that is met again in the batch is settled here: one row speaks for it
                _, one, same, times = np.unique(context, return_index=True, return_inverse=True, return_counts=True)
                speaks = np.zeros(len(context), bool)
                speaks[one] = True
                times = np.where(speaks, np.minimum(times[same], 2), 0).astype(np.int32)
                u = ids[np.array([p.row for p in pieces], dtype=np.int64)[at]]
                part = np.where(speaks, np.searchsorted(ends, lead, side="right"), u % (len(ends) + 1)).astype(np.int32)
                part = part if deal is None else deal[part]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(times), pa.array(lead.view(np.int64)), pa.array(context.view(np.int64)), pa.array(u), pa.array(place.astype(np.int32))],
                    names=["part", "times", "lead", "context", "uid", "place"],
                )

    return rows.mapInArrow(run, SUFFIX)


def judged(rows: DataFrame, parts: int) -> DataFrame:
    """``(lead, uid, place, full, alone)``: suffixes whose lead is met twice.  ``full``: so is the whole context.

    ``alone``: no other context of that lead differs, so nothing is left to compare.  Of a context that is met often, one
    row is kept for comparison (``full`` and not ``alone``), the others are ``alone``.  One pass over sorted rows, with the
    first row of the context at hand as its only state.
    """
    names = ["lead", "uid", "place", "full", "alone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # first row of the last context, how often the context was met, whether its lead had others before

        def firsts(lead, u, place, times, before, after):
            other = before | after
            keep = (times > 1) | other
            full = times > 1
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (lead, u, place, full, full & ~other)], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            lead, context, u, place, met = (b.column(i).to_numpy() for i in range(5))
            settled = met == 0
            if settled.any():
                true = np.ones(int(settled.sum()), bool)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (lead[settled], u[settled], place[settled], true, true)], names=names)
                lead, context, u, place, met = (x[~settled] for x in (lead, context, u, place, met))
                if not len(lead):
                    continue
            before = False
            if held is not None:
                lead, context, u, place = (np.append(x, y) for x, y in zip(held[0], (lead, context, u, place), strict=True))
                met, before = np.append(held[1], met), held[2]
            new = np.concatenate([[True], (lead[1:] != lead[:-1]) | (context[1:] != context[:-1])])
            at = np.flatnonzero(new)
            times = np.minimum(np.add.reduceat(met.astype(np.int64), at), 2)
            had = np.concatenate([[before], lead[at[1:]] == lead[at[:-1]]])
            rest = np.flatnonzero(~new)
            true = np.ones(len(rest), bool)
            yield pa.RecordBatch.from_arrays([pa.array(lead[rest]), pa.array(u[rest]), pa.array(place[rest]), pa.array(true), pa.array(true)], names=names)
            done = at[:-1]
            yield firsts(lead[done], u[done], place[done], times[:-1], had[:-1], had[1:])
            z = at[-1:]
            held = ((lead[z], context[z], u[z], place[z]), times[-1], had[-1])
        if held is not None:
            (lead, _, u, place), times, had = held
            yield firsts(lead, u, place, np.array([times]), np.array([had]), np.array([False]))

    dealt = rows.repartition(parts, "part").sortWithinPartitions("lead", "context")
    return dealt.select("lead", "context", "uid", "place", "times").mapInArrow(run, "lead long, uid long, place int, full boolean, alone boolean")


def contexts(docs: DataFrame, wanted: DataFrame, name: Column, text: str = "text") -> DataFrame:
    """Adds the bytes around each suffix and how many of them lie before it."""
    by_text = wanted.groupBy("uid").agg(F.collect_set(F.struct("lead", "place", "full")).alias("w"))
    # repeated rows have one uid and one text
    texts = docs.select(name.alias("uid"), F.col(text).cast("binary").alias("raw")).join(by_text, "uid")
    x = texts.select("uid", "raw", F.explode("w").alias("x")).select("uid", "raw", "x.*")
    before = F.least(F.col("place"), F.lit(BEFORE))
    return x.select("lead", "uid", "place", "full", before.alias("before"), F.substring(F.col("raw"), F.col("place") - before + 1, before + LENGTH).alias("bytes")).dropDuplicates(["uid", "place"])


def _grid(before: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Contexts under one another with their suffixes in one column, and how many bytes follow."""
    after = np.array([len(r) for r in raw]) - before
    grid = np.zeros((len(raw), BEFORE + LENGTH), np.uint8)
    for i, r in enumerate(raw):
        grid[i, BEFORE - before[i] : BEFORE + after[i]] = np.frombuffer(r, np.uint8)
    return grid, after


def _sums(before: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Running sums whose differences are the windows' hashes, alike at equal columns."""
    grid, after = _grid(before, raw)
    total = np.zeros((len(raw), BEFORE + LENGTH + 1), np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE[grid] * _powers(_BASE, BEFORE + LENGTH)[:-1][None, :], axis=1, out=total[:, 1:])
    return total, after


def spans_of(before: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each context how far repeated strings reach before and after the suffix; 0, 0 if there are none."""
    m = len(raw)
    if m <= PAIRWISE:
        grid, after = _grid(before, raw)
        same = grid[:, None, :] == grid[None, :, :]
        stop = np.zeros((m, m, 1), bool)
        r = np.argmin(np.concatenate([same[:, :, BEFORE:], stop], axis=2), axis=2)
        l = np.argmin(np.concatenate([same[:, :, :BEFORE][:, :, ::-1], stop], axis=2), axis=2)  # noqa: E741
        r = np.minimum(r, np.minimum(after[:, None], after[None, :]))
        l = np.minimum(l, np.minimum(before[:, None], before[None, :]))  # noqa: E741
        ok = (l + r >= LENGTH) & ~np.eye(m, dtype=bool)
        return np.where(ok, l, 0).max(axis=1), np.where(ok, r, 0).max(axis=1)
    total, after = _sums(before, raw)
    grid, _ = _grid(before, raw)
    left, right = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for o in range(BEFORE + 1):
        able = np.flatnonzero((before >= o) & (after >= LENGTH - o))
        if len(able) < 2:
            continue
        with np.errstate(over="ignore"):
            h = _mixed(total[able, BEFORE + LENGTH - o] - total[able, BEFORE - o])
        order = np.argsort(h, kind="stable")
        equal = h[order][1:] == h[order][:-1]
        rows, other = able[order[1:][equal]], able[order[:-1][equal]]
        equal[equal] = (grid[rows, BEFORE - o : BEFORE - o + LENGTH] == grid[other, BEFORE - o : BEFORE - o + LENGTH]).all(axis=1)
        hit = able[order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]]
        left[hit] = np.maximum(left[hit], o)
        right[hit] = np.maximum(right[hit], LENGTH - o)
    return left, right


def compared(rows: DataFrame, parts: int) -> DataFrame:
    """``(uid, a, b)``: what the contexts of one lead have in common, for those that are met once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, ...]] = []

        def flush():
            u, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["uid", "a", "b"])

        for g in grouped(batches):
            u, place, full, before = (g.column(i).to_numpy() for i in (1, 2, 3, 4))
            left, right = spans_of(before.astype(np.int64), g.column(5).to_pylist())
            some = (right > 0) & ~full
            out.append((u[some], place[some] - left[some], place[some] + right[some]))
            if len(out) >= 5000:
                yield flush()
        if out:
            yield flush()

    return rows.repartition(parts, "lead").sortWithinPartitions("lead").select("lead", "uid", "place", "full", "before", "bytes").mapInArrow(run, "uid long, a int, b int")


def compared_by_windows(rows: DataFrame) -> DataFrame:
    """The same for leads of any number of contexts: every 200-byte window under its hash, counted and joined back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                before = b.column(4).to_numpy().astype(np.int64)
                total, after = _sums(before, b.column(5).to_pylist())
                offset = np.arange(BEFORE + 1)
                with np.errstate(over="ignore"):
                    h = _mixed(total[:, LENGTH + BEFORE - offset] - total[:, BEFORE - offset])
                i, o = np.nonzero((before[:, None] >= offset) & (after[:, None] >= LENGTH - offset))
                take = pa.array(i)
                cols = [pa.array(h[i, o].view(np.int64)), pa.array(o.astype(np.int32)), *(b.column(j).take(take) for j in range(4))]
                yield pa.RecordBatch.from_arrays(cols, names=["x", "o", "lead", "uid", "place", "full"])

    windows = saved(rows.select("lead", "uid", "place", "full", "before", "bytes").mapInArrow(run, "x long, o int, lead long, uid long, place int, full boolean"))
    often = windows.groupBy("x", "lead").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = windows.filter("not full").join(often, ["x", "lead"]).groupBy("uid", "place").agg(F.min("o").alias("low"), F.max("o").alias("high"))
    return met.select("uid", (F.col("place") - F.col("high")).alias("a"), (F.col("place") + LENGTH - F.col("low")).alias("b"))


def cut(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``kept_bytes binary``, ``removed_spans array<struct<a, b>>`` (byte places) and ``n_bytes long``.

    Columns of these names are replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop("kept_bytes", "removed_spans", "n_bytes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = name_of(docs, text)
    met = saved(judged(suffixes(docs, splitters(docs, parts, text), text, dealing(docs, parts), name), parts))
    rest = met.filter("not alone")
    hot = saved(rest.groupBy("lead").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT).drop("n"))
    some = saved(compared(contexts(docs, rest.join(hot, "lead", "left_anti"), name, text), parts))
    if not hot.isEmpty():
        some = some.unionByName(saved(compared_by_windows(contexts(docs, rest.join(hot, "lead"), name, text))))
    whole = met.filter("full").select("uid", F.greatest(F.col("place") - BEFORE, F.lit(0)).alias("a"), (F.col("place") + LENGTH).alias("b"))
    spans = some.unionByName(whole).groupBy("uid").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    # the row travels as one column, so that its names cannot clash with those used here
    rows = docs.select(name.alias("uid"), F.struct(*docs.columns).alias("row")).join(spans, "uid", "left").select("row", F.col("row")[text].alias("text"), "spans")
    made = "kept_bytes binary, removed_spans array<struct<a: int, b: int>>, n_bytes long"
    schema = StructType([*rows.select("row").schema, *StructType.fromDDL(made)])
    arrow = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                kept, gone, size = [], [], []
                for t, s in zip(b.column(1), b.column(2), strict=True):
                    raw = (t.as_py() or "").encode()
                    runs: list[list[int]] = []
                    for a, z in sorted((x["a"], min(x["b"], len(raw))) for x in s.as_py() or ()):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(runs[-1][1], z)
                        else:
                            runs.append([a, z])
                    ends = [0, *(z for _, z in runs)]
                    kept.append(b"".join(raw[x:y] for x, y in zip(ends, [*(a for a, _ in runs), len(raw)], strict=True)))
                    gone.append([{"a": a, "b": z} for a, z in runs])
                    size.append(len(raw))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(gone, arrow), pa.array(size, pa.int64())], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in docs.columns], "kept_bytes", "removed_spans", "n_bytes")


def digests(out: DataFrame) -> DataFrame:
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda s, x: s + (x["b"] - x["a"]))
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed_spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))
