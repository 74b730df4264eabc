"""Line dedup by deletion neighbourhoods.

Lines are the parts of a text between line feeds.  A line goes if an earlier line of the corpus equals it or is near to it.
Earlier means a smaller (doc_id, line number) of the line's first occurrence; whether the earlier line itself goes does not matter.
Lines without words stay, and so does the order of the rest.

The bound is one edit (a unit inserted, deleted or replaced, letter case and amount of blanks aside) in lines long enough for it to be small:

* level 0: the units are words, and each character of a script written without blanks (``UNSPACED``) is a word.  Both
  lines have ``LEAST`` words or more: at most one word in 8 differs.
* level 1: the units are characters.  Both lines have ``LEAST`` + 1 words or fewer, and ``CHARS`` characters or more: at most one
  character in 16 differs.

Lines are near if they are so at either level; the levels overlap, as one character can make or join words.  Lines of fewer words than
LEAST and fewer characters than CHARS ("Page 12") have no near lines: the least edit is more of them than the bound.

Long lines are not compared by characters: the neighbourhood of a line of some hundred characters would be as many keys, which at
this scale no shuffle bears.  Even so a line's variants are emitted in two sizes, without losing a pair.  What is said of words below
holds for characters at level 1; keys of the two levels differ, by their lowest bit:

* A word whose hash ends in three zero bits begins a block.  Lines of ``MANY`` blocks or more emit the line without each block,
  without each two blocks in a row, and whole: one edited word changes one block, or joins or parts two, so what is
  left is equal on both sides.  A line of n words emits about n / 4 keys.
* Lines of up to ``MANY`` blocks emit the line without each word, and whole.

Before that the halves of all lines are hashed: two lines within one unit of each other share the first or the last half (see
``half_keys``), so only lines that share one emit variants.  Most lines of a corpus share none, which saves most of the keys.

An edit changes the number of blocks by one at most, so both lines of a pair have MANY blocks or more, or both MANY or fewer.  Keys met in one
line only are dropped; lines that share a key meet with their words, and the edit distance is verified.  Within a group
the earlier line is found by the group's own one-word variants, so a group costs time in proportion to its size.  Groups of
more than ``HOT`` lines are not gathered at all: their lines' one-word variants (128 bits) are aggregated and joined.

Exact repeats are settled before, by a hash of the line, and take no part in the groups.  Texts are read whole.

Null texts have no lines and stay null.  A null doc_id comes after all others.  Rows that share a doc_id share the places of
their lines: of repeated rows, all keep or lose the same lines.  Columns ``lines_total`` and ``lines_removed`` are replaced, others
travel along.  An empty table gives no rows.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import saved
from reelquery.llm.ngrams import _mixed, grouped, word_hashes

LEAST, CHARS, MANY, PAIRWISE, HOT = 8, 16, 4, 8, 2000
#: Scripts written without blanks (Thai, Lao, Tibetan, Burmese, Khmer, Han, kana) and their marks.
UNSPACED = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fdf\u3001-\u312f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff9f\U00020000-\U0003ffff"
_UNSPACED = re.compile(f"[{UNSPACED}]")
_WORD = re.compile(rf"[{UNSPACED}]|[^\s{UNSPACED}]+")
LAST_ID = 2**63 - 1
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
BATCH_WORDS = 200_000


def form(line: str, level: int) -> list[str]:
    """The units of a line: its words, or its characters with each run of blanks as one."""
    low = line.lower()
    if level:
        return list(" ".join(low.split()))
    return low.split() if low.isascii() or not _UNSPACED.search(low) else _WORD.findall(low)


def forms(line: str) -> list[tuple[int, list[str]]]:
    """The levels at which a line can have near lines, with its units."""
    words = form(line, 0)
    out = [(0, words)] if len(words) >= LEAST else []
    if len(words) <= LEAST + 1:
        chars = form(line, 1)
        if len(chars) >= CHARS:
            out.append((1, chars))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def variants(words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines given as word hashes, ``starts`` being their first words (and the end): ``(key, line)``."""
    n_lines = len(starts) - 1
    size = np.diff(starts)
    line = np.repeat(np.arange(n_lines), size)
    with np.errstate(over="ignore"):
        up, down = _powers(_BASE, len(words)), _powers(_BACK, len(words))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1], dtype=np.uint64)])

        def without(at: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
            """The hash of line ``at`` without its words s..e: does not depend on where the line stands."""
            a, b = starts[at], starts[at + 1]
            left, right = total[s] - total[a], total[b] - total[e]
            return _mixed((left + right * down[e - s]) * down[a] + (b - a - (e - s)).astype(np.uint64))

        first = np.zeros(len(words), bool)
        first[starts[:-1][size > 0]] = True
        begin = np.flatnonzero(first | ((words & np.uint64(7)) == 0))
        of = line[begin]
        end = np.append(begin[1:], len(words))
        blocks = np.bincount(of, minlength=n_lines)
        long = size >= LEAST
        keys, owner = [], []

        def emit(at, s, e):
            keys.append(without(at, s, e))
            owner.append(at)

        ok = (long & (blocks >= MANY))[of]  # of a pair with fewer blocks on one side, both emit words
        emit(of[ok], begin[ok], end[ok])
        pair = ok[:-1] & (of[:-1] == of[1:]) if len(of) else ok
        emit(of[:-1][pair], begin[:-1][pair], end[1:][pair])
        few = (long & (blocks <= MANY))[line]
        at = np.flatnonzero(few)
        emit(line[at], at, at + 1)
        whole = np.flatnonzero(long)
        emit(whole, starts[whole], starts[whole])
    return np.concatenate(keys), np.concatenate(owner)


def half_keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(key, h)``: the halves of every line that can have near lines, ``h`` naming the line.

    If one unit is inserted, deleted or replaced, what lies before it or what lies behind it is half a line: of the n units of the
    longer line, the first or the last (n - 1) // 2 are the first or last ones of the other, and n // 2 if both have n units.
    """
    import xxhash

    key = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # lines that this task has sent; bounded
        keys: list[int] = []
        names: list[int] = []

        def flush() -> pa.RecordBatch:
            out = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (keys, names)]
            keys.clear(), names.clear()
            return pa.RecordBatch.from_arrays(out, names=["key", "h"])

        for b in batches:
            for t in b.column(0):
                for raw in (t.as_py() or "").split("\n"):
                    if len(raw) < LEAST:
                        continue
                    h = xxhash.xxh64_intdigest(raw.encode(), 42)
                    if h in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(h)
                    for level, w in forms(raw):
                        n = len(w)
                        for m in {n // 2, (n - 1) // 2}:
                            keys += key(" ".join(w[:m]), 2 * level), key(" ".join(w[n - m :]), 2 * level + 1)
                            names += h, h
                if len(keys) > BATCH_WORDS:
                    yield flush()
        if keys:
            yield flush()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "key long, h long")


def line_keys(found: DataFrame) -> DataFrame:
    """``(key, h)``: the variants of the lines ``(h, line)`` at their levels; the lowest bit of a key is the level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        sizes: list[int] = []
        names: list[int] = []
        level: list[int] = []

        def flush() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            key, at = variants(word_hashes(words), starts)
            h = np.array(names, dtype=np.int64)[at]
            key = (key & ~np.uint64(1)) | np.array(level, dtype=np.uint64)[at]
            words.clear(), sizes.clear(), names.clear(), level.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h)], names=["key", "h"])

        for b in batches:
            for h, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for k, w in forms(line.as_py()):
                    words += w
                    sizes.append(len(w))
                    names.append(h)
                    level.append(k)
                if len(words) > BATCH_WORDS:
                    yield flush()
        if words:
            yield flush()

    return found.select("h", "line").mapInArrow(run, "key long, h long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """The distinct ``(key, h)`` whose key occurs with more than one h; one pass over sorted rows, nothing held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, and whether it has been sent
        for b in batches:
            if not b.num_rows:
                continue
            k, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            sent = False
            if held is not None:
                k, h, sent = np.append(held[0], k), np.append(held[1], h), held[2]
            same = (k[1:] == k[:-1]) & (h[1:] == h[:-1])
            keep = np.concatenate([[True], ~same])
            sent = sent and True
            k, h = k[keep], h[keep]
            joined = k[1:] == k[:-1]
            out = np.concatenate([[False], joined]) | np.concatenate([joined, [False]])
            last = bool(out[-1]) if len(out) > 1 else sent or bool(out[-1])
            if sent:
                out[0] = False
            held = (k[-1], h[-1], last)
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(h[out])], names=["key", "h"])

    return keys.repartition("key").sortWithinPartitions("key", "h").mapInArrow(run, "key long, h long")


def within_one(a: list[str], b: list[str]) -> bool:
    """True if one unit inserted, deleted or replaced, or none, turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def one_word(words: list[str]) -> tuple[int, list[int]]:
    """The hash of a line, and of the line without each of its words."""
    h = word_hashes(words)
    n = len(h)
    with np.errstate(over="ignore"):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_BASE, n)[:-1], dtype=np.uint64)])
        return int(c[-1]), (c[:-1] + (c[-1] - c[1:]) * np.uint64(_BACK)).tolist()


def _later(lines: list[list[str]]) -> list[int]:
    """Which lines of a group, in corpus order, lie within one word of an earlier one."""
    out = []
    if len(lines) <= PAIRWISE:
        return [j for j in range(1, len(lines)) if any(within_one(lines[i], lines[j]) for i in range(j))]
    whole: dict[int, int] = {}
    less: dict[int, int] = {}
    put: dict[tuple[int, int], int] = {}
    for j, w in enumerate(lines):
        full, gone = one_word(w)
        # the first line of a key is enough: what shares a key differs from it by one word
        near = [whole.get(full), less.get(full)]
        for x in enumerate(gone):
            near += whole.get(x[1]), put.get(x)
        if any(within_one(lines[i], w) for i in dict.fromkeys(near) if i is not None):
            out.append(j)
        whole.setdefault(full, j)
        for x in enumerate(gone):
            less.setdefault(x[1], j)
            put.setdefault(x, j)
    return out


def near_lines(rows: DataFrame) -> DataFrame:
    """``(key, h, doc, ln, line)`` to the ``h`` of lines within one word of an earlier line of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[int] = []
        for g in grouped(batches):
            d = g.to_pydict()
            order = sorted(range(g.num_rows), key=lambda i: (d["doc"][i], d["ln"][i], d["h"][i]))
            lines = [form(d["line"][i], d["key"][0] & 1) for i in order]
            out += [d["h"][order[j]] for j in _later(lines)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["h"])

    return rows.select("key", "h", "doc", "ln", "line").repartition("key").sortWithinPartitions("key").mapInArrow(run, "h long").distinct()


def near_lines_of_hot_keys(rows: DataFrame) -> DataFrame:
    """The same for groups of any size: ``(h, doc, ln, line, level)`` to the ``h`` of lines within one unit of an earlier one.

    Every line emits its one-word variants under 128 bits, of three kinds: 0 without word i, for the lines that have another
    word there; 1 whole; 2 without a word.  Kind 0 meets kind 0, kind 1 meets kind 2.  Only minima per key are needed, which
    are aggregated before the shuffle; the join back has one row per key on one side, so a hot key can be split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                b = whole.slice(lo, 1000)
                at, key, kind = [], [], []
                for i, (line, level) in enumerate(zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)):
                    full, gone = one_word(form(line, level))
                    n = len(gone)
                    at += [i] * (2 * n + 1)
                    kind += [0] * n + [1] + [2] * n
                    key += [(g, 2 * k + 2 + level) for k, g in enumerate(gone)] + [(full, level)] + [(g, level) for g in gone]
                with np.errstate(over="ignore"):
                    base, place = (np.array([k[j] for k in key], dtype=np.uint64) for j in (0, 1))
                    x, y = _mixed(base + place * np.uint64(_BASE)), _mixed(base ^ (place + np.uint64(77)) * np.uint64(_BACK))
                at = np.array(at, dtype=np.int64)
                cols = [pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(kind, pa.int32()), *(b.column(j).take(pa.array(at)) for j in range(3))]
                yield pa.RecordBatch.from_arrays(cols, names=["x", "y", "kind", "h", "doc", "ln"])

    keys = saved(rows.select("h", "doc", "ln", "line", "level").mapInArrow(run, "x long, y long, kind int, h long, doc long, ln int"))
    own = F.struct("doc", "ln", "h")
    first = keys.groupBy("x", "y").agg(*[F.min(F.when(F.col("kind") == k, own)).alias(f"m{k}") for k in range(3)])
    met = keys.join(first, ["x", "y"])
    other = F.when(F.col("kind") == 0, F.col("m0")).when(F.col("kind") == 1, F.col("m2")).otherwise(F.col("m1"))
    return met.filter(other < own).select("h").distinct()


def _doc() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc, gone array<struct<ln, h>>)``: the lines to be removed from the rows of a doc_id, if any."""
    parts = docs.select(_doc().alias("doc"), F.posexplode(F.split(F.col(text), "\n")).alias("ln", "line"))
    lines = saved(parts.filter(F.rlike("line", F.lit(r"[^ \t\r]"))).select("doc", "ln", F.xxhash64("line").alias("h")))
    first = saved(lines.groupBy("h").agg(F.min(F.struct("doc", "ln")).alias("at")).select("h", "at.doc", "at.ln"))
    candidates = saved(shared_keys(half_keys(docs, text)).select("h").distinct())
    wanted = candidates.join(first, "h").groupBy("doc").agg(F.collect_list(F.struct("ln", "h")).alias("w"))
    # the texts of candidate lines, each taken where it occurs first
    texts = docs.select(_doc().alias("doc"), F.split(F.col(text), "\n").alias("all")).join(wanted, "doc")
    found = texts.select("doc", F.explode(F.transform("w", lambda x: F.struct(x["h"].alias("h"), x["ln"].alias("ln"), F.get("all", x["ln"]).alias("line")))).alias("x")).select("doc", "x.*")
    found = saved(found.filter(F.xxhash64("line") == F.col("h")).dropDuplicates(["h"]), candidates)
    shared = saved(shared_keys(line_keys(found)).distinct())
    size = saved(shared.groupBy("key").agg(F.count(F.lit(1)).alias("members")))
    near = near_lines(shared.join(size.filter(F.col("members") <= HOT), "key").join(found, "h"))
    hot = size.filter(F.col("members") > HOT)
    if not hot.isEmpty():
        at = shared.join(hot, "key").select("h", F.col("key").bitwiseAND(F.lit(1)).cast("int").alias("level")).distinct()
        near = near.unionByName(near_lines_of_hot_keys(found.join(at, "h"))).distinct()
    near = saved(near, shared, size, found)
    state = first.join(near.withColumn("near", F.lit(True)), "h", "left").select("h", F.col("doc").alias("_d"), F.col("ln").alias("_l"), F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.join(state, "h").filter(F.col("near") | (F.col("doc") != F.col("_d")) | (F.col("ln") != F.col("_l")))
    return saved(gone.groupBy("doc").agg(F.collect_set(F.struct("ln", "h")).alias("gone")), lines, first, near)


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``lines_total`` and ``lines_removed``."""
    docs = docs.drop("lines_total", "lines_removed")
    gone = judge(docs, text)
    # the row travels as one column, so that its names cannot clash with those used here
    rows = docs.select(_doc().alias("doc"), F.struct(*docs.columns).alias("row")).join(gone, "doc", "left")
    whole = F.col("row")[text]
    lines = F.split(whole, "\n")
    # a doc_id's other row may have another line in the place: the hash tells
    left = F.filter(lines, lambda x, i: ~F.array_contains("gone", F.struct(i.alias("ln"), F.xxhash64(x).alias("h"))))
    rows = rows.select("row", F.when(F.col("gone").isNull(), lines).otherwise(left).alias("left"), F.col("gone").isNull().alias("same"))
    total = F.when(whole.isNull(), 0).otherwise(F.size(lines)).cast("long")
    kept = F.when(whole.isNull(), 0).otherwise(F.size("left")).cast("long")
    out = F.when(F.col("same"), whole).otherwise(F.array_join("left", "\n"))
    return rows.select(*[out.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns], total.alias("lines_total"), (total - kept).alias("lines_removed"))
