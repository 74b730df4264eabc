"""Benchmark decontamination: which documents hold a window of a benchmark item.

A window is ``WORDS`` consecutive words of an item, or the whole item if it has fewer.  Its shingles are its runs of ``SHINGLE`` words
(or the window itself, if it is shorter).  A document holds a window only if it holds all its shingles, so one of them is
enough to look for: the prefix of a set join that asks for all of it.

1. ``windows_of``: distinct windows, and the items of each.
2. One pass over the documents (``passages``).  Words and shingles are hashed in NumPy; a bitmap of the benchmark's shingles, of a
   bounded size, says which may be the benchmark's.  Stretches of shingles too short for any window (length bound) go at once; the words
   of the others leave the task in pieces of some ``PIECE`` words, with how often each shingle was met.
3. Shingles are ordered by how rare they are in all documents; each window keeps its rarest (``prefixes``).
4. ``occurrences``: the pieces' shingles meet the prefixes in an equi-join on the words themselves.  The place of the shingle in the window and of
   the stretch in the text bound where the window can lie (position); there all words are compared.
5. Per document: the union of the intervals, and the items.  Documents with the same windows look up their items once.

A bit set by chance only costs a row in step 4.  Nothing that grows with the corpus reaches the driver; the bitmap has
``BITS`` bits at most, whatever the benchmark's size.

Null and empty texts have no words.  Texts of any length are read whole.  Rows are judged one by one, so repeated ones get equal
results, and null ids stay.  Items without words have no windows; items with equal words are all named; repeated item ids count
once; a null item id is named ``-``.  An empty table of documents gives no rows, an empty benchmark cleans everything.  Other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import saved
from reelquery.llm.merkle import lower_az

WORDS, SHINGLE, PIECE = 10, 5, 64
#: Bytes of text hashed at once, bits of the bitmap, shingles whose counts a task holds.
CHUNK, BITS, HELD = 1 << 20, 1 << 28, 100_000
#: Word bytes are 0-9, a-z and all of a character beyond ASCII; A-Z become a-z.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = np.uint64(0x9E3779B97F4A7C15)
_NEXT = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of some normalised bytes: where they start and end, and a hash of each."""

    def __init__(self, data: bytes, width: int = CHUNK):
        self.data = data
        text = np.frombuffer(data, np.uint8)
        inside = np.concatenate([[False], text != 32, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        self.hash = np.zeros(len(self.start), np.uint64)
        i = 0
        while i < len(self.start):
            # some words at a time, so that eight bytes a byte of text are held for a bounded part
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + width, "right")))
            lo, hi = self.start[i], self.end[j - 1]
            sums = np.concatenate([[np.uint64(0)], np.cumsum((text[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_WORD, hi - lo))])
            value = sums[self.end[i:j] - lo] - sums[self.start[i:j] - lo]
            self.hash[i:j] = value * _powers(_INVERSE, hi - lo + 1)[self.start[i:j] - lo]
            i = j

    def shingles(self, n: int) -> np.ndarray:
        """A hash of each run of n words, mixed so that its high bits are good."""
        count = len(self.hash) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64)
        out = np.full(count, n, np.uint64)
        for k in range(n):
            out = out * _NEXT + self.hash[k : k + count]
            out ^= out >> np.uint64(29)
        return out * _WORD

    def text(self, i: int, j: int) -> str:
        return b" ".join(self.data[self.start[i] : self.end[j - 1]].split()).decode()


def shingle_hash(text: str) -> int:
    """The hash of a shingle given as its words, as a signed number."""
    w = Words(text.encode().translate(_TABLE))
    return int(w.shingles(len(w.hash)).view(np.int64)[0])


def words_in(text: Column) -> Column:
    return F.regexp_extract_all(lower_az(text), F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def windows_of(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(win, words, size)``, distinct windows with a number, and ``(win, item_id)``."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("-")).alias("item_id"), words_in(F.col("text")).alias("w")).filter(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(WORDS))
    at = w.withColumn("size", size).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("size") + 1)))
    each = saved(at.select("item_id", F.array_join(F.slice("w", F.col("i"), F.col("size")), " ").alias("words"), "size"))
    known = saved(each.select("words", "size").distinct().withColumn("win", F.monotonically_increasing_id()))
    return known, saved(each.join(known, ["words", "size"]).select("win", "item_id").distinct(), each)


def shingles_of(windows: DataFrame) -> DataFrame:
    """``(win, words, size, shingle, s, offset, hash)``: the shingles of each window; ``s`` is their length."""

    @F.pandas_udf("long")
    def hashed(v: pd.Series) -> pd.Series:
        return v.map(shingle_hash)

    s = F.least("size", F.lit(SHINGLE))
    rows = windows.withColumn("s", s).withColumn("w", F.split("words", " ")).withColumn("offset", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("s"))))
    rows = rows.select("win", "words", "size", "s", "offset", F.array_join(F.slice("w", F.col("offset") + 1, F.col("s")), " ").alias("shingle"))
    return rows.withColumn("hash", hashed("shingle"))


def bitmap(shingles: DataFrame, bits: int) -> np.ndarray:
    """A bit for each hash by its high bits, set in the cluster; ``bits`` / 64 rows at most reach the driver."""
    place = F.shiftrightunsigned(F.col("hash"), 64 - (bits.bit_length() - 1))
    out = np.zeros(bits // 8, np.uint8)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    got = shingles.select(F.shiftright(place, 6).alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out.view(np.int64)[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64)
    return out


FOUND = "doc_id {id}, n long, hash long, pieces array<struct<s: int, first: int, begin: int, n: int, words: string>>"


def passages(docs: DataFrame, maps: dict[int, tuple[np.ndarray, int]]) -> DataFrame:
    """One row a document: ``n`` words and the ``pieces`` that may hold windows; and rows with a ``hash`` that was met ``n`` times.

    ``maps``: for each shingle length its bitmap and the size of the shortest window that has such shingles.
    """
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    kind = docs.schema["doc_id"].dataType

    def pieces(w: Words, lo: int, hi: int, s: int, found: np.ndarray, least: int) -> list[dict]:
        """Pieces of the words lo to hi of one document; ``found`` says which shingles of them the bitmap knows."""
        edge = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
        out = []
        for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
            if b - a + s - 1 < least:
                continue
            for c in range(a, b, PIECE):
                d = min(c + PIECE, b)
                x, y = max(a, c - WORDS + s), min(b + s - 1, d + WORDS - 1)
                out.append({"s": s, "first": x, "begin": c - x, "n": d - c, "words": w.text(lo + x, lo + y)})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        met: dict[int, int] = {}

        def table(ids: pa.Array, n, hashes: list, found: list) -> pa.RecordBatch:
            kinds = pa.list_(pa.struct([("s", pa.int32()), ("first", pa.int32()), ("begin", pa.int32()), ("n", pa.int32()), ("words", pa.string())]))
            return pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(hashes, pa.int64()), pa.array(found, kinds)], names=["doc_id", "n", "hash", "pieces"])

        def counts(ids: pa.DataType) -> pa.RecordBatch:
            out = table(pa.nulls(len(met), ids), list(met.values()), list(met), [None] * len(met))
            met.clear()
            return out

        def judged(texts: list[bytes]) -> tuple[np.ndarray, list]:
            w = Words(b" ".join(texts).translate(_TABLE))
            ends = np.cumsum([len(t) + 1 for t in texts])
            doc = np.searchsorted(ends, w.start, "right")
            bound = np.searchsorted(doc, np.arange(len(texts) + 1))
            out: list = [[] for _ in texts]
            for s, (bits, least) in known.items():
                h = w.shingles(s)
                if not len(h):
                    continue
                at = h >> np.uint64(64 - (len(bits).bit_length() - 1) - 3)
                hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
                hit &= doc[: len(h)] == doc[s - 1 :]
                places = np.flatnonzero(hit)
                for k, n in zip(*[x.tolist() for x in np.unique(h[places].view(np.int64), return_counts=True)], strict=True):
                    met[k] = met.get(k, 0) + n
                for d in np.unique(doc[places]).tolist():
                    lo, hi = int(bound[d]), int(bound[d + 1])
                    out[d] += pieces(w, lo, hi, s, hit[lo : max(lo, hi - s + 1)], least)
            return np.diff(bound), out

        last = None
        for b in batches:
            last = b.column(0).type
            raw = b.column(1).cast(pa.binary())
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in raw]
            i = 0
            while i < b.num_rows:
                j, total = i, 0
                while j < b.num_rows and (j == i or total + sizes[j] <= CHUNK):
                    total += sizes[j]
                    j += 1
                n, found = judged([x or b"" for x in raw[i:j].to_pylist()])
                yield table(b.column(0)[i:j], n, [None] * (j - i), found)
                if len(met) > HELD:
                    yield counts(last)
                i = j
        if met:
            yield counts(last)

    return docs.select("doc_id", "text").mapInArrow(run, FOUND.format(id=kind.simpleString()))


def prefixes(shingles: DataFrame, met: DataFrame) -> DataFrame:
    """The rarest shingle of each window ``(win, words, size, shingle, s, offset)``; a window of which a shingle was never met is left out."""
    counted = shingles.join(met, "hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = counted.groupBy("win").agg(F.min(F.struct("n", "hash", "shingle", "s", "offset", "words", "size")).alias("p"))
    return best.filter("p.n > 0").select("win", "p.shingle", "p.s", "p.offset", "p.words", "p.size")


def occurrences(found: DataFrame, prefix: DataFrame) -> DataFrame:
    """``(row, win, start, end)`` of each verified window; ``found`` has ``(row, pieces)``."""
    p = found.select("row", F.explode("pieces").alias("p")).select("row", "p.*").withColumn("w", F.split("words", " ")).drop("words")
    p = p.withColumn("i", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)))
    # the words around a shingle that a window with it can cover
    low = F.greatest(F.col("i") + F.col("s") - WORDS, F.lit(0))
    p = p.select("row", (F.col("first") + low).alias("first"), (F.col("i") - low).alias("i"), F.col("s").alias("_s"), F.array_join(F.slice("w", F.col("i") + 1, F.col("s")), " ").alias("shingle"), F.slice("w", low + 1, F.col("i") - low + WORDS).alias("w"))
    met = p.join(prefix, (p["shingle"] == prefix["shingle"]) & (F.col("_s") == F.col("s")))
    at = F.col("i") - F.col("offset")
    met = met.filter((at >= 0) & (at + F.col("size") <= F.size("w")))
    same = met.filter(F.array_join(F.slice("w", at + 1, F.col("size")), " ") == F.col("words"))
    return same.select("row", "win", (F.col("first") + at).alias("start"), (F.col("first") + at + F.col("size")).alias("end")).distinct()


def scan(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document ``(doc_id, n_words, n_hit, items, spans)``: the item ids, as sorted strings, and the word ranges that are theirs; both null if none."""
    windows, members = windows_of(items)
    shingles = saved(shingles_of(windows))
    maps = {}
    for r in shingles.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("least")).collect():  # SHINGLE rows at most
        bits = min(BITS, max(1 << 12, 1 << (16 * r["n"]).bit_length()))
        maps[r["s"]] = (bitmap(shingles.filter(F.col("s") == r["s"]), bits), r["least"])
    found = saved(passages(docs, maps).withColumn("row", F.monotonically_increasing_id()))
    prefix = prefixes(shingles, found.filter("hash is not null").groupBy("hash").agg(F.sum("n").alias("n")))
    hits = saved(occurrences(found.filter(F.size("pieces") > 0), prefix))
    # a span begins where no earlier window reaches
    w = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select("row", "start", "end").distinct().withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    spans = spans.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("row", "_k").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("row").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    own = hits.groupBy("row").agg(F.array_sort(F.collect_set("win")).alias("wins"))
    sets = own.select("wins").distinct()
    named = sets.withColumn("win", F.explode("wins")).join(members, "win").groupBy("wins").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = found.filter("hash is null").select("row", "doc_id", F.col("n").alias("n_words"))
    out = out.join(spans.join(own.join(named, "wins").select("row", "items"), "row"), "row", "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "items", "spans")


def digests(scanned: DataFrame) -> DataFrame:
    items = F.coalesce("items", F.array().cast("array<string>"))
    return scanned.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
