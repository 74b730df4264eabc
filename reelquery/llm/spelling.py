"""Spelling variants: words within one edit, and the common form each leads to.

1. ``vocabulary``: the words of all texts with their counts, summed in each task before the shuffle.
2. A word of L letters has L - 2 positional 3-grams.  One edit touches at most 3 of them, so two words within one edit share
   at least ``longer - 5`` grams at places that differ by 0 (replaced) or by 0 or 1 (inserted).  Of the grams that an edit
   leaves alone, the rarest is among the 4 rarest of either word (3 at most can come before it), so only these
   4 are indexed: ``entries``.
3. The inverted index is spread by (gram, place, length): there a word is posted, and asked for by words of its length or one less that
   have the gram there or one place before.  Lists longer than ``BLOCK`` are cut into blocks that meet on a grid.
4. In a list, ``merged`` brings the postings of all grams of the asking words together under these limits, keeps the pairs that come
   up often enough, and ``one_edit`` verifies them.  The merge is a sort of many words' postings at once: one heap a
   word, in Python, took more than ten times as long.

Only verified pairs leave a task.  Counts of grams are over the whole vocabulary; their table has a row for each of 90 ** 3 grams at
most.  A list of n words that all share the rare grams still takes work for each block of n * n / BLOCK ** 2, in constant memory.

Null and empty texts have no words.  Texts and words of any length are read whole.  Repeated rows count again; a null id counts as the
empty string in the key of ``noisy``.  Ties in count go to the word that is first in code-point order.  An empty table gives no
rows.  Other columns are not looked at.
"""

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelquery.llm.common import saved

LEAST, MANY, TIMES, NOISE = 7, 2, 10, 31
Q, TOUCHED = 3, 3
BLOCK, HELD, GROUP, HITS = 2048, 400_000, 20_000, 2_000_000
#: Letters: a-z and U+00C0 to U+00FF; A-Z become a-z.  Texts are handled as Latin-1, one byte a code point; all other code points part words.
LETTERS = bytes([*range(97, 123), *range(0xC0, 0x100)])
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in LETTERS else 32 for b in range(256))
_CODE = np.zeros(256, np.int64)
_CODE[list(LETTERS)] = np.arange(len(LETTERS))
GRAMS = len(LETTERS) ** Q


def runs_of(text: str) -> list[bytes]:
    return text.encode("latin-1", "replace").translate(_TABLE).split()


def noisy(run: bytes, start: int) -> bytes:
    """The run, or for one in ``NOISE`` the run without one letter, by the CRC-32 of its key; ``start`` is that of the key's first part."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % NOISE:
        return run
    cut = h % len(run)
    return run[:cut] + run[cut + 1 :]


def vocabulary(docs: DataFrame, noise: bool = False, least: int = LEAST, many: int = MANY) -> DataFrame:
    """``(word, n)``: words of ``least`` letters or more that occur ``many`` times.  ``noise`` plants deletions (``noisy``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                if not text.is_valid:
                    continue
                found = Counter([w for w in runs_of(text.as_py()) if len(w) >= least])
                if noise:
                    start = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
                    for w, n in found.items():
                        held[noisy(w, start)] += n
                else:
                    held.update(found)
                if len(held) > HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    words = docs.select("doc_id", "text").mapInArrow(count, "word string, n long")
    return words.filter(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= many)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All letters of a column of Latin-1 words as numbers, where each word starts, and its length."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    text = column.buffers()[2]
    return _CODE[np.frombuffer(text, np.uint8)] if text is not None else np.zeros(0, np.int64), ends[:-1], np.diff(ends)


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ``lengths`` places a row: the row of each place, and its number in the row."""
    row = np.repeat(np.arange(len(lengths)), lengths)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def grams(letters: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, place, gram)`` of all grams, the gram as a number below ``GRAMS``."""
    row, place = spread(np.maximum(length - Q + 1, 0))
    at = start[row] + place
    return row, place, (letters[at] * len(LETTERS) + letters[at + 1]) * len(LETTERS) + letters[at + 2]


def latin(words: DataFrame) -> DataFrame:
    return words.select(F.encode("word", "ISO-8859-1").alias("word"), "n")


def gram_ranks(words: DataFrame) -> np.ndarray:
    """The place of each gram in the order from rare to frequent in the vocabulary: an array of fixed size, counted in the cluster."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GRAMS, np.int64)
        for b in batches:
            n += np.bincount(grams(*flat(b.column(0)))[2], minlength=GRAMS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["gram", "n"])

    n = np.zeros(GRAMS, np.int64)
    for r in latin(words).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():  # GRAMS rows at most
        n[r["gram"]] = r["n"]
    out = np.empty(GRAMS, np.int64)
    out[np.argsort(n, kind="stable")] = np.arange(GRAMS)
    return out


def _list_of(gram: np.ndarray, place: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The number of the list of (gram, place, length); should two lists get one number, verification parts their words."""
    return ((gram * 1_000_003 + place) * 1_000_003 + length) & ((1 << 62) - 1)


def entries(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``(list, role, word, n)``, words in Latin-1: role 0 posts a word and asks for words of its length, role 1 asks for longer ones by one."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for b in batches:
            letters, start, length = flat(b.column(0))
            row, place, gram = grams(letters, start, length)
            by = np.argsort(row * GRAMS + rank[gram], kind="stable")  # equal grams stay in the order of their places
            row, place, gram = row[by], place[by], gram[by]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            few, fewer = nth <= TOUCHED, nth < TOUCHED  # the shorter of two words has one gram less that an edit touches
            long = length[row] + 1
            lists = np.concatenate([_list_of(gram[few], place[few], length[row][few]), _list_of(gram[fewer], place[fewer], long[fewer]), _list_of(gram[fewer], place[fewer] + 1, long[fewer])])
            of = pa.array(np.concatenate([row[few], row[fewer], row[fewer]]))
            role = np.repeat(np.array([0, 1], np.int8), [few.sum(), 2 * fewer.sum()])
            yield pa.RecordBatch.from_arrays([pa.array(lists), pa.array(role), b.column(0).take(of), b.column(1).take(of)], names=["list", "role", "word", "n"])

    return latin(words).mapInArrow(run, "list long, role byte, word binary, n long")


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for p in parts:
        out = (out ^ p.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out


def merged(block: np.ndarray, posts: np.ndarray, longer: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray], sign: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (asking, posted) of one block whose words share enough grams at the same place, or one further on for ``longer`` words.

    The postings of an asking word's grams are brought together and put in order, which is the merge; runs of one pair count its grams.
    """
    row, place, gram = grams(*words)
    key = _mixed(block[row], gram, place)
    own = posts[row]
    order = np.argsort(key[own])
    index, posted = key[own][order], row[own][order]
    more = longer[row] == 1
    asks, key = np.concatenate([row, row[more]]), np.concatenate([key, _mixed(block[row[more]], gram[more], place[more] + 1)])
    first = np.searchsorted(index, key, "left")
    count = np.searchsorted(index, key, "right") - first
    some = np.flatnonzero(count)
    some = some[np.argsort(asks[some], kind="stable")]
    asks, first, count = asks[some], first[some], count[some]
    bound = np.maximum(1, words[2] - (Q - 1) - TOUCHED)
    done = np.cumsum(count)
    lo = 0
    while lo < len(asks):
        # all postings of some words at a time
        hi = int(np.searchsorted(done, (done[lo - 1] if lo else 0) + HITS, "right"))
        hi = int(np.searchsorted(asks, asks[max(hi - 1, lo)], "right"))
        which, nth = spread(count[lo:hi])
        x, y = asks[lo:hi][which], posted[first[lo:hi][which] + nth]
        # of two words of one length one asks
        fit = (words[2][y] == words[2][x] + longer[x]) & ((longer[x] == 1) | (sign[x] <= sign[y]))
        pair = np.sort(x[fit] * len(block) + y[fit])
        runs = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        x, y = np.divmod(pair[runs], len(block))
        enough = np.diff(np.append(runs, len(pair))) >= bound[y]
        yield x[enough], y[enough]
        lo = hi


def one_edit(x: np.ndarray, y: np.ndarray, words: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """Whether one replaced letter (equal lengths), or one more letter in y, makes word y of word x."""
    letters, start, length = words
    if not len(x):
        return np.zeros(0, bool)
    of, i = spread(length[x])
    a, at = letters[start[x][of] + i], start[y][of] + i
    longer = length[y] > length[x]
    here = a == letters[at]
    there = a == letters[np.where(longer[of], at + 1, at)]
    begin = np.cumsum(length[x]) - length[x]
    wrong = np.add.reduceat((~here).astype(np.int64), begin)
    # an inserted letter: all before it are equal in place, all after it one further on
    until = np.minimum.reduceat(np.where(here, length[x][of], i), begin)
    since = np.maximum.reduceat(np.where(there, -1, i), begin)
    return np.where(longer, since < until, wrong == 1)


def near_pairs(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)``, each pair both ways round, of the words ``(word, n)`` that differ by one edit."""
    rows = entries(words, gram_ranks(words))
    sizes = rows.groupBy("list").agg(F.count_if(F.col("role") == 0).alias("_posts"), F.count(F.lit(1)).alias("_asks"))
    # only long lists need a row of their own here
    long = sizes.filter((F.col("_posts") > BLOCK) | (F.col("_asks") > BLOCK)).select("list", F.ceil(F.col("_posts") / BLOCK).cast("int").alias("_i"), F.ceil(F.col("_asks") / BLOCK).cast("int").alias("_j"))
    long = saved(long.filter("_i > 0"))
    blocks = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    own = lambda c: F.array(F.pmod(F.xxhash64("word"), F.col(c)).cast("int"))
    met = rows.join(long, "list", "left")
    # in a long list a word asks every block of posts, in its own block of askers, and is posted once for every block of askers
    places = F.transform(blocks("_i"), lambda i: F.struct(i.alias("i"), own("_j")[0].alias("j"), F.lit(False).alias("posts"), F.lit(True).alias("asks")))
    posts = F.transform(blocks("_j"), lambda j: F.struct(own("_i")[0].alias("i"), j.alias("j"), F.lit(True).alias("posts"), F.lit(False).alias("asks")))
    short = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), (F.col("role") == 0).alias("posts"), F.lit(True).alias("asks")))
    at = F.when(F.col("_i").isNull(), short).when(F.col("role") == 0, F.concat(places, posts)).otherwise(places)
    spread_out = met.withColumn("_at", F.explode(at)).select(F.xxhash64("list", "_at.i", "_at.j").alias("block"), "role", "word", "n", "_at.posts", "_at.asks")
    groups = F.lit(max(1, words.count() * (3 * TOUCHED + 1) // GROUP))

    def run(group: pa.Table) -> pa.Table:
        t = group.combine_chunks()
        block, role, posts, asks, n = (t.column(c).to_numpy() for c in ("block", "role", "posts", "asks", "n"))
        # lists without a post, or with one word only, have no pairs
        _, of = np.unique(block, return_inverse=True)
        full = (np.bincount(of, posts)[of] > 0) & (np.bincount(of)[of] > 1)
        t, block, role, posts, asks, n = t.filter(pa.array(full)).combine_chunks(), of[full], role[full], posts[full], asks[full], n[full]
        column = t.column("word").chunk(0) if t.num_rows else pa.array([], pa.binary())
        words = flat(column)
        which, i = spread(words[2])
        sign = np.add.reduceat(_mixed(words[0][words[1][which] + i], i), np.cumsum(words[2]) - words[2]) if len(which) else np.zeros(0, np.uint64)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x, y in merged(block, posts, np.where(asks, role, -1), words, sign):
            x, y = x[asks[x]], y[asks[x]]
            ok = one_edit(x, y, words)
            xs.append(x[ok])
            ys.append(y[ok])
        x, y = np.concatenate(xs), np.concatenate(ys)
        alike = np.flatnonzero((sign[x] == sign[y]) & (words[2][x] == words[2][y]))
        once = np.ones(len(x), bool)
        once[alike] = [column[int(x[k])].as_py() < column[int(y[k])].as_py() for k in alike]
        x, y = x[once], y[once]
        return pa.table({"a": column.take(pa.array(x)), "b": column.take(pa.array(y)), "a_n": pa.array(n[x]), "b_n": pa.array(n[y])})

    found = spread_out.withColumn("group", F.pmod(F.col("block"), groups)).groupBy("group").applyInArrow(run, "a binary, b binary, a_n long, b_n long").distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    text = lambda c: F.decode(c, "ISO-8859-1")
    return found.select(F.explode(both).alias("p")).select(text("p.word").alias("word"), text("p.near").alias("near"), "p.near_n")


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of ``(word, n)``.

    The form is the most frequent word within one edit, if it is ``times`` as frequent; the root is where forms lead to.
    """
    words = saved(words)
    near = near_pairs(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    out = words.join(near, "word", "left")
    known = -F.col("best.n") >= F.lit(times) * F.col("n")
    out = saved(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(known, F.col("best.form")).alias("form"), F.when(known, -F.col("best.n")).alias("form_n")), words)
    steps = out.filter("form is not null").select("word", F.col("form").alias("root"))
    # frequencies grow with every step, so chains are short; each round doubles the reach
    most = out.agg(F.max("n")).first()[0] or 1
    reach = 1
    while times**reach < most:
        steps = saved(steps)
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        steps = steps.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"))
        reach *= 2
    return out.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
