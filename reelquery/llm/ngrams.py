"""N-gram Jaccard join by chosen paths.

A text's set holds its runs of five words (words: runs of letters and digits, lower case; a text of one to four words has the
one run it is).  Texts link when the Jaccard similarity of their sets is 0.8 or more.

1. Equal sets form classes; a class counts once from here on.
2. A set becomes ``T`` minimum hashes, whose agreement estimates the similarity.  In each run a tree is grown: at a node each
   coordinate is chosen with probability 1 / (threshold * T), and a class goes to the child of its value at every chosen
   coordinate.  Nodes of one class end there.  Nodes of up to ``SMALL`` classes are compared in one task: classes that agree in
   ``NEAR`` hashes or more are candidates.  More than ``FEW`` are first put around pivots as in step 3, and what is left is compared
   by brute force.
3. A larger node gets a pivot, the commonest values of some of its classes.  Classes that agree with the pivot in ``RETIRE`` hashes
   or more end there; whatever is a candidate with one of them agrees with the pivot in ``STAR`` or more, as disagreements obey the
   triangle inequality.  So all of these make one candidate group, by one edge each, and no candidate is lost.  The rest goes on to
   the children.  A node of near copies ends at once, in work in proportion to its size; any other falls apart.  Where none of the
   classes that made it would end at the pivot, the node has no pivot and all goes on to the children.
4. After ``RUNS`` runs the recall is measured: ``ASKED`` sampled classes are compared with all classes, and the share of those that
   agree in ``LIKELY`` hashes or more and lie in one candidate group is counted.  ``MORE`` runs follow until it reaches ``TARGET``.
5. Candidate groups are verified exactly, on whole sets.  Groups of up to ``BLOCK`` classes are compared pair by pair in one task.
   In larger ones each set becomes its difference from a pivot set; sets so near to it that any two of them must link (the triangle
   inequality again) are counted by sums, and the others are compared with all of the group, in blocks.

Workers return counts and one edge per class, never pairs.  ``n_links`` counts linked documents, copies included; ``class_id`` is the
smallest doc_id reachable by links.

Null texts and texts without words have no set: no links, a class of their own.  Rows with a null doc_id take part and link, but
classes are named by the smallest non-null doc_id (null if there is none).  Repeated rows are copies; different texts under one
doc_id are compared like any others.  Texts are read whole.  Other columns are ignored.  An empty table gives no rows.
"""

import logging
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reelquery.llm.common import components, discard, roots, saved

WORDS, THRESHOLD, T, SMALL, FEW, BLOCK = 5, 0.8, 64, 1024, 256, 1024
#: At a similarity of 0.8, 38 or more of 64 hashes agree but for 1 pair in 20,000.
NEAR, RETIRE = 38, 50
STAR = RETIRE + NEAR - T
LIKELY = 52
RUNS, MORE, ASKED, TARGET = 16, 8, 512, 0.995
#: Classes of a node or group from which its pivot is made; any pivot gives the same results.
PIVOT_OF = 64
KEPT_WORDS = 150_000
WORD = re.compile(r"[^\W_]+")
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, T, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_WORD_HASH: dict[str, int] = {}


def _mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    known = _WORD_HASH
    if len(known) > KEPT_WORDS:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = known[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's runs of n words."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mixed(out))


def sketch(s: np.ndarray) -> np.ndarray:
    """T minimum hashes of a set, 32 bits each."""
    low = np.full(T, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), 4096):
            part = s[at : at + 4096]
            low = np.minimum(low, (part[None, :] * _MUL[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype(np.uint32)


def set_name(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    import xxhash

    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def text_key(text: str = "text") -> Column:
    return F.xxhash64(F.col(text))


def sketches(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, at, name, sketch)``; the name is empty for texts without words, and ``at`` tells the texts of a doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(2)]
            name, sk = pa.array(map(set_name, sets), pa.binary()), pa.array([sketch(s).tobytes() if len(s) else b"" for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), name, sk], names=["doc_id", "at", "name", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(text).alias("at"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, at long, name binary, sketch binary")


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, T)


def _children(node: np.ndarray, sk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(child, row)``: every class at a node sees the same chosen coordinates, and goes to the child of its value at each."""
    with np.errstate(over="ignore"):
        chosen = _mixed(node[:, None] + _MUL[None, :]) < np.uint64(int(2**64 / (THRESHOLD * T)))
        row, coord = np.nonzero(chosen)
        return _mixed(_mixed(node[row] + _MUL[coord]) ^ sk[row, coord].astype(np.uint64)), row


def first_level(classes: DataFrame, runs: range) -> DataFrame:
    """``(id, sketch)`` to the children ``(node, id)`` of the runs' roots."""
    with np.errstate(over="ignore"):
        root = _mixed(np.arange(runs.start + 1, runs.stop + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                b = whole.slice(lo, 2048)
                ids, sk = b.column(0).to_numpy(), _matrix(b.column(1))
                for r in root:
                    child, row = _children(np.full(len(ids), r), sk)
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row])], names=["node", "id"])

    return classes.select("id", "sketch").mapInArrow(run, "node long, id long")


def _pivot(some: np.ndarray) -> np.ndarray | None:
    """Per coordinate the commonest value among some sketches; none if none of them agrees with it in RETIRE hashes."""
    same = (some[:, None, :] == some[None, :, :]).sum(axis=1)
    pivot = some[same.argmax(axis=0), np.arange(T)]
    return pivot if ((some == pivot).sum(axis=1) >= RETIRE).any() else None


def pivots(large: DataFrame) -> DataFrame:
    """``(node, id, sketch)`` to ``(node, pivot)``, made from some classes of the node; null where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for some in b.column(1).to_pylist():
                pivot = _pivot(np.frombuffer(b"".join(some), np.uint32).reshape(-1, T))
                out.append(None if pivot is None else pivot.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["node", "pivot"])

    some = large.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("id", F.lit(5)), "id"))).filter(F.col("_r") <= PIVOT_OF)
    return some.groupBy("node").agg(F.collect_list("sketch").alias("some")).mapInArrow(run, "node long, pivot binary")


def around(large: DataFrame) -> DataFrame:
    """``(node, id, sketch, pivot)`` to ``(kind, node, id)``: 1 for what ends here, 0 for what may be a candidate of such, and 2 for
    children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            node, ids = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            sk = _matrix(b.column(2))
            agree = np.zeros(len(ids), np.int64)
            there = b.column(3).is_valid().to_numpy(zero_copy_only=False)
            agree[there] = (sk[there] == _matrix(b.column(3).drop_null())).sum(axis=1)
            near, on = np.flatnonzero(agree >= STAR), np.flatnonzero(agree < RETIRE)
            child, row = _children(node[on], sk[on])
            kind = np.concatenate([(agree[near] >= RETIRE).astype(np.int32), np.full(len(row), 2, np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([node[near], child]).view(np.int64)), pa.array(np.concatenate([ids[near], ids[on][row]]))], names=["kind", "node", "id"])

    return large.select("node", "id", "sketch", "pivot").mapInArrow(run, "kind int, node long, id long")


def candidates(classes: DataFrame, runs: range) -> DataFrame:
    """``(a, b)``: edges whose components are the candidate groups that the runs find among ``(id, sketch)``."""
    step = saved(first_level(classes, runs))
    level, out = step, []
    while True:
        sizes = level.groupBy("node").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
        sized = saved(level.join(sizes, "node"), step)
        out.append(saved(candidate_edges(sized.filter(F.col("members") <= SMALL).join(classes, "id"))))
        large = sized.filter(F.col("members") > SMALL)
        if large.isEmpty():
            discard(sized)
            break
        large = saved(large.select("node", "id").join(classes, "id"), sized)
        step = saved(around(large.join(pivots(large), "node")), large)
        star = step.filter("kind < 2")
        root = star.groupBy("node").agg(F.min("id").alias("b"), F.max("kind").alias("k")).filter("k = 1").drop("k")
        out.append(saved(star.join(root, "node").select(F.col("id").alias("a"), "b")))
        level = step.filter("kind = 2").drop("kind")
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return saved(edges.distinct(), *out)


def measured(classes: DataFrame, groups: DataFrame) -> tuple[int, int]:
    """Of the pairs of ASKED classes with any class that agree in LIKELY hashes: how many there are, and how many lie in one group."""
    rows = classes.join(groups, "id", "left").select("id", "sketch", F.coalesce("component", "id").alias("component"))
    asked = rows.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(ASKED).toArrow().combine_chunks()
    if not asked.num_rows:
        return 0, 0
    shared = classes.sparkSession.sparkContext.broadcast((asked["id"].to_numpy(), _matrix(asked["sketch"]), asked["component"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, of, group = shared.value
        there = found = 0
        for b in batches:
            ids, sk, comp = b.column(0).to_numpy(), _matrix(b.column(1)), b.column(2).to_numpy()
            for lo in range(0, len(ids), 256):
                agree = np.zeros((len(own), len(ids[lo : lo + 256])), np.uint8)
                for j in range(T):
                    agree += of[:, j][:, None] == sk[lo : lo + 256, j][None, :]
                x, y = np.nonzero(agree >= LIKELY)
                x, y = x[own[x] != ids[lo + y]], y[own[x] != ids[lo + y]]
                there += len(x)
                found += int((group[x] == comp[lo + y]).sum())
        yield pa.RecordBatch.from_arrays([pa.array([there]), pa.array([found])], names=["there", "found"])

    got = rows.mapInArrow(run, "there long, found long").agg(F.sum("there"), F.sum("found")).first()
    return got[0] or 0, got[1] or 0


def candidate_groups(classes: DataFrame) -> DataFrame:
    """``(id, component)`` of ``(id, sketch)``, by as many runs as the target recall takes."""
    edges, runs = candidates(classes, range(RUNS)), RUNS
    while True:
        groups = components(edges)
        there, found = measured(classes, groups)
        logging.getLogger(__name__).info("%d runs, recall %d of %d sampled pairs", runs, found, there)
        if found >= TARGET * there:
            discard(edges)
            return groups
        more = candidates(classes, range(runs, runs + MORE))
        edges, runs = saved(edges.unionByName(more).distinct(), edges, more), runs + MORE


def grouped(batches: Iterator[pa.RecordBatch], key: int = 0) -> Iterator[pa.Table]:
    """The groups of rows sorted by an integer key column, one at a time; only one group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if held and k[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
            last = k[a]
    if held:
        yield pa.Table.from_batches(held)


def _stars(ids: np.ndarray, sk: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Edges ``(a, b)`` around pivots while more than FEW classes are left and some end there, and the positions that are left."""
    left = np.argsort(_mixed(ids.view(np.uint64)), kind="stable")  # the first of them are as good as drawn at random
    a, b = [], []
    while len(left) > FEW and (pivot := _pivot(sk[left[:PIVOT_OF]])) is not None:
        agree = (sk[left] == pivot).sum(axis=1)
        near = ids[left[agree >= STAR]]
        a.append(near)
        b.append(np.full(len(near), near.min()))
        left = left[agree < RETIRE]
    return a, b, left


def candidate_edges(rows: DataFrame) -> DataFrame:
    """``(node, id, sketch)`` to ``(a, b)``: at every node, each class and the smallest it is joined to by estimates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for g in grouped(batches):
            ids, sk = g.column(1).to_numpy(), _matrix(g.column(2))
            if len(ids) > FEW:
                *star, left = _stars(ids, sk)
                a, b, ids, sk = a + star[0], b + star[1], ids[left], sk[left]
            agree = np.zeros((len(ids), len(ids)), np.uint8)
            for j in range(T):
                agree += sk[:, j][:, None] == sk[:, j][None, :]
            x, y = np.nonzero(np.triu(agree >= NEAR, 1))
            if len(x):
                root = roots(ids, x, y)
                a.append(ids[root != ids])
                b.append(root[root != ids])
            if sum(map(len, a)) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    return rows.select("node", "id", "sketch").repartition("node").sortWithinPartitions("node").mapInArrow(run, "a long, b long")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many numbers each pair of sets has in common; of ``left`` with itself if there is no ``right``."""
    sets = left + (right or [])
    n, m = len(left), len(sets)
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(m), size)
    value, col, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)  # a number of one set alone adds to nothing
    place = np.full(len(value), -1)
    place[shared] = np.arange(len(shared))
    col = place[col]
    owner, col = owner[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out = np.zeros((n, n if right is None else m - n), dtype=np.float32)
    step = max(256, 8_000_000 // max(m, 1))  # bounds the matrix held at once to 32 MB
    for lo in range(0, len(shared), step):
        i, j = np.searchsorted(col, [lo, lo + step])
        x = np.zeros((m, min(step, len(shared) - lo)), dtype=np.float32)
        x[owner[i:j], col[i:j] - lo] = 1
        out += x[:n] @ (x if right is None else x[n:]).T
    return out


# With D the size of two sets' symmetric difference, their similarity is (S - D) / (S + D), where S is the sum of their sizes: it is
# 0.8 or more where 9 D <= S.
def _linked(both: np.ndarray, odd_a, size_a, odd_b, size_b) -> np.ndarray:
    """Of sets given by their differences from one pivot, ``odd`` numbers each, of which ``both`` are common."""
    return 9 * (odd_a[:, None] + odd_b[None, :] - 2 * both.astype(np.int64)) <= size_a[:, None] + size_b[None, :]


LINKED = "id long, links long, root long"


def _found(ids: np.ndarray, links: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    root, some = roots(ids, x, y), links > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["id", "links", "root"])


def verify(rows: DataFrame) -> DataFrame:
    """``(component, id, copies, grams)`` of small groups to ``(id, links, root)``: linked documents, and the smallest class joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches):
            ids, copies = (g.column(i).to_numpy() for i in (1, 2))
            sets = [np.frombuffer(x, np.uint64) for x in g.column(3).to_pylist()]
            size = np.array([len(s) for s in sets])
            x, y = np.nonzero(np.triu(_linked(shared_counts(sets), size, size, size, size), 1))
            yield _found(ids, np.bincount(x, copies[y], minlength=len(ids)) + np.bincount(y, copies[x], minlength=len(ids)), x, y)

    return rows.select("component", "id", "copies", "grams").repartition("component").sortWithinPartitions("component").mapInArrow(run, LINKED)


def differences(rows: DataFrame) -> DataFrame:
    """``(component, id, copies, grams)`` to ``(component, id, copies, size, slack, odd)``: ``odd`` is the set's difference from the
    group's pivot, the numbers that most of some members hold, and ``slack`` 9 times its size less the set's size.

    Two sets whose slacks add up to 0 or less must link.
    """

    def middle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for some in b.column(1):
                value, count = np.unique(np.frombuffer(b"".join(some.as_py()), np.uint64), return_counts=True)
                out.append(value[2 * count > len(some)].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["component", "pivot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            odd, size = [], []
            for s, p in zip(b.column(3), b.column(4), strict=True):
                s, p = (np.frombuffer(x.as_py(), np.uint64) for x in (s, p))
                odd.append(np.setxor1d(s, p, assume_unique=True))
                size.append(len(s))
            size = np.array(size, dtype=np.int64)
            slack = 9 * np.array([len(x) for x in odd], dtype=np.int64) - size
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(size), pa.array(slack), pa.array([x.tobytes() for x in odd], pa.binary())], names=["component", "id", "copies", "size", "slack", "odd"])

    some = rows.withColumn("_r", F.row_number().over(Window.partitionBy("component").orderBy(F.xxhash64("id", F.lit(6)), "id"))).filter(F.col("_r") <= PIVOT_OF)
    pivot = some.groupBy("component").agg(F.collect_list("grams").alias("some")).mapInArrow(middle, "component long, pivot binary")
    joined = rows.join(pivot, "component").select("component", "id", "copies", "grams", "pivot")
    return joined.mapInArrow(run, "component long, id long, copies long, size long, slack long, odd binary")


def verify_large(rows: DataFrame) -> DataFrame:
    """The same as ``verify`` for groups of any size."""
    rows = saved(differences(rows))
    inner = rows.filter("slack <= 0")
    total = inner.groupBy("component").agg(F.sum("copies").alias("all"), F.min("id").alias("root"))
    certain = inner.join(total, "component").select("id", (F.col("all") - F.col("copies")).alias("links"), "root").filter("links > 0")
    # the others meet all of the group: as the left side in blocks of their own, with the right side cut into blocks
    counts = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("slack") > 0, 1)).alias("m")).filter("m > 0")
    parts = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("long")
    blocks = counts.select("component", parts("m").alias("left_blocks"), parts("n").alias("right_blocks"))
    both = rows.join(blocks, "component")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(c))
    columns = [F.lit(0).alias("side"), "id", "copies", "size", "slack", "odd"]
    left = both.filter("slack > 0").select("component", own("left_blocks", 3).alias("i"), every("right_blocks").alias("j"), *columns)
    right = both.select("component", every("left_blocks").alias("i"), own("right_blocks", 4).alias("j"), F.lit(1).alias("side"), *columns[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in grouped(batches):
            side, ids, copies, size, slack = (g.column(i).to_numpy() for i in range(1, 6))
            odd = [np.frombuffer(x, np.uint64) for x in g.column(6).to_pylist()]
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if not len(a) or not len(b):
                continue
            n = np.array([len(x) for x in odd])
            ok = _linked(shared_counts([odd[i] for i in a], [odd[i] for i in b]), n[a], size[a], n[b], size[b])
            ok &= ids[a][:, None] != ids[b][None, :]
            x, y = np.nonzero(ok)
            x, y = a[x], b[y]
            # of two sets on the left, each counts where it is on the left
            back = slack[y] <= 0
            links = np.bincount(x, copies[y], minlength=len(ids)) + np.bincount(y[back], copies[x][back], minlength=len(ids))
            _, one = np.unique(ids, return_inverse=True)
            first = np.unique(one, return_index=True)[1]
            root = roots(ids[first], one[x], one[y])[one]
            some = links > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(root[some])], names=["id", "links", "root"])

    cells = left.unionByName(right).select(F.xxhash64("component", "i", "j").alias("cell"), *columns[1:], "side").select("cell", "side", "id", "copies", "size", "slack", "odd")
    compared = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, LINKED)
    return saved(certain.unionByName(compared), rows)


def fetch_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``grams`` to ``wanted`` (id, name, doc, at, ...): the whole set, from the text of one document of the class."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key(text).alias("at"), F.col(text).alias("_text"))
    rows = texts.join(wanted, ["doc", "at"])
    schema = wanted.select("*", F.lit(None).cast("binary").alias("grams")).schema
    names = wanted.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column("_text")]
            keep = pa.array([set_name(s) == n for s, n in zip(sets, b.column("name").to_pylist(), strict=True)], pa.bool_())
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([s.tobytes() for s in sets], pa.binary())], names=[f.name for f in schema])
            yield out.filter(keep)

    return rows.mapInArrow(run, schema).dropDuplicates(["id"])


NO_ID = -(2**63)


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, at, component, class_id, links, copies)``; all but the first two null without words."""
    rows = saved(sketches(docs, text))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "at")
    same = rows.filter("length(name) > 0").groupBy("name").agg(F.min(place).alias("p"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"))
    same = saved(same.select(F.monotonically_increasing_id().alias("id"), "name", "p.doc", "p.at", "low", "copies", "sketch"))
    groups = candidate_groups(same.select("id", "sketch"))
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    wanted = groups.join(sizes, "component").join(same.drop("sketch", "low"), "id")
    sets = saved(fetch_sets(docs, wanted, text))
    checked = verify(sets.filter(F.col("members") <= BLOCK))
    large = sets.filter(F.col("members") > BLOCK)
    if not large.isEmpty():
        checked = checked.unionByName(verify_large(large))
    checked = saved(checked, sets)
    linked = checked.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(checked.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("component", "part")
    known = same.join(linked, "id", "left").join(parts, "id", "left").select("name", F.coalesce("part", "id").alias("component"), "low", F.coalesce("links", F.lit(0).cast("long")).alias("links"), "copies")
    lowest = known.groupBy("component").agg(F.min("low").alias("class_id"))
    known = saved(known.drop("low").join(lowest, "component"), checked, parts, groups, same)
    return rows.select("doc_id", "at", "name").join(known, "name", "left").drop("name")


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(doc_id, class_id, n_links, n_copies, kept)``, one row per row of ``docs`` (columns doc_id and ``text``)."""
    own = F.coalesce("class_id", "doc_id")
    return judged(docs, text).select(
        "doc_id",
        own.alias("class_id"),
        F.coalesce(F.col("copies") - 1 + F.col("links"), F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("n_copies"),
        F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that remain when one document of each group stays: the one with the smallest doc_id.

    Of equal rows that share an id one stays.  Rows without an id, or with a text without words, all stay.
    """
    found = saved(judged(docs, text).filter("component is not null and doc_id is not null"))
    first = found.groupBy("component").agg(F.min(F.struct("doc_id", "at")).alias("w"))
    gone = found.join(first, "component").filter((F.col("doc_id") != F.col("w.doc_id")) | (F.col("at") != F.col("w.at"))).select(F.col("doc_id").alias("doc"), "at")
    twice = saved(first.join(found, "component").filter((F.col("doc_id") == F.col("w.doc_id")) & (F.col("at") == F.col("w.at"))).groupBy(F.col("doc_id").alias("doc"), "at").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    # the row travels as one column, so that its names cannot clash with those used here
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc"), text_key(text).alias("at"))
    left = rows.join(gone.distinct(), ["doc", "at"], "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, ["doc", "at"], "left_anti").unionByName(left.join(twice, ["doc", "at"], "left_semi").dropDuplicates(["doc", "at"]))
    return left.select(*[F.col("row")[c].alias(c) for c in docs.columns])
