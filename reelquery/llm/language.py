"""Language identification of mixed text.

Words are runs of letters (Unicode category L) of one script.  The script (by the ranges below) narrows a word's candidate languages; each candidate scores the word by smoothed
log-frequencies of its hashed character n-grams (2 to 4, word ends marked); a Viterbi pass with a switching
penalty labels the words, and runs of one label are spans.  A text's language is the one with most letters.

Two measures tell how far to trust it, both from 0 to 1.  The score is the share of letters in that language.  The fit says whether
they look like text of it at all: the share of a word's n-grams that are commoner in the language than chance (one in CELLS) would
have it, 0 for a word of a script that the language does not use; the mean over the words with the language's label, by letters.

``fit`` learns from ``text`` and ``lang`` of the rows it is given.  It may use a bounded sample: at most about
``sample`` rows, chosen by a hash of the text; gram counts and script shares are aggregated in the cluster and
the model has a fixed number of cells per language.  ``label`` covers every text whole.

A null or empty text, or one without letters, is ``und`` with score and fit 0 and no spans; so is every text if there was no labelled row to
learn from.  A script that no learned language uses leaves all languages as candidates; its words fit them by collisions of hashes only (up to 0.1 or so).  Ties go to the language that sorts first.
Equal texts get equal labels; an empty table gives no rows; other columns travel along.
"""

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELLS = 1 << 16
PENALTY = 12.0
ALPHA = 0.5
SHARE = 0.01
KEPT_WORDS = 200_000
CHUNK_WORDS = 100_000
#: First code point, last code point, script.
RANGES = [
    (0x0041, 0x024F, "Latn"), (0x0250, 0x02AF, "Latn"), (0x0370, 0x03FF, "Grek"), (0x0400, 0x052F, "Cyrl"), (0x0530, 0x058F, "Armn"), (0x0590, 0x05FF, "Hebr"),
    (0x0600, 0x077F, "Arab"), (0x0900, 0x097F, "Deva"), (0x0980, 0x09FF, "Beng"), (0x0A00, 0x0A7F, "Guru"), (0x0A80, 0x0AFF, "Gujr"), (0x0B80, 0x0BFF, "Taml"),
    (0x0C00, 0x0C7F, "Telu"), (0x0C80, 0x0CFF, "Knda"), (0x0D00, 0x0D7F, "Mlym"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Geor"), (0x1100, 0x11FF, "Hang"),
    (0x1E00, 0x1EFF, "Latn"), (0x1F00, 0x1FFF, "Grek"), (0x3040, 0x309F, "Kana"), (0x30A0, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Hani"), (0xAC00, 0xD7AF, "Hang"),
]
SCRIPTS = [*dict.fromkeys(r[2] for r in RANGES), "other"]
_FIRST = np.array([r[0] for r in RANGES])
_LAST = np.array([r[1] for r in RANGES])
_SCRIPT = np.array([SCRIPTS.index(r[2]) for r in RANGES])
LETTERS = re.compile(r"[^\W\d_]+")


def _numbers(first: int, end: int) -> re.Pattern:
    return re.compile("[" + "".join(c for c in map(chr, range(first, end)) if unicodedata.category(c) in ("Nl", "No")) + "]")


#: What the pattern takes for letters besides: numbers such as one half, superscript two or Roman eight.  Those of plane 1 are
#: apart, as a class that holds any is slow; there are none above.
_ODD, _ODD_ABOVE, _ABOVE = _numbers(0, 0x10000), _numbers(0x10000, 0x20000), re.compile("[\U00010000-\U0010ffff]")
FAR = -1e6
_CHANCE = -np.log(CELLS)


#: A letter beyond the Latin ranges: without one, all words are of one script.
_BEYOND = re.compile(r"[^\W\d_\x00-\u024f]")


def _lettered(text: str) -> str:
    """The text with blanks for numbers that the pattern would take for letters."""
    if text.isascii():
        return text
    if _ODD.search(text):
        text = _ODD.sub(" ", text)
    return _ODD_ABOVE.sub(" ", text) if _ABOVE.search(text) else text


def places_of(text: str) -> Iterator[tuple[int, int]]:
    """Where the words of a text start and end."""
    plain = _lettered(text)
    latin = not _BEYOND.search(plain)
    for m in LETTERS.finditer(plain):
        a, z = m.span()
        if latin or m[0].isascii():
            yield a, z
            continue
        script = scripts_of(np.frombuffer(m[0].encode("utf-32-le"), np.uint32).astype(np.int64))
        cuts = [a, *(a + 1 + np.flatnonzero(script[1:] != script[:-1])).tolist(), z]
        yield from zip(cuts, cuts[1:], strict=False)


def words_of(text: str) -> list[str]:
    plain = _lettered(text)
    if plain.isascii() or not _BEYOND.search(plain):
        return LETTERS.findall(plain)
    return [text[a:z] for a, z in places_of(text)]


def scripts_of(first: np.ndarray) -> np.ndarray:
    """Script numbers of code points."""
    at = np.searchsorted(_FIRST, first, side="right") - 1
    ok = (at >= 0) & (first <= _LAST[np.maximum(at, 0)])
    return np.where(ok, _SCRIPT[np.maximum(at, 0)], len(SCRIPTS) - 1)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all words and the word each belongs to."""
    text = np.frombuffer(("\x01" + "\x01".join(words).lower() + "\x01").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    ends = np.flatnonzero(text == 1)
    word = np.cumsum(text == 1) - 1  # a mark belongs to the word that follows it
    cells, owner = [], []
    with np.errstate(over="ignore"):
        h = text * np.uint64(0x9E3779B97F4A7C15)
        for n in (2, 3, 4):
            h = (h[:-1] * np.uint64(0x100000001B3)) ^ (text[n - 1 :] * np.uint64(0xC2B2AE3D27D4EB4F))
            m = len(text) - n + 1
            if m <= 0:
                break
            at = np.arange(m)
            ok = ends[np.minimum(word[:m] + 1, len(ends) - 1)] >= at + n - 1  # the gram ends by its word's closing mark
            ok &= word[:m] < len(words)
            mixed = h ^ (h >> np.uint64(29))
            cells.append((mixed[ok] % np.uint64(CELLS)).astype(np.int64))
            owner.append(word[:m][ok])
    return np.concatenate(cells), np.concatenate(owner)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # CELLS x languages: log-frequencies
    allowed: np.ndarray  # scripts x languages

    def judge(self, words: list[str]) -> np.ndarray:
        """A row per word: its scores, then its fits, by language."""
        cells, owner = grams_of(words)
        allowed = self.allowed[scripts_of(np.array([ord(w[0]) for w in words]))]
        grams = np.maximum(np.bincount(owner, minlength=len(words)), 1)
        common = [np.bincount(owner, self.table[cells, j] > _CHANCE, minlength=len(words)) / grams for j in range(len(self.langs))]
        return np.hstack([self._scores(words, cells, owner, allowed), np.stack(common, axis=1) * allowed])

    def word_scores(self, words: list[str]) -> np.ndarray:
        return self.judge(words)[:, : len(self.langs)]

    def _scores(self, words: list[str], cells: np.ndarray, owner: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        out = np.stack([np.bincount(owner, self.table[cells, j], minlength=len(words)) for j in range(len(self.langs))], axis=1)
        out -= out.max(axis=1, keepdims=True)
        out = np.maximum(out, -30.0)  # one odd word must not outweigh a sentence
        return np.where(allowed, out, FAR)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample: int = 20_000) -> Model:
    """A model of the languages in ``docs``; rows without text or language are left out, and without any the model has no language."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not per:
        return Model([], np.zeros((CELLS, 0)), np.zeros((len(SCRIPTS), 0), bool))
    langs = sorted(per)
    share = F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, min(1.0, sample / len(langs) / n))])
    chosen = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    n_langs = len(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((n_langs, CELLS + len(SCRIPTS)))
        number = {k: i for i, k in enumerate(langs)}
        for b in batches:
            for t, k in zip(b.column(0), b.column(1), strict=True):
                words = words_of(t.as_py())
                if words:
                    at = cells[number[k.as_py()]]
                    at[:CELLS] += np.bincount(grams_of(words)[0], minlength=CELLS)
                    at[CELLS:] += np.bincount(scripts_of(np.array([ord(w[0]) for w in words])), minlength=len(SCRIPTS))
        j, c = np.nonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(j.astype(np.int32)), pa.array(c.astype(np.int32)), pa.array(cells[j, c])], names=["j", "c", "n"])

    got = chosen.mapInArrow(count, "j int, c int, n double").groupBy("j", "c").agg(F.sum("n").alias("n")).toPandas()  # at most languages x cells
    n = np.zeros((n_langs, CELLS + len(SCRIPTS)))
    n[got["j"], got["c"]] = got["n"]
    grams, scripts = n[:, :CELLS], n[:, CELLS:]
    table = np.log((grams + ALPHA) / (grams.sum(axis=1, keepdims=True) + ALPHA * CELLS)).T
    allowed = (scripts >= SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T
    allowed |= ~allowed.any(axis=1, keepdims=True)
    return Model(langs, np.ascontiguousarray(table), allowed)


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label per word when each change of label costs ``penalty``."""
    n, k = scores.shape
    total = scores.sum(axis=0)
    a = int(np.argmax(total))
    # One label is best throughout if no stretch of words gains more than the penalty by another, as m stretches beside some that keep
    # it take m changes at least.  If none keeps it they take m - 1, and the first and the last must gain more than the penalty.
    gain = np.cumsum(scores - scores[:, a : a + 1], axis=0)
    before = np.vstack([np.zeros(k), gain[:-1]]) if n else gain
    low = np.minimum.accumulate(before, axis=0)
    if not n or ((gain - low).max() <= penalty and gain.max() + (gain[-1] - before).max() <= penalty):
        return np.full(n, a)
    best, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(range(k), key=best.__getitem__)
        leave = best[top] - penalty
        came = [j if best[j] >= leave else top for j in range(k)]
        best = [row[j] + (best[j] if best[j] >= leave else leave) for j in range(k)]
        back.append(came)
    out = [max(range(k), key=best.__getitem__)]
    for came in reversed(back):
        out.append(came[out[-1]])
    return np.array(out[::-1])


class Labeller:
    """Scores and fits of words are kept in a bounded table."""

    def __init__(self, model: Model):
        self.model, self.kept, self.rows = model, {}, np.zeros((KEPT_WORDS + CHUNK_WORDS, 2 * len(model.langs)))

    def scores(self, words: list[str]) -> np.ndarray:
        get = self.kept.get
        new = [w for w in dict.fromkeys(words) if get(w) is None]
        if new:
            if len(self.kept) + len(new) > KEPT_WORDS:
                self.kept.clear()
                new = list(dict.fromkeys(words))
            n = len(self.kept)
            self.kept.update(zip(new, range(n, n + len(new)), strict=True))
            for i in range(0, len(new), 10_000):
                part = new[i : i + 10_000]
                self.rows[n + i : n + i + len(part)] = self.model.judge(part)
        return self.rows[np.fromiter(map(self.kept.__getitem__, words), dtype=np.int64, count=len(words))]

    def text_scores(self, words: list[str]) -> np.ndarray:
        parts = [self.scores(words[i : i + CHUNK_WORDS]) for i in range(0, len(words), CHUNK_WORDS)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def label(self, text: str | None, words: list[str], judged: np.ndarray) -> tuple[str, float, float, list[tuple[int, int, str]]]:
        """Language, share of letters in it, fit, and spans."""
        langs = self.model.langs
        if not words or not langs:
            return "und", 0.0, 0.0, []
        labels = viterbi(judged[:, : len(langs)])
        size = np.fromiter(map(len, words), dtype=np.float64, count=len(words))

        def fit_of(j: int) -> float:
            mine = size * (labels == j)
            return float(np.clip(mine @ judged[:, len(langs) + j] / mine.sum(), 0.0, 1.0))

        if labels[0] == labels[-1] and (labels == labels[0]).all():
            first = text.index(words[0])
            return langs[labels[0]], 1.0, fit_of(labels[0]), [(first, text.rindex(words[-1]) + len(words[-1]), langs[labels[0]])]
        letters = np.bincount(labels, size, minlength=len(langs))
        most = int(np.argmax(letters))
        spans, at = [], -1
        for (a, z), j in zip(places_of(text), labels, strict=True):
            if j == at:
                spans[-1] = (spans[-1][0], z, langs[j])
            else:
                spans.append((a, z, langs[j]))
                at = j
        return langs[most], float(letters[most] / letters.sum()), fit_of(most), spans


def label(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``lang_pred string``, ``lang_score double``, ``lang_fit double`` and ``lang_spans array<struct<start, end, lang>>``.

    Columns of these names are replaced.  No shuffle; the model (of fixed size per language) is broadcast.
    """
    docs = docs.drop("lang_pred", "lang_score", "lang_fit", "lang_spans")
    spans = "array<struct<start: int, end: int, lang: string>>"
    schema = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score"), F.lit(0.0).alias("lang_fit"), F.lit(None).cast(spans).alias("lang_spans")).schema
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Labeller(shared.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, 16):
                b = whole.slice(lo, 16)
                texts = b.column(at).to_pylist()
                words = [words_of(t) if t and known.model.langs else [] for t in texts]
                flat = [w for x in words for w in x]
                scores = known.text_scores(flat) if flat else np.zeros((0, 2 * len(known.model.langs)))
                ends = np.cumsum([0, *map(len, words)])
                got = [known.label(t, w, scores[i:j]) for t, w, i, j in zip(texts, words, ends, ends[1:], strict=False)]
                made = pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in g[3]] for g in got], arrow)
                cols = [*b.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()), made]
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that is not learned from: crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
