"""Operator 7 against a loop, and the pipeline's stages against brute force."""

import hashlib
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from reelquery.llm import language, lines, mixing, ngrams
from reelquery.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_lines import brute as line_brute

SF = "/root/testdata/sf0.001"


def fill(budget, children):
    """Divides by weight; what a child cannot take goes to its siblings."""
    out, open_ = {}, dict(children)
    while open_:
        level = budget / sum(w for w, _ in open_.values())
        short = [k for k, (w, c) in open_.items() if c < level * w]
        if not short:
            return out | {k: min(c, int(level * w)) for k, (w, c) in open_.items()}
        for k in short:
            out[k] = open_.pop(k)[1]
            budget -= out[k]
    return out


WEIGHT = {"domain": {"d0": 4, "d1": 3, "d2": 2}, "lang": {"en": 4}, "source": {}}


def expected(rows, fraction, epochs, seed, weight=WEIGHT):
    docs, off = [], 0
    for i, text, lang, source in rows:
        n = len(text.split()) if text else 0
        digits = "".join(c for c in source or "" if c.isdigit())
        leaf = (f"d{int(digits) % 4}" if digits else "other", lang or mixing.NONE, source or mixing.NONE)
        if n and all(weight[level].get(name, 1) for level, name in zip(mixing.LEVELS, leaf, strict=True)):
            docs.append((leaf, i, text, n))
        else:
            off += n
    cap = defaultdict(int)
    for leaf, _, _, n in docs:
        for k in range(4):
            cap[leaf[:k]] += n * epochs
    budget = {(): (off + sum(d[3] for d in docs)) * fraction[0] // fraction[1]}
    for k, level in enumerate(mixing.LEVELS):
        for parent in [p for p in budget if len(p) == k]:
            kids = {p[k]: (weight[level].get(p[k], 1), c) for p, c in cap.items() if len(p) == k + 1 and p[:k] == parent}
            budget |= {(*parent, name): b for name, b in fill(budget[parent], kids).items()}
    out = []
    for leaf in {d[0] for d in docs}:
        order = sorted((e, hashlib.md5(f"{seed}:{e}:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, n) for x, i, t, n in docs if x == leaf for e in range(epochs))
        start, key, at = 0, None, 0
        for e, k, i, n in order:
            if (e, k) != key:
                key, at = (e, k), start
            if at < budget[leaf]:
                out.append((i, e, n))
            start += n
    return sorted(out, key=str)


def test_op7_loop(spark):
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "a b c", None, None), (9001, None, "en", "src1"), (9002, "", "en", "src1"), (9003, "x y", "xx", "web"), (9003, "x y", "xx", "web"), (9004, "w " * 50_000, "yy", "src3")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, lang string, source string, key string")
    for fraction, epochs in (((1, 2), 1), ((1, 2), 2), ((3, 2), 3)):
        got = mixing.mix(df, fraction, epochs, 7).select("doc_id", "epoch", "mix_tokens").collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(rows, fraction, epochs, 7)
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "weight",
    [
        {"domain": {"d1": 0, "other": 0}, "lang": {"en": 4}, "source": {}},
        {"domain": {"d0": 2}, "lang": {"en": 0, mixing.NONE: 0}, "source": {"src1": 0, "src7": 3}},
        {"domain": {"d0": 4}, "lang": {x: 0 for x in ("en", "xx", "yy")}, "source": {f"src{i}": 0 for i in range(0, 20, 2)}},
        {"domain": {x: 0 for x in ("d0", "d1", "d2", "d3", "other")}, "lang": {}, "source": {}},
    ],
)
def test_op7_weights_of_zero(spark, weight):
    rows = [(i, "w " * (1 + i % 37) + str(i), ["en", "xx", "yy", None][i % 4], f"src{i % 19}" if i % 11 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")

    def weights(level, name):
        out = F.lit(1)
        for k, v in weight[level].items():
            out = F.when(name == k, v).otherwise(out)
        return out.cast("long")

    for fraction in ((1, 2), (1, 20), (9, 10)):
        got = mixing.mix(df, fraction, 2, 7, weights).select("doc_id", "epoch", "mix_tokens").collect()
        assert sorted((tuple(r) for r in got), key=str) == expected(rows, fraction, 2, 7, weight)


@pytest.mark.parametrize("wrong", [None, -1])
def test_op7_weights_that_are_errors(spark, wrong):
    df = spark.createDataFrame([(1, "a b", "en", "src1")], "doc_id long, text string, lang string, source string")
    with pytest.raises((PySparkException, Py4JJavaError), match="must be 0 or more"):  # the latter if several stages fail at once
        mixing.mix(df, weights=lambda level, name: F.lit(wrong).cast("long") if level == "lang" else F.lit(1).cast("long")).collect()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.by_language(spark, docs, SF).cache()
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    gone = letters - {r["doc_id"] for r in kept.collect()}
    assert kept.columns == corpus_pipeline.COLUMNS and len(gone) <= 0.01 * len(letters)
    cut = corpus_pipeline.by_lines(spark, kept, SF).cache()
    assert cut.filter("n_chars <> length(text)").isEmpty()
    assert lines.dedup(cut).agg(F.sum("lines_removed")).first()[0] == 0
    first = corpus_pipeline.by_ngrams(spark, docs, SF).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    ids = [r[0] for r in rows]
    comp = brute.smallest_reachable(ids, brute.jaccard_links([r[1] for r in rows]))
    assert sorted(r["doc_id"] for r in first) == sorted(set(comp))
    assert ngrams.near_duplicates(corpus_pipeline.by_ngrams(spark, docs, SF)).filter("n_links > 0").isEmpty()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter(~F.col("round_trip")).isEmpty()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0


def plain_label(model, text):
    """The language of a text, its share of the letters and its fit, word by word and by the full dynamic programme."""
    words = language.words_of(text or "")
    if not words:
        return "und", 0.0, 0.0
    best, back = None, []
    for w in words:
        s = model.word_scores([w])[0]
        if best is None:
            best = s
            continue
        leave = best.max() - language.PENALTY
        back.append([j if best[j] >= leave else int(best.argmax()) for j in range(len(s))])
        best = s + np.maximum(best, leave)
    at = [int(best.argmax())]
    for came in reversed(back):
        at.append(came[at[-1]])
    letters = np.bincount(at[::-1], [len(w) for w in words], minlength=len(model.langs))
    most = int(letters.argmax())
    fits = {}
    for w in {w for w, j in zip(words, at[::-1], strict=True) if j == most}:
        cells, allowed = language.grams_of([w])[0], model.allowed[language.scripts_of(np.array([ord(w[0])]))][0, most]
        fits[w] = allowed * sum(model.table[c, most] > -np.log(language.CELLS) for c in cells) / len(cells)
    fit = sum(len(w) * fits[w] for w, j in zip(words, at[::-1], strict=True) if j == most) / letters[most]
    return model.langs[most], letters.max() / letters.sum(), fit


def test_op4_whole_table_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs.filter(~language.held_out()).select("text", "lang"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = QUERIES["op4_language"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, share, fit = plain_label(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["share"] - share) < 1e-9 and abs(r["fit"] - fit) < 1e-9 and abs(r["score"] - share * fit) < 1e-9
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)


def test_language_stage_rejects_what_no_row_is_labelled_with(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    rng = np.random.default_rng(3)
    noise = " ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(3, 11))) for _ in range(200))
    odd = {9001: noise, 9002: "Это русский текст о погоде и о людях " * 5, 9003: "今天天气很好我们去公园散步" * 5, 9004: "Αυτό είναι ένα ελληνικό κείμενο " * 5}
    more = docs.unionByName(spark.createDataFrame([(i, t, None, "src1", len(t)) for i, t in odd.items()], docs.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.by_language(spark, more, SF).select("doc_id").collect()}
    alone = {r["doc_id"] for r in corpus_pipeline.by_language(spark, docs, SF).select("doc_id").collect()}
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert kept == alone and len(letters - alone) <= 0.001 * len(letters)


def test_whole_pipeline_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(corpus_pipeline.COLUMNS)
    few = [(9001, None, "en", "src1", None), (9002, "", "de", None, 0), (9003, "½ ²", "en", "src2", 3), (9004, "word " * 3000, None, "src3", 15_000), (9005, "eins zwei drei", None, None, 14)]
    docs = docs.unionByName(spark.createDataFrame(few, docs.schema)).coalesce(2)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    model = language.fit(spark.read.parquet(str(tmp_path / "documents.parquet")))
    rows = []
    for r in docs.collect():
        lang, share, fit = plain_label(model, r["text"])
        if lang != "und" and share >= corpus_pipeline.LEAST_SHARE and fit >= corpus_pipeline.LEAST_FIT:
            rows.append((r["doc_id"], r["text"], lang, r["source"]))
    cut = {i: (t, gone) for i, t, _, gone in line_brute([(i, t) for i, t, *_ in rows])}
    rows = [(i, cut[i][0], lang, source) for i, _, lang, source in rows if not cut[i][1] or cut[i][0].strip(" \t\r\n")]
    ids = [r[0] for r in rows]
    first = brute.smallest_reachable(ids, brute.jaccard_links([r[1] for r in rows]))
    worded = brute.word_sets([r[1] for r in rows])
    rows = [r for r, f, w in zip(rows, first, worded, strict=True) if r[0] == f or not w]
    chosen = [i for i, _, _ in expected(rows, *corpus_pipeline.MIX)]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = {r[0]: r for r in rows}
    want = sorted((i, text[i][2], sp.encode(text[i][1])) for i in chosen)
    assert sorted((r["doc_id"], r["lang"], list(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == want


def test_stages_bear_any_rows(spark):
    rows = [(1, "the same text of more than eight words in it", "en", "src1", 5, 1), (1, "the same text of more than eight words in it", "en", "src1", 5, 1), (None, "the same text of more than eight words in it", None, None, None, 2)]
    rows += [(None, None, None, None, None, 3), (2, "", "en", "", 0, 4), (3, "\n\n", "de", "src2", 2, 5), (3, "another text under the same number as an empty one", "de", "src2", 9, 6), (4, "a\n" * 20_000, "en", "src1", 40_000, 7)]
    extra = "doc_id long, text string, lang string, source string, n_chars long, row int"
    docs = spark.createDataFrame(rows, extra)
    for c in ("doc", "at", "epoch", "key", "tokens", "lang_pred", "component", "gone", "piece_ids"):
        docs = docs.withColumn(c, F.lit(7))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert name == "pieces" or out.columns == corpus_pipeline.COLUMNS
        assert {"language": 5, "lines": 7, "pieces": 8}.get(name, len(got)) == len(got), name
        if name == "ngrams":
            assert sorted(str(r["doc_id"]) for r in got) == ["1", "2", "3", "3", "4", "None", "None"]


def test_keep_first_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None), (3, None), (None, "a b c d e f"), (4, "q r s t u v")], "doc_id long, text string")
    got = sorted((tuple(r) for r in ngrams.keep_first(df).collect()), key=str)
    assert got == sorted([(1, "a b c d e f"), (3, None), (3, None), (4, "q r s t u v"), (None, "a b c d e f")], key=str)
