"""Operator 1 against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from reelquery.llm import pieces
from reelquery.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.read_model(PATH))


def test_random_texts(library, model):
    rng = random.Random(1)
    some = [*"abcthe ing  \n\t▁éñ日本<>0x'\"1234-_=ß😀\u0000", "   ", "the", "ing", "tion", " " * 16, "====", "\r\n", "</s>", "<0x0A>"]
    for _ in range(4000):
        t = "".join(rng.choice(some) for _ in range(rng.randint(0, 60)))
        ids = library.encode(t)
        assert model.encode(t) == ids
        assert model.decode(ids) == library.decode(ids)


def test_runs_of_blanks(library, model):
    for n in range(120):
        for t in (" " * n, " " * n + "x", " " * n + "\n", "a" + " " * n + "日"):
            assert model.encode(t) == library.encode(t)


def test_any_ids_decode_alike(library, model):
    rng = random.Random(2)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 32000), rng.randrange(3, 259)]) for _ in range(rng.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids)


def test_long_texts(library, model):
    rng = random.Random(3)
    for t in ("ab" * 40_000, "".join(rng.choice("abcdeftion") for _ in range(60_000)), "x" + " " * 5000 + "y", "é" * 20_000):
        assert model.encode(t) == library.encode(t)


def test_backtracking_is_needed(model):
    """Some pieces may not follow the longest piece: the greedy path alone is not the encoding."""
    wrong = 0
    for word in ("thentinonthe", "anererinthst", "hetionlyingre"):
        greedy, at = [], 0
        while at < len(word):
            k = max(k for k in range(1, len(word) - at + 1) if word[at : at + k] in model.id)
            greedy.append(model.id[word[at : at + k]])
            at += k
        wrong += greedy != model.backtrack(word)
        assert model.backtrack(word) == [model.id[p] for p in model.merged(word)]
    assert wrong


def test_whole_table(spark, library):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op1_pieces"](spark, sf).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "")
        assert got[r["doc_id"]] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_edges(spark):
    rows = [(1, None, 5), (2, "", 5), (3, " ", 5), (3, " ", 5), (None, "a", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece_ids int")
    got = pieces.digests(pieces.encode(df, PATH)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted((tuple(r) for r in got), key=str)[0][1:] == (0, empty, empty)
    assert len(got) == 5
    assert pieces.encode(df.limit(0), PATH).count() == 0
    back = pieces.decode(pieces.encode(df, PATH, decoded=False), PATH).select("text", "piece_text").collect()
    assert all((r[0] or "") == r[1] for r in back)
