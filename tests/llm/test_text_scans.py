"""Operators 2, 3 and 4."""

import hashlib
import random
import re
import time
import unicodedata
import zlib

import numpy as np

from reelquery.llm import language, licenses, secrets
from reelquery.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def base_spans(text):
    """The base patterns restated: leftmost matches, then those that are too short dropped."""
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [s for _, _, s in sorted(out)]


def test_op3_whole_table(spark):
    got = {r["doc_id"]: r for r in QUERIES["op3_secrets"](spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        base = base_spans(r["text"] or "")
        g = got[r["doc_id"]]
        assert g["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in g["spans"].split(",") if s and not s.startswith("literal")] == base
        assert g["n_assign"] == sum(s.startswith("assign") for s in base)


def test_op3_base_edges():
    for t in (
        'PassWord = "abcdef" token:abc api_key=zzzzzzzz apikey: "q1w2e3r4"', "secret=token: \"abcdefgh\"", "token = a token = abcdef", "AKIA" + "A" * 15 + " AKIA" + "B" * 16 + "c", "f" * 23 + "g" + "0" * 24,
        "ſecret=abcdefgh toKen=abcdefgh", "password\t=abcdefg", "tokentoken=abcdef=", "é password='abc.def/ghi' 😀 token=xxxxxx",
    ):
        assert [":".join(map(str, s)) for s in secrets.find(t) if s[0] != "literal"] == base_spans(t)


def literals(text):
    return [text[a:b] for k, a, b in secrets.find(text) if k == "literal"]


def test_op3_lexer():
    assert literals('db_password = "hunter2-Zx9"') == ["hunter2-Zx9"]
    assert literals('{"clientSecret": "aB3dE5gH7j"}') == ["aB3dE5gH7j"]
    assert literals('auth_token: str = "q9W8e7R6t5"') == ["q9W8e7R6t5"]
    assert literals("X = 'k3yM4t3ri4l!'\npassword = X") == ["k3yM4t3ri4l!"]
    assert literals('aws.secret-access-key = "abcDEF" + "123ghi"') == ["abcDEF", "123ghi"]
    assert literals("PASSWORD=s3cr3tvalue") == ["s3cr3tvalue"]
    for clean in ('color = "abcdef123456"', 'password = "changeme"', 'password = "${PASSWORD}"', "if token == 'abcdef123456':", "see http://example.org/token", "the token of love", "password:"):
        assert literals(clean) == []
    assert secrets.find(None) == secrets.find("") == []


def test_op3_generated_assignments():
    """Random programs against a plain interpreter."""
    rng = random.Random(5)
    names = ["alpha", "beta", "gamma", "delta", "db_password", "authToken", "api_key", "counter"]
    for _ in range(300):
        text, value, want = "", {}, set()
        for _ in range(rng.randint(1, 12)):
            name = rng.choice(names)
            line = name + rng.choice([" = ", "=", ": ", " := ", " => "])
            parts = []
            for k in range(rng.randint(1, 3)):
                line += " + " if k else ""
                if value and rng.random() < 0.4:
                    other = rng.choice(sorted(value))
                    parts += value[other]
                    line += other
                else:
                    quote = rng.choice("\"'")
                    word = "".join(rng.choice("abcXYZ0189!") for _ in range(rng.randint(1, 9)))
                    at = len(text) + len(line) + 1
                    parts.append((at, at + len(word), word))
                    line += quote + word + quote
            text += line + rng.choice(["\n", ";\n", "  \n"])
            value[name] = parts
            length = min(12, sum(z - a for a, z, _ in parts))
            score = secrets.sensitivity(name) * (0.5 + 0.25 * length / 12 + 0.25 * min(1, max(secrets.variety(w) for *_, w in parts) / 3))
            if length >= 6 and score >= secrets.THRESHOLD and not all(re.fullmatch("(?i)x+", w) for *_, w in parts):
                want |= {(a, z) for a, z, _ in parts}
        assert {s[1:] for s in secrets.find(text) if s[0] == "literal"} == want, text


def test_op3_hostile_texts():
    start = time.perf_counter()
    assert secrets.find('a = "xy"\n' + "a = a + a\n" * 60 + "password = a") == [("literal", 5, 7)]
    for text in ("a=" * 250_000, "token=" * 80_000, 'x="' * 100_000, "a: b[" * 100_000, "password:" * 50_000, "`" * 100_000 + "=", '"" + ' * 100_000 + "= 1"):
        secrets.find(text)
    assert len([s for s in secrets.find('password = password + "abcdefgh"\n' * 20_000) if s[0] == "literal"]) == 20_000
    assert time.perf_counter() - start < 90


def test_op3_strings_and_comments():
    assert literals('conn = "Server=a;Password=s3cr3tvalue9;"') == ["s3cr3tvalue9"]
    assert literals('config["password"] = "hunter2-Zx9"') == ["hunter2-Zx9"]
    assert literals("it's password = 'hunter2-Zx9' isn't it") == ["hunter2-Zx9"]
    assert literals('# material = "k3yM4t3ri4l!"\npassword = material') == ["material"]
    assert literals('x = y_token = "q9W8e7R6t5"') == ["q9W8e7R6t5"]


def test_op3_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "token=" + "a" * 100_000, 1), (3, "x", 1)], "doc_id long, text string, secret_spans int")
    assert secrets.digests(secrets.scan(df)).count() == 4
    assert secrets.scan(df.limit(0)).count() == 0


def test_op4_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op4_language"](spark, SF).collect()
    assert len(got) == len(lang)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) >= 0.98


def test_op4_spans_and_edges(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang")
    model = language.fit(docs)
    few = docs.filter("length(text) between 400 and 900").collect()
    en = next(r["text"] for r in few if r["lang"] == "en")
    de = next(r["text"] for r in few if r["lang"] == "de")
    rows = [(1, en + "\n" + de, "x"), (2, None, "x"), (3, "1234 !?", "x"), (4, "", "x"), (5, "Ж" * 30, "x"), (6, (en + " ") * 40, "x")]
    got = {r["doc_id"]: r for r in language.label(spark.createDataFrame(rows, "doc_id long, text string, lang_pred string"), model).collect()}
    spans = got[1]["lang_spans"]
    assert [s["lang"] for s in spans] == ["en", "de"] and abs(spans[1]["start"] - len(en)) < 40
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 and not got[i]["lang_spans"] for i in (2, 3, 4))
    assert got[5]["lang_pred"] in model.langs and got[6]["lang_pred"] == "en"


def test_op4_letters(spark):
    model = language.Model(["xx"], np.zeros((language.CELLS, 1)), np.ones((len(language.SCRIPTS), 1), bool))
    texts = ["½ ²", "Ⅷ ①", "a½b", "Приветhello", "日本ごカナ", "straße", "x" * 300_000, "é " * 100_000]
    got = [tuple(r) for r in language.label(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).orderBy("doc_id").select("lang_pred", "lang_score").collect()]
    assert got == [("und", 0.0)] * 2 + [("xx", 1.0)] * 6
    words = [language.words_of(t) for t in texts[:6]]
    assert words == [[], [], ["a", "b"], ["Привет", "hello"], ["日本", "ごカナ"], ["straße"]]
    assert [t[a:z] for t in texts[:6] for a, z in language.places_of(t)] == [w for x in words for w in x]
    assert all(unicodedata.category(c)[0] == "L" for i in range(0x250, 0x30000) for c in language.words_of(chr(i)))


def test_op4_nothing_to_learn_from(spark):
    rows = [(1, "some text", None), (1, "some text", None), (2, None, "en"), (None, "", None)]
    for df in (spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, text string, lang string")):
        got = language.label(df, language.fit(df)).collect()
        assert len(got) == df.count() and all(r["lang_pred"] == "und" and r["lang_score"] == 0 and r["lang_spans"] == [] for r in got)


def test_viterbi_neighbours():
    """Two stretches that gain less than the penalty each, and more than it together."""
    s = np.zeros((20, 3))
    s[:10, 1] = s[10:, 2] = 1.0
    s[10:, 1] = s[:10, 2] = -5.0
    assert language.viterbi(s, 12.0).tolist() == [1] * 10 + [2] * 10


def test_viterbi_matches_full_search():
    rng = np.random.default_rng(1)
    for _ in range(200):
        s = rng.normal(size=(rng.integers(1, 40), 3)) * 5
        best = s[0].copy()
        for row in s[1:]:
            best = row + np.maximum(best, best.max() - 6.0)
        labels = language.viterbi(s, 6.0)
        total = s[np.arange(len(s)), labels].sum() - 6.0 * (labels[1:] != labels[:-1]).sum()
        assert abs(total - best.max()) < 1e-9


def test_op2_rules(spark):
    mit = "\n".join(s for n, s in licenses.SENTENCES if n in ("mit_grant", "mit_notice", "as_is"))
    rows = [(1, mit), (2, "x\nReleased under the MIT License."), (3, "Intro. Licensed under the Apache License, Version 2.0. All rights reserved."), (4, None), (5, ""), (6, "the license of nothing"), (7, mit + "\n" + mit)]
    df = spark.createDataFrame([(a, b, "q") for a, b in rows], "doc_id long, text string, licenses string")
    got = {r["doc_id"]: r for r in licenses.recognise(df).collect()}
    assert got[1]["licenses"] == ["MIT"] and got[2]["licenses"] == ["MIT"]
    assert got[3]["licenses"] == ["Apache-2.0", "Proprietary"]
    assert all(got[i]["licenses"] == [] for i in (4, 5, 6)) and len(got[7]["license_sentences"]) == 6
    assert licenses.recognise(df.limit(0)).count() == 0
