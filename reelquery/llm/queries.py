"""The registered queries of this subpackage, and SQL where it can express them."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery.llm import decontam, language, licenses, lines, merkle, mixing, multiindex, ngrams, oracle, pieces, secrets, spelling, suffixes, topk

TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(pieces.encode(docs, public_tokenizers.path(TOKENIZER)).drop("text"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.recognise(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.filter(~language.held_out()))
    out = language.label(docs.select("doc_id", "text"), model)
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", (F.col("lang_score") * F.col("lang_fit")).alias("score"), F.col("lang_score").alias("share"), F.col("lang_fit").alias("fit"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.valid(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors.filter("vec_id % 50 = 0"), vectors)


def op6_multiindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(table(spark, sf_dir, "embeddings"))


MIX = ((1, 2), 2, 42)


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), *MIX)
    none = F.lit(mixing.NONE)
    return out.select("doc_id", "epoch", F.col("mix_tokens").alias("n_tokens"), F.coalesce("lang", none).alias("lang"), F.coalesce("source", none).alias("source"))


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(suffixes.cut(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("lines_total").alias("n_lines"), F.col("lines_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op10_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    of = lambda text: merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, of(merkle.lower_az(F.col("text"))))
    made = merkle.manifest(docs.select("doc_id", "source", of(F.col("text")).alias("leaf"), changed.alias("changed")))
    folded = made.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), noise=True))


def op13_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digests(decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


QUERIES = {"op8_suffixes": op8_suffixes, "op9_lines": op9_lines, "op5_topk": op5_topk, "op6_multiindex": op6_multiindex, "op2_licenses": op2_licenses, "op7_mix": op7_mix, "op10_ngrams": op10_ngrams, "op1_pieces": op1_pieces, "op3_secrets": op3_secrets, "op4_language": op4_language, "op11_merkle": op11_merkle, "op12_spelling": op12_spelling, "op13_benchmark": op13_benchmark}
ORACLE = {
    "op2_licenses": licenses.oracle_sql(), "op5_topk": oracle.TOPK, "op6_multiindex": oracle.MULTIINDEX, "op7_mix": mixing.oracle_sql(*MIX),
    "op8_suffixes": oracle.SUFFIXES, "op9_lines": oracle.LINES, "op10_ngrams": oracle.NGRAMS, "op11_merkle": oracle.MERKLE, "op12_spelling": oracle.SPELLING, "op13_benchmark": oracle.BENCHMARK,
}
