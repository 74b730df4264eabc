"""From raw documents to encoded training documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs.  All but the last return the columns of ``documents``.

1. language: ``lang`` becomes the language found.  Rejected are texts without letters, those with no language for at
   least 35 % of their letters (mixes of three languages or more; clean text in two languages must stay), and those that do not look
   like text of the language found (a fit below 0.3: random letters, scripts and languages that no row is labelled with)
2. lines: repeated lines are cut out of the texts; texts of which nothing is left go; ``n_chars`` is counted again
3. ngrams: of each group of near-duplicates the document with the smallest doc_id stays
4. mixing: half of the tokens, divided among domains, languages and sources by weight, without repetitions
5. pieces: every text as SentencePiece ids, decoded again and compared

Null and empty texts go with the first stage, as they have no letters; if no row has a text and a language, all rows go, as nothing
can be learned.  Repeated rows are copies of each other: their lines go or stay alike, and one of them stays in the third stage.
Rows without an id stay there, and come last where order counts.  Texts of any length are read whole.  Other columns are left behind,
so names cannot clash.  An empty table gives no rows.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelquery import ship
from reelquery.llm import language, lines, mixing, ngrams, pieces
from reelquery.llm.common import saved

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SHARE, LEAST_FIT = 0.35, 0.3
MIX = ((1, 2), 1, 42)


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    if docs.filter("text is not null and lang is not null").isEmpty():
        return docs.select(COLUMNS).filter("false")
    out = language.label(docs.select(COLUMNS), language.fit(docs))
    kept = out.filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= LEAST_SHARE) & (F.col("lang_fit") >= LEAST_FIT))
    return kept.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def by_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = lines.dedup(docs.select(COLUMNS))
    left = F.rlike("text", F.lit(r"[^ \t\r\n]"))
    return out.filter((F.col("lines_removed") == 0) | left).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def by_ngrams(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngrams.keep_first(docs.select(COLUMNS))


def by_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs.select(COLUMNS), *MIX).select(COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pieces.encode(docs.select(COLUMNS), public_tokenizers.path("piece_bpe_32k.model"))
    same = F.coalesce(F.col("piece_text"), F.lit("")) == F.coalesce(F.col("text"), F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_tokens"), F.col("piece_ids").alias("ids"), same.alias("round_trip"))


STAGES = [("language", by_language), ("lines", by_lines), ("ngrams", by_ngrams), ("mixing", by_weights), ("pieces", encoded)]
#: SQL cannot express the language stage; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), docs)
    return docs
