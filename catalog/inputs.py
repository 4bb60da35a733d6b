"""Tables of the test data in the shapes the engine works on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.functions import lexicon as lx
from attestra.session import balanced

from . import sql


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A table; with ``key``, spread over tasks when it is one small file."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return balanced(df, key) if key else df


def deva(text: Column) -> Column:
    """Latin text as Devanagari text (see ``sql.deva``)."""
    out = F.lower(text)
    for old, new in sql.STAND_INS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return F.translate(out, sql.LETTERS + "0123456789", sql.CONSONANTS + lx.DEVANAGARI_DIGITS)


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id")
    return docs.select(
        F.col("doc_id").alias("pos"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("source").alias("title"),
        "text",
        "lang",
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bench = table(spark, sf_dir, "benchmark")
    return bench.select(
        F.col("item_id").alias("qid"),
        F.col("item_id").alias("pos"),
        F.col("text").alias("question"),
        F.lit("en").alias("lang"),
        (F.pmod("item_id", F.lit(3)) != 0).alias("answerable"),
    )


def mixed_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with French as Hindi and German as Marathi, both in Devanagari script."""
    docs = passages(spark, sf_dir)
    lang = F.when(F.col("lang") == "fr", "hi").when(F.col("lang") == "de", "mr")
    return docs.withColumn("lang", F.coalesce(lang, "lang")).withColumn(
        "text", F.when(F.col("lang").isin("hi", "mr"), deva(F.col("text"))).otherwise(F.col("text"))
    )


def mixed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns of the conversations; those of every other one in Devanagari script."""
    turns = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    odd = F.pmod("conv_id", F.lit(2)) == 1
    return turns.select(
        number.alias("qid"),
        number.alias("pos"),
        F.when(odd, deva(F.col("text"))).otherwise(F.col("text")).alias("question"),
    )


SQL_PASSAGES = (
    "SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, source AS title, text, lang, "
    "source || ' ' || text AS body FROM documents"
)
SQL_QUESTIONS = (
    "SELECT item_id AS qid, text AS question, 'en' AS lang, item_id % 3 <> 0 AS answerable "
    "FROM benchmark"
)
SQL_MIXED_PASSAGES = (
    "SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, source AS title, "
    "CASE lang WHEN 'fr' THEN 'hi' WHEN 'de' THEN 'mr' ELSE lang END AS lang, "
    "source || ' ' || CASE WHEN lang IN ('fr', 'de') THEN "
    f"{sql.deva('text')} ELSE text END AS body FROM documents"
)
SQL_MIXED_QUESTIONS = (
    f"SELECT conv_id * 1000 + turn AS qid, CASE WHEN conv_id % 2 = 1 THEN {sql.deva('text')} ELSE text END "
    "AS question FROM conversations"
)
