"""A corpus from raw documents to a training mix: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import read_table, shared_path
from attestra.llm.curriculum import mix_documents
from attestra.llm.decontaminate import drop_contaminated
from attestra.llm.host_rules import keep_documents
from attestra.llm.language import keep_identified
from attestra.llm.simhash import drop_near_duplicates
from attestra.session import staging_scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose language is told with confidence."""
    return keep_identified(docs)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules themselves and whose host passes them."""
    return keep_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; ids may be null or repeated."""
    return drop_near_duplicates(docs, unique_ids=False)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap with no benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passes over documents in training order."""
    return mix_documents(docs)


STAGES = [
    ("language ID", language),
    ("quality rules", rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing to target weights", mix),
]

#: Near-duplicate components and hashes have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``STAGES`` applied to the documents table."""
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        with staging_scope(spark):  # what a stage staged goes once its result is written
            step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
