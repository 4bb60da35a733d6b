"""Queries of the operators on document texts; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .decontaminate import find_overlaps
from .language import identify_documents
from .simhash import near_duplicates
from .suffix_tree import score_documents as suffix_scores
from .toxicity import score_documents as toxic_scores


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return find_overlaps(docs, read_table(spark, sf_dir, "benchmark"))


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(read_table(spark, sf_dir, "documents"))


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_scores(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_decontaminate": (decontaminate, None),
    "op2_toxicity": (toxicity, None),
    "op3_suffix_tree": (suffix_tree, None),
    "op5_simhash": (simhash, None),
    "op10_language": (language, None),
}
