"""The pipeline on small tables against its stages' brute-force meaning, and the registry."""

import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries

from .conftest import DOCS, prose


def write(spark, folder):
    rng = random.Random(11)
    items = [(i, prose(rng, 25)) for i in range(5)]
    rows = []
    for i in range(120):
        kind = ("en", "de", "fr")[i % 3]
        rows.append((i, prose(rng, rng.randint(60, 140), kind), kind, f"s{i % 4}", 0))
    clean = set(range(120))
    rows += [(200 + i, rows[3 * i][1].upper(), "en", "s1", 0) for i in range(20)]  # copies, English only as A-Z are lowered
    rows += [(300 + i, rows[i][1] + " " + items[i % 5][1], "en", "s2", 0) for i in range(40, 50)]  # leaks
    rows += [(400, None, "en", "s0", 0), (401, "123 456", "en", None, 0), (402, "too short", "en", "s0", 0), (None, prose(rng, 80), None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return clean | {None}


def test_stages(spark, tmp_path):
    clean = write(spark, str(tmp_path))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "quality rules", "SimHash near-dedup", "benchmark decontamination", "mixing to target weights"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id for r in docs.collect()} == clean
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    words = docs.select(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert abs(mixed.agg(F.sum("words_taken")).first()[0] - 1.5 * words) <= 3
    assert mixed.where("text IS NULL").count() == 0
    assert spark.createDataFrame([], DOCS).schema == docs.schema


def test_empty_documents(spark, tmp_path):
    write(spark, str(tmp_path / "full"))
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = [n for n in queries() if re.match(r"op\d+_|pipeline$", n)]
    assert len(names) == 11 and {int(n[2:].split("_")[0]) for n in names if n != "pipeline"} == set(range(1, 11))
    assert {n for n in names if n in oracle_sql()} == {"op4_host_rules", "op6_curriculum", "op8_preference"}
