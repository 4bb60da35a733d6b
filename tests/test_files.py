"""File sources and the registered queries' contract."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from attestra.functions import records as rc
from attestra.sources import files
from catalog import source_queries

ROW = '{"id": "T1", "topic_id": "T", "title": "t", "text": "x", "lang": "en", "source_url": ""}'


def test_jsonl_modes(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text(f"{ROW}\n\n  \n{ROW.replace('T1', 'T2')}\n")
    bad.write_text(f"# comment\n{ROW}\nnot json\n{ROW.replace('T1', 'T2')}\n")
    assert [r.id for r in files.read_passages(spark, str(good)).orderBy("pos").collect()] == ["T1", "T2"]
    lenient = files.read_passages(spark, str(bad), strict=False)
    assert [r.id for r in lenient.orderBy("pos").collect()] == ["T1", "T2"]
    for options in ({}, {"comments": True}):
        with pytest.raises(Exception):
            files.read_passages(spark, str(bad), **options).collect()
    assert files.read_passages(spark, str(tmp_path / "none.jsonl"), strict=False).count() == 0
    with pytest.raises(Exception):
        files.read_passages(spark, str(tmp_path / "none.jsonl"))
    content = tmp_path / "content.jsonl"
    content.write_text('{"id": "C", "content": "body", "lang": "en"}\n')
    assert files.read_passages(spark, str(content)).first().text == "body"


def test_lines_keep_the_order_of_files(spark, tmp_path):
    """Also where Spark reads large files first and one file in several ranges."""
    want = []
    for name, n in (("a", 1), ("b", 300), ("c", 3), ("d", 90)):
        ids = [f"{name}{i}" for i in range(n)]
        (tmp_path / f"{name}.jsonl").write_text("".join(f'{{"id": "{i}", "question": "{i}", "text": "{"x" * 50}"}}\n\n' for i in ids))
        want += ids
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.read_passages(spark, str(tmp_path)).orderBy("pos").collect()
        runs = files.read_traces(spark, str(tmp_path), "id string, question string", lines=True).orderBy("pos").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.id for r in rows] == want and [r.pos for r in rows] == [2 * i for i in range(len(want))]
    assert [r.id for r in runs] == want


def test_documents_and_settings(spark, tmp_path):
    runs = tmp_path / "runs.json"
    runs.write_text('[{"question": "q", "answer": "a"}, {"question": "r", "answer": "b"}]')
    assert files.read_traces(spark, str(runs)).count() == 2
    assert files.read_traces(spark, str(tmp_path / "none.json")) is None
    assert files.read_results(spark, str(tmp_path / "none.json")).first().status == "not_found"
    broken = tmp_path / "broken.json"
    broken.write_text("{")
    assert files.read_results(spark, str(broken)).first().status == "error"
    assert files.read_results(spark, str(runs)).first().status == "ok"
    env = tmp_path / "env"
    env.write_text("# c\nA = 'x=y'\nB=\"two\"\nnothing\nA=second\n")
    assert {r.key: r.value for r in files.read_settings(spark, str(env)).collect()} == {"A": "x=y", "B": "two"}


def test_missing_model_is_an_error(spark):
    df = spark.createDataFrame([(" ", "")], "a string, b string")
    with pytest.raises(Exception, match="No model configured"):
        df.select(rc.model_id(F.col("a"), F.col("b"))).collect()


def test_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


def test_file_order_writes_bounded_files(spark, tmp_path):
    """No file holds half of all documents, and positions still follow the ids."""
    text = "concat_ws(' ', transform(sequence(1, 8), i -> sha2(concat(id, '-', i), 256))) AS text"
    docs = spark.range(65_000).selectExpr("id AS doc_id", text)
    docs.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    rows = source_queries.file_order(spark, str(tmp_path))
    assert rows.where("pos <> CAST(id AS BIGINT)").count() == 0 and rows.count() == 65_000
    (pack,) = [x for x in os.listdir(folder) if x not in before and x.startswith("pack")]
    sizes = [r["count"] for r in spark.read.text(f"{folder}/{pack}").groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 65_000 and max(sizes) < 30_000


def test_danda_words_tokenises_once(spark, tmp_path):
    spark.createDataFrame([(1, "one two. three"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = source_queries.danda_words(spark, str(tmp_path))
    assert sorted((r.doc_id, r.n, r.with_danda) for r in found.collect()) == [(1, 3, False), (2, 0, False)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
