"""Streaming deduplication against a plain Python model."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attestra.llm.common import shared_path
from attestra.llm.stream_dedup import STATE, StreamDedup, deduplicate, entries, ingest, report

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def normal(text):
    return BLANK.sub(" ", text or "")


def model(rows):
    """(id, keep_id, size, sha) of each row, and the number of rows kept."""
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r.text)].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr), len(groups)


def check(got, rows):
    want, kept = model(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == want
    assert sum(r.kept for r in got) == kept
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


@pytest.fixture(scope="module")
def copies(spark, tricky, corpus):
    hot = [(1000 - i, " one\ttext\n\n  of many " if i % 2 else " one text of many ", "en", "a", 0) for i in range(400)]
    return tricky.union(corpus).union(spark.createDataFrame(hot + [(None, "nobody's", None, None, None)] * 3, corpus.schema))


def saved(spark, docs, files=3):
    path = shared_path(spark, "docs")
    docs.repartition(files).write.parquet(path)
    return path


def test_against_model(spark, copies):
    path = saved(spark, copies.withColumn("_metadata", F.lit(1)).withColumn("digest", F.lit("x")).withColumn("file", F.lit(2)))
    got = deduplicate(spark, StreamDedup(path, shared_path(spark, "home")))
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().toString())
    check(got.collect(), copies.collect())


def test_colliding_digests_are_told_by_bytes(spark, copies):
    weak = StreamDedup(saved(spark, copies), shared_path(spark, "home"), digest=lambda t: F.substring(F.md5(t), 1, 1))
    check(deduplicate(spark, weak).collect(), copies.collect())


def test_later_files_meet_old_state(spark, copies):
    before = {name: spark.conf.get(name, None) for name in STATE}
    path = saved(spark, copies.limit(0))
    job = StreamDedup(path, shared_path(spark, "home"), files_per_batch=1)
    ingest(spark, job)
    assert report(spark, job).count() == 0 and entries(spark, job).count() == 0
    rows = copies.collect()
    for part in (rows[:300], rows[300:]):
        spark.createDataFrame(part, copies.schema).repartition(3).write.mode("append").parquet(path)
        ingest(spark, job)
        ingest(spark, job)  # nothing new
    check(deduplicate(spark, job).collect(), rows)
    assert {name: spark.conf.get(name, None) for name in STATE} == before
