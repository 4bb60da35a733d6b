"""Admission and pacing against step-by-step models, in batch and as a stream."""

import os
import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from attestra.config import Config
from attestra.operators import limits
from attestra.session import stage
from attestra.streaming.requests import admit_stream, answer_stream

START = datetime(2024, 1, 1, 23, 30, tzinfo=timezone.utc)


def stream_of(seed, n, clients, spread):
    rng = random.Random(seed)
    hot = lambda: 0 if rng.random() < 0.4 else rng.randrange(clients)
    return [(i, hot(), START + timedelta(seconds=rng.randrange(spread))) for i in range(n)]


def model(rows, cfg):
    """One request at a time: the window first, then the day."""
    hits, day, used, out = {}, None, 0, {}
    for i, client, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        if ts.date() != day:
            day, used = ts.date(), 0
        recent = [t for t in hits.get(client, []) if t > ts - timedelta(seconds=cfg.window_seconds)]
        if len(recent) >= cfg.hits_per_window:
            out[i] = limits.WINDOW_FULL
        elif used >= cfg.daily_cap:
            out[i] = limits.DAY_FULL
        else:
            out[i], used = limits.ADMITTED, used + 1
            recent.append(ts)
        hits[client] = recent
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, client long, ts timestamp").repartition(4)


@pytest.mark.parametrize("seed, limit, cap, spread", [(1, 3, 10**6, 1200), (2, 2, 60, 3600), (3, 4, 25, 90000)])
def test_admission_matches_model(spark, seed, limit, cap, spread):
    cfg = replace(Config(), hits_per_window=limit, daily_cap=cap)
    rows = stream_of(seed, 400, 5, spread)
    want = model(rows, cfg)
    got = {r.event_id: r.verdict for r in limits.admission(frame(spark, rows), cfg).collect()}
    assert got == want and len(set(want.values())) >= 2
    if cap > len(rows):
        admitted = limits.sliding_window(frame(spark, rows), cfg).collect()
        assert {r.event_id: r.admitted for r in admitted} == {i: v == limits.ADMITTED for i, v in want.items()}


def test_pacing(spark):
    rows = stream_of(4, 200, 3, 900)
    got = {r.event_id: r.starts_at for r in limits.pacing(frame(spark, rows), 20).collect()}
    last = None
    for i, _, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        at = int(ts.timestamp() * 1_000_000)
        last = at if last is None else max(at, last + 3_000_000)
        assert got[i] == last
    free = limits.pacing(frame(spark, rows), 0).first()
    assert free.starts_at == int(free.ts.timestamp() * 1_000_000)


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_streaming_admission_equals_the_model(spark, tmp_path, batch):
    """Files in no order, several micro-batches, any Arrow batch size: the same verdicts."""
    cfg = replace(Config(), hits_per_window=3)
    rows = stream_of(5, 90, 4, 900)
    late = [(1000 + c, c, START + timedelta(days=1)) for c in range(4)]  # moves the watermark past the rest
    source, shape = str(tmp_path / "in"), "event_id long, client long, ts timestamp"
    for part in (rows[:30], rows[30:60], rows[60:], late):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(source)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        query = (
            admit_stream(stream, cfg, "1000 seconds").writeStream.format("memory").queryName(f"admitted{batch}").outputMode("append")
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert query.exception() is None
    got = {r.event_id: r.admitted for r in spark.table(f"admitted{batch}").collect() if r.event_id < 1000}
    want = model(rows, replace(cfg, daily_cap=10**6))
    assert got == {i: v == limits.ADMITTED for i, v in want.items()}


def test_streaming_answers(spark, tmp_path):
    rows, shape = stream_of(5, 40, 4, 900), "event_id long, client long, ts timestamp"
    spark.createDataFrame(rows, shape).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    paths = []

    def answer(batch):
        staged = stage(batch.withColumn("answer", F.lit("ok")), "answers")
        paths.extend(staged.inputFiles())
        return staged

    answers = answer_stream(stream, answer, str(tmp_path / "out"), str(tmp_path / "cp"))
    answers.awaitTermination(120)
    assert paths and not any(os.path.exists(p.removeprefix("file://")) for p in paths)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
