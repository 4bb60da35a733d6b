"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm.periodic_runs import RunRules, detect_runs, find_runs
from attestra.llm.queries_audit import periodic_runs


def runs_by_force(words, rules=RunRules()):
    """Start, end, smallest period of the maximal runs."""
    found = {}
    for q in range(1, len(words) // rules.min_power + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(rules.min_words, rules.min_power * q) and j > i:
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


@pytest.mark.parametrize("rules", [RunRules(), RunRules(1, 2), RunRules(5, 3), RunRules(2, 4), RunRules(24, 2)])
def test_against_all_periods(rules):
    rng = random.Random(repr(rules))
    for _ in range(300):
        n, kinds, words = rng.randint(0, 200), rng.choice([1, 2, 3, 5]), []
        while len(words) < n:
            piece = [rng.randint(0, kinds) for _ in range(rng.randint(1, 20))]
            words += piece * rng.choice([1, 1, 2, 3, 5, 8])
        assert find_runs(np.array(words[:n], np.int64), rules) == runs_by_force(words[:n], rules)


def test_one_word_a_million_times():
    assert find_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted((a, b - a, q) for a, b, q in runs_by_force(words))
    kept = [True] * n
    for s, length, q in runs:
        for i in range(s + q, s + length):
            kept[i] = False
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    text = b" ".join(w for w, k in zip(words, kept, strict=True) if k)
    return (doc_id, len(runs), *tail, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest())


def test_query(spark, tricky, corpus, nothing, tmp_path):
    rng = random.Random(5)
    extra = []
    for i in range(400, 440):
        unit = [f"w{rng.randint(0, 3)}" for _ in range(rng.randint(1, 30))]
        extra.append((i, "\t".join(unit * rng.randint(1, 30)) + "\x1c é end", "en", "a", 0))
    # the longest text of `tricky` has too many words for the search over all periods
    docs = tricky.where("text is null or length(text) < 10000").union(corpus).union(spark.createDataFrame(extra, corpus.schema))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(r.doc_id, r.text) for r in docs.collect()), key=repr)
    assert sum(r[1] > 0 for r in got) > 40
    (tmp_path / "none").mkdir()
    nothing.write.parquet(f"{tmp_path}/none/documents.parquet")
    assert periodic_runs(spark, f"{tmp_path}/none").count() == 0


def test_columns_and_long_text(tricky):
    clash = tricky.withColumn("runs", F.lit("x")).withColumn("text_", F.lit(1)).withColumn("Collapsed", F.lit(2))
    found = detect_runs(clash, chunk=10)
    assert found.columns == [*tricky.columns, "text_", "n_words", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == tricky.count() and max(r.n_words for r in rows) == 20_000
    assert {r.doc_id: r.collapsed for r in rows}[7] == "same text here"
    assert detect_runs(tricky.withColumnRenamed("text", "body"), "body").count() == len(rows)
