"""Ranking against BM25 written out in plain Python on a pack of its own."""

import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.config import Config
from attestra.functions import text as tx
from attestra.operators import retrieve
from attestra.operators import score as sc
from attestra.operators.index import Index
from attestra.operators.retrieve import rank

WORDS = "river bridge stone lamp garden market winter ferry copper signal harbor meadow 1,200 45% seven".split()


def bm25(pack, question, cfg):
    """Scores of all passages: sum of idf times the saturated count of each query feature, repeats included."""
    n, average = len(pack), sum(map(len, pack)) / len(pack)
    df = Counter(t for p in pack for t in set(p))
    scores = []
    for p in pack:
        tf = Counter(p)
        norm = cfg.k1 * (1 - cfg.b + cfg.b * len(p) / average)
        scores.append(
            sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (cfg.k1 + 1) / (tf[t] + norm) for t in question if df[t])
        )
    return scores


@pytest.mark.parametrize("k1, b", [(1.5, 0.75), (0.9, 0.0)])
def test_scores_equal_the_formula(spark, k1, b):
    rng, cfg = random.Random(3), Config(k1=k1, b=b)
    rows = [(i, str(i), "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(3, 40))), "en") for i in range(60)]
    pack = spark.createDataFrame(rows, "pos long, id string, title string, text string, lang string")
    asked = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(4))) for i in range(8)], "qid long, question string")
    features = lambda df, c: [r[0] for r in df.select(tx.extract_features(F.col(c), "en")).collect()]
    passages = features(pack.orderBy("pos"), "text")
    questions = dict(zip([r.qid for r in asked.orderBy("qid").collect()], features(asked.orderBy("qid"), "question")))
    for index in (None, Index.build(pack)):
        found = {}
        for r in rank(asked, pack, cfg, index).collect():
            found.setdefault(r.qid, []).append((r["rank"], r.pos, r.score))
        for qid, question in questions.items():
            scores = bm25(passages, question, cfg)
            best = sorted(range(60), key=lambda p: (-round(scores[p], 9), p))[:3]
            got = sorted(found[qid])
            assert [p for _, p, _ in got] == best
            assert [s for *_, s in got] == pytest.approx([scores[p] for p in best])


def test_rounds_and_repeated_passages_equal_the_index(spark):
    """Several rounds of questions, blocks of passages, positions that come twice and terms that few or all share."""
    rng = random.Random(5)
    word = lambda: rng.choice(WORDS) if rng.random() < 0.7 else f"rare{rng.randint(0, 300)}"
    rows = [(i, str(i), " ".join(word() for _ in range(rng.randint(0, 30))), rng.choice(["en", "en", "hi", "fr"])) for i in range(1300)]
    pack = spark.createDataFrame(rows + rows[:40] + [(7, "7", "a lamp of copper", "hi")], "pos long, id string, text string, lang string")
    asked = [(i, " ".join(word() for _ in range(6))) for i in range(30)] + [(3, "lamp"), (30, "the of"), (None, "river")]
    asked = spark.createDataFrame(asked, "qid long, question string")
    index = Index.build(pack.coalesce(1))
    for cfg in (Config(), Config(broadcast_max_rows=1500), Config(filter_language=False, top_k=7)):
        rows_of = lambda index: sorted(map(repr, rank(asked, pack.coalesce(2), cfg, index).withColumn("score", F.round("score", 8)).collect()))  # noqa: E731, B023
        assert rows_of(None) == rows_of(index)


def test_scores_leave_tasks_as_best_of_questions(spark):
    """A word that all passages and questions share makes no row per question and passage."""
    pack = spark.range(2000).selectExpr("id AS pos", "'common lamp' AS text", "'en' AS lang").coalesce(2)
    asked = spark.range(50).selectExpr("id AS qid", "'common' AS question")
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert rank(asked, pack).count() == 150
    scored = [x for x in os.listdir(folder) if x.startswith("scored-") and x not in before]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(scored) == 1 and spark.read.parquet(f"{folder}/{scored[0]}").count() <= tasks * 50 * 3


def test_passages_are_packed_once_for_all_rounds(spark, monkeypatch):
    """More rounds of questions read the packed passages again, but make them once; a round takes as many query terms as allowed."""
    rng, made, rounds = random.Random(9), [], []
    pack = spark.createDataFrame([(i, " ".join(rng.choice(WORDS) for _ in range(9)), "en") for i in range(50)], "pos long, text string, lang string")
    asked = spark.createDataFrame([(i, f"river lamp seven w{i}") for i in range(40)], "qid long, question string")
    rows = retrieve.query_terms(asked, Config()).count()
    stage, score_round = retrieve.stage, retrieve._score_round
    monkeypatch.setattr(retrieve, "stage", lambda df, label: made.append(label) or stage(df, label))
    monkeypatch.setattr(retrieve, "_score_round", lambda *a: rounds.append(a) or score_round(*a))
    found = rank(asked, pack, Config(broadcast_max_rows=rows // 3))
    assert found.count() == 120 and made.count("packed") == 1 and len(rounds) in (3, 4)


def _sent(value):
    return type("Sent", (), {"value": value})


@pytest.mark.parametrize("k", [3, 70])
def test_best_by_exact_scores(k):
    """Scores that single precision cannot tell apart, ties, copies, several blocks of passages and of questions, a question of two pools."""
    rng = np.random.default_rng(4)
    grams = [f"w{i}" for i in range(40)]
    rows, lengths, groups = 2500, rng.integers(40_000_000, 40_000_020, 2500), rng.choice(["en", "hi"], 2500)
    words = [" ".join(rng.choice(grams, rng.integers(0, 6))) for _ in range(rows)]
    words[1000:1400], lengths[1000:1400], groups[1000:1400] = ["w1 w1 w2"] * 400, 40_000_000, "en"
    parts = [[{"lang_group": g, "doc_len": int(n), "words": w}] for g, n, w in zip(groups, lengths, words, strict=True)]
    kind = pa.list_(pa.struct([("lang_group", pa.string()), ("doc_len", pa.int32()), ("words", pa.string())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(parts, kind)], names=["pos", "parts"])
    packed = [*sc.pack(iter([batch.slice(0, 2300), batch.slice(2300), batch.slice(0, 0)]))]
    assert len(packed) == 3

    question = np.repeat(np.arange(1100), 4)
    term, pool = np.tile(rng.permuted(np.tile(np.arange(40), (1100, 1)), axis=1)[:, :4], 1).reshape(-1), np.repeat(np.arange(1100) % 2, 4)
    pool[2] = 1  # question 0 asks both
    weight, density = rng.random(4400) + 1.0, np.where(term < 20, 0.5, 0.0)
    pools = [(["en"], 40_000_010.0), (["hi", "en"], 3e7)]
    todo = sc.plan(question, pool, term, weight, density, pools)
    assert {len(a.pools) for a in todo} == {1, 2}
    out = pa.Table.from_batches(sc.score(_sent(pa.array(grams)), _sent(todo), k, 1.5, 0.75)(iter(packed)))

    tf = np.array([[0.0] * 40 if not w else [w.split().count(g) + sum(max(1, len(x) - 2) for x in w.split() if x[:3] == g) for g in grams] for w in words])
    scores = np.zeros((1100, rows))
    for i, (own, avgdl) in enumerate(pools):
        value = tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * lengths / avgdl)[:, None])
        mine = pool == i
        matrix = np.zeros((1100, 40))
        matrix[question[mine], term[mine]] = weight[mine]
        scores += np.where(np.isin(groups, own), matrix @ value.T, 0.0)
    got = {}
    for q, pos, s in zip(*(out[c].to_pylist() for c in ("question", "pos", "score")), strict=True):
        got.setdefault(q, []).append((pos, s))
    for q in range(1100):
        best = [p for p in np.lexsort((np.arange(rows), -np.round(scores[q], 9)))[:k] if scores[q, p] > 0]
        mine = sorted(got.get(q, []), key=lambda x: (-round(x[1], 9), x[0]))
        assert [p for p, _ in mine] == best
        assert [s for _, s in mine] == pytest.approx(scores[q, best], rel=1e-12)


def test_lists_without_texts(spark):
    """Lists of ids carry no text, and the rest is as with it."""
    pack = spark.createDataFrame([(i, str(i), "t", f"lamp w{i}", "en") for i in range(9)], "pos long, id string, title string, text string, lang string")
    asked = spark.createDataFrame([(1, "lamp w3"), (2, "w4")], "qid long, question string")
    whole, bare = (retrieve.retrieve(asked, pack, text=x).orderBy("qid").collect() for x in (True, False))
    assert [p.id for r in bare for p in r.retrieved] == [p.id for r in whole for p in r.retrieved]
    assert [(r.qid, r.top_score, r.resolved_lang, r.precheck_passed) for r in bare] == [(r.qid, r.top_score, r.resolved_lang, r.precheck_passed) for r in whole]
    assert "text" not in bare[0].retrieved[0] and whole[0].retrieved[0].text == "lamp w3"
