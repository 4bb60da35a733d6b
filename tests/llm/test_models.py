"""Language ID, toxicity and suffix-tree scores: held-out accuracy, and brute force where results are exact."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import language as lg
from attestra.llm import suffix_tree as st
from attestra.llm import toxicity as tx

from .conftest import DOCS, prose


def held(doc_id, n):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % n == 0


def test_languages_held_out(corpus):
    truth = {r.doc_id: r.lang for r in corpus.collect()}
    rows = lg.identify_documents(corpus).collect()
    assert len(rows) == 340 and all(r.held_out == held(r.doc_id, 5) for r in rows)
    assert all(r.lang_pred == truth[r.doc_id] and 0.5 < r.score <= 1 for r in rows)


def test_words_before_grams():
    log = np.log(np.array([[0.9, 0.1], [0.1, 0.9], [0.2, 0.8], [0.7, 0.3]], np.float32))
    model = lg.Model(["a", "b"], [{"known": 0}, {}, {" k": 1}, {"kno": 2, "unx": 3}], log)
    assert (model.vector("known,") == log[0]).all()  # its n-grams say otherwise
    assert (model.vector("knorr") == log[2]).all()  # the longest n-gram that is known
    assert (model.vector("kx") == log[1]).all()
    assert (model.vector("zz") == 0).all() and model.vector("12") is None
    assert model.predict("zz") == ("a", 0.5)


def test_language_edges(spark, tricky, nothing, corpus):
    got = {(r.doc_id, r.lang_pred) for r in lg.identify_documents(tricky.union(corpus.where("doc_id > 20"))).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (8, "und"), (4, "en"), (None, "de")} <= got
    assert lg.identify_documents(nothing).count() == 0
    unlabelled = corpus.withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in lg.identify_documents(unlabelled).collect()} == {("und", 0.0)}
    clash = tricky.withColumn("copy_", F.lit(1)).withColumn("lang_pred", F.lit("x"))
    found = lg.identify(clash, lg.Model([], [{}], np.zeros((0, 0))), carry=("lang_pred", "copy_"))
    assert found.columns == ["copy_", "lang_pred", "score"] and {r.lang_pred for r in found.collect()} == {"und"}
    assert lg.keep_identified(clash.union(clash)).columns == clash.columns
    kept = lg.keep_identified(corpus)
    assert kept.columns == corpus.columns and kept.count() == 340


@pytest.fixture(scope="module")
def labelled(spark):
    rng, docs, labels = random.Random(9), [], []
    bad = ["vileword", "nastyone", "grimterm"]
    for i in range(900):
        words = prose(rng, rng.randint(15, 150)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(max(1, len(words) // 20)):
                # a third of them are rare expressions of one stem
                words[rng.randrange(len(words))] = rng.choice(bad) if i % 3 else "badstem" + prose(rng, 1)
        docs.append((i, " ".join(words), "en", "s", 0))
        if i % 10 != 9:
            labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(labelled):
    rows = tx.score_documents(*labelled).collect()
    assert len(rows) == 900
    tested = [r for r in rows if r.held_out]
    assert all(r.held_out == held(r.doc_id, 5) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    right = sum(r.predicted == (r.doc_id % 4 == 0) for r in tested)
    assert right >= 0.95 * len(tested)


def test_toxicity_edges(spark, labelled, tricky, nothing):
    docs, labels = labelled
    rows = tx.score_documents(docs.union(tricky.withColumn("doc_id", F.col("doc_id") + 5000)), labels.union(labels).union(spark.createDataFrame([(None, 1, 1), (3, 1, None), (5001, 0, 0)], labels.schema))).collect()
    assert len(rows) == 910 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (5001, 5002, 5003))
    assert tx.score_documents(nothing, labels).count() == 0
    assert {r.score for r in tx.score_documents(docs, labels.where("false")).collect()} == {0.0}
    assert {r.score for r in tx.score_documents(docs, labels.where("toxic = 1")).collect()} == {1.0}


def test_kneser_ney_probabilities(spark):
    """Continuation counts are discounted; the two classes share what that leaves."""
    rows = [(f"h{i}", "both", 1, 1) for i in range(40)] + [(f"h{i}", "toxic", 0, 1) for i in range(30)] + [("h0", "rare", 1, 0)]
    model = tx.kneser_ney(spark.createDataFrame(rows, "before string, word string, n0 long, n1 long"), tx.Classes(min_count=12))
    v, p = model.vocabulary, model.unigram
    assert p[1, v["toxic"]] > 10 * p[0, v["toxic"]] > 0
    assert "rare" not in v
    assert model.measures("both rare unseen")[0] == pytest.approx(0, abs=0.5)
    assert model.measures("toxic toxic")[0] > 1 and model.measures(None) == (0.0, 0)


def test_fixed_expressions_count(spark):
    """A word that always follows the same word has one kind of continuation, however often it occurs; its pair counts."""
    rows = [(f"h{i % 40}", f"w{i}", 20, 20) for i in range(400)] + [("foul", "phrase", 0, 900), ("h1", "foul", 0, 900), ("mild", "hint", 20, 60), ("h2", "mild", 40, 60)]
    model = tx.kneser_ney(spark.createDataFrame(rows, "before string, word string, n0 long, n1 long"), tx.Classes())
    v = model.vocabulary
    assert {"foul", "phrase", "mild", "hint"} <= set(v)
    assert {v["foul"] * len(v) + v["phrase"], v["mild"] * len(v) + v["hint"]} <= set(model.pairs.tolist())
    assert model.measures("foul phrase")[0] > 1 and model.measures("mild hint")[0] > 0
    assert (model.backoff > 0).all() and (model.backoff <= 1).all()


def brute_base(rows):
    counts = Counter()
    for i, text in rows:
        if not held(i, 10):
            counts.update((text or "").encode().lower().split())
            counts[b"\n"] += 1
    total, kinds = sum(counts.values()), len(counts)
    out = []
    for i, text in rows:
        words = [*(text or "").encode().lower().split(), b"\n"]
        out.append((i, held(i, 10), len(words), sum(counts[w] > 0 for w in words), total, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)))
    return out


@pytest.mark.parametrize("part", [5e-7, 0.01])
def test_base_columns(tricky, corpus, part):
    docs = tricky.union(corpus)
    want = brute_base([(r.doc_id, r.text) for r in docs.collect()])
    got = st.score_documents(docs, tree=st.Tree(frequent_part=part)).collect()
    key = lambda r: (r[0] is None, r[0], r[2], r[5])
    for a, b in zip(sorted(want, key=key), sorted((tuple(r[:6]) for r in got), key=key), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5])
    assert all(r.score < 0 for r in got)


def brute_tree(texts, tree):
    """Contexts by a dictionary, each symbol scored from its longest retained suffix."""
    d = tree.depth
    counts = [defaultdict(Counter) for _ in range(d + 1)]
    for t in texts:
        s = b"\0" * d + t + b"\n"
        for i in range(d, len(s)):
            for k in range(d + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    kept = {}

    def probability(context, s):
        while context and context not in kept:
            context = context[1:]
        n, size, kinds = kept[context]
        return (n[s] + kinds * (probability(context[1:], s) if context else 1 / 256)) / (size + kinds)

    for k, level in enumerate(counts):
        for c, n in level.items():
            size, kinds = sum(n.values()), len(n)
            if k == 0:
                kept[c] = n, size, kinds
            elif size >= tree.min_count:
                gain = sum(x * math.log(x / size / probability(c[1:], s)) for s, x in n.items())
                if gain > tree.penalty * 0.5 * kinds * math.log(size):
                    kept[c] = n, size, kinds

    def score(t):
        s = b"\0" * d + t + b"\n"
        return sum(math.log10(probability(s[i - d : i], s[i])) for i in range(d, len(s)))

    return score, len(kept)


@pytest.mark.parametrize("tree", [st.Tree(depth=3, min_count=20, penalty=0.5), st.Tree(depth=7, min_count=4), st.Tree(depth=7, min_count=4, shard_rows=900)])
def test_tree_scores(corpus, tree):
    rows = corpus.collect()
    plain = {r.doc_id: b" ".join(r.text.encode().lower().split()) for r in rows}
    score, _ = brute_tree([t for i, t in plain.items() if not held(i, 10)], tree)
    got = st.score_documents(corpus, tree=tree).collect()
    assert len(got) == len(rows)
    for r in got[:80]:
        assert r.score == pytest.approx(score(plain[r.doc_id]), rel=1e-4), r.doc_id
    tested = [r for r in got if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested)


def test_ranges_bound_the_broadcast(corpus):
    tree = st.Tree(depth=7, min_count=4, shard_rows=900)
    nodes = st.retained(st.count(corpus, "text", tree.depth), tree)
    spans = st.ranges(nodes, tree)
    sizes = [sum(len(rows) for _, _, rows, _ in st.shard(nodes, low, high, tree.depth).levels) for low, high in spans]
    assert len(spans) > 2 and max(sizes) <= tree.shard_rows + tree.depth * 256
    assert sum(sizes) >= nodes.count()


@pytest.mark.parametrize("piece", [50, 400_000])
def test_contexts_of_pieces(corpus, piece):
    counts = st.count(corpus, "text", 3)
    rows = [(r.key & (2**64 - 1), r.n) for r in counts.where("kind = 1").collect()]
    want = [defaultdict(Counter) for _ in range(4)]
    for key, n in rows:
        for d in range(4):
            want[d][key >> 8 & st.newest(d)][key & 255] += n
    mapper, got = st._Contexts(st.Tree(depth=3, min_count=5), piece), [defaultdict(Counter) for _ in range(4)]
    rows.sort(key=lambda r: r[0] >> 8)
    pieces = [pa.RecordBatch.from_pydict({"key": np.array([k for k, _ in part], np.uint64).view(np.int64), "n": [n for _, n in part]}) for part in (rows[i : i + 40] for i in range(0, len(rows), 40))]
    for batch in mapper(iter(pieces)):
        for r in batch.to_pylist():
            assert not r["whole"] or dict(r["next"]) == want[r["d"]][r["context"]]
            got[r["d"]][r["context"]].update(dict(r["next"]))
    for d in range(4):
        big = {c for c, n in want[d].items() if sum(n.values()) >= 5}
        assert all(got[d][c] == want[d][c] for c in big)


def test_tree_grows_with_the_corpus(corpus):
    """Contexts are tested by their own count, so more of the same kind of text brings more of them."""
    contexts = [st.retained(st.count(corpus.where(f"doc_id < {n}"), "text", 7), st.Tree(depth=7)).select("d", "context").distinct().count() for n in (75, 150, 300)]
    assert contexts[0] < contexts[1] < contexts[2]


def test_tree_edges(nothing, tricky):
    assert st.score_documents(nothing).count() == 0
    empty = tricky.where("doc_id <= 3").withColumn("text", F.lit(None).cast("string"))
    assert {(r.n_tokens, round(r.score, 3) <= 0) for r in st.score_documents(empty).collect()} == {(1, True)}
