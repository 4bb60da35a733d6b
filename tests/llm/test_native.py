"""Host rules and curriculum against plain Python models."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra.llm.common import running
from attestra.llm.curriculum import Mix, mix_documents, mixed, plan_mix
from attestra.llm.host_rules import HostRules, judge, keep_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(grams)
    covered = {i + d for i, g in enumerate(grams) if seen[g] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures(spark, tricky, corpus):
    extra = spark.createDataFrame(
        [(90, "a b c a b c\n\na b c\n x\n x\n#|*", "en", "a", 0), (91, "one two", "en", "a", 0), (92, "é ü x\x0b\x0cy", "en", "a", 0)], tricky.schema
    )
    rows = judge(tricky.union(extra).union(corpus)).collect()
    assert len(rows) == tricky.count() + 3 + 340
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measures(r.text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_no_python_on_the_path(tricky):
    plan = judge(tricky)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bad_host_takes_its_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, good, "good") for i in range(30)] + [(100 + i, good if i < 4 else "short", "bad") for i in range(30)]
    rows += [(200, good, "tiny"), (201, "short", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in keep_documents(docs).collect()}
    # one document of its own says little about a host, so the tiny host is drawn to the others
    assert kept == {*range(30), 200}


def test_mostly_failing_corpus_keeps_its_good_documents(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame(
        [(i, good if i % 20 < 9 else "short", f"host{i % 3}") for i in range(600)], "doc_id long, text string, source string"
    )
    assert {r.doc_id for r in keep_documents(docs).collect()} == {i for i in range(600) if i % 20 < 9}
    assert "text" not in judge(docs, with_text=False).columns


def test_clashing_names_and_empty(spark, nothing, tricky):
    assert judge(nothing).count() == 0
    clash = tricky.withColumn("n_words", F.lit("x")).withColumn("words_", F.lit(1)).withColumn("kept", F.lit(None))
    assert [f.dataType.simpleString() for f in judge(clash).schema if f.name == "n_words"] == ["bigint"]
    assert judge(clash).count() == tricky.count()
    kept = keep_documents(clash)
    assert kept.columns == clash.columns and {r.n_words for r in kept.collect()} == {"x"}


def test_running_sums(spark):
    rows = [(i % 3 if i % 5 else None, (i * 7) % 11, i, i % 4) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, o int, i int, v int")
    got = {r.i: r.before for r in running(df, "v", "before", [F.col("o"), F.col("i")], group="g").collect()}
    for g, o, i, v in rows:
        assert got[i] == sum(w for h, p, j, w in rows if h == g and (p, j) < (o, i))


def targets(sizes, mix):
    names = sorted(k for k in sizes if k is not None) + ([None] if None in sizes else [])
    weight = {k: mix.weights[i % 3] for i, k in enumerate(names)}
    words, out, left = mix.share * sum(sizes.values()), {}, set(names)
    while left:
        level = (words - sum(out.values())) / sum(weight[k] for k in left)
        over = {k for k in left if weight[k] * level >= mix.repeats * sizes[k]}
        if not over:
            return out | {k: weight[k] * level for k in left}
        out |= {k: float(mix.repeats * sizes[k]) for k in over}
        left -= over
    return out


@pytest.mark.parametrize("name", ["corpus", "tricky"])
def test_targets_and_taken(request, name):
    docs = request.getfixturevalue(name)
    rows = plan_mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, want = Counter(), None
    for r in rows:
        sizes[r.source] += r.size
    want = targets(sizes, Mix())
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    assert all(abs(taken[k] - want[k]) <= 0.5 for k in sizes)
    again = plan_mix(docs.repartition(5)).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_order_in_a_source(corpus):
    rows = [r for r in plan_mix(corpus).collect() if r.source == "src1"]
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in rows), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())


def test_training_order(corpus, nothing):
    assert mix_documents(nothing).count() == 0
    mixed = mix_documents(corpus.withColumn("position", F.lit("clash")))
    rows = mixed.collect()
    words = {r.doc_id: len(r.text.split()) for r in corpus.collect()}
    at = 0
    for r in sorted(rows, key=lambda r: (r.position, r.pass_no)):
        assert r.position == at and r.words_taken <= words[r.doc_id]
        at += r.words_taken
    times = [r.train_time for r in sorted(rows, key=lambda r: r.position)]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    # a fading source has more of its words in the first half than in the second
    half = Counter()
    for r in rows:
        half[r.source, r.train_time < 0.5] += r.words_taken
    assert half["src0", True] > 1.3 * half["src0", False] and half["src1", False] > 1.3 * half["src1", True]


def test_documents_in_training_order(spark, corpus, nothing, tricky):
    """A document's passes add up, and rows follow the position of their first pass, as ``mix_documents`` has it."""
    assert mixed(plan_mix(nothing)).count() == 0
    rows = mixed(plan_mix(corpus.union(corpus.limit(20)))).collect()
    assert len(rows) == corpus.count() + 20
    taken = [r for r in rows if r.taken]
    assert all((r.position is None) == (r.taken == 0) and (r.first_time is None) == (r.taken == 0) for r in rows)
    assert [r.position for r in rows] == sorted((r.position for r in taken)) + [None] * (len(rows) - len(taken))
    assert all(r.taken == r.taken1 + r.taken2 for r in rows)
    assert sorted(repr((r.doc_id, r.size, r.taken)) for r in mixed(plan_mix(tricky)).collect()) == sorted(
        repr((r.doc_id, r.size, r.taken)) for r in plan_mix(tricky).collect()
    )
    single, first = mixed(plan_mix(corpus)).collect(), {}
    for r in mix_documents(corpus).collect():
        first[r.doc_id] = min(first.get(r.doc_id, (9.0, 0)), (r.train_time, r.words_taken))
    assert {r.doc_id: r.first_time for r in single if r.taken} == pytest.approx({i: t for i, (t, _) in first.items()})
