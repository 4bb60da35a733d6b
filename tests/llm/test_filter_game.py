"""The filter audit against applying every order to every document."""

import math
import re
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from attestra.llm.filter_game import audit_filters, coalition_worths, potentials

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failures(rows):
    """Letters each row fails."""
    ids = {}
    for r in rows:
        if r.doc_id is not None:
            ids[r.text or ""] = min(r.doc_id, ids.get(r.text or "", r.doc_id))
    for r in rows:
        text = r.text or ""
        words = WORD.findall(text)
        yield {
            letter
            for letter, failed in {
                "A": len(words) < 200,
                "B": 100 * len(set(words)) < 50 * len(words),
                "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
                "D": bool(re.search(r"[#$%&*|]", text)),
                "E": r.doc_id is not None and r.doc_id > ids[text],
            }.items()
            if failed
        }


def audit(rows, labels):
    out, gone = [], list(failures(rows))
    for part in {r.lang or "" for r in rows}:
        mine = [(f, labels.get(r.doc_id, (0, 0))) for r, f in zip(rows, gone) if (r.lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = mine
            for k, letter in enumerate(order):
                hit = [x for x in left if letter in x[0]]
                left = [x for x in left if letter not in x[0]]
                shapley[letter] += len(hit)
                fails = sum(letter in f for f, _ in mine)
                alone = sum(f == {letter} for f, _ in mine)
                good, toxic = (sum(y[i] == 1 for _, y in hit) for i in (0, 1))
                lines.append((part, "".join(order), k + 1, len(left), len(hit), fails - len(hit), alone, good, toxic))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in lines]
    return sorted(out)


@pytest.fixture(scope="module")
def mixed(spark, tricky, corpus):
    loud = [(500 + i, "LOUD words # " * (30 + 20 * i), ("en", None, "")[i % 3], "a", 0) for i in range(12)]
    copies = [(600 + i % 9, "a copy of it " * 60, ("de", "en")[i % 2], "a", 0) for i in range(40)]
    nobody = [(None, "a copy of it " * 60, "de", "a", 0)] * 5 + [(None, None, None, None, None)] * 3
    return tricky.union(corpus).union(spark.createDataFrame(loud + copies + nobody, corpus.schema))


def test_every_order(spark, mixed):
    pairs = [(i, int(i % 3 == 0), int(i % 7 == 0)) for i in range(0, 620, 2)] + [(None, 1, 1), (600, None, None), (5, 1, None)]
    labels = spark.createDataFrame(pairs + [(8, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int")
    known = {i: (q, t) for i, q, t in pairs if i is not None} | {8: (1, 1)}
    got = audit_filters(mixed.withColumn("mask", F.lit("x")).withColumn("key", F.lit(1)), labels)
    assert sorted(map(tuple, got.collect())) == audit(mixed.collect(), known | {600: (1, 0)})


def test_potential_is_the_recursion(spark):
    counts = [("p", m, (m * 7) % 11 + 1, 0, 0) for m in range(32)]
    game = coalition_worths(spark.createDataFrame(counts, "part string, mask int, docs long, good long, toxic long"))
    row = game.select("docs", potentials(F.col("docs")).alias("potential")).first()
    worth = {}
    for size in range(6):
        for s in combinations(range(5), size):
            bits = sum(1 << i for i in s)
            assert row.docs[bits] == sum(n for _, m, n, _, _ in counts if m & bits)
            # the sum of marginal contributions to the potential is the worth of the coalition
            worth[bits] = row.potential[bits]
            marginal = sum(worth[bits] - worth[bits - (1 << i)] for i in s)
            assert marginal == math.factorial(5) * row.docs[bits]


def test_empty_and_other_filters(spark, nothing, tricky):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(nothing, labels).count() == 0
    short = {"s": F.length("text") < 10, "n": F.col("text").isNull()}
    rows = audit_filters(tricky, labels, failures=short, copies="c").where("part = 'en'").collect()
    assert len(rows) == 18 and {r.filter_order for r in rows} == {"".join(p) for p in permutations("snc")}
    assert {r.shapley for r in rows if r.filter_order[r.step - 1] == "s"} == {6}
