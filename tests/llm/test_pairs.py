"""Near-duplicates and decontamination against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from attestra.llm import decontaminate as dc
from attestra.llm import simhash as sh
from attestra.llm.components import components


def brute_print(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_classes(prints, radius=3):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("name", ["tricky", "corpus", "nothing"])
def test_documents(request, name):
    docs = request.getfixturevalue(name)
    rows, got = docs.collect(), sh.near_duplicates(docs).collect()
    prints = [brute_print(r.text) for r in rows]
    classes = brute_classes(prints)
    least = {}
    for r, c in zip(rows, classes):
        ids = [i for i in (least.get(c), r.doc_id) if i is not None]
        least[c] = min(ids) if ids else None
    want = [(r.doc_id, f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, classes)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_dense_cells_and_chains(spark, monkeypatch):
    """Many prints within few bits of each other, in cells of several chunks, and chains of one-bit steps."""
    monkeypatch.setattr(sh, "CHUNK", 16)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(300)}
    x = rng.getrandbits(64)
    for _ in range(60):
        x ^= 1 << rng.randrange(64)
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = sh.near_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    assert links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > 64).count() == 0
    roots = dict(map(tuple, components(links).collect()))
    classes = brute_classes(prints)
    by_class = {}
    for p, c in zip(signed, classes):
        by_class.setdefault(c, []).append(p)
    for group in by_class.values():
        assert {roots.get(p, p) for p in group} == {min(group)}


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 2000, dtype=np.int64).view(np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k, replace=False)) for k in rng.integers(0, 6, 2000)], np.uint64)
    assert (sh.near(x, x ^ flips, 3) == (np.bitwise_count(flips) <= 3)).all()


def test_one_of_each_group_stays(tricky, corpus):
    kept = sh.drop_near_duplicates(corpus)
    found = {(r.component_id, r.doc_id) for r in sh.near_duplicates(corpus).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c, _ in found})
    assert kept.columns == corpus.columns
    clash = tricky.withColumn("kept_id", F.lit(1))
    ids = [r.doc_id for r in sh.drop_near_duplicates(clash).collect()]
    assert len(ids) == len(set(ids)) and {1, 4, 7} <= set(ids)


def test_rows_without_an_id_of_their_own_stay(spark):
    """Null and repeated ids: each group keeps a row, and no group takes another's."""
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdefg"}
    rows = [(None, "a", "x"), (None, "b", "x"), (None, "b", "y"), (None, "c", "x"), (1, "c", "x"), (1, "d", None), (1, "d", None), (2, "e", None), (None, "f", None), (3, "g", "x"), (3, "g", "y")]
    docs = spark.createDataFrame([(i, texts[k], n) for i, k, n in rows], "doc_id long, text string, note string")
    name = {t: k for k, t in texts.items()}
    kept = sh.drop_near_duplicates(docs, unique_ids=False)
    assert kept.columns == docs.columns
    found = [(r.doc_id, name[r.text]) for r in kept.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, [(None, "a"), (None, "b"), (1, "c"), (1, "d"), (2, "e"), (None, "f"), (3, "g")]))
    once = [(r.doc_id, name[r.text]) for r in sh.drop_near_duplicates(docs).collect()]
    assert {t for i, t in once if i is None} == {"a", "b", "f"} and sorted(i for i, _ in once if i) == [1, 2, 3]
    alike = spark.createDataFrame([(None, None, "x"), (None, "x", None)], docs.schema)  # nulls count by where they are
    assert sh.drop_near_duplicates(alike, unique_ids=False).count() == 2


def passages(rng, n, words):
    return [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(words))) for i in range(n)]


def test_passages_with_substitutions_are_found(spark):
    rng = random.Random(2)
    items = passages(rng, 20, 30)
    rows, want = [], set()
    for d in range(120):
        filler = [f"w{rng.randrange(300)}" for _ in range(200)]
        if d % 3 == 0:
            k = d % 20
            words = items[k][1].split()
            for at in rng.sample(range(30), d % 4):
                words[at] = "other"
            filler[50:50] = [w.upper() + "," for w in words]
            want.add((d, k))
        rows.append((d, " ".join(filler)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for seeds in (dc.Seeds(), dc.Seeds(block_tokens=50)):
        found = dc.find_overlaps(docs, bench, seeds=seeds).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert all(r.overlap_start == 50 or r.overlap_tokens < 30 for r in found)
        kept = {r.doc_id for r in dc.drop_contaminated(docs, bench, seeds).collect()}
        assert kept == set(range(120)) - {d for d, _ in want}


def test_any_single_substitution_in_thirteen_tokens_is_met():
    index = dc.Index([(0, b" ".join(b"t%d" % i for i in range(13)))], dc.Seeds(min_match=0.9))
    for at in range(13):
        ids = np.arange(1, 14, dtype=np.uint64)
        ids[at] = 0
        assert index.diagonals(ids) == {(0, 0)}


def test_longest_stretch_against_all():
    rng = random.Random(4)
    for _ in range(200):
        flags = np.array([rng.random() < 0.75 for _ in range(rng.randint(1, 40))])
        n = len(flags)
        best = max((j - i for i in range(n) for j in range(i + 1, n + 1) if flags[i:j].sum() >= 0.8 * (j - i) - 1e-9), default=0)
        i, j = dc.longest_stretch(flags, 0.8)
        assert j - i <= best and (not best or flags[i:j].mean() >= 0.8 - 1e-9 and best - (j - i) <= 0.2 * best + 1)


def test_decontamination_edges(spark, tricky, nothing):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "same text here same text"), (4, "same text here same text"), (None, "1234 5678")], "item_id long, text string")
    found = sorted((r.doc_id, r.item_id) for r in dc.find_overlaps(tricky, bench).where("item_id is not null").collect())
    assert found == [(7, 3), (7, 3), (7, 4), (7, 4)]
    assert dc.find_overlaps(nothing, bench).count() == 0
    assert dc.find_overlaps(tricky, bench.where("false")).count() == 0
    clash = tricky.withColumn("body_", F.lit("x"))
    assert dc.drop_contaminated(clash, bench).columns == clash.columns
    assert dc.drop_contaminated(tricky, bench.where("false")).count() == tricky.count()
