"""Toxicity by two Kneser-Ney models, one of toxic and one of ordinary texts, with shared backoff counts."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, stage

#: ASCII letters to lower case, marks and control characters to blanks; other characters stay.
_MARKS = {c: " " for c in range(128) if not chr(c).isalnum()} | {ord(c): " " for c in "«»„“”‘’…–—¿¡ "}
START, OTHER, PREFIX = "\n", "\t", "\v"


@dataclass(frozen=True)
class Classes:
    """``sample_chars``, ``sample_rows``: per class, labelled texts are sampled by id hash to about so many
    characters and rows at most; both classes get as many characters, the smaller class's if that is less,
    so that chance finds favour neither. For calibration up to eight times as many ordinary rows count.
    So no more than about 3 ``sample_rows`` ids are ever chosen, and these are broadcast.
    Every eighth of them (by id) is kept for calibration.

    ``min_count``: a word with fewer occurrences in both classes together backs off to its longest prefix
    of at least ``min_prefix`` characters that has as many, else to what all rare words share; word pairs need
    as many occurrences. ``discount``: absolute discount. ``min_z``: where the counts of the classes differ by
    so many standard deviations (twice as many for pairs), half of the difference counts (for words, of their log ratio); of smaller ones
    less, of larger ones more, so that the many words of a long text that say nothing add little noise.
    """

    sample_chars: int = 20_000_000
    sample_rows: int = 50_000
    min_count: int = 12
    min_prefix: int = 4
    discount: float = 0.75
    min_z: float = 3.5


def words(text: str | None) -> list[str]:
    return (text or "").lower().translate(_MARKS).split()


class _Pairs:
    """(toxic, before, word, n): counts of word pairs of a slice of rows."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            counts = (Counter(), Counter())
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = words(text)
                counts[toxic].update(zip([START, *own], own))
            for toxic, pairs in enumerate(counts):
                if pairs:
                    before, word = zip(*pairs)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(pairs), toxic, np.int32)),
                            pa.array(before, pa.string()),
                            pa.array(word, pa.string()),
                            pa.array(list(pairs.values()), pa.int64()),
                        ],
                        names=["toxic", "before", "word", "n"],
                    )


class Model:
    """Log ratios of the two models by word and by frequent word pair, and the calibration of a text's ratio."""

    def __init__(self, vocabulary: dict[str, int], unigram: np.ndarray, backoff: np.ndarray, pairs: np.ndarray, kept: np.ndarray, min_prefix: int):
        """``unigram``: P(word) by class; ``backoff``: what a context leaves to it, by class; ``pairs``: keys before * V + word, sorted; ``kept``: their discounted share by class."""
        self.vocabulary, self.unigram, self.backoff, self.pairs, self.kept = vocabulary, unigram, backoff, pairs, kept
        self.min_prefix, self._rare = min_prefix, {}
        self.weights, self.mean, self.scale = None, None, None

    def measures(self, text: str | None) -> tuple[float, int]:
        """Length-normalised log-likelihood difference, toxic minus ordinary, and the number of words."""
        get = self.vocabulary.get
        ids = np.array([1, *[at if (at := get(w)) is not None else self.rare(w) for w in words(text)]], np.int64)
        n = len(ids) - 1
        if not n:
            return 0.0, 0
        before, word = ids[:-1], ids[1:]
        p = self.backoff[:, before] * self.unigram[:, word]
        if len(self.pairs):
            key = before * len(self.vocabulary) + word
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            hit = np.flatnonzero(self.pairs[at] == key)
            p[:, hit] += self.kept[:, at[hit]]
        return float(np.log(p[1] / p[0]).sum()) / n, n

    def rare(self, word: str) -> int:
        """Symbol of a word's longest known prefix; ``OTHER`` without one. Kept for the words met last."""
        found = self._rare.get(word)
        if found is None:
            found, get = 0, self.vocabulary.get
            for n in range(len(word) - 1, self.min_prefix - 1, -1):
                at = get(PREFIX + word[:n])
                if at is not None:
                    found = at
                    break
            if len(self._rare) >= 200_000:
                self._rare.clear()
            self._rare[word] = found
        return found

    @staticmethod
    def features(found: list[tuple[float, int]]) -> np.ndarray:
        """The difference per word, and in all, on a scale that large values don't dominate."""
        d, n = np.array([x for x, _ in found], float), np.array([n for _, n in found], float)
        return np.stack([np.arcsinh(100 * d), np.arcsinh(d * n)], axis=1)

    def calibrate(self, found: list[tuple[float, int]], toxic: np.ndarray) -> None:
        """Logistic regression with a small ridge, by Newton steps."""
        x = self.features(found)
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w, ridge = np.zeros(x.shape[1]), np.diag([1e-2] * (x.shape[1] - 1) + [1e-6])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (toxic - p) - ridge @ w)
            w += np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def scores(self, found: list[tuple[float, int]]) -> np.ndarray:
        x = np.c_[(self.features(found) - self.mean) / self.scale, np.ones(len(found))]
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


class Constant:
    """Where labels of one class or none are there to learn from."""

    def __init__(self, value: float):
        self.value = value

    def measures(self, text: str | None) -> tuple[float, int]:
        return 0.0, 0

    def scores(self, found: list[tuple[float, int]]) -> np.ndarray:
        return np.full(len(found), self.value)


def kneser_ney(counts: DataFrame, how: Classes) -> Model:
    """Both models from pair counts (before, word, n0, n1).

    A symbol is a word with enough occurrences, after however few words, the prefix of rare words, or ``OTHER``; its counts are continuations, kinds of
    words before it by class. Class counts are discounted; what that leaves goes to the counts of both
    classes together, and theirs to a uniform share. How words of one prefix share its probability is
    the same in both classes, so it takes no part in the comparison.
    """
    n0, n1 = F.col("n0"), F.col("n1")
    on = [F.sum((n > 0).cast("long")).alias(k) for n, k in ((n0, "k0"), (n1, "k1"))]
    by_word = stage(counts.groupBy("word").agg(*on, F.sum(n0 + n1).alias("n")), "words")
    prefixes = F.transform(
        F.sequence(F.lit(how.min_prefix), F.greatest(F.length("word") - 1, F.lit(how.min_prefix))),
        lambda i: F.concat(F.lit(PREFIX), F.substring("word", F.lit(1), i)),
    )
    rare = by_word.where((F.col("n") < how.min_count) & (F.length("word") > how.min_prefix))
    by_prefix = rare.select(F.explode(prefixes).alias("word"), "k0", "k1", "n").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("k0", "k1", "n")])
    total = by_word.agg(F.sum("k0").alias("k0"), F.sum("k1").alias("k1")).first()
    table = by_word.union(by_prefix).where(F.col("n") >= how.min_count).orderBy("word").toPandas()
    vocabulary = {OTHER: 0, START: 1} | {w: i + 2 for i, w in enumerate(table["word"])}
    size, d = len(vocabulary), how.discount
    k = np.zeros((size, 2))
    k[2:] = table[["k0", "k1"]].to_numpy(float)
    totals = np.maximum(np.array([total["k0"], total["k1"]], float), 1)
    k[0] = np.maximum(totals - k[2:].sum(axis=0), 1)
    shared = np.maximum(k.sum(axis=1) - d, 0) / totals.sum() + d * size / totals.sum() / size
    unigram = np.empty((2, size))
    for c in (0, 1):
        unigram[c] = np.maximum(k[:, c] - d, 0) / totals[c] + d * (k[:, c] > 0).sum() / totals[c] * shared
    apart = trust(k, totals, how.min_z)
    apart[:2] = 0
    unigram = unigram**apart * unigram.mean(axis=0) ** (1 - apart)
    by_before = counts.groupBy(F.col("before").alias("word")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    by_before = by_before.where(n0 + n1 >= how.min_count).toPandas()
    contexts = np.zeros((2, size))
    known = by_before[by_before["word"].isin(vocabulary)]
    contexts[:, known["word"].map(vocabulary).to_numpy(np.int64)] = known[["n0", "n1"]].to_numpy(float).T
    pairs = counts.where(n0 + n1 >= how.min_count).toPandas()
    sizes = np.maximum(np.array(counts.agg(F.sum("n0"), F.sum("n1")).first()[:], float), 1)
    pairs = pairs[pairs["word"].isin(vocabulary) & pairs["before"].isin(vocabulary)]
    before, word = pairs["before"].map(vocabulary).to_numpy(np.int64), pairs["word"].map(vocabulary).to_numpy(np.int64)
    order = np.argsort(before * size + word)
    before, word = before[order], word[order]
    n = pairs[["n0", "n1"]].to_numpy(float)[order]
    kept, backoff = np.maximum(n.T - d, 0) / np.maximum(contexts[:, before], 1), np.ones((2, size))
    most = np.max([np.bincount(before, kept[c], size) for c in (0, 1)], axis=0)
    # a pair that says little beyond its word has the classes' ratio of the word
    apart = trust(n, sizes, 2 * how.min_z)
    kept = apart * kept + (1 - apart) * kept.mean(axis=0) * unigram[:, word] / unigram[:, word].mean(axis=0)
    for c in (0, 1):
        mass = np.bincount(before, kept[c], size)
        kept[c] *= np.minimum(most / np.maximum(mass, 1e-12), 1)[before]
        backoff[c] -= np.bincount(before, kept[c], size)
    return Model(vocabulary, unigram, np.maximum(backoff, 1e-6), before * size + word, kept, how.min_prefix)


def trust(counts: np.ndarray, totals: np.ndarray, z: float) -> np.ndarray:
    """0 to 1: how far the rates of two classes (rows of counts) are told apart, a half at ``z`` standard deviations."""
    rates = counts / totals
    variance = counts.sum(axis=1) / totals.sum() * (1 / totals).sum()
    fourth, half = (rates[:, 1] - rates[:, 0]) ** 4, (z * z * variance) ** 2
    return fourth / np.maximum(fourth + half, 1e-300)


class _Measure:
    def __init__(self, model, score: bool):
        self.model, self.score = model, score

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in slices(batches, 1024):
            found = [model.measures(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            names = batch.schema.names[:-1]
            if self.score:
                new, label = [pa.array(model.scores(found))], ["score"]
            else:
                new, label = [pa.array([d for d, _ in found], pa.float64()), pa.array([n for _, n in found], pa.int64())], ["d", "n"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*names, *label])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", how: Classes = Classes()) -> Model | Constant:
    """Learns both models from a sample of the rows with a label of 0 or 1; a document with both labels counts as toxic."""
    own = labels.where(F.col(toxic).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(F.max(toxic).cast("int").alias("toxic"))
    lengths = docs.select(F.col(doc_id).alias("doc"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"))
    slim = lengths.join(own, F.col("doc") == F.col("id")).select("id", "toxic", "chars", F.xxhash64("id").alias("h"))
    slim = stage(slim, "labelled")
    counted = slim.groupBy("toxic").agg(F.sum("chars").alias("chars"), F.count(F.lit(1)).alias("rows")).collect()
    sizes, rows = {r["toxic"]: r["chars"] for r in counted}, {r["toxic"]: r["rows"] for r in counted}
    if not sizes.get(0) or not sizes.get(1):
        return Constant(1.0 if sizes.get(1) else 0.0)
    most, n = min(how.sample_chars, sizes[0], sizes[1]), F.lit(1_000_003)
    share = {c: min(most / sizes[c], how.sample_rows / rows[c]) for c in (0, 1)}
    part = F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])
    wide = F.when(F.col("toxic") == 1, share[1]).otherwise(8 * share[0])
    flagged = slim.select(
        "id",
        "toxic",
        (F.pmod("h", n) < part * n).alias("drawn"),
        (F.pmod(F.shiftright("h", 24), F.lit(8)) == 0).alias("aside"),
        (F.pmod(F.shiftright("h", 8), n) < wide * n).alias("wide"),
    )
    chosen = flagged.where("drawn OR aside AND wide").distinct()
    # texts are read once more and meet the chosen ids, which are few, without a shuffle
    texts = docs.select(F.col(doc_id).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    used = stage(texts.join(F.broadcast(chosen), F.col("doc") == F.col("id")).select("toxic", "drawn", "aside", "wide", "text"), "drawn")
    counted = used.where("drawn AND NOT aside").select("toxic", "text").mapInArrow(_Pairs(), "toxic int, before string, word string, n long")
    n = [F.sum(F.when(F.col("toxic") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in (0, 1)]
    counts = stage(counted.groupBy("before", "word").agg(*n), "counts")
    if not all(counts.agg(F.sum("n0"), F.sum("n1")).first()):
        return Constant(0.0)
    model = kneser_ney(counts, how)
    measure = _Measure(docs.sparkSession.sparkContext.broadcast(model), False)
    for test in (used.where("aside AND wide"), used.where("drawn")):  # all that was drawn, if too few lie aside
        found = test.select("toxic", "text").mapInArrow(measure, "toxic int, d double, n long").toPandas()
        if found["toxic"].nunique() == 2:
            break
    model.calibrate(list(zip(found["d"], found["n"])), found["toxic"].to_numpy(float))
    return model


def score_documents(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", how: Classes = Classes()) -> DataFrame:
    """(doc_id, held_out, score, predicted) for the whole text of every row; labels only of rows whose fold of five is not 0.

    Null and blank texts have no evidence and get the score of the calibration at length 0. Null ids are
    held out. Labels that are null or not 0 or 1 are left out; without both classes the score is 1 if only
    toxic rows are labelled, else 0. Repeated rows count and come back as often as they occur.
    """
    held = fold(doc_id, 5) == 0
    model = docs.sparkSession.sparkContext.broadcast(train(docs.where(~held), labels, doc_id, text, how=how))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), held.alias("held_out"), F.col(text).alias("text"))
    scored = rows.mapInArrow(_Measure(model, True), f"id {kind}, held_out boolean, score double")
    return scored.select(F.col("id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
