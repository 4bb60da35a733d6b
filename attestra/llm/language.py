"""Language identification: known words by their frequency per language, unseen words by shorter and shorter n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, stage

#: Stripped from the ends of a word.
EDGE = ".,;:!?\"'()[]{}<>«»„“”‘’…*#$%&|/\\-–—_=+~^`@0123456789"
UNKNOWN = "und"


@dataclass(frozen=True)
class Training:
    """``sample_chars``: per language, texts are sampled by id hash to about so many characters in all.

    The model is a classifier on a bounded sample: with L languages it has at most 6 L ``sample_chars`` items.
    Words and n-grams seen less than ``min_word`` and ``min_gram`` times are left to the backoff.
    """

    sample_chars: int = 4_000_000
    max_gram: int = 5
    min_word: int = 2
    min_gram: int = 3
    alpha: float = 0.1


def word_counts(text: str | None) -> Counter:
    """Lower-case words without marks at their ends; only those with a letter."""
    counts: Counter = Counter()
    for token, n in Counter((text or "").lower().split()).items():
        word = token.strip(EDGE)
        if word and any(map(str.isalpha, word)):
            counts[word] += n
    return counts


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams of a word with a blank on either side; single characters without the blanks."""
    if n == 1:
        return list(word)
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class _Count:
    """(lang, level, item, n): level 0 are words, n >= 1 are n-grams; counts of a slice of rows each."""

    def __init__(self, max_gram: int):
        self.max_gram = max_gram

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words.setdefault(lang, Counter()).update(word_counts(text))
            rows: list[tuple[str, int, str, int]] = []
            for lang, counts in words.items():
                rows += [(lang, 0, w, n) for w, n in counts.items()]
                for level in range(1, self.max_gram + 1):
                    grams: Counter = Counter()
                    for w, n in counts.items():
                        for g in grams_of(w, level):
                            grams[g] += n
                    rows += [(lang, level, g, n) for g, n in grams.items()]
            if rows:
                columns = list(zip(*rows))
                types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["lang", "level", "item", "n"]
                )


class Model:
    """Languages, items by level and log frequencies by item and language. Small enough to broadcast, see ``Training``."""

    def __init__(self, langs: list[str], levels: list[dict[str, int]], log: np.ndarray):
        self.langs, self.levels, self.log = langs, levels, log
        self._seen: dict[str, np.ndarray | None] = {}

    def vector(self, token: str) -> np.ndarray | None:
        """Log frequencies of a lower-case token by language; None if it has no letter."""
        word = token.strip(EDGE)
        if not any(map(str.isalpha, word)):
            return None
        at = self.levels[0].get(word)
        if at is not None:
            return self.log[at]
        for n in range(len(self.levels) - 1, 0, -1):
            known = self.levels[n]
            found = [at for g in grams_of(word, n) if (at := known.get(g)) is not None]
            if found:
                return self.log[found].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Likeliest language, ties to the first by name, and its share of the probability."""
        seen, total, any_word = self._seen, np.zeros(len(self.langs)), False
        rows, times = [], []
        for token, n in Counter((text or "").lower().split()).items():
            try:
                v = seen[token]
            except KeyError:
                if len(seen) >= 200_000:
                    seen.clear()
                v = seen[token] = self.vector(token)
            if v is not None:
                any_word = True
                rows.append(v)
                times.append(n)
        if not any_word or not self.langs:
            return UNKNOWN, 0.0
        total = np.asarray(times, np.float64) @ np.asarray(rows)
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.langs[best], float(share[best] / share.sum())


def train(docs: DataFrame, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", how: Training = Training()) -> Model:
    """Counts words and n-grams of a sample of the rows with a language. Without such rows the model knows no language."""
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(doc_id).alias("h")
    )
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"))
    parts = [x for r in sizes.collect() for x in (F.lit(r["lang"]), F.lit(how.sample_chars / r["chars"]))]
    if not parts:
        return Model([], [{}], np.zeros((0, 0), np.float32))
    part = F.element_at(F.create_map(*parts), F.col("lang"))
    sample = rows.where(F.pmod("h", F.lit(1_000_003)) < part * 1_000_003).select("lang", "text")
    counted = sample.mapInArrow(_Count(how.max_gram), "lang string, level int, item string, n long")
    items = counted.groupBy("level", "item", "lang").agg(F.sum("n").alias("n"))
    items = stage(items, "lang-items")
    totals = items.groupBy("level", "lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).toPandas()
    langs = sorted(totals["lang"].unique())
    least = F.when(F.col("level") == 0, how.min_word).otherwise(how.min_gram)
    kept = (
        items.groupBy("level", "item")
        .agg(F.sum("n").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by"))
        .where(F.col("all") >= least)
        .select("level", "item", *[F.coalesce(F.element_at("by", x), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    ).toPandas()
    levels: list[dict[str, int]] = [{} for _ in range(how.max_gram + 1)]
    log = np.zeros((len(kept), len(langs)), np.float32)
    for at, (level, item) in enumerate(zip(kept["level"], kept["item"])):
        levels[level][item] = at
    for i in range(len(langs)):
        total, kinds = np.zeros(how.max_gram + 1), np.zeros(how.max_gram + 1)
        own = totals[totals["lang"] == langs[i]]
        total[own["level"]] = own["n"]
        for level in range(how.max_gram + 1):
            kinds[level] = len(levels[level])
        level = kept["level"].to_numpy(int)
        log[:, i] = np.log((kept[f"n{i}"].to_numpy(float) + how.alpha) / (total[level] + how.alpha * (kinds[level] + 1)))
    return Model(langs, levels, log)


class _Predict:
    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = self.model.value
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )


def identify(docs: DataFrame, model: Model, text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry``, ``lang_pred`` and ``score`` for every row of ``docs``, from its whole text.

    ``und`` with score 0 if the text is null or has no letter, or if the model knows no language. Carried
    columns of the two names are left out.
    """
    carry = tuple(c for c in carry if c not in ("lang_pred", "score"))
    return _predicted(docs, model, text, carry).select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "lang_pred", "score"
    )


def _predicted(docs: DataFrame, model: Model, text: str, carry: tuple[str, ...]) -> DataFrame:
    """Carried columns as c0, c1, ... and the prediction, so that no names clash."""
    rows = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("text"))
    shape = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]], "lang_pred string, score double"])
    return rows.mapInArrow(_Predict(docs.sparkSession.sparkContext.broadcast(model)), shape)


def identify_documents(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from documents whose fold of five is not 0.

    Null languages are not learned from; null ids count as held out. Repeated rows are learned from and
    come back as often as they occur. No rows: no rows.
    """
    rows = docs.withColumn("held_out_", fold("doc_id", 5) == 0)
    model = train(rows.where(~F.col("held_out_")), how=how)
    found = identify(rows, model, carry=("doc_id", "held_out_"))
    return found.withColumnRenamed("held_out_", "held_out")


def keep_identified(docs: DataFrame, least: float = 0.5, how: Training = Training()) -> DataFrame:
    """Documents whose language is told with a score of ``least`` or more, with the columns of ``docs``."""
    model = train(docs.where(fold("doc_id", 5) != 0), how=how)
    names = tuple(docs.columns)
    found = _predicted(docs, model, "text", names).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
