"""Language-model scores by a probabilistic suffix tree over bytes.

Symbols are the bytes of the normalised text: words in lower case (A-Z), one blank between them, an end sign
after the last. Every context of up to ``depth`` bytes that occurs ``min_count`` times is tested, whatever the size of
the corpus: it is retained if its next symbols diverge from what the longest retained suffix of it predicts. The
test is a join of the contexts of a length with those one byte shorter. A symbol is scored from the longest
retained suffix of what came before.

Contexts are packed with the newest byte highest, so a context stands before all that end in it, and a range of
packed contexts needs beside itself only the suffixes of its first. A tree too large for one broadcast is
therefore cut into ranges; each scores the symbols whose contexts lie in it, and the parts are summed by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, stage

END, PAD = b"\n", b"\0"
#: longest context a packed key holds
LONGEST = 7


@dataclass(frozen=True)
class Tree:
    """``depth``: longest context in bytes, at most 7. ``min_count``: fewest occurrences of a context that is tested.
    A context is retained if its log-likelihood gain over its suffix, in nats, is above ``penalty``
    times half the logarithm of its count for each kind of next symbol (1: the Bayesian information criterion).
    ``shard_rows``: (context, next symbol) rows of the tree in one broadcast, about 20 bytes each; a larger tree is
    cut into ranges of that size. ``frequent_part``: words with at least this part of all tokens are broadcast with
    their counts, so at most 1 / ``frequent_part`` of them; the others are joined.
    """

    depth: int = 6
    min_count: int = 16
    penalty: float = 1.0
    shard_rows: int = 4_000_000
    frequent_part: float = 5e-7


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def windows(texts: list[bytes], depth: int) -> np.ndarray:
    """Every symbol with the ``depth`` symbols before it, packed: the symbol in the lowest byte, its context above, newest byte first."""
    flat = np.frombuffer(b"".join(PAD * depth + t + END for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    # symbol j of text i lies behind the pads of i + 1 texts
    at = np.arange(int(sizes.sum())) + depth * np.repeat(np.arange(1, len(texts) + 1), sizes)
    packed = np.zeros(len(flat), np.uint64)
    for back in range(1, depth + 1):
        packed[back:] |= flat[:-back].astype(np.uint64) << np.uint64(8 * (LONGEST + 1 - back))
    return packed[at] | flat[at]


class _Tally:
    """Sums of counts by key, handed out when a good deal has come together."""

    def __init__(self, most: int = 1_500_000):
        self.most, self.keys, self.counts = most, np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> bool:
        keys, first = np.unique(keys, return_counts=True) if counts is None else (keys, counts)
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        both, n = both[order], np.concatenate([self.counts, first])[order]
        new = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.empty(0, int)
        self.keys, self.counts = both[new], np.add.reduceat(n, new) if len(new) else n
        return len(self.keys) > self.most

    def rows(self, kind: int) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(self.keys), kind, np.int32)), pa.array(self.keys.view(np.int64)), pa.array(self.counts)],
            names=["kind", "key", "n"],
        )
        self.__init__(self.most)
        return out


class _Count:
    """(kind, key, n): kind 0 are words by hash, kind 1 symbols in their windows."""

    def __init__(self, depth: int):
        self.depth = depth

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols, vocabulary, counted, held, size = _Tally(), _Tally(), {}, [], 0
        for batch in slices(batches, 256):
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                own = words(text)
                for w in own:
                    counted[w] = counted.get(w, 0) + 1
                counted[END] = counted.get(END, 0) + 1
                held.append(b" ".join(own))
                size += len(held[-1]) + 1
            if size >= 2_000_000:
                if symbols.add(windows(held, self.depth)):
                    yield symbols.rows(1)
                held, size = [], 0
            if len(counted) >= 300_000:
                if vocabulary.add(*_by_hash(counted)):
                    yield vocabulary.rows(0)
                counted = {}
        symbols.add(windows(held, self.depth))
        vocabulary.add(*_by_hash(counted))
        yield symbols.rows(1)
        yield vocabulary.rows(0)


def _by_hash(counted: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    return (
        np.fromiter(map(word_hash, counted), np.uint64, len(counted)),
        np.fromiter(counted.values(), np.int64, len(counted)),
    )


def count(docs: DataFrame, text: str, depth: int) -> DataFrame:
    """Staged counts of all words and windows of the texts."""
    counted = docs.select(text).mapInArrow(_Count(depth), "kind int, key long, n long")
    # tasks have summed what they could, so their rows move without a second try at it
    return stage(counted.repartition("kind", "key").groupBy("kind", "key").agg(F.sum("n").alias("n")), "symbols")


def newest(length: int) -> int:
    """Mask of the ``length`` newest bytes of a packed context."""
    return ((1 << 8 * length) - 1) << 8 * (LONGEST - length)


class _Contexts:
    """(d, context, whole, next) of the contexts in windows that come sorted by context.

    A context's windows are neighbours, so all but the first and the last context of a length are whole in the
    piece at hand; the two may go on in other pieces and are given out as parts, whatever their counts.
    """

    def __init__(self, tree: Tree, piece: int = 400_000):
        self.tree, self.piece = tree, piece

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            size += batch.num_rows
            if size >= self.piece:
                yield from self.levels(held)
                held, size = [], 0
        if size:
            yield from self.levels(held)

    def levels(self, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, counts = (np.concatenate(x) for x in zip(*held))
        for d in range(self.tree.depth + 1):
            rows = keys & np.uint64(newest(d) << 8 | 255)
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
            n, rows = np.add.reduceat(counts[order], first), rows[first]
            context = rows >> np.uint64(8)
            start = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
            whole = np.ones(len(start), bool)
            whole[[0, -1]] = False
            chosen = ~whole | (np.add.reduceat(n, start) >= self.tree.min_count)
            sizes = np.diff(np.r_[start, len(rows)])
            mine, ends = np.repeat(chosen, sizes), np.r_[0, np.cumsum(sizes[chosen])].astype(np.int32)
            following = pa.MapArray.from_arrays(pa.array(ends), pa.array((rows[mine] & np.uint64(255)).astype(np.int32)), pa.array(n[mine]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ends) - 1, d, np.int32)),
                    pa.array(context[start][chosen].view(np.int64)),
                    pa.array(whole[chosen]),
                    following,
                ],
                names=["d", "context", "whole", "next"],
            )


def candidates(counts: DataFrame, tree: Tree) -> DataFrame:
    """(d, context, size, next) of every context of ``d`` bytes that occurs ``min_count`` times; next: counts by symbol, at most 256.

    Windows are sorted over ranges of contexts. The contexts of all lengths fall out of one pass over them; only those
    at the ends of a piece are summed again.
    """
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    context = F.shiftrightunsigned("key", 8)
    placed = counts.where("kind = 1").select("key", "n").repartitionByRange(tasks, context, "key").sortWithinPartitions(context)
    found = stage(placed.mapInArrow(_Contexts(tree), "d int, context long, whole boolean, next map<int,long>"), "levels")
    parts = found.where("NOT whole").select("d", "context", F.explode("next").alias("s", "n"))
    parts = parts.groupBy("d", "context", "s").agg(F.sum("n").alias("n"))
    parts = parts.groupBy("d", "context").agg(F.map_from_entries(F.collect_list(F.struct("s", "n"))).alias("next"))
    rows = found.where("whole").select("d", "context", "next").union(parts)
    size = F.aggregate(F.map_values("next"), F.lit(0).cast("long"), lambda a, n: a + n)
    return rows.withColumn("size", size).where((F.col("size") >= tree.min_count) | (F.col("d") == 0))


def retained(counts: DataFrame, tree: Tree) -> DataFrame:
    """Staged (d, context, rest, s, p): the retained contexts, for each next symbol seen there log10 of its probability.

    ``rest`` is log10 of the factor for a symbol that was not seen there, before its probability at the longest
    retained suffix. Lengths are tested in turn, each by a join with the length before.
    """
    found, levels, before = stage(candidates(counts, tree), "contexts"), [], None
    kinds = F.size("next")
    for d in range(tree.depth + 1):
        rows = found.where(F.col("d") == d)
        if before is None:
            known = rows.withColumn("above", F.transform_values("next", lambda s, n: F.lit(1 / 256)))
            keep: Column = F.lit(True)
        else:
            suffix = before.select(F.col("context").alias("suffix"), F.col("p").alias("above"))
            known = rows.withColumn("suffix", F.col("context").bitwiseAND(F.lit(newest(d - 1)).cast("long"))).join(suffix, "suffix")
            gain = F.aggregate(
                F.map_entries("next"),
                F.lit(0.0),
                lambda sum_, e: sum_ + e["value"] * F.log(e["value"] / F.col("size") / F.element_at("above", e["key"])),
            )
            keep = gain > F.lit(tree.penalty * 0.5) * kinds * F.log("size")
        own = F.transform_values("next", lambda s, n: (n + kinds * F.element_at("above", s)) / (F.col("size") + kinds))
        passed_on = F.transform_values("next", lambda s, n: F.element_at("above", s))
        judged = known.withColumn("kept", keep).select(
            "d",
            "context",
            "kept",
            F.log10(kinds / (F.col("size") + kinds)).alias("rest"),
            F.when(F.col("kept"), own).otherwise(passed_on).alias("p"),
        )
        before = stage(judged, "level")
        levels.append(before.where("kept"))
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.union(level)
    rows = rows.select("d", "context", F.col("rest").cast("float").alias("rest"), F.explode("p").alias("s", "p"))
    rows = rows.select("d", "context", "rest", F.col("s").cast("short").alias("s"), F.log10("p").cast("float").alias("p"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stage(rows.repartitionByRange(tasks, "context").sortWithinPartitions("context"), "tree")


class Shard:
    """Retained contexts of a range of packed contexts ``low`` to before ``high``, with the suffixes of ``low``."""

    def __init__(self, rows: pa.Table, low: int, high: int, depth: int):
        self.low, self.high, self.depth, self.levels = low, high, depth, []
        columns = {name: rows.column(name).to_numpy() for name in ("d", "context", "rest", "s", "p")}
        for d in range(depth + 1):
            own = columns["d"] == d
            context, s = columns["context"][own].astype(np.uint64) << np.uint64(8), columns["s"][own].astype(np.uint64)
            order = np.argsort(context | s)
            contexts, first = np.unique(context[order], return_index=True)
            self.levels.append((contexts, columns["rest"][own][order][first], (context | s)[order], columns["p"][own][order]))

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 of the probability of each sorted window of the range."""
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for d in range(self.depth, -1, -1):
            contexts, rest, rows, p = self.levels[d]
            if not len(contexts):
                continue
            own = keys[open_] & np.uint64(newest(d) << 8)
            place = np.minimum(np.searchsorted(contexts, own), len(contexts) - 1)
            here = contexts[place] == own
            row = own[here] | (keys[open_[here]] & np.uint64(255))
            at = np.minimum(np.searchsorted(rows, row), len(rows) - 1)
            seen = rows[at] == row
            out[open_[here]] += np.where(seen, p[at], rest[place[here]])
            done = np.zeros(len(open_), bool)
            done[np.flatnonzero(here)[seen]] = True
            open_ = open_[~done]
        out[open_] -= np.log10(256)
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Sum over the symbols of each normalised text with its end sign, as far as their contexts lie in the range."""
        keys = windows(texts, self.depth)
        doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
        if self.low > 0 or self.high <= newest(LONGEST):
            mine = (keys >> np.uint64(8) >= np.uint64(self.low)) & (keys >> np.uint64(8) < np.uint64(self.high))
            keys, doc = keys[mine], doc[mine]
        order = np.argsort(keys)
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]][: len(keys)]
        values = self.log10(keys[first])[np.cumsum(first) - 1]
        return np.bincount(doc[order], values, len(texts))


def shard(rows: DataFrame, low: int, high: int, depth: int) -> Shard:
    """Brings the rows of a range to the driver: about ``shard_rows`` of them, and those of at most ``depth`` suffixes."""
    context = F.col("context")
    wanted = (context >= low) & (context < high)
    for d in range(depth + 1):
        wanted |= (F.col("d") == d) & (context == low & newest(d))
    return Shard(rows.where(wanted).toArrow(), low, high, depth)


def ranges(rows: DataFrame, tree: Tree) -> list[tuple[int, int]]:
    """Ranges of packed contexts that hold about ``shard_rows`` rows or fewer each; one range if all fit."""
    parts, end = -(-rows.count() * 5 // (tree.shard_rows * 4)), newest(LONGEST) + 1
    if rows.count() <= tree.shard_rows:
        return [(0, end)]
    cuts = [i / parts for i in range(1, parts)]
    at = rows.select(F.percentile_approx("context", cuts, F.lit(parts * 20)).alias("at")).first().at
    edges = sorted({0, *at, end})
    return list(zip(edges, edges[1:]))


class _Add:
    """(row, score): what a shard adds to the score of each text."""

    def __init__(self, model):
        self.model = model

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            texts = [b" ".join(words(t)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(self.model.value.scores(texts))], names=["row", "score"])


class _Score:
    """Per text: token counts and scores, with the counts of frequent words; hashes and numbers of its other words."""

    def __init__(self, model, frequent, total: int, kinds: int):
        self.model, self.frequent, self.scale = model, frequent, np.log10(total + 0.1 * (kinds + 1))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (hashes, counts) = self.model.value, self.frequent.value
        for batch in slices(batches, 512):
            lists = [[*words(t), END] for t in batch.column(batch.num_columns - 1).cast(pa.binary()).to_pylist()]
            sizes = np.array([len(x) for x in lists])
            number = {w: i for i, w in enumerate(dict.fromkeys(w for x in lists for w in x))}
            at = np.fromiter((number[w] for x in lists for w in x), np.int64, int(sizes.sum()))
            own = np.fromiter(map(word_hash, number), np.uint64, len(number))
            where = np.minimum(np.searchsorted(hashes, own), max(len(hashes) - 1, 0))
            c = np.where(hashes[where] == own, counts[where], 0) if len(hashes) else np.zeros(len(own), np.int64)
            doc = np.repeat(np.arange(len(lists)), sizes)
            base = np.bincount(doc, np.log10(c + 0.1)[at] - self.scale, len(lists))
            known = np.bincount(doc, (c > 0)[at], len(lists)).astype(np.int64)
            open_ = (c == 0)[at]
            pairs, times = np.unique(doc[open_] * len(number) + at[open_], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(len(lists) + 1) * len(number)).astype(np.int32)
            rare = pa.StructArray.from_arrays(
                [pa.array(own[pairs % max(len(number), 1)].view(np.int64)), pa.array(times.astype(np.int32))], ["h", "times"]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(sizes.astype(np.int64)),
                    pa.array(known),
                    pa.array(base),
                    pa.array(model.scores([b" ".join(x[:-1]) for x in lists])),
                    pa.ListArray.from_arrays(pa.array(ends), rare),
                ],
                names=[*batch.schema.names[:-1], "n_tokens", "known_", "base_", "score", "rare"],
            )


def score_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tree: Tree = Tree(), held_of: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learns from all rows whose fold of ``held_of`` is not 0, whole texts; counts of all their words are
    exact up to equal 64-bit hashes. What is broadcast at once is bounded by ``Tree``; words that are too rare for
    it are joined with their counts, and a tree of several ranges scores staged texts range by range.

    Null text: empty, only the end is scored. Null id: held out. Repeated rows count and come back as
    often as they occur. No rows: no rows; nothing to learn from: each byte has one part in 256.
    """
    context = docs.sparkSession.sparkContext
    held = fold(doc_id, held_of) == 0
    counts = count(docs.where(~held), text, tree.depth)
    nodes = retained(counts, tree)
    spans = ranges(nodes, tree)
    model = context.broadcast(shard(nodes, *spans[0], tree.depth))
    vocabulary = counts.where("kind = 0").select(F.col("key").alias("h"), F.col("n").alias("c"))
    total, kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    least = max(total * tree.frequent_part, 1)
    often = vocabulary.where(F.col("c") >= least).toPandas().to_numpy().reshape(-1, 2)
    often = often[np.argsort(often[:, 0].astype(np.int64).view(np.uint64))]
    frequent = context.broadcast((np.ascontiguousarray(often[:, 0]).astype(np.int64).view(np.uint64), often[:, 1].astype(np.int64)))
    rows = docs.select(
        F.col(doc_id).alias("id"), held.alias("held_out"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text")
    )
    if len(spans) > 1:
        rows = stage(rows, "texts")  # rows keep their numbers over the ranges
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"id {kind}, held_out boolean, row long, n_tokens long, known_ long, base_ double, score double, rare array<struct<h:long,times:int>>"
    scored = stage(rows.mapInArrow(_Score(model, frequent, total, kinds), shape), "scored")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.times")
    more = (
        rare.join(vocabulary.where(F.col("c") < least), "h")
        .groupBy("row")
        .agg(
            F.sum("times").alias("known"),
            F.sum(F.col("times") * (F.log10(F.col("c") + 0.1) - F.log10(F.lit(0.1)))).alias("base"),
        )
    )
    parts = scored.select("row", "score")
    for low, high in spans[1:]:
        # one range at a time: its broadcast is done with once its sums are written
        other = context.broadcast(shard(nodes, low, high, tree.depth))
        parts = parts.union(stage(rows.select("row", "text").mapInArrow(_Add(other), "row long, score double"), "part"))
        other.unpersist()
    if len(spans) > 1:
        scored = scored.drop("score").join(parts.groupBy("row").agg(F.sum("score").alias("score")), "row")
    zero = F.lit(0)
    return (
        scored.drop("rare")
        .join(more, "row", "left")
        .select(
            F.col("id").alias(doc_id),
            "held_out",
            "n_tokens",
            (F.col("known_") + F.coalesce("known", zero)).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base_") + F.coalesce("base", zero)).alias("base_score"),
            "score",
        )
    )
