"""Mixing sources to target weights as a curriculum whose weights change over training time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, running, stage, words_of


@dataclass(frozen=True)
class Mix:
    """``weights`` go to the sources in order of their names, null last, over and over.

    ``share``: words of the mix as a part of all words. ``repeats``: a source gives at most so many
    times its words. ``ramps``: by position in ``weights``, the slope r of a source's weight over time t
    in [0, 1], weight * (1 + r * (2 t - 1)) with r in [-1, 1]: below 0 it fades, above 0 it grows.
    """

    weights: tuple[float, ...] = (3.0, 1.0, 2.0)
    share: float = 1.5
    repeats: int = 2
    ramps: tuple[float, ...] = (-0.5, 0.5, 0.0)


def source_targets(sized: DataFrame, source: str, size: str, mix: Mix) -> DataFrame:
    """A row per source: ``source_key``, ``source_size``, ``target``, ``ramp``.

    Only sums come to the driver. A round gives the words that are left to sources below their limit
    by weight; those that reach it stop there. Each round but the last stops at least one source, and
    a weight class at a time in practice.
    """
    sizes = sized.groupBy(F.col(source).alias("source_key")).agg(F.sum(size).cast("long").alias("source_size"))
    ranked = running(
        sizes.withColumn("one_", F.lit(1).cast("long")), "one_", "rank_", [F.col("source_key").asc_nulls_last()]
    )
    turn = F.pmod("rank_", F.lit(len(mix.weights))).cast("int")
    sources = stage(
        ranked.select(
            "source_key",
            "source_size",
            F.get(F.array(*map(F.lit, mix.weights)), turn).alias("weight"),
            F.get(F.array(*map(F.lit, mix.ramps)), turn).alias("ramp"),
            (F.col("source_size") * mix.repeats).cast("double").alias("most"),
        ),
        "sources",
    )
    total = sources.agg(F.sum("source_size").alias("n"), F.sum("weight").alias("w")).first()
    words = mix.share * (total["n"] or 0)
    level, stopped = (words / total["w"] if total["w"] else 0.0), -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.col("most")
        row = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)).alias("fixed"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.coalesce(F.sum(over.cast("long")), F.lit(0)).alias("stopped"),
        ).first()
        if row["stopped"] == stopped or not row["open"]:
            break
        stopped, level = row["stopped"], (words - row["fixed"]) / row["open"]
    target = F.least(F.col("weight") * F.lit(level), F.col("most"))
    return sources.select("source_key", "source_size", target.alias("target"), "ramp")


def time_of(part: Column, ramp: Column) -> Column:
    """Time at which a source has given ``part`` of its target: the inverse of its integrated weight.

    The integral of 1 + r (2 t - 1) is (1 - r) t + r t^2. The form below is stable for r near 0.
    """
    b = 1 - ramp
    return 2 * part / (b + F.sqrt(b * b + 4 * ramp * part))


def plan_mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    mix: Mix = Mix(),
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """A row per row of ``docs``: id, source, ``carry``, size, source_size, target, ramp, start, taken1, taken2, taken.

    A source's documents follow each other in the order of an MD5 of their id; passes over them are cut
    at the source's target, rounded to whole words, so the last document of the last pass may give only
    its first words. ``start`` is the number of words of the source before the document, ``taken1`` and
    ``taken2`` are what the passes take. Texts are measured once and staged as sizes: what is sorted are ids and sizes.

    Null text: size 0, nothing taken. Null source: a source of its own, last in order. Null id: ordered
    as an empty id. Repeated rows are separate documents. No rows: no rows.
    """
    sized = stage(
        docs.select(F.col(doc_id).alias("id_"), F.col(source).alias("source_"), *carry, F.size(words_of(text)).cast("long").alias("size")),
        "sizes",
    )
    order = [F.md5(F.coalesce(F.col("id_").cast("string"), F.lit(""))), F.col("id_"), F.col("size"), *map(F.col, carry)]
    placed = stage(running(sized, "size", "start", order, group="source_"), "placed")
    targets = source_targets(placed, "source_", "size", mix)
    joined = placed.join(targets, placed["source_"].eqNullSafe(targets["source_key"])).drop("source_key")
    whole, zero = F.round("target").cast("long"), F.lit(0).cast("long")

    def given(offset: Column) -> Column:
        return F.greatest(zero, F.least(F.col("size"), whole - offset - F.col("start")))

    joined = joined.withColumns({"taken1": given(zero), "taken2": given(F.col("source_size"))})
    return joined.select(
        F.col("id_").alias(doc_id), F.col("source_").alias(source), *carry, "size", "source_size", "target", "ramp",
        "start", "taken1", "taken2", (F.col("taken1") + F.col("taken2")).alias("taken"),
    )


def schedule(planned: DataFrame) -> DataFrame:
    """A row per pass over a taken document, with ``pass_no``, ``words_taken`` and ``train_time``."""
    passes = F.array(
        F.struct(F.lit(1).alias("no"), F.col("taken1").alias("words"), F.col("start").alias("from")),
        F.struct(F.lit(2).alias("no"), F.col("taken2").alias("words"), (F.col("start") + F.col("source_size")).alias("from")),
    )
    rows = planned.withColumn("pass_", F.explode(F.filter(passes, lambda x: x["words"] > 0)))
    part = (F.col("pass_.from") + F.col("pass_.words") / 2) / F.greatest(F.round("target"), F.lit(1.0))
    return rows.withColumns(
        {
            "pass_no": F.col("pass_.no"),
            "words_taken": F.col("pass_.words"),
            "train_time": time_of(F.least(part, F.lit(1.0)), F.col("ramp")),
        }
    ).drop("pass_")


def training_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``position`` to the passes of ``schedule``: words of the mix before a pass, in the order of training time.

    Passes are range-sorted by time; passes of one time go by ``keys``, then by pass and words.
    """
    order = [F.col("train_time"), *map(F.col, keys), F.col("pass_no"), F.col("words_taken")]
    return running(rows.select(*keys, "pass_no", "words_taken", "train_time"), "words_taken", "position", order)


def mixed(planned: DataFrame, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The documents of a plan as the mix gives them: taken, first_time and position of their passes, in training order.

    ``taken`` sums the passes, ``first_time`` and ``position`` are those of the first one (null without a
    pass). Documents without a pass come last. Rows meet their passes by source and ``start``, which no two rows with words share.
    """
    # a stand-in for the source that is never null
    name = clear_of("name_", planned.columns)
    named = planned.withColumn(name, F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")))
    keys = [name, "start"]
    placed = training_order(schedule(named), keys)
    given = placed.groupBy(*keys).agg(
        F.sum("words_taken").alias("taken_"), F.min("train_time").alias("first_time"), F.min("position").alias("position")
    )
    # documents without words may share their start with the one after them
    marked = named.drop("taken").withColumn("given_", F.col("size") > 0)
    joined = marked.join(given.withColumn("given_", F.lit(True)), [*keys, "given_"], "left")
    taken = F.coalesce("taken_", F.lit(0).cast("long")).alias("taken")
    tasks = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = joined.select(*[c for c in planned.columns if c != "taken"], taken, "first_time", "position")
    last = F.col("position").asc_nulls_last()
    return rows.repartitionByRange(tasks, last, F.col(doc_id)).sortWithinPartitions(last, doc_id)


def mix_documents(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", mix: Mix = Mix()) -> DataFrame:
    """The mix in training order: a row per pass over a taken document.

    Columns of ``docs``, then pass_no, words_taken, train_time (0 to 1) and position: words of the mix
    before this document. Rows are range-sorted by position. Columns of these names are replaced.
    Rows meet their plan by two 64-bit hashes of all their columns, so repeated ids don't meet each other;
    rows that are alike throughout become one, which meets the plans of all of them. Texts move twice, to
    their plan and to their place, and are not staged.
    """
    added = ["pass_no", "words_taken", "train_time", "position"]
    docs = docs.drop(*[c for c in docs.columns if c in added and c not in (doc_id, source, text)])
    names = docs.columns
    keys = [clear_of("row_a_", names), clear_of("row_b_", names)]
    marked = docs.withColumns({k: F.xxhash64(F.lit(i), *names) for i, k in enumerate(keys)})
    rows = schedule(plan_mix(marked, doc_id, source, text, mix, carry=tuple(keys)))
    placed = training_order(rows, keys)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unlike = marked.groupBy(*keys).agg(*[F.first(c).alias(c) for c in names])
    joined = unlike.join(placed, keys).select(*names, *added)
    return joined.repartitionByRange(tasks, "position", "pass_no").sortWithinPartitions("position", "pass_no")
