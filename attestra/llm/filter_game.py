"""Filter interaction audit by the Hart-Mas-Colell potential of the removal game.

A coalition of filters is worth the number of documents that fail any of its filters. Five filters have 32
coalitions, so everything follows from 32 counts per part: the potential of a coalition is its worth plus the
potentials of the coalitions with one filter less, divided by its size; a filter's Shapley value is the potential
of all filters minus that of the others; and what a filter removes at a step of an order is the difference between
the coalitions before and after it.

Documents meet in counts only. Copies are told by the SHA-256 of the whole text and counted before they are
compared, so a text of any number of copies ends as a few rows.
"""

from __future__ import annotations

import json
import math
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words_of

VALUES = ("docs", "good", "toxic")
STEP = {"filter_order": "string", "step": "int", "bit": "int", "before": "int"}


def text_failures(text: Column) -> dict[str, Column]:
    """Failure conditions that look at one text: A few words, B repetitive, C capitals, D symbols."""
    words = words_of(text)
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def _facts(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, part: str, failures: dict[str, Column]) -> DataFrame:
    """Counts per text, failures of the text, part and labels: ``n``, ``n_null`` (null ids), ``first`` and ``n_first``."""
    mask = sum((F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(failures.values())), F.lit(0))
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(doc_id).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(body, 256)).alias("digest"),
        mask.alias("mask"),
    )
    # null ids have no label; they are spread instead of meeting in one task
    spread = F.concat(F.lit("-"), F.pmod(F.xxhash64("digest", "part"), F.lit(4096)).cast("string"))
    slim = slim.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), spread))
    known = (
        labels.where(F.col(doc_id).isNotNull())
        .groupBy(F.concat(F.lit("="), F.col(doc_id).cast("string")).alias("key"))
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    )
    rows = (
        slim.join(known, "key", "left")
        .withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
        .groupBy("key", "id", "part", "digest", "mask", "good", "toxic")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
        F.min("id").alias("first"),
        F.min_by("n", "id").alias("n_first"),
    )


def failure_counts(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    failures: dict[str, Column] | None = None,
) -> DataFrame:
    """A row per part and set of failed filters: ``part``, ``mask``, ``docs``, ``good``, ``toxic``.

    Bit i of ``mask`` is the i-th of ``failures``; the bit after the last is the copy filter: the text is that
    of a smaller id anywhere in the table. At most 32 rows a part with five filters.
    """
    failures = failures or text_failures(F.coalesce(F.col(text), F.lit("")))
    facts = _facts(docs, labels, doc_id, text, part, failures)
    # rows of one text differ by part and labels only, so they are few
    firsts = facts.groupBy("digest").agg(F.min("first").alias("smallest"))
    same = facts.join(firsts, "digest")
    spared = F.col("n_null") + F.when(F.col("first") == F.col("smallest"), F.col("n_first")).otherwise(0)
    copy = 1 << len(failures)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), spared.alias("n")),
        F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - spared).alias("n")),
    )
    split = same.select("part", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    n = F.col("x.n")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(
        F.sum(n).alias("docs"),
        F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"),
    )


def coalition_worths(counts: DataFrame, n_filters: int = 5) -> DataFrame:
    """A row per part: ``n_docs`` and arrays ``docs``, ``good`` and ``toxic`` of what each coalition removes.

    Place ``S`` of an array is the coalition of the filters whose bits are set in ``S``.
    """
    coalitions = counts.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))).alias("coalition")
    )
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    worth = coalitions.groupBy("part", "coalition").agg(
        F.sum("docs").alias("n_docs"), *[F.sum(F.when(hit, F.col(v)).otherwise(0)).alias(v) for v in VALUES]
    )
    listed = worth.groupBy("part").agg(
        F.max("n_docs").alias("n_docs"), F.sort_array(F.collect_list(F.struct("coalition", *VALUES))).alias("all")
    )
    return listed.select("part", "n_docs", *[F.col(f"all.{v}").alias(v) for v in VALUES])


def potentials(worths: Column, n_filters: int = 5) -> Column:
    """The potential of each coalition times ``n_filters!``, as exact integers; place 0 is the empty coalition.

    A coalition comes after its subsets, so one pass over the numbers is the recursion.
    """
    scale = math.factorial(n_filters)

    def extend(known: Column, coalition: Column) -> Column:
        smaller = F.lit(0).cast("long")
        for i in range(n_filters):
            without = F.get(known, coalition - (1 << i))
            smaller += F.when(coalition.bitwiseAND(F.lit(1 << i)) != 0, without).otherwise(0)
        total = scale * F.get(worths, coalition) + smaller
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(coalition))))

    start = F.array(F.lit(0).cast("long"))
    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), start, extend)


def _steps(names: list[str]) -> list[dict]:
    """Every step of every order: its filter's bit and the bits of the filters before."""
    return [
        {
            "filter_order": "".join(names[i] for i in order),
            "step": k + 1,
            "bit": 1 << order[k],
            "before": sum(1 << i for i in order[:k]),
        }
        for order in permutations(range(len(names)))
        for k in range(len(names))
    ]


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    failures: dict[str, Column] | None = None,
    copies: str = "E",
) -> DataFrame:
    """A row per part, order of all filters and step, with document counts of the part.

    ``filter_order`` joins the filters' names in the order of application; ``step`` counts from 1. ``kept`` after
    the step, ``removed`` by it, ``redundant`` (fail its filter, removed earlier), ``unique_fails`` (fail only its
    filter), ``good_lost`` and ``toxic_lost`` (removed by it, ``labels`` quality or toxic 1), ``shapley`` (removed by
    its filter, summed over all orders: the Shapley value times the number of orders).

    Null text is empty; null part is the part ''. A row with a null id is never a copy and makes none, and has no
    label. Rows with the same id and text are no copies of each other. Several label rows of an id: any 1 counts.
    Of ``docs`` only the three named columns are read, so others may have any name. No rows: no rows.
    """
    failures = failures or text_failures(F.coalesce(F.col(text), F.lit("")))
    names = [*failures, copies]
    m, every = len(names), (1 << len(names)) - 1
    game = coalition_worths(failure_counts(docs, labels, doc_id, text, part, failures), m)
    game = game.withColumn("potential", potentials(F.col("docs"), m))
    step_of = F.from_json(F.lit(json.dumps(_steps(names))), f"array<struct<{', '.join(f'{f} {t}' for f, t in STEP.items())}>>")
    rows = game.withColumn("at", F.explode(step_of))

    def change(value: str, before: Column, after: Column) -> Column:
        return F.get(value, after) - F.get(value, before)

    before, after, bit, everything = F.col("at.before"), F.col("at.before") + F.col("at.bit"), F.col("at.bit"), F.lit(every)
    removed = change("docs", before, after)
    return rows.select(
        "part",
        "at.filter_order",
        "at.step",
        (F.col("n_docs") - F.get("docs", after)).alias("kept"),
        removed.alias("removed"),
        (F.get("docs", bit) - removed).alias("redundant"),
        change("docs", everything - bit, everything).alias("unique_fails"),
        change("good", before, after).alias("good_lost"),
        change("toxic", before, after).alias("toxic_lost"),
        change("potential", everything - bit, everything).alias("shapley"),
    )
