"""Checks on packs and question sets, and on the language capability of completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import contract as ct
from ..functions import text as tx
from ..functions.records import preview
from ..functions.rounding import exact_round

#: fixed value: smallest Devanagari share of an answer that kept its script
KEPT_SCRIPT_RATIO = 0.40


def topic_completeness(
    passages: DataFrame, languages: tuple[str, ...] = ("en", "hi", "mr")
) -> DataFrame:
    """(topic_id, langs, n, complete): complete topics have each language exactly once."""
    wanted = F.array(*[F.lit(x) for x in sorted(languages)])
    grouped = passages.groupBy("topic_id").agg(
        F.array_sort(F.collect_set("lang")).alias("langs"), F.count("*").alias("n")
    )
    return grouped.withColumn(
        "complete", (F.col("langs") == wanted) & (F.col("n") == len(languages))
    )


def distribution(questions: DataFrame) -> DataFrame:
    """Question counts by answerable and language with all subtotals."""
    counts = questions.cube("answerable", "lang").agg(
        F.count("*").alias("n"), F.grouping_id().alias("level")
    )
    return counts


def broken_references(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """(qid, source): expected sources that no passage has, and sources listed for traps."""
    cited = questions.select(
        "qid", "answerable", F.explode("expected_sources").alias("source")
    )
    known = passages.select(F.col("id").cast("string").alias("source"))
    unknown = cited.join(known, "source", "left_anti").select("qid", "source")
    return unknown.unionByName(cited.where("NOT answerable").select("qid", "source")).distinct()


def incomplete_passages(passages: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """Passages with a required field missing."""
    absent = F.lit(False)
    for name in required:
        absent = absent | F.col(name).isNull()
    return passages.where(absent)


def capability(answers: DataFrame) -> DataFrame:
    """Per completion: contract kept, script share, detected language, answer preview."""
    read = answers.withColumn("_data", ct.parse_object(F.col("raw_output")))
    answer = ct.lenient_text(F.col("_data"), "answer")
    valid = F.col("_data").isNotNull() & ct.field_kind(F.col("_data"), "answer").isNotNull()
    full = read.withColumns(
        {"json_valid": valid, "_answer": F.when(valid, answer).otherwise(F.lit(""))}
    ).withColumn("_ratio", tx.devanagari_ratio(F.col("_answer")))
    ok: Column = F.col("json_valid")
    return full.select(
        *[c for c in answers.columns],
        "json_valid",
        exact_round("_ratio", 3).alias("script_ratio"),
        F.when(ok, tx.detect_language(F.col("_answer"))).otherwise("unknown").alias("detected_lang"),
        preview(F.col("_answer")).alias("answer_preview"),
    )


def go_no_go(checked: DataFrame, *by: str) -> DataFrame:
    """Verdict per group: every completion valid and in Devanagari script."""
    return checked.groupBy(*by).agg(
        F.bool_and("json_valid").alias("contract_followed"),
        F.bool_and(F.col("script_ratio") >= KEPT_SCRIPT_RATIO).alias("script_kept"),
        F.when(
            F.bool_and(F.col("json_valid") & (F.col("script_ratio") >= KEPT_SCRIPT_RATIO)), "GO"
        )
        .otherwise("NO-GO / INVESTIGATE")
        .alias("verdict"),
    )


def model_listing(models: DataFrame, family: str, found: int = 10, other: int = 5) -> DataFrame:
    """Model ids of a family (first ``found``), or the first ``other`` ids when there are none."""
    mine = models.withColumn("family", F.contains(F.lower("id"), F.lit(family.lower())))
    matched = mine.where("family").orderBy("pos").limit(found)
    rest = mine.where("NOT family").orderBy("pos").limit(other)
    chosen = matched.unionByName(rest)  # at most found + other rows
    any_match = F.bool_or("family").over(Window.partitionBy(F.lit(0)))
    return chosen.withColumn("any_match", any_match).where("family = any_match").drop("any_match")


def select_by_ids(questions: DataFrame, ids: DataFrame) -> DataFrame:
    """Questions of an id list (qid, ord) in list order; ``found`` is false for ids that no question has.

    Each id is listed once per row of ``ids``; a question that occurs several times is taken by its first ``pos``.
    """
    columns = [c for c in questions.columns if c != "qid"]
    wanted = questions.join(ids.select("qid").distinct(), "qid", "left_semi")
    first = wanted.groupBy("qid").agg(F.min_by(F.struct(*columns), "pos").alias("row"))
    joined = ids.join(first, "qid", "left")
    return joined.select("qid", "ord", F.col("row").isNotNull().alias("found"), *[F.col("row")[c].alias(c) for c in columns])


def active_providers(providers: DataFrame) -> DataFrame:
    """Known providers with an API key, in configured order (name, ord, known, api_key)."""
    return providers.where(F.col("known") & (F.coalesce(F.length("api_key"), F.lit(0)) > 0)).select("name", "ord")
