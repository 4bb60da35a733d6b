"""Conditional rates over evaluation records, overall and per language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import percent_text, round_columns

#: fixed values: languages every report lists
REPORT_LANGUAGES = ["en", "hi", "mr"]

#: fixed values: decimals of each figure
DIGITS = {
    "citation_valid_rate": 3,
    "ungrounded_answer_rate": 3,
    "wrong_answer_rate_on_traps": 3,
    "correct_refusal_rate_on_traps": 3,
    "refusal_rate_on_answerable": 3,
    "avg_model_calls": 2,
    "avg_extra_model_calls": 2,
    "avg_latency": 2,
    "escalation_rate": 3,
}


def citation_valid(sources: Column, retrieved_ids: Column) -> Column:
    """Cited something, and only retrieved passages."""
    return (F.size(sources) > 0) & (F.size(F.array_except(sources, retrieved_ids)) == 0)


def _figures() -> list[Column]:
    outcome = F.col("outcome")
    valid = outcome != "error"
    answerable = F.coalesce("answerable", F.lit(True))
    answered, trap, normal = outcome == "passed", valid & ~answerable, valid & answerable
    grounded = F.coalesce("is_grounded", F.lit(True))
    calls = F.coalesce("model_calls", F.lit(0))

    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(part), F.count_if(whole)), F.lit(0.0))

    def mean(value: Column) -> Column:
        total = F.sum(F.when(valid, value)).cast("double")
        return F.coalesce(F.try_divide(total, F.count_if(valid)), F.lit(0.0))

    cited = citation_valid(F.col("sources"), F.col("retrieved_passage_ids"))
    return [
        F.count("*").alias("total_questions"),
        F.count_if(valid).alias("valid_questions"),
        F.count_if(~valid).alias("errors"),
        rate(answered & cited, answered).alias("citation_valid_rate"),
        rate(answered & ~grounded, answered).alias("ungrounded_answer_rate"),
        rate(trap & answered, trap).alias("wrong_answer_rate_on_traps"),
        rate(trap & outcome.isin("refused", "failed"), trap).alias("correct_refusal_rate_on_traps"),
        rate(normal & ~answered, normal).alias("refusal_rate_on_answerable"),
        mean(calls).alias("avg_model_calls"),
        mean(F.greatest(F.lit(0), calls - 1)).alias("avg_extra_model_calls"),
        mean(F.coalesce("latency", F.lit(0.0))).alias("avg_latency"),
        rate(valid & F.coalesce("escalated", F.lit(False)), valid).alias("escalation_rate"),
    ]


def metrics(records: DataFrame, *by: str) -> DataFrame:
    """The twelve figures per group; records with outcome 'error' leave every denominator."""
    return round_columns(records.groupBy(*by).agg(*_figures()), DIGITS)


def metrics_by_language(records: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """Overall (lang 'all') and per-language figures of each setup in one aggregation.

    Every reported language has a row, with zeros when it has no records.
    """
    languages = languages or REPORT_LANGUAGES
    grouped = records.groupingSets([["setup"], ["setup", "lang"]], "setup", "lang").agg(
        *_figures(), F.grouping("lang").alias("_overall")
    )
    named = grouped.withColumn(
        "lang", F.when(F.col("_overall") == 1, F.lit("all")).otherwise(F.col("lang"))
    ).drop("_overall")
    wanted = ["all", *languages]
    slots = (
        records.select("setup")
        .distinct()
        .withColumn("lang", F.explode(F.array(*[F.lit(x) for x in wanted])))
    )
    full = slots.join(named, ["setup", "lang"], "left").fillna(
        0, [c for c in named.columns if c not in ("setup", "lang")]
    )
    return round_columns(full, DIGITS)


# ---- report lines -------------------------------------------------------------------------
def _cells(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def _seconds(value: Column) -> Column:
    return F.concat(value.cast("string"), F.lit("s"))


def comparison_line() -> Column:
    """One Markdown row of the setup comparison."""
    p = lambda name: percent_text(name)
    return _cells(
        F.col("setup"),
        F.col("total_questions"),
        F.col("errors"),
        p("citation_valid_rate"),
        p("ungrounded_answer_rate"),
        p("wrong_answer_rate_on_traps"),
        p("correct_refusal_rate_on_traps"),
        p("refusal_rate_on_answerable"),
        F.col("avg_model_calls").cast("string"),
        F.col("avg_extra_model_calls").cast("string"),
        _seconds(F.col("avg_latency")),
        p("escalation_rate"),
    )


def language_line() -> Column:
    """One Markdown row of a per-language table."""
    p = lambda name: percent_text(name)
    return _cells(
        F.upper("lang"),
        F.col("total_questions"),
        F.col("errors"),
        p("citation_valid_rate"),
        p("ungrounded_answer_rate"),
        p("correct_refusal_rate_on_traps"),
        p("refusal_rate_on_answerable"),
        F.col("avg_model_calls").cast("string"),
        _seconds(F.col("avg_latency")),
    )


def sweep_line() -> Column:
    """One Markdown row of the threshold sweep."""
    p = lambda name: percent_text(name)
    return _cells(
        F.format_string("%.2f", F.col("overlap_threshold")),
        p("citation_valid_rate"),
        p("ungrounded_answer_rate"),
        p("correct_refusal_rate_on_traps"),
        p("refusal_rate_on_answerable"),
        p("escalation_rate"),
    )


def console_line() -> Column:
    """One fixed-width row of the console summary."""
    p = lambda name: percent_text(name)
    columns = [
        (F.col("setup"), 12),
        (F.col("total_questions").cast("string"), 6),
        (F.col("errors").cast("string"), 7),
        (p("citation_valid_rate"), 10),
        (p("ungrounded_answer_rate"), 12),
        (p("wrong_answer_rate_on_traps"), 11),
        (p("correct_refusal_rate_on_traps"), 12),
        (p("refusal_rate_on_answerable"), 11),
        (F.col("avg_model_calls").cast("string"), 7),
        (F.col("avg_extra_model_calls").cast("string"), 7),
        (_seconds(F.col("avg_latency")), 8),
    ]
    # text longer than its column is kept whole
    padded = [F.when(F.length(c) < n, F.rpad(c, n, " ")).otherwise(c) for c, n in columns]
    return F.concat_ws(" ", *padded)
