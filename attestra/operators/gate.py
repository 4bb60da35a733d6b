"""Deterministic verification of completions against the passages they cite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contract as ct
from ..functions import lexicon as lx
from ..functions import text as tx
from ..functions.rounding import exact_round, percent_text

CHECKS = (
    "json_valid",
    "refusal_ok",
    "sources_real",
    "numbers_grounded",
    "token_overlap",
    "language_match",
)
_NO_TEXTS = "array<string>"


def _empty() -> Column:
    return F.array().cast(_NO_TEXTS)


# ---- single checks ------------------------------------------------------------------------
def cited_ids(sources: Column) -> Column:
    """Distinct non-blank citations, trimmed."""
    trimmed = F.transform(sources, tx.strip_space)
    return F.array_distinct(F.filter(trimmed, lambda s: s != ""))


def passage_ids(retrieved: Column) -> Column:
    ids = F.transform(retrieved, lambda p: tx.strip_space(p["id"]))
    return F.filter(ids, lambda i: i != "")


def check_sources_real(sources: Column, valid_ids: Column) -> Column:
    """NULL when the citations are real, else the failure message."""
    cited = cited_ids(sources)
    invalid = F.array_sort(F.array_except(cited, valid_ids))
    return (
        F.when(F.size(sources) == 0, F.lit("Answer cites no sources (sources list is empty)."))
        .when(
            F.size(cited) == 0,
            F.lit("Answer contains only empty or whitespace source citations."),
        )
        .when(
            F.size(invalid) > 0,
            F.concat(
                F.lit("Cited source ID(s) not in retrieved passages: "),
                ct.quoted_list(invalid),
                F.lit("."),
            ),
        )
    )


def cited_text(sources: Column, retrieved: Column) -> Column:
    """Texts of the cited passages in citation order, joined by a blank."""

    def text_of(source: Column) -> Column:
        same = F.filter(retrieved, lambda p: tx.strip_space(p["id"]) == tx.strip_space(source))
        return F.when(tx.strip_space(source) != "", F.try_element_at(same, F.lit(-1))["text"])

    return F.array_join(F.array_compact(F.transform(sources, text_of)), " ")


def bare_numbers(text: Column) -> Column:
    return F.transform(tx.extract_numbers(text), tx.bare_number)


def ungrounded_numbers(answer: Column, cited: Column) -> Column:
    """Numbers of the answer that the cited text lacks, in order, duplicates kept."""
    return numbers_beyond(answer, bare_numbers(cited))


def numbers_beyond(answer: Column, known: Column) -> Column:
    """Numbers of the answer that are not among the bare numbers ``known``."""

    def loose(numbers: Column) -> Column:
        # by hash first; bound, or the cited text would be read again for each number of the answer
        lacking = F.array_except(F.transform(numbers, tx.bare_number), known)
        return tx.bound(
            lacking,
            lambda found: F.filter(numbers, lambda n: F.array_contains(found, tx.bare_number(n))),
        )

    return tx.bound(tx.extract_numbers(answer), loose)


def content_words(text: Column) -> Column:
    """Distinct tokens without the stopwords of any language."""
    return F.array_except(tx.raw_tokens(text), tx.word_array(lx.STOPWORDS_ANY))


def like_levels(thresholds: tuple[float, ...], apart: Column, overlap: Column) -> Column:
    """Thresholds (arrays of them) that make no difference to the failures of a row.

    Where the overlap counts (``apart``), each threshold above it is told in a failure of its own.
    """
    every = F.array(*map(F.lit, thresholds))
    met = F.filter(every, lambda t: F.coalesce(overlap >= t, F.lit(False)))
    missed = F.transform(F.filter(every, lambda t: F.coalesce(overlap < t, F.lit(True))), lambda t: F.array(t))
    one_by_one = F.when(F.size(met) > 0, F.concat(F.array(met), missed)).otherwise(missed)
    return F.when(apart, one_by_one).otherwise(F.array(every))


def overlap_ratio(words: Column, known: Column) -> Column:
    """Share of an answer's content words among the cited ones; NULL if either side is empty."""
    shared = F.size(F.array_intersect(words, known))
    return F.when(F.size(known) > 0, F.try_divide(shared, F.size(words)))


def script_failure(question_ratio: str, answer_ratio: str) -> Column:
    """NULL when the scripts agree, else the failure message; takes names of ratio columns."""
    asked_in_devanagari = F.col(question_ratio) >= lx.QUESTION_RATIO
    return F.when(
        asked_in_devanagari & (F.col(answer_ratio) < lx.ANSWER_RATIO),
        F.concat(
            F.lit("Question was in Devanagari script ("),
            percent_text(question_ratio),
            F.lit("), but answer is in Latin script ("),
            percent_text(answer_ratio),
            F.lit(")."),
        ),
    ).when(
        ~asked_in_devanagari & (F.col(answer_ratio) >= lx.QUESTION_RATIO),
        F.concat(
            F.lit("Question was in Latin script, but answer is in Devanagari script ("),
            percent_text(answer_ratio),
            F.lit(")."),
        ),
    )


# ---- full gate ----------------------------------------------------------------------------
def parse(df: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Add ``_data`` (variant), ``_answer``, ``_sources``, ``_refuse`` and ``_contract`` messages.

    The three contract columns are NULL whenever ``_contract`` is not empty.
    """
    data = F.col("_data")
    missing = F.exists(
        F.array(*[ct.field_kind(data, f) for f in ct.FIELDS]), lambda kind: kind.isNull()
    )
    messages = (
        F.when(data.isNull(), F.array(F.lit("Invalid JSON: no JSON object could be parsed")))
        .when(
            missing,
            F.array(
                F.lit("JSON missing required contract fields: 'answer', 'sources', 'refuse'.")
            ),
        )
        .otherwise(ct.type_failures(data))
    )
    checked = df.withColumn("_data", ct.parse_object(F.col(raw))).withColumn("_contract", messages)
    ok = F.size("_contract") == 0
    return checked.withColumns(
        {
            "_answer": F.when(ok, tx.strip_space(F.try_variant_get(data, "$.answer", "string"))),
            "_sources": F.when(ok, ct.string_list(data, "sources")),
            "_refuse": F.when(ok, F.try_variant_get(data, "$.refuse", "boolean")),
        }
    )


def verify(
    df: DataFrame,
    overlap_threshold: float | Column = 0.60,
    raw: str | None = "raw_output",
    question: str = "question",
    retrieved: str = "retrieved",
    output: str = "gate",
    levels: tuple[str, tuple[float, ...] | str] | None = None,
    carry: str | None = None,
    reuse: str | None = None,
) -> DataFrame:
    """Add the struct ``gate``: passed, outcome, checks, failures, details.

    ``levels`` repeats each row for several thresholds after it was measured, so that texts are read once for
    all of them. (column name, thresholds) adds arrays of thresholds with the same failures, of which the first
    is applied; (column name, name of such an array) adds and applies each threshold of the array.

    ``carry`` names a column to add with what was measured of the question, the cited text and the answer; ``reuse``
    names that column of an earlier verification of the same question and passages. What is equal is not measured again.

    With ``raw=None`` the contract columns ``_answer``, ``_sources``, ``_refuse`` are taken as they
    are (an already typed completion).
    """
    limit = overlap_threshold if isinstance(overlap_threshold, Column) else F.lit(overlap_threshold)
    keep = df.columns
    if raw is None:
        keep = [c for c in keep if c not in ("_answer", "_sources", "_refuse")]
        typed = df.withColumns(
            {
                "_data": F.lit(None).cast("variant"),
                "_contract": _empty(),
                "_answer": tx.strip_space(F.col("_answer")),
            }
        )
    else:
        typed = parse(df, raw)
    cited, answer, before = F.col("_cited"), F.col("_answer"), F.col(reuse) if reuse else None

    def known(same: Column | None, name: str, fresh: Column) -> Column:
        return fresh if same is None else F.when(same, before[name]).otherwise(fresh)

    same_cited = None if before is None else cited == before["cited"]
    same_answer = None if before is None else answer == before["answer"]
    same_both = None if before is None else same_cited & same_answer
    measured = typed.withColumns(
        {
            "_cited": cited_text(F.col("_sources"), F.col(retrieved)),
            "_q_ratio": tx.devanagari_ratio(F.col(question)) if before is None else before["q_ratio"],
            "_a_ratio": known(same_answer, "a_ratio", tx.devanagari_ratio(answer)),
        }
    ).withColumns(
        {
            "_numbers": known(same_cited, "numbers", bare_numbers(cited)),
            "_known": known(same_cited, "known", content_words(cited)),
        }
    ).withColumns(
        {
            "_loose": known(same_both, "loose", numbers_beyond(answer, F.col("_numbers"))),
            "_words": known(same_answer, "words", content_words(answer)),
            "_source_fault": check_sources_real(
                F.col("_sources"), passage_ids(F.col(retrieved))
            ),
            "_script_fault": script_failure("_q_ratio", "_a_ratio"),
        }
    ).withColumn("_overlap", known(same_both, "overlap", overlap_ratio(F.col("_words"), F.col("_known")))
    ).withColumn("_ratio", F.coalesce("_overlap", F.lit(0.0)))
    if carry:
        names = "q_ratio a_ratio cited numbers known answer loose words overlap".split()
        measured = measured.withColumn(carry, F.struct(*[F.col(f"_{n}").alias(n) for n in names]))
        keep = [*(c for c in keep if c != carry), carry]
    if levels:
        name, values = levels
        if isinstance(values, str):
            spread, limit = F.col(values), F.col(name)
        else:
            apart = (F.size("_contract") == 0) & ~F.coalesce(F.col("_refuse"), F.lit(False))
            spread, limit = like_levels(values, apart, F.col("_overlap")), F.get(name, F.lit(0))
        measured = measured.withColumn(name, F.explode(spread))
        keep = [*keep, name]
    measured = measured.withColumn("_limit", limit.cast("double"))
    valid = F.size("_contract") == 0
    refused = F.coalesce(F.col("_refuse"), F.lit(False))
    answered = valid & ~refused
    overlap_ok = F.coalesce(F.col("_overlap") >= F.col("_limit"), F.lit(False))
    faults = F.array_compact(
        F.array(
            F.col("_source_fault"),
            F.when(
                F.size("_loose") > 0,
                F.concat(
                    F.lit("Answer contains ungrounded number(s) not found in cited sources: "),
                    ct.quoted_list(F.col("_loose")),
                ),
            ),
            F.when(
                ~overlap_ok,
                F.concat(
                    F.lit("Token overlap ("),
                    percent_text("_ratio"),
                    F.lit(") is below threshold ("),
                    percent_text("_limit"),
                    F.lit(")."),
                ),
            ),
            F.col("_script_fault"),
        )
    )
    judged = measured.withColumn(
        "_failures", F.when(~valid, F.col("_contract")).when(refused, _empty()).otherwise(faults)
    )
    passed = F.size("_failures") == 0
    checks = {
        "json_valid": valid,
        "refusal_ok": valid,
        "sources_real": answered & F.col("_source_fault").isNull(),
        "numbers_grounded": answered & (F.size("_loose") == 0),
        "token_overlap": answered & overlap_ok,
        "language_match": valid & F.col("_script_fault").isNull(),
    }
    details = {
        "error": F.when(F.col("_data").isNull() & ~valid, F.get("_contract", F.lit(0))),
        "data": F.when(~valid, F.col("_data").cast("string")),
        "answer": F.col("_answer"),
        "sources": F.col("_sources"),
        "refuse": F.col("_refuse"),
        "question_devanagari_ratio": F.when(valid, exact_round("_q_ratio", 3)),
        "answer_devanagari_ratio": F.when(valid, exact_round("_a_ratio", 3)),
        "warnings": F.when(
            refused & F.col("_script_fault").isNotNull(),
            F.array(F.concat(F.lit("Refusal script mismatch: "), F.col("_script_fault"))),
        ),
        "ungrounded_numbers": F.when(answered, F.col("_loose")),
        "token_overlap_ratio": F.when(answered, exact_round("_ratio", 3)),
        "overlap_threshold": F.when(answered, F.col("_limit")),
    }
    result = F.struct(
        passed.alias("passed"),
        F.when(~passed, F.lit("failed"))
        .when(refused, F.lit("refused"))
        .otherwise(F.lit("passed"))
        .alias("outcome"),
        F.struct(
            *[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()]
        ).alias("checks"),
        F.col("_failures").alias("failures"),
        F.struct(*[c.alias(n) for n, c in details.items()]).alias("details"),
    )
    return judged.select(*keep, result.alias(output))
