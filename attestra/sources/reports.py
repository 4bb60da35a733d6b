"""Result sinks: JSON documents, Markdown and console reports, recorded traces."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.records import outcome_label, scenario
from ..operators import metrics as mt
from ..plans.benchmark import Benchmark

# fixed values: table heads
COMPARISON_HEAD = (
    "| Setup | Questions | Errors | Citation Valid | Ungrounded Answers | Trap Wrong Answer | "
    "Trap Refusal | Answerable Refusal | Avg Calls | Avg Extra Calls | Avg Latency | Escalation Rate |"
)
LANGUAGE_HEAD = (
    "| Language | Questions | Errors | Citation Valid | Ungrounded Answers | Trap Refusal | "
    "Answerable Refusal | Avg Calls | Avg Latency |"
)
SWEEP_HEAD = (
    "| Overlap Threshold | Citation Valid | Ungrounded Rate | Trap Refusal Rate | "
    "Over-Abstention | Escalation Rate |"
)
CONSOLE_HEAD = [
    ("Setup", 12), ("Total", 6), ("Errors", 7), ("CitValid", 10), ("Ungrounded", 12),
    ("TrapWrong", 11), ("TrapRefuse", 12), ("AnsRefuse", 11), ("Calls", 7), ("Extra", 7),
    ("Latency", 8),
]
LANGUAGE_NAMES = {"en": "English", "hi": "Hindi", "mr": "Marathi"}


def write_results(result: Benchmark, path: str, **metadata: str) -> None:
    """``path/summary``: one JSON document of settings and metrics; ``path/details``: the records.

    Records are written as JSON Lines by all tasks instead of being gathered into one document.
    """
    rows = F.array_sort(F.collect_list(F.struct(*result.metrics.columns)))  # setups x 4 rows
    stamp = time.strftime("%Y-%m-%d %H:%M:%S UTC", time.gmtime())
    facts = F.struct(
        *[F.lit(v).alias(k) for k, v in {"timestamp": stamp, **metadata}.items()]
    )
    document = result.metrics.agg(facts.alias("metadata"), rows.alias("summary"))
    document.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    result.records.write.mode("overwrite").json(f"{path}/details")


def _separator(head: str) -> str:
    return "| " + " | ".join([":---"] * (head.count("|") - 1)) + " |"


def notes(questions: int, errors: int, setups: list[str], remarks: list[str] | None = None) -> list[str]:
    """What a reader should know about the figures of this run; ``remarks`` are the caller's own."""
    found = []
    if "gate" in setups:
        found.append(
            "`gate` is judged by the checks that it applies itself, so its ungrounded rate shows that the "
            "checks agree with themselves. It is no independent measurement of accuracy."
        )
    if questions:
        step = 100 / questions
        found.append(
            f"Each setup saw {questions} question(s): one question more or less moves a rate over all of them "
            f"by {step:.1f} points."
        )
    if errors:
        found.append(f"{errors} record(s) ended as `error` and are left out of the denominators of all rates.")
    return found + list(remarks or [])


def markdown_report(result: Benchmark, remarks: list[str] | None = None) -> str:
    """The Markdown report. Only metric rows (setups x languages, thresholds) reach the driver."""
    order = {s: i for i, s in enumerate(("raw", "llm_judge", "gate"))}
    langs = ["all", *mt.REPORT_LANGUAGES]
    rows = result.metrics.select(
        "setup", "lang", "errors", "total_questions", mt.comparison_line().alias("a"), mt.language_line().alias("b")
    ).collect()
    rows.sort(key=lambda r: (order.get(r.setup, 9), langs.index(r.lang)))
    overall = [r for r in rows if r.lang == "all"]
    said = notes(
        max((r.total_questions for r in overall), default=0), sum(r.errors for r in overall), [r.setup for r in overall], remarks
    )
    lines = ["# Evaluation results", "", "## Reading the figures", ""]
    lines += [f"{i}. {x}" for i, x in enumerate(said, 1)]
    lines += ["", "## Setup Performance Comparison", "", COMPARISON_HEAD, _separator(COMPARISON_HEAD)]
    lines += [r.a for r in rows if r.lang == "all"]
    lines += ["", "## Performance by Language", ""]
    for setup in dict.fromkeys(r.setup for r in rows):
        lines += [f"### Setup: {setup}", LANGUAGE_HEAD, _separator(LANGUAGE_HEAD)]
        lines += [r.b for r in rows if r.setup == setup and r.lang != "all"] + [""]
    if result.sweep is not None:
        lines += ["## Gate Overlap Threshold Sensitivity Sweep", "", SWEEP_HEAD, _separator(SWEEP_HEAD)]
        swept = result.sweep.select("overlap_threshold", mt.sweep_line().alias("line"))
        lines += [r.line for r in swept.orderBy("overlap_threshold").collect()] + [""]
    return "\n".join(lines) + "\n"


def write_report(result: Benchmark, path: str, remarks: list[str] | None = None) -> None:
    """The Markdown report as one text file in the folder ``path``; it is a few dozen lines."""
    spark = result.metrics.sparkSession
    spark.createDataFrame([(markdown_report(result, remarks),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def console_report(metrics: DataFrame) -> str:
    """Fixed-width summary table."""
    overall = metrics.where("lang = 'all'").select("errors", mt.console_line().alias("line"))
    rows = overall.orderBy("line").collect()
    head = " ".join(name.ljust(width) for name, width in CONSOLE_HEAD)
    body = ["=" * 115, head, "-" * 115, *[r.line for r in rows], "=" * 115]
    errors = sum(r.errors for r in rows)
    if errors:
        body.insert(0, f"[WARNING] {errors} upstream error(s); excluded from rate denominators.")
    return "\n".join(body)


def recorded_runs(answered: DataFrame) -> DataFrame:
    """Cascade results as replayable example records; provider errors are left out."""
    named = F.when(F.lit(False), F.lit(""))
    for code, name in LANGUAGE_NAMES.items():
        named = named.when(F.col("lang") == code, F.lit(name))
    title = F.concat(
        named.otherwise(F.col("lang")),
        F.lit(" question: "),
        outcome_label(F.col("outcome"), F.col("model_calls")),
    )
    kept = answered.where("NOT (outcome = 'failed' AND trace.provider_error IS NOT NULL)")
    return kept.select(
        F.concat(F.lit("example_"), F.lower(F.col("qid").cast("string"))).alias("id"),
        title.alias("title"),
        scenario(F.col("outcome"), F.col("model_calls"), F.col("escalated")).alias("scenario"),
        "question",
        "lang",
        "answer",
        "sources",
        "outcome",
        "escalated",
        "model_calls",
        "trace",
        F.lit(True).alias("is_cached_example"),
        F.lit(lx.RECORDED_NOTICE).alias("notice"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss 'UTC'").alias("recorded_at"),
    )


def write_runs(runs: DataFrame, path: str) -> bool:
    """Write example records as JSON Lines; False, and nothing touched, when there are none."""
    if runs.isEmpty():
        return False
    runs.write.mode("overwrite").json(path)
    return True
