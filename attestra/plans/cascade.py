"""Pre-check, answer, verify, escalate once, refuse: one linear plan over a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import contract as ct
from ..operators import gate
from ..operators.index import Index
from ..operators.retrieve import retrieve
from ..sources.completions import REPLAY_MISS, CompletionSource

#: column of the first attempt with what the second one needs not measure again
MEASURED = "_measured"


def ask(
    questions: DataFrame,
    passages: DataFrame,
    source: CompletionSource,
    cfg: Config = Config(),
    index: Index | None = None,
    raise_misses: bool = True,
) -> DataFrame:
    """Answer ``questions`` (qid, question, ...) from ``passages``; see ``resolve``.

    A request that replay-only mode can't answer is an error of the whole call, or, without
    ``raise_misses``, of its own row (see ``is_miss``).
    """
    answered = resolve(retrieve(questions, passages, cfg, index), source, cfg)
    if not (raise_misses and cfg.replay_only):
        return answered
    told = F.when(is_miss(), F.raise_error(F.col("trace")["provider_error"]).cast("string"))
    return answered.withColumn("outcome", F.coalesce(told, F.col("outcome")))


def is_miss() -> Column:
    """True for answered rows that failed since replay-only mode had no completion for them."""
    return F.coalesce(F.col("trace")["provider_error"].startswith(REPLAY_MISS), F.lit(False))


def first_attempt(retrieved: DataFrame, source: CompletionSource) -> DataFrame:
    """Add the tier-1 ``completion`` and ``error`` for the questions that pass the pre-check."""
    requests = retrieved.withColumns(
        {
            "wanted": F.col("precheck_passed") & (F.size("retrieved") > 0),
            "messages": ct.answer_messages(F.col("question"), F.col("retrieved")),
        }
    )
    return source.complete(requests, "tier1").drop("messages")


def second_attempt(
    checked: DataFrame,
    source: CompletionSource,
    threshold: Column | float,
    levels: tuple[str, str] | None = None,
) -> DataFrame:
    """Escalate the rows whose tier-1 answer failed the gate; add the ``tier2`` attempt.

    What ``attempt_one`` measured of the question, the cited text and the answer is used again and dropped.
    """
    requests = checked.withColumns(
        {
            "wanted": F.col("tier1").isNotNull() & (F.col("tier1")["gate_outcome"] == "failed"),
            "messages": ct.escalation_messages(
                F.col("question"),
                F.col("retrieved"),
                F.col("tier1")["raw_output"],
                F.col("tier1")["gate_failures"],
            ),
        }
    )
    done = source.complete(requests, "tier2").drop("messages")
    done = done.withColumn("escalated", F.col("wanted"))
    done = attempt(done, "tier2", threshold, levels, reuse=MEASURED)
    return done.drop(MEASURED).withColumnRenamed("error", "tier2_error")


def attempt(
    completed: DataFrame,
    tier: str,
    threshold: Column | float,
    levels: tuple[str, tuple[float, ...] | str] | None = None,
    carry: str | None = None,
    reuse: str | None = None,
) -> DataFrame:
    """Verify ``completion`` and fold both into one attempt struct named after the tier."""
    raw = completed.withColumn("_raw", F.col("completion")["text"])
    verified = gate.verify(raw, threshold, raw="_raw", levels=levels, carry=carry, reuse=reuse)
    g, c = F.col("gate"), F.col("completion")
    record = F.struct(
        F.lit(tier).alias("tier"),
        c["provider"].alias("provider"),
        c["model"].alias("model"),
        c["latency"].alias("latency"),
        c["finish_reason"].alias("finish_reason"),
        c["text"].alias("raw_output"),
        g["passed"].alias("gate_passed"),
        g["outcome"].alias("gate_outcome"),
        g["checks"].alias("gate_checks"),
        g["failures"].alias("gate_failures"),
        g["details"].alias("gate_details"),
    )
    done = verified.withColumn(tier, F.when(c.isNotNull(), record))
    return done.drop("completion", "gate", "_raw", "wanted")


def resolve(
    retrieved: DataFrame,
    source: CompletionSource,
    cfg: Config = Config(),
    threshold: Column | None = None,
) -> DataFrame:
    """Run both attempts on retrieved questions and decide the outcome.

    Keeps the caller's columns and adds ``answer, sources, outcome, escalated, model_calls`` and
    the nested ``trace``. Rows stay in one branch: a flag says which of them a source is asked
    about, so nothing upstream is computed twice.
    """
    limit = threshold if threshold is not None else F.lit(cfg.overlap_threshold)
    first = first_attempt(retrieved, source)
    return decide(second_attempt(attempt_one(first, limit), source, limit))


def attempt_one(
    completed: DataFrame,
    threshold: Column | float,
    levels: tuple[str, tuple[float, ...]] | None = None,
) -> DataFrame:
    """Verify the first completion; measures that ``completed`` has from a verification of the same text are used."""
    seen = MEASURED if MEASURED in completed.columns else None
    done = attempt(completed, "tier1", threshold, levels, carry=MEASURED, reuse=seen)
    return done.withColumnRenamed("error", "tier1_error")


def decide(attempted: DataFrame) -> DataFrame:
    """Final outcome, answer and trace from the two attempts."""
    one, two = F.col("tier1"), F.col("tier2")
    last = F.coalesce(two, one)
    skipped = ~F.coalesce(F.col("precheck_passed"), F.lit(False)) | (F.size("retrieved") == 0)
    error = F.coalesce("tier1_error", "tier2_error")
    outcome = (
        F.when(skipped, F.lit("refused"))
        .when(error.isNotNull(), F.lit("failed"))
        .otherwise(F.coalesce(last["gate_outcome"], F.lit("failed")))
    )
    passed = F.col("outcome") == "passed"
    answer = F.when(passed, last["gate_details"]["answer"]).otherwise(
        ct.safe_refusal(F.col("resolved_lang"))
    )
    no_sources = F.array().cast("array<string>")
    sources = F.when(passed, last["gate_details"]["sources"]).otherwise(no_sources)
    ids = F.transform("retrieved", lambda p: p["id"])
    attempts = F.array_compact(F.array(one, two))
    decided = (
        attempted.withColumn("outcome", outcome)
        .withColumn("answer", answer)
        .withColumn("sources", sources)
        .withColumn("model_calls", F.size(attempts))
        .withColumn("escalated", F.coalesce("escalated", F.lit(False)))
    )
    trace = F.struct(
        F.col("question"),
        F.col("resolved_lang").alias("detected_language"),
        F.struct(
            F.size("retrieved").alias("passages_count"),
            F.col("top_score").alias("top_bm25_score"),
            F.col("precheck_passed"),
            ids.alias("retrieved_passage_ids"),
        ).alias("retrieval"),
        attempts.alias("attempts"),
        F.col("escalated"),
        F.col("model_calls").alias("total_model_calls"),
        F.col("outcome").alias("final_outcome"),
        F.col("answer").alias("final_answer"),
        F.col("sources").alias("final_sources"),
        error.alias("provider_error"),
    )
    return decided.withColumn("trace", trace).drop("tier1", "tier2", "tier1_error", "tier2_error")
