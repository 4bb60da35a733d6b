"""The three evaluation setups over one shared retrieval, their records, and the sweep."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import NO_PRECHECK, Config
from ..functions import contract as ct
from ..functions.rounding import exact_round
from ..operators import gate
from ..operators.index import Index
from ..operators.metrics import metrics, metrics_by_language
from ..operators.retrieve import retrieve
from ..session import stage
from ..sources.completions import CompletionSource
from . import cascade

#: fixed values: setups, sweep thresholds, and the threshold of the raw and judge audits
SETUPS = ("raw", "llm_judge", "gate")
SWEEP = (0.4, 0.5, 0.6, 0.7, 0.8)
AUDIT_THRESHOLD = 0.60

RECORD = (
    "id setup lang answerable outcome answer sources retrieved_passage_ids model_calls escalated "
    "latency is_grounded error_details"
).split()


def select_questions(questions: DataFrame, lang: str = "all", limit: int = 0) -> DataFrame:
    """Questions of one language, and the first ``limit`` by ``pos`` when that is not zero."""
    chosen = questions if lang == "all" else questions.where(F.col("lang") == lang)
    return chosen.orderBy("pos").limit(limit) if limit else chosen


def call_estimates(questions: DataFrame, setups: tuple[str, ...] = SETUPS) -> DataFrame:
    """(setup, min_calls, max_calls) a run would need, from the question count alone."""
    setup = F.col("setup")
    return (
        questions.agg(F.count("*").alias("n"))
        .select("n", F.explode(F.array(*[F.lit(s) for s in setups])).alias("setup"))
        .select(
            "setup",
            (F.col("n") * F.when(setup == "llm_judge", 2).otherwise(1)).alias("min_calls"),
            (F.col("n") * F.when(setup == "raw", 1).otherwise(2)).alias("max_calls"),
        )
    )


def _no_texts() -> Column:
    return F.array().cast("array<string>")


def _ids() -> Column:
    return F.transform("retrieved", lambda p: p["id"])


def _record(df: DataFrame, setup: str, **values: Column) -> DataFrame:
    base = {
        "id": F.col("qid"),
        "setup": F.lit(setup),
        "lang": F.col("lang"),
        "answerable": F.col("answerable"),
    }
    return df.select(*[{**base, **values}[name].alias(name) for name in RECORD])


def raw_stage(completed: DataFrame) -> DataFrame:
    """Lenient reading of a tier-1 completion, without the gate; adds ``raw_*`` columns.

    ``completed`` has ``completion, error, wanted`` and the retrieval columns, which stay as they are. What the audit
    measured stays too (``cascade.MEASURED``), for the judge's audit and the gate over the same completions.
    """
    data = F.col("_raw_data")
    read = completed.withColumn("_raw_text", F.col("completion")["text"]).withColumn(
        "_raw_data", ct.parse_object(F.col("_raw_text"))
    )
    kind = ct.field_kind(data, "sources")
    listed = F.rlike(kind, F.lit("^(ARRAY|OBJECT|STRING)"))
    # sources that can't be read as a list at all end the record, as a failed call does
    unread = F.when(
        ~F.coalesce(listed, F.lit(True)) & ~ct.truthy(data, "refuse"),
        F.concat(F.lit("sources: "), ct.type_name(kind), F.lit(" is not a list")),
    )
    read = read.withColumn("raw_error", F.coalesce("error", unread))
    unusable = data.isNull() | (data.cast("string") == "{}")
    outcome = (
        F.when(~F.col("wanted"), F.lit("refused"))
        .when(F.col("raw_error").isNotNull(), F.lit("error"))
        .when(unusable, F.lit("failed"))
        .when(ct.truthy(data, "refuse"), F.lit("refused"))
        .otherwise(F.lit("passed"))
    )
    passed = F.col("raw_outcome") == "passed"
    # only answers that passed are audited
    told = read.withColumn("raw_outcome", outcome).withColumn("_audited", F.when(passed, F.col("_raw_text")))
    audited = gate.verify(told, AUDIT_THRESHOLD, raw="_audited", output="_audit", carry=cascade.MEASURED)
    refusal = ct.safe_refusal(F.col("resolved_lang"))
    return audited.withColumns(
        {
            "raw_answer": F.when(passed, ct.lenient_text(data, "answer"))
            .when(F.col("raw_outcome") == "refused", refusal)
            .when(F.col("raw_outcome") == "failed", F.col("_raw_text"))
            .otherwise(F.concat(F.lit("Error: "), F.col("raw_error"))),
            "raw_sources": F.when(passed, ct.lenient_list(data, "sources")).otherwise(_no_texts()),
            "raw_ids": F.when(F.col("raw_outcome") == "error", _no_texts()).otherwise(_ids()),
            "raw_calls": F.when(F.col("wanted") & F.col("raw_error").isNull(), 1).otherwise(0),
            "raw_latency": F.coalesce(F.col("completion")["latency"], F.lit(0.0)),
            "raw_grounded": F.when(passed, F.col("_audit")["passed"]).otherwise(
                F.col("raw_outcome") == "refused"
            ),
        }
    ).drop("_raw_data", "_raw_text", "_audited", "_audit")


def raw_records(staged: DataFrame) -> DataFrame:
    return _record(
        staged,
        "raw",
        outcome=F.col("raw_outcome"),
        answer=F.col("raw_answer"),
        sources=F.col("raw_sources"),
        retrieved_passage_ids=F.col("raw_ids"),
        model_calls=F.col("raw_calls"),
        escalated=F.lit(False),
        latency=F.col("raw_latency"),
        is_grounded=F.col("raw_grounded"),
        error_details=F.col("raw_error"),
    )


def judge_records(staged: DataFrame, source: CompletionSource) -> DataFrame:
    """Second completion judges the raw answers; ungrounded ones become refusals."""
    in_pack_order = F.array_sort(
        "retrieved",
        lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0),
    )
    asked = (
        staged.withColumnRenamed("raw_error", "_raw_error")
        .drop("completion", "error")
        .withColumns({"retrieved": in_pack_order, "wanted": F.col("raw_outcome") == "passed"})
        .withColumn("_rank_ids", F.col("raw_ids"))
        .withColumn(
            "messages",
            ct.judge_messages(F.col("question"), F.col("retrieved"), F.col("raw_answer")),
        )
    )
    judged = source.complete(asked, "judge").drop("messages")
    verdict = judged.withColumn("_verdict", ct.parse_object(F.col("completion")["text"]))
    agrees = F.col("_agrees")
    heard = F.col("_verdict").isNotNull() & ct.truthy(F.col("_verdict"), "grounded")
    # only answers the judge agrees with are audited
    typed = verdict.withColumn("_agrees", F.col("wanted") & F.coalesce(heard, F.lit(False))).withColumns(
        {
            "_answer": F.when(agrees, F.col("raw_answer")),
            "_sources": F.when(agrees, F.col("raw_sources")),
            "_refuse": F.lit(False),
        }
    )
    audited = gate.verify(typed, AUDIT_THRESHOLD, raw=None, output="_audit", reuse=cascade.MEASURED)
    asked_judge, failed = F.col("wanted"), F.col("wanted") & F.col("error").isNotNull()
    refusal = ct.safe_refusal(F.get("candidates", F.lit(0)))
    outcome = (
        F.when(~asked_judge, F.col("raw_outcome"))
        .when(failed, F.lit("error"))
        .when(agrees, F.lit("passed"))
        .otherwise(F.lit("refused"))
    )
    latency = F.col("raw_latency") + F.coalesce(F.col("completion")["latency"], F.lit(0.0))
    return _record(
        audited.withColumn("_latency", latency),
        "llm_judge",
        outcome=outcome,
        answer=F.when(~asked_judge | agrees, F.col("raw_answer"))
        .when(failed, F.concat(F.lit("Error: "), F.col("error")))
        .otherwise(refusal),
        sources=F.when(~asked_judge | agrees, F.col("raw_sources")).otherwise(_no_texts()),
        retrieved_passage_ids=F.when(failed, _no_texts()).otherwise(F.col("_rank_ids")),
        model_calls=F.when(~asked_judge, F.col("raw_calls")).when(failed, 0).otherwise(2),
        escalated=F.lit(False),
        latency=exact_round("_latency", 2),
        is_grounded=F.when(~asked_judge, F.col("raw_grounded"))
        .when(failed, False)
        .when(agrees, F.col("_audit")["passed"])
        .otherwise(True),
        error_details=F.coalesce(F.col("_raw_error"), F.when(failed, F.col("error"))),
    )


def gate_records(answered: DataFrame) -> DataFrame:
    """Records of cascade results; a provider error becomes outcome 'error'."""
    error = F.col("trace")["provider_error"]
    spent = F.aggregate(
        F.col("trace")["attempts"], F.lit(0.0), lambda s, a: s + F.coalesce(a["latency"], F.lit(0.0))
    )
    timed = answered.withColumn("_latency", spent)
    return _record(
        timed,
        "gate",
        outcome=F.when(error.isNotNull(), F.lit("error")).otherwise(F.col("outcome")),
        answer=F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).otherwise(
            F.col("answer")
        ),
        sources=F.when(error.isNotNull(), _no_texts()).otherwise(F.col("sources")),
        retrieved_passage_ids=F.col("trace")["retrieval"]["retrieved_passage_ids"],
        model_calls=F.col("model_calls"),
        escalated=F.col("escalated"),
        latency=exact_round("_latency", 2),
        is_grounded=error.isNull() & (F.col("outcome") == "passed"),
        error_details=error,
    )


def gate_sweep(
    completed: DataFrame, source: CompletionSource, thresholds: tuple[float, ...] = SWEEP
) -> DataFrame:
    """Gate metrics at each overlap threshold, from one retrieval and one tier-1 completion.

    Thresholds that give a question the same tier-1 failures share its second request and what is read from the reply.
    """
    limit = F.col("overlap_threshold")
    spread = cascade.attempt_one(completed, F.get("_levels", F.lit(0)), ("_levels", thresholds))
    checked = cascade.second_attempt(spread, source, limit, ("overlap_threshold", "_levels"))
    told = F.when(F.col("tier1")["gate_details"]["overlap_threshold"].isNotNull(), limit)
    own = F.col("tier1").withField("gate_details.overlap_threshold", told)
    answered = cascade.decide(checked.withColumn("tier1", own).drop("_levels"))
    records = gate_records(answered.withColumn("qid", F.struct("qid", "overlap_threshold")))
    return metrics(
        records.withColumn("overlap_threshold", F.col("id")["overlap_threshold"]),
        "overlap_threshold",
    )


@dataclass(frozen=True)
class Benchmark:
    """Records and metrics of a run; ``sweep`` is None unless asked for."""

    records: DataFrame
    metrics: DataFrame
    sweep: DataFrame | None


def run_benchmark(
    questions: DataFrame,
    passages: DataFrame,
    source: CompletionSource,
    cfg: Config = Config(),
    setups: tuple[str, ...] = SETUPS,
    no_precheck: bool = False,
    sweep: bool = False,
    index: Index | None = None,
) -> Benchmark:
    """Evaluate ``questions`` (qid, question, lang, answerable) under each setup.

    Retrieval and the tier-1 completion are shared: they are staged once and read by every setup
    and by the sweep.
    """
    if no_precheck:
        cfg = replace(cfg, min_score=NO_PRECHECK)
    retrieved = retrieve(questions, passages, cfg, index)
    completed = stage(cascade.first_attempt(retrieved, source), "tier1")
    parts, read = [], completed
    if "raw" in setups or "llm_judge" in setups:
        raw = read = stage(raw_stage(completed), "raw")
        if "raw" in setups:
            parts.append(raw_records(raw))
        if "llm_judge" in setups:
            parts.append(judge_records(raw, source))
    if "gate" in setups:
        limit = F.lit(cfg.overlap_threshold)
        checked = cascade.attempt_one(read, limit)
        answered = cascade.decide(cascade.second_attempt(checked, source, limit))
        parts.append(gate_records(answered))
    records = parts[0]
    for part in parts[1:]:
        records = records.unionByName(part)
    records = stage(records, "records")
    swept = gate_sweep(completed, source) if sweep and "gate" in setups else None
    return Benchmark(records, metrics_by_language(records), swept)
