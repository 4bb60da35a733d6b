"""Answering submitted requests: validation, admission, answers, recorded fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import lexicon as lx
from ..functions.records import client_address, question_status
from ..functions.text import normalize_question, strip_space
from ..operators.index import Index
from ..operators.limits import DAY_FULL, WINDOW_FULL, admission
from ..session import stage
from ..sources.completions import CompletionSource
from .cascade import ask, is_miss

REPLAYED = ["answer", "sources", "outcome", "escalated", "model_calls", "trace"]


def validate(requests: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Trim ``question`` and add ``status`` ('ok' or the reason for rejection)."""
    trimmed = requests.withColumn("question", strip_space(F.col("question")))
    return trimmed.withColumn("status", question_status(F.col("question"), cfg.max_question_chars))


def recorded_by_question(traces: DataFrame) -> DataFrame:
    """(question_key, run): the first recorded run of each question, by ``pos``."""
    run = F.struct(*[c for c in REPLAYED if c in traces.columns])
    keyed = traces.withColumn("question_key", normalize_question(F.col("question")))
    return keyed.groupBy("question_key").agg(F.min_by(run, "pos").alias("run"))


def with_fallback(requests: DataFrame, traces: DataFrame) -> DataFrame:
    """Add ``run``: the recorded run whose question is the same up to case and whitespace.

    One row per question key is joined; a question asked very often is split by the adaptive skew
    join on the request side.
    """
    keyed = requests.withColumn("question_key", normalize_question(F.col("question")))
    return keyed.join(recorded_by_question(traces), "question_key", "left").drop("question_key")


def admit(checked: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Turn the status 'ok' of requests over a limit into window_full or day_full.

    Needs qid, ts, peer and forwarded next to ``status``. Only valid requests count. Limits are decided on
    ids, times and callers; questions are joined back by id.
    """
    caller = client_address(F.col("forwarded"), F.col("peer"), cfg.trust_proxy)
    events = checked.where("status = 'ok'").select(F.col("qid").alias("event_id"), caller.alias("client"), "ts")
    verdicts = admission(events, cfg).select(F.col("event_id").alias("_id"), "verdict")
    joined = checked.join(verdicts, checked["qid"] == verdicts["_id"], "left")
    refused = F.col("verdict").isin(WINDOW_FULL, DAY_FULL)
    return joined.withColumn("status", F.when(refused, F.col("verdict")).otherwise(F.col("status"))).drop("_id", "verdict")


def answer_requests(
    requests: DataFrame,
    passages: DataFrame,
    source: CompletionSource,
    traces: DataFrame | None = None,
    cfg: Config = Config(),
    index: Index | None = None,
) -> DataFrame:
    """Answer requests (qid, question; with ts, peer and forwarded, limits apply).

    ``status`` is ok, the reason why a question is invalid, window_full, day_full, or unavailable: the request
    may only be answered from the cache, which lacks it, and no recorded run has the question. Only
    such misses fall back to recorded runs; a failure of the providers is an answer, the safe refusal.
    Requests with another status than ok have no answer.
    """
    checked = validate(requests, cfg)
    if {"ts", "peer", "forwarded"} <= set(requests.columns):
        checked = admit(checked, cfg)
    checked = stage(checked, "checked")
    answered = ask(checked.where("status = 'ok'"), passages, source, cfg, index, raise_misses=False)
    answered = answered.withColumn("_miss", is_miss()).select("qid", "question", "status", "_miss", *REPLAYED)
    done = _replay(answered, traces)
    rejected = checked.where("status <> 'ok'").select("qid", "question", "status")
    return done.unionByName(rejected, allowMissingColumns=True)


def _replay(answered: DataFrame, traces: DataFrame | None) -> DataFrame:
    """Misses take a recorded run, with its trace as JSON in ``recorded_trace``, or become unavailable."""
    miss = F.col("_miss")
    if traces is None:
        matched, found = answered, F.lit(False)
        run = dict.fromkeys(REPLAYED, F.lit(None))
    else:
        matched, found = with_fallback(answered, traces), F.col("run").isNotNull()
        given = matched.schema["run"].dataType.names
        run = {c: F.col("run")[c] if c in given else F.lit(None) for c in REPLAYED}
    taken = {c: F.when(miss, run[c]).otherwise(F.col(c)) for c in REPLAYED if c != "trace"}
    recorded = F.to_json(run["trace"]) if traces is not None and "trace" in given else F.lit(None).cast("string")
    return matched.withColumns(
        {
            **taken,
            "trace": F.when(~miss, F.col("trace")),
            "recorded_trace": F.when(miss, recorded),
            "status": F.when(miss & ~found, "unavailable").otherwise(F.col("status")),
            "is_cached_example": miss & found,
            "notice": F.when(miss & found, F.lit(lx.FALLBACK_NOTICE)),
        }
    ).drop("run", "_miss")


def health(passages: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row of liveness facts."""
    return passages.agg(
        F.lit("healthy").alias("status"),
        F.count("*").alias("passages"),
        F.lit(", ".join(cfg.provider_order)).alias("providers"),
        F.lit(cfg.requests_per_minute).alias("requests_per_minute"),
    )
