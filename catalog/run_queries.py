"""Cascade, evaluation setups, metrics and reports, each with its SQL counterpart.

Answers come from ``DerivedSource``: a deterministic completion per question, made from the first
retrieved passage, with defects by question number (see ``sql.completion``).
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.config import Config
from attestra.functions import records as rc
from attestra.operators import metrics as mt
from attestra.operators.retrieve import route
from attestra.plans import benchmark as bm
from attestra.plans import cascade
from attestra.session import stage

from . import gate_queries, inputs, sql
from .gate_queries import SQL_VERDICT, gate_columns
from .inputs import SQL_PASSAGES, SQL_QUESTIONS

CFG = replace(Config(), min_score=40.0)

_TIER1_DOWN = "(qid % 32 = 31)"
_TIER2_DOWN = "(qid % 32 = 14)"
_JUDGE_DOWN = "(qid % 64 = 17)"


class DerivedSource:
    """Completions computed from ``qid`` and the first retrieved passage."""

    def complete(self, requests: DataFrame, tier: str) -> DataFrame:
        first = requests.withColumns(
            {"_id": F.get("retrieved", F.lit(0))["id"], "_text": F.get("retrieved", F.lit(0))["text"]}
        )
        variant = "(qid % 16)"
        if tier == "tier1":
            text, down = sql.completion(variant, "_text", "_id", sql.plain_java), _TIER1_DOWN
        elif tier == "tier2":
            text = sql.completion(f"({sql.SECOND.format(v=variant)})", "_text", "_id", sql.plain_java)
            down = _TIER2_DOWN
        else:
            text = "'{\"grounded\": ' || CASE WHEN qid % 3 = 0 THEN 'false' ELSE 'true' END || '}'"
            down = _JUDGE_DOWN
        number = {"tier1": 1, "tier2": 2, "judge": 3}[tier]
        latency = (F.col("qid") % 7).cast("double") / 4.0 + F.lit(float(number))
        completion = F.struct(
            F.expr(text).alias("text"),
            F.lit("derived").alias("provider"),
            F.lit(f"model-{number}").alias("model"),
            latency.alias("latency"),
            F.lit("stop").alias("finish_reason"),
        )
        fails = F.expr(down)
        return first.withColumns(
            {
                "completion": F.when(F.col("wanted") & ~fails, completion),
                "error": F.when(F.col("wanted") & fails, F.lit(f"{tier} down")),
            }
        ).drop("_id", "_text")


def answered_questions(spark, sf_dir) -> DataFrame:
    """Benchmark questions through retrieval and the cascade."""
    return cascade.ask(
        inputs.questions(spark, sf_dir), inputs.passages(spark, sf_dir), DerivedSource(), CFG
    )


def document_cases(spark, sf_dir) -> DataFrame:
    """One retrieved question per document, in the shape ``retrieve`` returns."""
    cases = gate_queries.cases(spark, sf_dir).withColumnRenamed("key", "qid").drop("raw_output")
    size = F.length(F.get("retrieved", F.lit(0))["text"])
    lang = F.when(F.col("qid") % 3 == 0, "hi").when(F.col("qid") % 3 == 1, "mr").otherwise("en")
    return route(cases).withColumns(
        {
            "pos": F.col("qid"),
            "lang": lang,
            "answerable": (F.col("qid") % 4) != 1,
            "precheck_passed": size >= 200,
            "top_score": size.cast("double") / 8,
            "resolved_lang": F.get("candidates", F.lit(0)),
        }
    )


def answered_documents(spark, sf_dir) -> DataFrame:
    return cascade.resolve(document_cases(spark, sf_dir), DerivedSource(), CFG)


def _outcomes(answered: DataFrame) -> DataFrame:
    return answered.select(
        "qid",
        "outcome",
        "answer",
        F.array_join("sources", ",").alias("sources"),
        "escalated",
        F.col("model_calls").cast("long").alias("model_calls"),
        F.col("trace")["provider_error"].alias("provider_error"),
    )


def cascade_outcomes(spark, sf_dir):
    return _outcomes(answered_questions(spark, sf_dir))


def cascade_documents(spark, sf_dir):
    return _outcomes(answered_documents(spark, sf_dir))


def trace_rows(spark, sf_dir):
    answered = answered_questions(spark, sf_dir)
    found = F.col("trace")["retrieval"]
    return answered.select(
        "qid",
        F.col("trace")["detected_language"].alias("detected_language"),
        found["passages_count"].cast("long").alias("passages_count"),
        found["top_bm25_score"].alias("top_bm25_score"),
        found["precheck_passed"].alias("precheck_passed"),
        F.array_join(found["retrieved_passage_ids"], ",").alias("retrieved_ids"),
        F.array_join(
            F.transform(
                F.col("trace")["attempts"],
                lambda a: F.concat_ws(":", a["tier"], a["model"], a["gate_outcome"], a["latency"].cast("string")),
            ),
            ",",
        ).alias("attempts"),
        F.col("trace")["total_model_calls"].cast("long").alias("total_model_calls"),
        F.col("trace")["final_outcome"].alias("final_outcome"),
    )


def trace_attempts(spark, sf_dir):
    """One row per attempt with its full gate result."""
    attempts = answered_documents(spark, sf_dir).select(
        "qid", F.explode("trace.attempts").alias("a")
    )
    g = F.struct(
        F.col("a.gate_passed").alias("passed"),
        F.col("a.gate_outcome").alias("outcome"),
        F.col("a.gate_checks").alias("checks"),
        F.col("a.gate_failures").alias("failures"),
        F.col("a.gate_details").alias("details"),
    )
    return attempts.select("qid", F.col("a.tier").alias("tier"), g.alias("g")).select(
        "qid", "tier", *gate_columns(F.col("g"))
    )


def escalation_subset(spark, sf_dir):
    answered = answered_documents(spark, sf_dir)
    return answered.where("escalated").select(
        "qid", F.array_join(F.get("trace.attempts", F.lit(0))["gate_failures"], " ; ").alias("reasons")
    )


def outcome_labels(spark, sf_dir):
    answered = answered_documents(spark, sf_dir)
    outcome, calls = F.col("outcome"), F.col("model_calls")
    return answered.select(
        "qid",
        rc.outcome_label(outcome, calls).alias("label"),
        rc.scenario(outcome, calls, F.col("escalated")).alias("scenario"),
    )


# ---- evaluation ---------------------------------------------------------------------------
def _completed(spark, sf_dir) -> DataFrame:
    return cascade.first_attempt(document_cases(spark, sf_dir), DerivedSource())


def _raw(spark, sf_dir) -> DataFrame:
    return bm.raw_records(bm.raw_stage(_completed(spark, sf_dir)))


def _judge(spark, sf_dir) -> DataFrame:
    return bm.judge_records(bm.raw_stage(_completed(spark, sf_dir)), DerivedSource())


def _gate(spark, sf_dir) -> DataFrame:
    return bm.gate_records(answered_documents(spark, sf_dir))


def _records(spark, sf_dir) -> DataFrame:
    """Records of the three setups over one staged first attempt with its measures, as ``run_benchmark`` has them."""
    source, limit = DerivedSource(), F.lit(CFG.overlap_threshold)
    raw = stage(bm.raw_stage(_completed(spark, sf_dir)), "raw")
    checked = cascade.second_attempt(cascade.attempt_one(raw, limit), source, limit)
    parts = [bm.raw_records(raw), bm.judge_records(raw, source), bm.gate_records(cascade.decide(checked))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _flat(records: DataFrame) -> DataFrame:
    return records.select(
        "id",
        "setup",
        "lang",
        "answerable",
        "outcome",
        "answer",
        F.array_join("sources", ",").alias("sources"),
        F.array_join("retrieved_passage_ids", ",").alias("retrieved_ids"),
        F.col("model_calls").cast("long").alias("model_calls"),
        "escalated",
        "latency",
        "is_grounded",
        "error_details",
    )


def raw_setup(spark, sf_dir):
    return _flat(_raw(spark, sf_dir))


def judge_setup(spark, sf_dir):
    return _flat(_judge(spark, sf_dir))


def gate_setup(spark, sf_dir):
    return _flat(_gate(spark, sf_dir))


def citation_validity(spark, sf_dir):
    valid = mt.citation_valid(F.col("sources"), F.col("retrieved_passage_ids"))
    return _raw(spark, sf_dir).select("id", valid.alias("valid"))


def eval_metrics_overall(spark, sf_dir):
    return mt.metrics(_records(spark, sf_dir), "setup")


def eval_metrics_by_lang(spark, sf_dir):
    return mt.metrics_by_language(_records(spark, sf_dir))


def error_total(spark, sf_dir):
    return _records(spark, sf_dir).agg(F.count_if(F.col("outcome") == "error").alias("errors"))


def overlap_sweep(spark, sf_dir):
    return bm.gate_sweep(_completed(spark, sf_dir), DerivedSource())


def report_lines(spark, sf_dir):
    rows = mt.metrics_by_language(_records(spark, sf_dir))
    return rows.select(
        "setup", "lang", mt.comparison_line().alias("comparison"), mt.language_line().alias("language")
    )


def console_lines(spark, sf_dir):
    return mt.metrics(_records(spark, sf_dir), "setup").select(mt.console_line().alias("line"))


def sweep_lines(spark, sf_dir):
    return overlap_sweep(spark, sf_dir).select(mt.sweep_line().alias("line"))


def benchmark_run(spark, sf_dir):
    """All setups over retrieval of the benchmark questions, without the pre-check."""
    result = bm.run_benchmark(
        inputs.questions(spark, sf_dir),
        inputs.passages(spark, sf_dir),
        DerivedSource(),
        CFG,
        no_precheck=True,
    )
    return result.metrics


def call_estimates(spark, sf_dir):
    return bm.call_estimates(inputs.questions(spark, sf_dir)).select(
        "setup", F.col("min_calls").cast("long"), F.col("max_calls").cast("long")
    )


def question_filter(spark, sf_dir):
    questions = inputs.questions(spark, sf_dir)
    return bm.select_questions(questions, "en", 10).select("qid", "lang")


# ---- SQL ----------------------------------------------------------------------------------
_LATENCY = "((qid % 7)::DOUBLE / 4.0 + {n}.0)"

#: ``retrieved(qid, question, lang, answerable, cand, resolved, ok, ids, texts, top)``
_DOCUMENTS = f"""{gate_queries.CASES_SQL},
retrieved AS MATERIALIZED (
  SELECT key AS qid, question, ['hi', 'mr', 'en'][key % 3 + 1] AS lang, key % 4 <> 1 AS answerable,
         {sql.candidates('question')} AS cand, left({sql.candidates('question')}, 2) AS resolved,
         length(texts[1]) >= 200 AS ok, ids, texts, length(texts[1])::DOUBLE / 8 AS top
  FROM cases)"""


def _questions(min_score: float) -> str:
    return f"""{sql.bm25(SQL_PASSAGES, SQL_QUESTIONS)},
retrieved AS MATERIALIZED (
  SELECT qid, any_value(q.question) AS question, any_value(q.lang) AS lang,
         any_value(q.answerable) AS answerable, any_value(cand) AS cand,
         CASE WHEN any_value(cand) = 'hi_mr' THEN arg_min(d.lang, rank) ELSE any_value(cand) END AS resolved,
         max(score) >= {min_score} AS ok, list(d.id ORDER BY rank) AS ids,
         list(d.text ORDER BY rank) AS texts, max(score) AS top
  FROM ranked JOIN docs d USING (pos) JOIN questions q USING (qid) JOIN routed USING (qid)
  GROUP BY qid)"""


def _cascade(levels: str = "", limit: str = "0.6") -> str:
    """CTEs from ``retrieved`` to ``answered``; ``levels`` is an extra column and its values."""
    extra = f", unnest([{levels}]) AS level" if levels else ", 0.6 AS level"
    one = sql.completion("(qid % 16)", "texts[1]", "ids[1]")
    two = sql.completion(f"({sql.SECOND.format(v='(qid % 16)')})", "texts[1]", "ids[1]")
    return f"""
spread AS (SELECT *{extra} FROM retrieved),
first_try AS (SELECT *, {_TIER1_DOWN} AS down1, {one} AS raw, qid AS key FROM spread WHERE ok),
asked1 AS (SELECT * FROM first_try WHERE NOT down1),
{sql.gate('asked1', 'a', 'level')},
asked2 AS (SELECT qid AS key, qid, question, ids, texts, level, {two} AS raw
           FROM a_gated WHERE outcome = 'failed' AND NOT {_TIER2_DOWN}),
{sql.gate('asked2', 'b', 'level')},
joined AS (
  SELECT s.*, a.qid IS NOT NULL AS has1, b.qid IS NOT NULL AS has2, a.outcome AS o1, b.outcome AS o2,
         a.answer AS ans1, b.answer AS ans2, a.sources AS src1, b.sources AS src2,
         a.failures AS fail1,
         CASE WHEN s.ok AND {_TIER1_DOWN.replace('qid', 's.qid')} THEN 'tier1 down'
              WHEN a.outcome = 'failed' AND {_TIER2_DOWN.replace('qid', 's.qid')} THEN 'tier2 down' END AS err
  FROM spread s LEFT JOIN a_gated a USING (qid, level) LEFT JOIN b_gated b USING (qid, level)),
decided AS (SELECT *, CASE WHEN NOT ok THEN 'refused' WHEN err IS NOT NULL THEN 'failed'
                      ELSE coalesce(o2, o1) END AS outcome,
              coalesce(o1 = 'failed', false) AS escalated,
              CAST(has1 AS BIGINT) + CAST(has2 AS BIGINT) AS model_calls FROM joined),
answered AS (SELECT *, CASE WHEN outcome = 'passed' THEN CASE WHEN has2 THEN ans2 ELSE ans1 END
                       ELSE {sql.refusal('resolved')} END AS answer,
               CASE WHEN outcome = 'passed' THEN CASE WHEN has2 THEN src2 ELSE src1 END
                    ELSE [] END AS sources FROM decided)"""


_GATE_RECORDS = f"""
gate_records AS (SELECT qid AS id, 'gate' AS setup, lang, answerable,
  CASE WHEN err IS NOT NULL THEN 'error' ELSE outcome END AS outcome,
  CASE WHEN err IS NOT NULL THEN 'Error: ' || err ELSE answer END AS answer,
  CASE WHEN err IS NOT NULL THEN [] ELSE sources END AS sources, ids AS retrieved_ids, model_calls,
  escalated,
  {sql.exact_round(f"has1::INT * {_LATENCY.format(n=1)} + has2::INT * {_LATENCY.format(n=2)}", 2)} AS latency,
  err IS NULL AND outcome = 'passed' AS is_grounded, err AS error_details, level FROM answered)"""

_TRUTHY = gate_queries._TRUTHY
_RAW_RECORDS = f"""
raw_try AS (SELECT qid AS key, *, {sql.completion('(qid % 16)', 'texts[1]', 'ids[1]')} AS raw
            FROM retrieved WHERE ok AND NOT {_TIER1_DOWN}),
{sql.gate('raw_try', 'r')},
raw_read AS (SELECT qid, outcome AS audit, j, raw, {_TRUTHY} AS refuses FROM r_gated),
raw_full AS (SELECT t.*, a.audit, a.j, a.raw,
  CASE WHEN NOT ok THEN 'refused' WHEN a.qid IS NULL THEN 'error' WHEN j IS NULL THEN 'failed'
       WHEN refuses THEN 'refused' ELSE 'passed' END AS raw_outcome
  FROM retrieved t LEFT JOIN raw_read a USING (qid)),
raw_records AS (SELECT qid AS id, 'raw' AS setup, lang, answerable, raw_outcome AS outcome,
  CASE raw_outcome WHEN 'passed' THEN json_extract_string(j, '$.answer') WHEN 'failed' THEN raw
    WHEN 'refused' THEN {sql.refusal('resolved')} ELSE 'Error: tier1 down' END AS answer,
  CASE WHEN raw_outcome = 'passed' THEN coalesce(json_extract_string(j, '$.sources[*]'), []) ELSE [] END AS sources,
  CASE WHEN raw_outcome = 'error' THEN [] ELSE ids END AS retrieved_ids,
  CAST(ok AND raw_outcome <> 'error' AS BIGINT) AS model_calls, false AS escalated,
  CASE WHEN ok AND raw_outcome <> 'error' THEN {_LATENCY.format(n=1)} ELSE 0.0 END AS latency,
  CASE raw_outcome WHEN 'passed' THEN audit = 'passed' WHEN 'refused' THEN true ELSE false END AS is_grounded,
  CASE WHEN raw_outcome = 'error' THEN 'tier1 down' END AS error_details, qid, question, cand, ids, texts
  FROM raw_full)"""
_JUDGE_RECORDS = f"""
judge_try AS (SELECT qid AS key, qid, question, ids, texts,
    '{{"answer": ' || to_json(answer) || ', "sources": ' || to_json(sources) || ', "refuse": false}}' AS raw
  FROM raw_records WHERE outcome = 'passed'),
{sql.gate('judge_try', 'u')},
judge_full AS (SELECT r.*, u.outcome AS audit, r.outcome = 'passed' AS judged,
    r.outcome = 'passed' AND {_JUDGE_DOWN.replace('qid', 'r.qid')} AS down,
    r.outcome = 'passed' AND r.qid % 3 <> 0 AND NOT {_JUDGE_DOWN.replace('qid', 'r.qid')} AS agrees
  FROM raw_records r LEFT JOIN u_gated u USING (qid)),
judge_records AS (SELECT id, 'llm_judge' AS setup, lang, answerable,
  CASE WHEN NOT judged THEN outcome WHEN down THEN 'error' WHEN agrees THEN 'passed' ELSE 'refused' END AS outcome,
  CASE WHEN NOT judged OR agrees THEN answer WHEN down THEN 'Error: judge down'
       ELSE {sql.refusal('left(cand, 2)')} END AS answer,
  CASE WHEN NOT judged OR agrees THEN sources ELSE [] END AS sources,
  CASE WHEN down THEN [] ELSE retrieved_ids END AS retrieved_ids,
  CASE WHEN NOT judged THEN model_calls WHEN down THEN 0 ELSE 2 END AS model_calls, false AS escalated,
  {sql.exact_round(f"latency + CASE WHEN judged AND NOT down THEN {_LATENCY.format(n=3)} ELSE 0.0 END", 2)} AS latency,
  CASE WHEN NOT judged THEN is_grounded WHEN down THEN false WHEN agrees THEN audit = 'passed' ELSE true END AS is_grounded,
  CASE WHEN down THEN 'judge down' ELSE error_details END AS error_details FROM judge_full)"""
_FLAT = """SELECT id, setup, lang, answerable, outcome, answer, array_to_string(sources, ',') AS sources,
  array_to_string(retrieved_ids, ',') AS retrieved_ids, model_calls, escalated, latency, is_grounded,
  error_details FROM """
_FIELDS = (
    "id, setup, lang, answerable, outcome, sources, retrieved_ids, model_calls, escalated, latency, is_grounded"
)


def _all_records(retrieved: str) -> str:
    return f"""{retrieved}, {_cascade()}, {_GATE_RECORDS}, {_RAW_RECORDS}, {_JUDGE_RECORDS},
records AS (SELECT {_FIELDS} FROM raw_records UNION ALL SELECT {_FIELDS} FROM judge_records
            UNION ALL SELECT {_FIELDS} FROM gate_records)"""


def _metrics(records: str, by: str) -> str:
    """SELECT of the twelve figures of ``records`` grouped by ``by`` (or overall when empty)."""
    def rate(part: str, whole: str) -> str:
        return f"coalesce(count(*) FILTER ({part})::DOUBLE / nullif(count(*) FILTER ({whole}), 0), 0.0)"

    valid, passed = "outcome <> 'error'", "outcome = 'passed'"
    trap, normal = f"{valid} AND NOT answerable", f"{valid} AND answerable"
    cited = "len(sources) > 0 AND len(list_filter(sources, lambda s: NOT list_contains(retrieved_ids, s))) = 0"

    def mean(value: str) -> str:
        return f"coalesce(sum({value}) FILTER ({valid})::DOUBLE / nullif(count(*) FILTER ({valid}), 0), 0.0)"

    figures = {
        "citation_valid_rate": rate(f"{passed} AND {cited}", passed),
        "ungrounded_answer_rate": rate(f"{passed} AND NOT is_grounded", passed),
        "wrong_answer_rate_on_traps": rate(f"{trap} AND {passed}", trap),
        "correct_refusal_rate_on_traps": rate(f"{trap} AND outcome IN ('refused', 'failed')", trap),
        "refusal_rate_on_answerable": rate(f"{normal} AND NOT {passed}", normal),
        "avg_model_calls": mean("model_calls"),
        "avg_extra_model_calls": mean("greatest(0, model_calls - 1)"),
        "avg_latency": mean("latency"),
        "escalation_rate": rate(f"{valid} AND escalated", valid),
    }
    inner = ", ".join(f"{text} AS {name}" for name, text in figures.items())
    outer = ", ".join(f"{sql.exact_round(name, mt.DIGITS[name])} AS {name}" for name in figures)
    keys = f"{by}, " if by else ""
    return (
        f"SELECT {keys}total_questions, valid_questions, errors, {outer} FROM (SELECT {keys}"
        f"count(*) AS total_questions, count(*) FILTER ({valid}) AS valid_questions, "
        f"count(*) FILTER (NOT {valid}) AS errors, {inner} FROM {records} "
        + (f"GROUP BY {by})" if by else ")")
    )


_NUMBERS = ["total_questions", "valid_questions", "errors", *mt.DIGITS]
_ZERO_FILLED = ", ".join(f"coalesce({c}, 0) AS {c}" for c in _NUMBERS)


def _language_rows(retrieved: str) -> str:
    return f"""WITH {_all_records(retrieved)},
slots AS (SELECT setup, unnest(['all', 'en', 'hi', 'mr']) AS lang FROM (SELECT DISTINCT setup FROM records)),
figures AS ({_metrics("(SELECT * REPLACE ('all' AS lang) FROM records UNION ALL SELECT * FROM records)", "setup, lang")}),
filled AS (SELECT s.setup, s.lang, {_ZERO_FILLED} FROM slots s LEFT JOIN figures f USING (setup, lang))"""


def _cells(*cells: str) -> str:
    return "'| ' || " + " || ' | ' || ".join(cells) + " || ' |'"


_COMPARISON = _cells(
    "setup", "total_questions", "errors", sql.percent("citation_valid_rate"),
    sql.percent("ungrounded_answer_rate"), sql.percent("wrong_answer_rate_on_traps"),
    sql.percent("correct_refusal_rate_on_traps"), sql.percent("refusal_rate_on_answerable"),
    "avg_model_calls", "avg_extra_model_calls", "avg_latency || 's'", sql.percent("escalation_rate"),
)
_LANGUAGE = _cells(
    "upper(lang)", "total_questions", "errors", sql.percent("citation_valid_rate"),
    sql.percent("ungrounded_answer_rate"), sql.percent("correct_refusal_rate_on_traps"),
    sql.percent("refusal_rate_on_answerable"), "avg_model_calls", "avg_latency || 's'",
)
_CONSOLE = " || ' ' || ".join(
    f"CASE WHEN length({c}) < {n} THEN rpad({c}, {n}, ' ') ELSE {c} END"
    for c, n in [
        ("setup", 12), ("total_questions::VARCHAR", 6), ("errors::VARCHAR", 7),
        (sql.percent("citation_valid_rate"), 10), (sql.percent("ungrounded_answer_rate"), 12),
        (sql.percent("wrong_answer_rate_on_traps"), 11),
        (sql.percent("correct_refusal_rate_on_traps"), 12),
        (sql.percent("refusal_rate_on_answerable"), 11), ("avg_model_calls::VARCHAR", 7),
        ("avg_extra_model_calls::VARCHAR", 7), ("(avg_latency || 's')", 8),
    ]
)
_OUTCOMES = (
    "SELECT qid, outcome, answer, array_to_string(sources, ',') AS sources, escalated, model_calls, "
    "err AS provider_error FROM answered"
)
_SWEEP = (
    f"WITH {_DOCUMENTS}, {_cascade(', '.join(str(t) + '::DOUBLE' for t in bm.SWEEP))}, {_GATE_RECORDS}, "
    f"figures AS ({_metrics('gate_records', 'level')})"
)
_SWEEP_LINE = _cells(
    "printf('%.2f', level)", sql.percent("citation_valid_rate"), sql.percent("ungrounded_answer_rate"),
    sql.percent("correct_refusal_rate_on_traps"), sql.percent("refusal_rate_on_answerable"),
    sql.percent("escalation_rate"),
)

QUERIES = {
    "cascade_outcomes": (cascade_outcomes, f"WITH {_questions(40.0)}, {_cascade()} {_OUTCOMES}"),
    "cascade_documents": (cascade_documents, f"WITH {_DOCUMENTS}, {_cascade()} {_OUTCOMES}"),
    "trace_rows": (
        trace_rows,
        f"""WITH {_questions(40.0)}, {_cascade()} SELECT qid, resolved AS detected_language,
        CAST(len(ids) AS BIGINT) AS passages_count, {sql.exact_round('top', 3)} AS top_bm25_score,
        ok AS precheck_passed, array_to_string(ids, ',') AS retrieved_ids,
        array_to_string(list_filter([
          CASE WHEN has1 THEN 'tier1:model-1:' || o1 || ':' || {_LATENCY.format(n=1)} END,
          CASE WHEN has2 THEN 'tier2:model-2:' || o2 || ':' || {_LATENCY.format(n=2)} END],
          lambda x: x IS NOT NULL), ',') AS attempts,
        model_calls AS total_model_calls, outcome AS final_outcome FROM answered""",
    ),
    "trace_attempts": (
        trace_attempts,
        f"WITH {_DOCUMENTS}, {_cascade()} SELECT qid, 'tier1' AS tier, {SQL_VERDICT} FROM a_gated "
        f"UNION ALL SELECT qid, 'tier2' AS tier, {SQL_VERDICT} FROM b_gated",
    ),
    "escalation_subset": (
        escalation_subset,
        f"WITH {_DOCUMENTS}, {_cascade()} SELECT qid, array_to_string(fail1, ' ; ') AS reasons "
        "FROM answered WHERE escalated",
    ),
    "outcome_labels": (
        outcome_labels,
        f"""WITH {_DOCUMENTS}, {_cascade()} SELECT qid,
        CASE WHEN outcome = 'passed' THEN 'answered and verified'
             WHEN outcome = 'refused' AND model_calls = 0 THEN 'refused by the pre-check'
             WHEN outcome = 'refused' THEN 'refused after the model declined'
             ELSE 'no verified answer' END AS label,
        CASE WHEN outcome = 'passed' AND NOT escalated
             THEN 'The first model''s answer passed all checks (calls: ' || model_calls || ').'
             WHEN outcome = 'passed'
             THEN 'The first answer failed a check, the second model''s passed (calls: ' || model_calls || ').'
             WHEN outcome = 'refused' AND model_calls = 0 THEN 'No passage was relevant enough, so no model was asked.'
             WHEN outcome = 'refused' THEN 'The model found no answer in the passages; the fixed refusal was given.'
             ELSE 'No answer passed all checks; the fixed refusal was given.' END AS scenario
        FROM answered""",
    ),
    "raw_setup": (raw_setup, f"WITH {_DOCUMENTS}, {_RAW_RECORDS} {_FLAT} raw_records"),
    "judge_setup": (
        judge_setup,
        f"WITH {_DOCUMENTS}, {_RAW_RECORDS}, {_JUDGE_RECORDS} {_FLAT} judge_records",
    ),
    "gate_setup": (gate_setup, f"WITH {_DOCUMENTS}, {_cascade()}, {_GATE_RECORDS} {_FLAT} gate_records"),
    "citation_validity": (
        citation_validity,
        f"""WITH {_DOCUMENTS}, {_RAW_RECORDS} SELECT id, len(sources) > 0 AND
        len(list_filter(sources, lambda s: NOT list_contains(retrieved_ids, s))) = 0 AS valid
        FROM raw_records""",
    ),
    "eval_metrics_overall": (
        eval_metrics_overall,
        f"WITH {_all_records(_DOCUMENTS)} {_metrics('records', 'setup')}",
    ),
    "eval_metrics_by_lang": (
        eval_metrics_by_lang,
        f"{_language_rows(_DOCUMENTS)} SELECT * FROM filled",
    ),
    "error_total": (
        error_total,
        f"WITH {_all_records(_DOCUMENTS)} SELECT count(*) FILTER (outcome = 'error') AS errors FROM records",
    ),
    "overlap_sweep": (
        overlap_sweep,
        f"{_SWEEP} SELECT level AS overlap_threshold, * EXCLUDE (level) FROM figures",
    ),
    "sweep_lines": (sweep_lines, f"{_SWEEP} SELECT {_SWEEP_LINE} AS line FROM figures"),
    "report_lines": (
        report_lines,
        f"{_language_rows(_DOCUMENTS)} SELECT setup, lang, {_COMPARISON} AS comparison, "
        f"{_LANGUAGE} AS language FROM filled",
    ),
    "console_lines": (
        console_lines,
        f"WITH {_all_records(_DOCUMENTS)}, m AS ({_metrics('records', 'setup')}) SELECT {_CONSOLE} AS line FROM m",
    ),
    "benchmark_run": (
        benchmark_run,
        f"{_language_rows(_questions(-999.0))} SELECT * FROM filled",
    ),
    "call_estimates": (
        call_estimates,
        """SELECT setup, n * lo AS min_calls, n * hi AS max_calls FROM (SELECT count(*) AS n FROM benchmark),
        (VALUES ('raw', 1, 1), ('llm_judge', 2, 2), ('gate', 1, 2)) v(setup, lo, hi)""",
    ),
    "question_filter": (
        question_filter,
        "SELECT item_id AS qid, 'en' AS lang FROM benchmark ORDER BY item_id LIMIT 10",
    ),
}
