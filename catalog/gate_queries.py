"""Contract and grounding checks on one derived completion per document, with SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions import contract as ct
from attestra.functions import text as tx
from attestra.functions.rounding import exact_round
from attestra.operators import gate

from . import inputs, sql


def cases(spark, sf_dir) -> DataFrame:
    """One question per document; retrieved are the document itself and the next one."""
    docs = inputs.passages(spark, sf_dir)
    fields = ["pos", "id", "lang", "title", "text"]
    following = docs.select((F.col("pos") - 1).alias("pos"), F.struct(*fields).alias("other"))
    paired = docs.join(following, "pos", "left")
    passages = [
        F.struct(F.lit(1).alias("rank"), *fields),
        F.when(
            F.col("other").isNotNull(), F.struct(F.lit(2).alias("rank"), *[f"other.{f}" for f in fields])
        ),
    ]
    variant = "(pos % 16)"
    return paired.select(
        F.col("pos").alias("key"),
        F.expr(sql.case_question(variant, "text", sql.plain_java)).alias("question"),
        F.expr(sql.completion(variant, "text", "id", sql.plain_java)).alias("raw_output"),
        F.array_compact(F.array(*passages)).alias("retrieved"),
    )


CASES_SQL = f"""
docs AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS id, text FROM documents),
cases AS (
  SELECT d.pos AS key, {sql.case_question('(d.pos % 16)', 'd.text')} AS question,
         {sql.completion('(d.pos % 16)', 'd.text', 'd.id')} AS raw,
         list_filter([d.id, n.id], lambda x: x IS NOT NULL) AS ids,
         list_filter([d.text, n.text], lambda x: x IS NOT NULL) AS texts
  FROM docs d LEFT JOIN docs n ON n.pos = d.pos + 1)"""
_GATED = f"WITH {CASES_SQL}, {sql.gate('cases')}"


def _joined(items: Column, separator: str = " ; ") -> Column:
    return F.array_join(items, separator)


def _parsed(spark, sf_dir) -> DataFrame:
    return gate.parse(cases(spark, sf_dir))


def parse_model_json(spark, sf_dir):
    data = cases(spark, sf_dir).withColumn("data", ct.parse_object(F.col("raw_output")))
    return data.select(
        "key",
        F.col("data").isNotNull().alias("is_object"),
        F.md5(ct.json_slice(F.col("raw_output"))).alias("slice"),
        F.coalesce(ct.lenient_text(F.col("data"), "answer"), F.lit("")).alias("answer"),
    )


def contract_types(spark, sf_dir):
    return _parsed(spark, sf_dir).select("key", _joined(F.col("_contract")).alias("messages"))


def lenient_reads(spark, sf_dir):
    data = cases(spark, sf_dir).withColumn("data", ct.parse_object(F.col("raw_output")))
    return data.select(
        "key",
        ct.truthy(F.col("data"), "refuse").alias("refuses"),
        ct.lenient_text(F.col("data"), "answer").alias("answer"),
        _joined(ct.lenient_list(F.col("data"), "sources"), ",").alias("sources"),
    )


def event_props(spark, sf_dir):
    """Lenient reads of the JSON properties of events."""
    events = inputs.table(spark, sf_dir, "events")
    data = events.select("event_id", ct.parse_object(F.col("props")).alias("data"))
    return data.select(
        "event_id", ct.lenient_text(F.col("data"), "k").alias("k"), ct.truthy(F.col("data"), "k").alias("k_set")
    )


def sources_real(spark, sf_dir):
    fault = gate.check_sources_real(F.col("_sources"), gate.passage_ids(F.col("retrieved")))
    return _parsed(spark, sf_dir).select("key", fault.alias("fault"))


def numbers_grounded(spark, sf_dir):
    df = _parsed(spark, sf_dir)
    cited = df.withColumn("cited", gate.cited_text(F.col("_sources"), F.col("retrieved")))
    loose = gate.ungrounded_numbers(F.col("_answer"), F.col("cited"))
    return cited.select("key", _joined(loose, ",").alias("ungrounded"), F.md5("cited").alias("cited_text"))


def token_overlap(spark, sf_dir):
    df = _parsed(spark, sf_dir)
    cited = df.withColumn("cited", gate.cited_text(F.col("_sources"), F.col("retrieved")))
    words = cited.select(
        "key",
        gate.content_words(F.col("_answer")).alias("words"),
        gate.content_words(F.col("cited")).alias("known"),
    )
    ratio = F.coalesce(gate.overlap_ratio(F.col("words"), F.col("known")), F.lit(0.0))
    measured = words.withColumn("r", ratio)
    return measured.select(
        "key", exact_round("r", 3).alias("ratio"), (F.col("r") >= 0.6).alias("enough")
    )


def language_match(spark, sf_dir):
    df = _parsed(spark, sf_dir)
    ratios = df.select(
        "key",
        tx.devanagari_ratio(F.col("question")).alias("q"),
        tx.devanagari_ratio(F.col("_answer")).alias("a"),
    )
    return ratios.select("key", gate.script_failure("q", "a").alias("fault"))


def gate_columns(g: Column) -> list[Column]:
    details = g["details"]
    return [
        g["passed"].alias("passed"),
        g["outcome"].alias("outcome"),
        *[g["checks"][c].alias(c) for c in gate.CHECKS],
        _joined(g["failures"]).alias("failures"),
        details["answer"].alias("answer"),
        _joined(details["sources"], ",").alias("sources"),
        details["token_overlap_ratio"].alias("overlap"),
        details["question_devanagari_ratio"].alias("question_ratio"),
        details["answer_devanagari_ratio"].alias("answer_ratio"),
        _joined(details["ungrounded_numbers"], ",").alias("ungrounded"),
        _joined(details["warnings"]).alias("warnings"),
    ]


def gate_verdict(spark, sf_dir):
    return gate.verify(cases(spark, sf_dir)).select("key", *gate_columns(F.col("gate")))


SQL_VERDICT = f"""
  outcome <> 'failed' AS passed, outcome,
  valid AS json_valid, valid AS refusal_ok,
  coalesce(answered AND source_fault IS NULL, false) AS sources_real,
  coalesce(answered AND len(loose) = 0, false) AS numbers_grounded,
  coalesce(answered AND overlap >= lim AND len(known) > 0 AND len(words) > 0, false) AS token_overlap,
  valid AND script_fault IS NULL AS language_match,
  array_to_string(failures, ' ; ') AS failures, answer, array_to_string(sources, ',') AS sources,
  CASE WHEN answered THEN {sql.exact_round('overlap', 3)} END AS overlap,
  CASE WHEN valid THEN {sql.exact_round('q_ratio', 3)} END AS question_ratio,
  CASE WHEN valid THEN {sql.exact_round('a_ratio', 3)} END AS answer_ratio,
  CASE WHEN answered THEN array_to_string(loose, ',') END AS ungrounded,
  CASE WHEN refused AND script_fault IS NOT NULL
       THEN 'Refusal script mismatch: ' || script_fault END AS warnings"""

_TRUTHY = """CASE WHEN kr IS NULL OR kr = 'NULL' THEN false
  WHEN kr = 'BOOLEAN' THEN json_extract_string(j, '$.refuse') = 'true'
  ELSE json_extract_string(j, '$.refuse') <> '' END"""

QUERIES = {
    "parse_model_json": (
        parse_model_json,
        f"{_GATED} SELECT key, j IS NOT NULL AS is_object, md5(body) AS slice, "
        "coalesce(json_extract_string(j, '$.answer'), '') AS answer FROM g_gated",
    ),
    "contract_types": (
        contract_types,
        f"{_GATED} SELECT key, array_to_string(contract, ' ; ') AS messages FROM g_gated",
    ),
    "lenient_reads": (
        lenient_reads,
        f"{_GATED} SELECT key, {_TRUTHY} AS refuses, "
        "coalesce(json_extract_string(j, '$.answer'), '') AS answer, "
        "coalesce(array_to_string(json_extract_string(j, '$.sources[*]'), ','), '') AS sources "
        "FROM g_gated",
    ),
    "event_props": (
        event_props,
        "SELECT event_id, json_extract_string(props, '$.k') AS k, "
        "CAST(json_extract(props, '$.k') AS DOUBLE) <> 0 AS k_set FROM events",
    ),
    "sources_real": (
        sources_real,
        f"{_GATED} SELECT key, CASE WHEN valid THEN source_fault END AS fault FROM g_gated",
    ),
    "numbers_grounded": (
        numbers_grounded,
        f"{_GATED} SELECT key, array_to_string(loose, ',') AS ungrounded, CASE WHEN valid THEN md5(cited_text) END AS cited_text "
        "FROM g_gated",
    ),
    "token_overlap": (
        token_overlap,
        f"{_GATED} SELECT key, {sql.exact_round('overlap', 3)} AS ratio, valid AND overlap >= 0.6 AS enough "
        "FROM g_gated",
    ),
    "language_match": (
        language_match,
        f"{_GATED} SELECT key, CASE WHEN valid THEN script_fault END AS fault FROM g_gated",
    ),
    "gate_verdict": (gate_verdict, f"{_GATED} SELECT key, {SQL_VERDICT} FROM g_gated"),
}
