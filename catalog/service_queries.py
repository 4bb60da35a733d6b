"""Cache, request admission, fallbacks and data checks, each with its SQL counterpart."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from attestra.config import Config
from attestra.functions import records as rc
from attestra.operators import limits, quality
from attestra.plans import service
from attestra.sources import cache

from . import gate_queries, inputs, sql

MODELS = {"nvidia": "model-a", "openrouter": " model-b "}
#: limits that bind on the sparse event stream: two hits per twelve hours, 60 a day
LIMITS = replace(Config(), hits_per_window=2, window_seconds=43_200.0, daily_cap=60)


# ---- cache --------------------------------------------------------------------------------
def _requests(spark, sf_dir):
    turns = inputs.table(spark, sf_dir, "conversations")
    message = F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))
    return turns.select("conv_id", "turn", F.array(message).alias("messages"))


def _cached(spark, sf_dir):
    """Cache entries: some requests at one provider or both, some written twice."""
    requests = _requests(spark, sf_dir)
    offers = F.array_compact(
        F.array(
            F.when(F.col("conv_id") % 3 == 0, F.lit("nvidia")),
            F.when(F.col("conv_id") % 2 == 0, F.lit("openrouter")),
        )
    )
    rows = requests.withColumn("provider", F.explode(offers)).withColumn(
        "version", F.explode(F.sequence(F.lit(0), (F.col("turn") % 2).cast("int")))
    )
    model = F.when(F.col("provider") == "nvidia", F.lit("model-a")).otherwise(F.lit("model-b"))
    # equal requests hold equal answers, so any of them may be the last one written
    text = F.concat(
        F.col("provider"), F.lit(" "), F.col("version"), F.lit(" "),
        F.md5(F.get("messages", F.lit(0))["content"]),
    )
    completion = F.struct(
        text.alias("text"), F.col("provider"), model.alias("model"),
        F.lit(1.5).alias("latency"), F.lit("stop").alias("finish_reason"),
    )
    key = rc.request_key(F.col("provider"), model, F.col("messages"), cache.params_of(Config()))
    return rows.select(
        key.alias("key"),
        completion.alias("completion"),
        F.timestamp_seconds(F.col("version")).alias("written_at"),
    )


def cache_key(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    key = rc.request_key(
        F.lit(" NVIDIA"), F.lit(MODELS["nvidia"]), F.col("messages"), cache.params_of(Config())
    )
    return requests.select("conv_id", "turn", key.alias("request_key"))


def cache_lookup(spark, sf_dir):
    """First provider in order with a cached completion, the latest entry of each key."""
    found = cache.lookup(_requests(spark, sf_dir), _cached(spark, sf_dir), MODELS, Config())
    return found.select(
        "conv_id", "turn", F.col("completion")["provider"].alias("provider"),
        F.col("completion")["text"].alias("reply"),
    )


def provider_fallback(spark, sf_dir):
    """The same with the providers in the other order."""
    cfg = replace(Config(), provider_order=("openrouter", "nvidia"))
    found = cache.lookup(_requests(spark, sf_dir), _cached(spark, sf_dir), MODELS, cfg)
    return found.select("conv_id", "turn", F.col("completion")["provider"].alias("provider"))


# ---- admission ----------------------------------------------------------------------------
def _events(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events", "event_id")
    return events.select("event_id", F.col("user_id").alias("client"), "ts")


def rate_limit_sliding(spark, sf_dir):
    return limits.sliding_window(_events(spark, sf_dir), LIMITS).select("event_id", "admitted")


def daily_cap(spark, sf_dir):
    return limits.admission(_events(spark, sf_dir), LIMITS).select("event_id", "verdict")


def pacing_schedule(spark, sf_dir):
    paced = limits.pacing(_events(spark, sf_dir), 1)
    return paced.select(
        "event_id", (F.col("starts_at") - limits.micros(F.col("ts"))).alias("delay_micros")
    )


# ---- requests -----------------------------------------------------------------------------
def question_validation(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    blank = F.when(F.col("doc_id") % 7 == 0, F.lit(" \n\t ")).otherwise(F.col("text"))
    requests = docs.select("doc_id", blank.alias("question"))
    return service.validate(requests).select("doc_id", "status")


def question_key_lookup(spark, sf_dir):
    """Conversation turns answered from recorded runs of the same question."""
    turns = inputs.table(spark, sf_dir, "conversations")
    asked = turns.select(
        "conv_id", "turn", F.concat(F.translate(F.replace("text", F.lit(" "), F.lit("  ")), sql.LETTERS, sql.LETTERS.upper()), F.lit(" ")).alias("question")
    )
    recorded = turns.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("pos"),
        F.col("text").alias("question"),
        F.concat(F.lit("run "), F.col("conv_id"), F.lit("/"), F.col("turn")).alias("answer"),
    )
    matched = service.with_fallback(asked, recorded)
    return matched.select("conv_id", "turn", F.col("run")["answer"].alias("recorded"))


def health(spark, sf_dir):
    return service.health(inputs.passages(spark, sf_dir)).select("status", "passages", "providers")


def client_address(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" 10.0.0."), F.col("user_id"), F.lit(" , 10.1.1.1")))
        .when(F.col("event_id") % 3 == 1, F.lit(""))
        .alias("forwarded"),
        F.when(F.col("event_id") % 5 > 0, F.concat(F.lit("192.168.0."), F.col("user_id"))).alias("peer"),
    )
    forwarded, peer = F.col("forwarded"), F.col("peer")
    return events.select(
        "event_id",
        rc.client_address(forwarded, peer, True).alias("trusted"),
        rc.client_address(forwarded, peer, False).alias("untrusted"),
    )


def error_snippet(spark, sf_dir):
    events = inputs.table(spark, sf_dir, "events")
    body = (
        F.when(
            F.col("event_id") % 4 == 0,
            F.concat(F.lit('{"error": {"message": "bad '), F.col("event_type"), F.lit('", "code": 1}}')),
        )
        .when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"error": "'), F.col("event_type"), F.lit('"}')))
        .when(F.col("event_id") % 4 == 2, F.repeat(F.col("event_type"), 60))
        .otherwise(F.col("props"))
    )
    return events.select("event_id", body.alias("body")).select(
        "event_id", rc.error_snippet(F.col("body")).alias("snippet")
    )


def model_resolution(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part")
    specific = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), F.col("p_brand")))
    return parts.select("p_partkey", rc.model_id(specific, F.col("p_type")).alias("model"))


def model_listing(spark, sf_dir):
    parts = inputs.table(spark, sf_dir, "part")
    models = parts.select(F.col("p_partkey").alias("pos"), F.concat("p_name", F.lit(" "), "p_brand").alias("id"))
    return quality.model_listing(models, "Widget")


# ---- data checks --------------------------------------------------------------------------
def _topics(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents")
    place = F.when(F.col("doc_id") % 20 == 7, 0).otherwise(F.col("doc_id") % 3)
    return docs.select(
        F.floor(F.col("doc_id") / 3).alias("topic_id"),
        F.get(F.array(*[F.lit(x) for x in ("en", "hi", "mr")]), place.cast("int")).alias("lang"),
    )


def topic_triplets(spark, sf_dir):
    return quality.topic_completeness(_topics(spark, sf_dir)).select(
        "topic_id", F.array_join("langs", ",").alias("langs"), "n", "complete"
    )


def dataset_distribution(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "lang")
    labels = inputs.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("answerable"))
    counts = quality.distribution(docs.join(labels, "doc_id", "left"))
    return counts.withColumns(
        {"answerable": F.col("answerable").cast("string"), "level": F.col("level").cast("long")}
    )


def source_integrity(spark, sf_dir):
    labels = inputs.table(spark, sf_dir, "labels")
    questions = labels.select(
        F.col("doc_id").alias("qid"),
        (F.col("quality") == 1).alias("answerable"),
        F.transform(F.array(F.col("doc_id"), F.col("doc_id") * 2), lambda i: i.cast("string")).alias("expected_sources"),
    )
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return quality.broken_references(questions, docs)


def _answers(spark, sf_dir):
    return gate_queries.cases(spark, sf_dir).select("key", (F.col("key") % 4).alias("tier"), "raw_output")


def capability_check(spark, sf_dir):
    return quality.capability(_answers(spark, sf_dir)).drop("raw_output", "tier")


def go_no_go(spark, sf_dir):
    return quality.go_no_go(quality.capability(_answers(spark, sf_dir)), "tier")


# ---- SQL ----------------------------------------------------------------------------------
def _key(provider: str, model: str) -> str:
    return (
        f"sha256(to_json({{'messages': [{{'content': text, 'role': 'user'}}], 'model': '{model}', "
        f"'params': {{'max_tokens': 1024, 'seed': 42, 'temperature': 0.0::DOUBLE}}, "
        f"'provider': '{provider}'}})::VARCHAR)"
    )


def _lookup(first: str, second: str, columns: str) -> str:
    # a repeated text is one request, cached if any turn with it was cached
    turns = "conversations"
    offer = {
        "nvidia": f"(SELECT text, 'nvidia ' || max(turn % 2) || ' ' || md5(text) AS reply FROM {turns} WHERE conv_id % 3 = 0 GROUP BY text)",
        "openrouter": f"(SELECT text, 'openrouter ' || max(turn % 2) || ' ' || md5(text) AS reply FROM {turns} WHERE conv_id % 2 = 0 GROUP BY text)",
    }
    return f"""SELECT conv_id, turn, {columns} FROM (
      SELECT conv_id, turn, coalesce(a.reply, b.reply) AS reply,
             split_part(coalesce(a.reply, b.reply), ' ', 1) AS provider
      FROM {turns} t LEFT JOIN {offer[first]} a USING (text) LEFT JOIN {offer[second]} b USING (text))"""


_W = int(LIMITS.window_seconds * 1_000_000)
_SLIDING = f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS t_us,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT event_id, user_id, i, [t_us] AS hits, true AS admitted FROM e WHERE i = 1
  UNION ALL
  SELECT event_id, user_id, i,
         CASE WHEN len(recent) < {LIMITS.hits_per_window} THEN list_append(recent, t_us) ELSE recent END,
         len(recent) < {LIMITS.hits_per_window}
  FROM (SELECT e.event_id, e.user_id, e.i, e.t_us, list_filter(w.hits, lambda h: h > e.t_us - {_W}) AS recent
        FROM walk w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
SELECT event_id, admitted FROM walk"""

_CAPPED = f"""
WITH RECURSIVE e AS (
  SELECT event_id, user_id, epoch_us(ts) AS t_us, CAST(ts AS DATE) AS day,
         row_number() OVER (ORDER BY ts, event_id) AS i FROM events),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS event_id, DATE '1970-01-01' AS day, CAST(0 AS BIGINT) AS used,
         CAST([] AS STRUCT(u BIGINT, t BIGINT)[]) AS hits, '' AS verdict
  UNION ALL
  SELECT i, event_id, day, used + CAST(verdict = 'admitted' AS BIGINT),
         CASE WHEN verdict = 'admitted' THEN list_append(recent, {{'u': user_id, 't': t_us}}) ELSE recent END,
         verdict
  FROM (SELECT *, CASE WHEN len(list_filter(recent, lambda h: h.u = user_id)) >= {LIMITS.hits_per_window}
                       THEN 'window_full' WHEN used >= {LIMITS.daily_cap} THEN 'day_full'
                       ELSE 'admitted' END AS verdict
        FROM (SELECT e.i, e.event_id, e.user_id, e.t_us, e.day,
                     CASE WHEN e.day = w.day THEN w.used ELSE 0 END AS used,
                     list_filter(w.hits, lambda h: h.t > e.t_us - {_W}) AS recent
              FROM walk w JOIN e ON e.i = w.i + 1)))
SELECT event_id, verdict FROM walk WHERE i > 0"""

QUERIES = {
    "cache_key": (
        cache_key,
        f"SELECT conv_id, turn, {_key('nvidia', 'model-a')} AS request_key FROM conversations",
    ),
    "cache_lookup": (cache_lookup, _lookup("nvidia", "openrouter", "provider, reply")),
    "provider_fallback": (provider_fallback, _lookup("openrouter", "nvidia", "provider")),
    "rate_limit_sliding": (rate_limit_sliding, _SLIDING),
    "daily_cap": (daily_cap, _CAPPED),
    "pacing_schedule": (
        pacing_schedule,
        """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS t_us,
                      row_number() OVER (ORDER BY ts, event_id) AS i FROM events)
           SELECT event_id, 60000000 * i + max(t_us - 60000000 * i) OVER (ORDER BY i) - t_us AS delay_micros
           FROM e""",
    ),
    "question_validation": (
        question_validation,
        f"""SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR length({sql.strip('text')}) = 0
            THEN 'Question cannot be empty.' WHEN length({sql.strip('text')}) > 500
            THEN 'Question is longer than 500 characters.' ELSE 'ok' END AS status FROM documents""",
    ),
    "question_key_lookup": (
        question_key_lookup,
        f"""WITH k AS (SELECT conv_id, turn, lower({sql.strip(f"regexp_replace(text, '{sql.SP}+', ' ', 'g')")}) AS key
                       FROM conversations),
            r AS (SELECT key, arg_min('run ' || conv_id || '/' || turn, conv_id * 100 + turn) AS recorded
                  FROM k GROUP BY key)
            SELECT conv_id, turn, recorded FROM k LEFT JOIN r USING (key)""",
    ),
    "health": (
        health,
        "SELECT 'healthy' AS status, count(*) AS passages, 'nvidia, openrouter' AS providers FROM documents",
    ),
    "client_address": (
        client_address,
        """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || user_id ELSE peer END AS trusted,
           peer AS untrusted FROM (SELECT event_id, user_id, CASE WHEN event_id % 5 > 0
           THEN '192.168.0.' || user_id ELSE 'unknown' END AS peer FROM events)""",
    ),
    "error_snippet": (
        error_snippet,
        """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'bad ' || event_type WHEN 1 THEN event_type
           WHEN 2 THEN left(repeat(event_type, 60), 200) ELSE props END AS snippet FROM events""",
    ),
    "model_resolution": (
        model_resolution,
        "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_type END AS model FROM part",
    ),
    "model_listing": (
        model_listing,
        """WITH m AS (SELECT p_partkey AS pos, p_name || ' ' || p_brand AS id,
                      contains(lower(p_name || ' ' || p_brand), 'widget') AS family FROM part)
           SELECT pos, id, family FROM m WHERE family = (SELECT bool_or(family) FROM m)
           ORDER BY pos LIMIT (SELECT CASE WHEN bool_or(family) THEN 10 ELSE 5 END FROM m)""",
    ),
    "topic_triplets": (
        topic_triplets,
        """WITH t AS (SELECT doc_id // 3 AS topic_id,
                      ['en', 'hi', 'mr'][CASE WHEN doc_id % 20 = 7 THEN 0 ELSE doc_id % 3 END + 1] AS lang FROM documents)
           SELECT topic_id, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs, count(*) AS n,
                  count(*) = 3 AND count(DISTINCT lang) = 3 AS complete FROM t GROUP BY topic_id""",
    ),
    "dataset_distribution": (
        dataset_distribution,
        """SELECT CAST(answerable AS VARCHAR) AS answerable, lang, count(*) AS n, GROUPING(answerable, lang) AS level
           FROM (SELECT lang, quality = 1 AS answerable FROM documents LEFT JOIN labels USING (doc_id))
           GROUP BY CUBE (answerable, lang)""",
    ),
    "source_integrity": (
        source_integrity,
        """WITH c AS (SELECT doc_id AS qid, quality = 1 AS answerable, unnest([doc_id, doc_id * 2]) AS s FROM labels)
           SELECT DISTINCT qid, CAST(s AS VARCHAR) AS source FROM c
           WHERE NOT answerable OR s NOT IN (SELECT doc_id FROM documents)""",
    ),
    "capability_check": (
        capability_check,
        f"""WITH {gate_queries.CASES_SQL}, {sql.gate('cases')},
            a AS (SELECT key, coalesce(ka IS NOT NULL, false) AS ok,
                         coalesce(json_extract_string(j, '$.answer'), '') AS ans FROM g_gated),
            r AS (SELECT *, {sql.ratio('ans')} AS q FROM a)
            SELECT key, ok AS json_valid, {sql.exact_round('q', 3)} AS script_ratio,
                   CASE WHEN ok THEN left({sql.candidates('ans')}, 2) ELSE 'unknown' END AS detected_lang,
                   CASE WHEN length(ans) > 60 THEN left(ans, 60) || '...' ELSE ans END AS answer_preview FROM r""",
    ),
    "go_no_go": (
        go_no_go,
        f"""WITH {gate_queries.CASES_SQL}, {sql.gate('cases')},
            a AS (SELECT key % 4 AS tier, coalesce(ka IS NOT NULL, false) AS ok,
                         coalesce(json_extract_string(j, '$.answer'), '') AS ans FROM g_gated),
            q AS MATERIALIZED (SELECT *, {sql.ratio('ans')} AS share FROM a),
            r AS (SELECT *, {sql.exact_round('share', 3)} >= 0.4 AS kept FROM q)
            SELECT tier, bool_and(ok) AS contract_followed, bool_and(kept) AS script_kept,
                   CASE WHEN bool_and(ok AND kept) THEN 'GO' ELSE 'NO-GO / INVESTIGATE' END AS verdict
            FROM r GROUP BY tier""",
    ),
}
