"""Index statistics, BM25 retrieval and prompts, each with its SQL counterpart."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from attestra.config import Config
from attestra.functions import contract as ct
from attestra.functions.rounding import exact_round
from attestra.operators import index as ix
from attestra.operators.retrieve import rank, retrieve

from . import inputs, sql
from .inputs import (
    SQL_MIXED_PASSAGES,
    SQL_MIXED_QUESTIONS,
    SQL_PASSAGES,
    SQL_QUESTIONS,
)

#: pre-check level that separates the benchmark questions
PRECHECK = replace(Config(), min_score=60.0)


def term_frequency(spark, sf_dir):
    entries = ix.postings(ix.prepare(inputs.passages(spark, sf_dir)))
    return entries.groupBy("pos").agg(
        F.count("*").alias("n_terms"), F.sum("tf").alias("n_features"), F.max("tf").alias("max_tf")
    )


def doc_frequency(spark, sf_dir):
    return ix.document_frequency(ix.postings(ix.prepare(inputs.passages(spark, sf_dir))))


def doc_length(spark, sf_dir):
    docs = ix.analyse(inputs.passages(spark, sf_dir))
    return docs.select("pos", "lang_group", F.col("doc_len").cast("long").alias("doc_len"))


def corpus_stats(spark, sf_dir):
    stats = ix.pool_stats(ix.group_stats(ix.analyse(inputs.mixed_passages(spark, sf_dir))))
    return stats.select("pool", "n", F.round("avgdl", 6).alias("avgdl"))


def _ranked(df):
    return df.select(
        "qid", F.col("rank").cast("long").alias("rank"), "pos", exact_round("score", 3).alias("bm25_score")
    )


def bm25_topk(spark, sf_dir):
    return _ranked(rank(inputs.questions(spark, sf_dir), inputs.passages(spark, sf_dir)))


def bm25_no_lang_filter(spark, sf_dir):
    cfg = replace(Config(), filter_language=False)
    return _ranked(rank(inputs.questions(spark, sf_dir), inputs.passages(spark, sf_dir), cfg))


def bm25_mixed_pools(spark, sf_dir):
    cfg = replace(Config(), top_k=5)
    found = rank(inputs.mixed_questions(spark, sf_dir), inputs.mixed_passages(spark, sf_dir), cfg)
    return _ranked(found)


def bm25_precheck(spark, sf_dir):
    found = retrieve(inputs.questions(spark, sf_dir), inputs.passages(spark, sf_dir), PRECHECK)
    return found.select(
        "qid", "top_score", "precheck_passed", F.size("retrieved").cast("long").alias("n_passages")
    )


def top_passage_lang(spark, sf_dir):
    found = retrieve(
        inputs.mixed_questions(spark, sf_dir).drop("lang"), inputs.mixed_passages(spark, sf_dir), text=False
    )
    return found.select(
        "qid",
        F.array_join("candidates", "_").alias("candidates"),
        "resolved_lang",
        F.array_join(F.transform("retrieved", lambda p: p["id"]), ",").alias("retrieved_ids"),
    )


def _retrieved(spark, sf_dir):
    return retrieve(inputs.questions(spark, sf_dir), inputs.passages(spark, sf_dir))


def format_context(spark, sf_dir):
    return _retrieved(spark, sf_dir).select(
        "qid", F.md5(ct.format_context(F.col("retrieved"))).alias("context")
    )


def _digests(messages):
    return [
        F.array_join(F.transform(messages, lambda m: m["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform(messages, lambda m: m["content"]), "\n")).alias("content"),
    ]


def prompt_messages(spark, sf_dir):
    messages = ct.answer_messages(F.col("question"), F.col("retrieved"))
    return _retrieved(spark, sf_dir).select("qid", *_digests(messages))


def escalation_prompt(spark, sf_dir):
    previous = F.concat(F.lit("draft "), F.col("question"))
    failures = F.transform("retrieved", lambda p: F.concat(F.lit("not "), p["id"]))
    messages = ct.escalation_messages(F.col("question"), F.col("retrieved"), previous, failures)
    return _retrieved(spark, sf_dir).select("qid", *_digests(messages))


def judge_prompt(spark, sf_dir):
    messages = ct.judge_messages(F.col("question"), F.col("retrieved"), F.reverse("question"))
    return _retrieved(spark, sf_dir).select("qid", *_digests(messages))


_BM25 = sql.bm25(SQL_PASSAGES, SQL_QUESTIONS)
_RANKED = f"SELECT qid, rank, pos, {sql.exact_round('score', 3)} AS bm25_score FROM ranked"
_CONTEXT = rf"""
context AS (
  SELECT qid, string_agg('[' || id || ']' ||
           CASE WHEN {sql.strip('title')} <> '' THEN ' ' || {sql.strip('title')} ELSE '' END ||
           chr(10) || {sql.strip('text')}, chr(10) || chr(10) ORDER BY rank) AS context,
         string_agg('- not ' || id, chr(10) ORDER BY rank) AS bullets
  FROM ranked JOIN docs USING (pos) GROUP BY qid)"""


def _messages(system: str, user: str) -> str:
    return (
        f"WITH {_BM25}, {_CONTEXT} SELECT qid, 'system,user' AS roles, "
        f"md5({sql.quote(system)} || chr(10) || {user}) AS content "
        "FROM context JOIN questions USING (qid)"
    )


_HEAD = "'Reference Context:' || chr(10) || context || chr(10) || chr(10) || "
_ESCALATION_TAIL = """Correction instructions:
Carefully correct the output. Ensure every number and claim is strictly verified
in the reference passages. Cite only valid passage IDs. If the passages do not
support the claim, set 'refuse': true. Return raw JSON."""

QUERIES = {
    "term_frequency": (
        term_frequency,
        f"""WITH t AS (SELECT doc_id AS pos, {sql.tokens("source || ' ' || text", 'lang')} AS toks
                       FROM documents),
                 f AS (SELECT pos, unnest({sql.features('toks')}) AS term FROM t),
                 tf AS (SELECT pos, term, count(*) AS tf FROM f GROUP BY ALL)
            SELECT pos, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_features,
                   max(tf) AS max_tf FROM tf GROUP BY pos""",
    ),
    "doc_frequency": (
        doc_frequency,
        f"""WITH t AS (SELECT CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS lang_group,
                              {sql.tokens("source || ' ' || text", 'lang')} AS toks FROM documents),
                 f AS (SELECT lang_group, unnest(list_distinct({sql.features('toks')})) AS term FROM t)
            SELECT lang_group, term, count(*) AS df FROM f GROUP BY ALL""",
    ),
    "doc_length": (
        doc_length,
        f"""WITH t AS (SELECT doc_id AS pos, lang, {sql.tokens("source || ' ' || text", 'lang')} AS toks
                       FROM documents)
            SELECT pos, CASE WHEN lang = 'en' THEN 'en' ELSE 'other' END AS lang_group,
                   CAST(len({sql.features('toks')}) AS BIGINT) AS doc_len FROM t""",
    ),
    "corpus_stats": (
        corpus_stats,
        f"WITH {sql.bm25(SQL_MIXED_PASSAGES, SQL_QUESTIONS)} "
        "SELECT pool, n, round(avgdl, 6) AS avgdl FROM stats",
    ),
    "bm25_topk": (bm25_topk, f"WITH {_BM25} {_RANKED}"),
    "bm25_no_lang_filter": (
        bm25_no_lang_filter,
        f"WITH {sql.bm25(SQL_PASSAGES, SQL_QUESTIONS, filter_language=False)} {_RANKED}",
    ),
    "bm25_mixed_pools": (
        bm25_mixed_pools,
        f"WITH {sql.bm25(SQL_MIXED_PASSAGES, SQL_MIXED_QUESTIONS, k=5)} {_RANKED}",
    ),
    "bm25_precheck": (
        bm25_precheck,
        f"""WITH {_BM25}, tops AS (
              SELECT qid, max(score) AS top, count(*) AS n_passages FROM ranked GROUP BY qid)
            SELECT qid, {sql.exact_round('top', 3)} AS top_score,
                   top >= {PRECHECK.min_score} AS precheck_passed, n_passages FROM tops""",
    ),
    "top_passage_lang": (
        top_passage_lang,
        f"""WITH {sql.bm25(SQL_MIXED_PASSAGES, SQL_MIXED_QUESTIONS)}
            SELECT qid, cand AS candidates,
                   CASE WHEN cand = 'hi_mr' THEN arg_min(lang, rank) ELSE cand END AS resolved_lang,
                   string_agg(CAST(pos AS VARCHAR), ',' ORDER BY rank) AS retrieved_ids
            FROM ranked JOIN docs USING (pos) JOIN routed USING (qid) GROUP BY qid, cand""",
    ),
    "format_context": (
        format_context,
        f"WITH {_BM25}, {_CONTEXT} SELECT qid, md5(context) AS context FROM context",
    ),
    "prompt_messages": (
        prompt_messages,
        _messages(ct.lx.SYSTEM_PROMPT, f"{_HEAD} 'Question: ' || question"),
    ),
    "escalation_prompt": (
        escalation_prompt,
        _messages(
            ct.lx.SYSTEM_PROMPT,
            f"""{_HEAD} 'Question: ' || question || chr(10) || chr(10) ||
            'A previous attempt generated the following output, which FAILED verification:' ||
            chr(10) || 'draft ' || question || chr(10) || chr(10) ||
            'Verification failures identified:' || chr(10) || bullets || chr(10) || chr(10) ||
            {sql.quote(_ESCALATION_TAIL)}""",
        ),
    ),
    "judge_prompt": (
        judge_prompt,
        _messages(
            ct.lx.JUDGE_PROMPT,
            f"""{_HEAD} 'Question:' || chr(10) || question || chr(10) || chr(10) ||
            'Candidate Answer:' || chr(10) || reverse(question) || chr(10) || chr(10) ||
            'Is the Candidate Answer completely grounded in the Reference Context '
            || 'without hallucinated facts or numbers?'""",
        ),
    ),
}
