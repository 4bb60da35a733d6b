"""Sources and sinks: tables are written to the shared staging folder, read back, and compared with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from attestra.config import Config
from attestra.functions import text as tx
from attestra.operators import quality
from attestra.operators.retrieve import rank
from attestra.session import staging_dir
from attestra.sources import cache, files

from . import inputs, sql

PASSAGE = "id string, title string, text string, lang string"


def _folder(spark, label):
    return f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _pack_lines(spark, sf_dir, odd: bool):
    """Documents as JSON Lines; ``odd`` puts comments, blank and broken lines around every fifth."""
    docs = inputs.table(spark, sf_dir, "documents")
    row = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text", "lang"))
    line = row
    if odd:
        line = (
            F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("# note\n\n  "), row, F.lit("  \n{\"id\": broken")))
            .otherwise(row)
        )
    path = _folder(spark, "pack")
    docs.select(line.alias("value")).write.text(path)
    return path


def _digests(rows):
    return rows.select("id", "title", F.md5("text").alias("text_md5"), "lang")


def jsonl_strict(spark, sf_dir):
    return _digests(files.read_jsonl(spark, _pack_lines(spark, sf_dir, False), PASSAGE))


def jsonl_lenient(spark, sf_dir):
    return _digests(files.read_jsonl(spark, _pack_lines(spark, sf_dir, True), PASSAGE, strict=False))


def jsonl_comments(spark, sf_dir):
    """Strict reading that skips comments; a broken line would raise, so there is none."""
    docs = inputs.table(spark, sf_dir, "documents")
    row = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), "text", "lang"))
    path = _folder(spark, "pack")
    docs.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("# note\n\n"), row)).otherwise(row).alias("value")).write.text(path)
    return _digests(files.read_jsonl(spark, path, PASSAGE, comments=True))


def file_order(spark, sf_dir):
    """Documents in files of different sizes, sorted by id over the files, read back with their line numbers."""
    docs = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id", "text")
    path = _folder(spark, "pack")
    # files double in size up to 2^14 ids: a task writes one of these, not half of all documents
    number = F.col("doc_id") + 1
    files_of = F.when(number > 0, F.least(F.floor(F.log2(number)), F.lit(14)) + F.floor(number / 2**14))
    docs.withColumn("part", files_of).repartitionByRange("part").sortWithinPartitions("part", "doc_id").select("id", "text").write.json(path)
    rows = files.read_jsonl(spark, path, "id string, text string")
    return rows.select("pos", "id", F.md5("text").alias("text_md5"))


def recorded_traces(spark, sf_dir):
    """Recorded runs written as JSON Lines and read back with their order."""
    turns = inputs.table(spark, sf_dir, "conversations")
    path = _folder(spark, "runs")
    turns.select(
        F.concat_ws("/", "conv_id", "turn").alias("id"), F.col("text").alias("question"), F.lit("passed").alias("outcome")
    ).write.json(path)
    rows = files.read_traces(spark, path, "id string, question string, outcome string", lines=True)
    ordered = rows.agg(F.count_distinct("pos").alias("n")).withColumn("one", F.lit(1))
    counts = rows.agg(F.count("*").alias("n"), F.count_distinct("question").alias("questions"))
    return counts.join(ordered.select("n"), "n").select("n", "questions")


def results_document(spark, sf_dir):
    """A summary document per language, as one JSON text each."""
    docs = inputs.table(spark, sf_dir, "documents")
    path = _folder(spark, "results")
    summary = docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    summary.agg(F.array_sort(F.collect_list(F.struct("lang", "n", "chars"))).alias("summary")).coalesce(1).write.json(path)
    read = files.read_results(spark, path, ("synthetic texts",))
    rows = F.from_json("data", "summary array<struct<lang:string,n:long,chars:long>>")["summary"]
    return read.select("status", F.explode(rows).alias("r")).select("status", "r.*")


def settings_file(spark, sf_dir):
    """Customers as key=value lines with comments, quotes, blanks and later values of the same key."""
    customers = inputs.table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    path = _folder(spark, "settings")
    line = F.concat(F.lit("# c\n KEY_"), (F.col("c_custkey") % 50), F.lit(" = \""), F.col("c_name"), F.lit("\" \nno value\n"))
    # sorted ranges are files in order of their names, and lines are numbered by file
    customers.orderBy("c_custkey").select(line.alias("value")).write.text(path)
    return files.read_settings(spark, path)


def cache_upsert(spark, sf_dir):
    """Completions put twice; the later ones count."""
    turns = inputs.table(spark, sf_dir, "conversations")
    store = cache.CompletionCache(spark, _folder(spark, "cache"))
    for version in (0, 1):
        part = turns.where(F.col("conv_id") % 2 >= version)
        message = F.struct(F.lit("user").alias("role"), F.concat_ws("/", "conv_id", "turn").alias("content"))
        text = F.concat(F.lit(f"v{version} "), F.concat_ws("/", "conv_id", "turn"))
        completion = F.struct(
            text.alias("text"), F.lit("nvidia").alias("provider"), F.lit("m").alias("model"), F.lit(1.0).alias("latency"), F.lit("stop").alias("finish_reason")
        )
        stored = store.put(
            part.select(
                F.lit("nvidia").alias("provider"), F.lit("m").alias("model"), F.array(message).alias("messages"),
                cache.params_of(Config()).alias("params"), completion.alias("completion"),
            )
        )
        if not stored:
            raise RuntimeError("the cache was not written")
    return cache.latest(store.entries()).select(F.col("completion")["text"].alias("text"))


def zero_score_fill(spark, sf_dir):
    """Questions of terms that no passage has: the first passages of the pool with score zero."""
    bench = inputs.questions(spark, sf_dir)
    odd = F.translate(F.col("question"), "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ζξψ" * 17 + "ζ")
    found = rank(bench.withColumn("question", odd), inputs.passages(spark, sf_dir), Config())
    return found.select("qid", "rank", "pos", F.round("score", 6).alias("score"))


def example_selection(spark, sf_dir):
    """Recorded examples chosen by id; every third id of the list has no question."""
    bench = inputs.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("item_id").alias("pos"), F.col("text").alias("question"))
    ids = bench.select(F.when(F.col("qid") % 3 == 0, F.col("qid") + 1_000_000).otherwise(F.col("qid")).alias("qid"), (-F.col("qid")).alias("ord"))
    return quality.select_by_ids(bench, ids).select("qid", "ord", "found", "question")


def active_providers(spark, sf_dir):
    suppliers = inputs.table(spark, sf_dir, "supplier")
    return quality.active_providers(
        suppliers.select(
            F.col("s_name").alias("name"), F.col("s_suppkey").alias("ord"), (F.col("s_suppkey") % 4 > 0).alias("known"),
            F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, F.col("s_name")).alias("api_key"),
        )
    )


def danda_words(spark, sf_dir):
    """Texts in Devanagari letters whose sentences end in a danda: it is no part of a word."""
    docs = inputs.table(spark, sf_dir, "documents")
    # a step each, as text and tokens are used more than once
    texts = docs.select("doc_id", F.translate(inputs.deva(F.col("text")), ".,", "।॥").alias("text"))
    tokens = texts.select("doc_id", tx.tokenize(F.col("text"), lang="hi").alias("tokens"))
    danda = F.exists("tokens", lambda t: F.contains(t, F.lit("।")) | F.contains(t, F.lit("॥")))
    return tokens.select("doc_id", F.size("tokens").alias("n"), danda.alias("with_danda"))


_DOCS = "SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, md5(text) AS text_md5, lang FROM documents"
_DEVA = f"translate({sql.deva('text')}, '.,', '।॥')"

QUERIES = {
    "jsonl_strict": (jsonl_strict, _DOCS),
    "jsonl_lenient": (jsonl_lenient, _DOCS),
    "jsonl_comments": (jsonl_comments, _DOCS),
    "file_order": (
        file_order,
        "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5 FROM documents",
    ),
    "recorded_traces": (recorded_traces, "SELECT count(*) AS n, count(DISTINCT text) AS questions FROM conversations"),
    "results_document": (
        results_document,
        "SELECT 'ok' AS status, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang",
    ),
    "settings_file": (
        settings_file,
        "SELECT 'KEY_' || (c_custkey % 50) AS key, arg_min(c_name, c_custkey) AS value FROM customer GROUP BY 1",
    ),
    "cache_upsert": (
        cache_upsert,
        "SELECT CASE WHEN conv_id % 2 = 1 THEN 'v1 ' ELSE 'v0 ' END || conv_id || '/' || turn AS text FROM conversations",
    ),
    "zero_score_fill": (
        zero_score_fill,
        """SELECT item_id AS qid, rank, pos, 0.0::DOUBLE AS score FROM benchmark,
           (SELECT doc_id AS pos, CAST(row_number() OVER (ORDER BY doc_id) AS INT) AS rank FROM documents WHERE lang = 'en' QUALIFY rank <= 3)""",
    ),
    "example_selection": (
        example_selection,
        """WITH l AS (SELECT CASE WHEN item_id % 3 = 0 THEN item_id + 1000000 ELSE item_id END AS qid, -item_id AS ord FROM benchmark)
           SELECT qid, ord, text IS NOT NULL AS found, text AS question FROM l LEFT JOIN benchmark b ON b.item_id = qid""",
    ),
    "active_providers": (
        active_providers,
        "SELECT s_name AS name, s_suppkey AS ord FROM supplier WHERE s_suppkey % 4 > 0 AND s_suppkey % 3 = 1",
    ),
    "danda_words": (
        danda_words,
        f"""SELECT doc_id, CAST(len({sql.tokens(_DEVA, "'hi'")}) AS INT) AS n, false AS with_danda FROM documents""",
    ),
}
