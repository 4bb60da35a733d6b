"""Queries of streaming deduplication, the filter audit and periodic runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, shared_path, words_of
from .filter_game import audit_filters
from .periodic_runs import detect_runs
from .stream_dedup import StreamDedup, deduplicate


def _planted(docs: DataFrame) -> DataFrame:
    """Every tenth text by crc32 of its id gets a periodic tail of its own words, as the query's contract says."""
    h = F.crc32(F.col("doc_id").cast("string"))
    listed = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words_of("text")).alias("words"))
    listed = listed.withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10)})
    listed = listed.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    listed = listed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    word = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - 1),
        lambda i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    text = F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.array_join(word, " ")).otherwise(F.col("text"))
    return listed.select("doc_id", text.alias("text"))


def _strongest(runs: Column) -> Column:
    """The run of most periods (exactly compared), earliest start, then shortest period; null without runs."""

    def better(best: Column, run: Column) -> Column:
        ours, theirs = run["length"] * best["period"], best["length"] * run["period"]
        # runs come by start, then period, so a later one wins by more periods only
        return F.when(best.isNull() | (ours > theirs), run).otherwise(best)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = detect_runs(_planted(docs)).withColumn("best", _strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, StreamDedup(f"{sf_dir}/documents.parquet", shared_path(spark, "dedup")))


_DEDUP_SQL = r"""
WITH texts AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM texts WINDOW w AS (PARTITION BY t)
"""


def filter_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


_GAME_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
lists AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    min(doc_id) OVER (PARTITION BY t) AS first FROM texts),
known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    CAST(len(words) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INT)
    + 4 * CAST(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t) AS INT)
    + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(lists.doc_id > first, false) AS INT) AS mask
  FROM lists LEFT JOIN known ON lists.doc_id = known.doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS t FROM failed GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
steps AS (
  SELECT filter_order, s AS step, bits[s] AS bit, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INT) AS before
  FROM orders, range(1, 6) AS r(s)),
audited AS (
  SELECT part, filter_order, step, bit,
    sum(n) FILTER (WHERE mask & (before + bit) = 0) AS kept,
    sum(n) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS removed,
    sum(n) FILTER (WHERE mask & before <> 0 AND mask & bit <> 0) AS redundant,
    sum(n) FILTER (WHERE mask = bit) AS unique_fails,
    sum(g) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS good_lost,
    sum(t) FILTER (WHERE mask & before = 0 AND mask & bit <> 0) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept,
  CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
  CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM audited
"""

QUERIES = {
    "op11_stream_dedup": (stream_dedup, _DEDUP_SQL),
    "op12_filter_game": (filter_game, _GAME_SQL),
    "op13_periodic_runs": (periodic_runs, None),
}
