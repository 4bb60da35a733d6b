"""Queries of the operators on pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .html_cut import extract
from .preference import preference_segments, replies
from .warc import read_archives, write_archives


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(read_table(spark, sf_dir, "pages"))
    return read_archives(spark, archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))


def preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference_segments(*replies(read_table(spark, sf_dir, "conversations")))


_PREFERENCE_SQL = """
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
ends AS (
  SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS last, min(turn) FILTER (WHERE role = 'assistant') AS first
  FROM t GROUP BY conv_id),
early AS (
  SELECT t.conv_id, min(t.text) AS text FROM t JOIN ends e ON t.conv_id IS NOT DISTINCT FROM e.conv_id
  WHERE t.role = 'assistant' AND t.turn = e.first GROUP BY t.conv_id),
sides AS (
  SELECT t.conv_id, t.turn, t.role, t.text AS chosen,
    CASE WHEN t.role = 'assistant' AND t.turn = e.last THEN CASE WHEN e.last > e.first THEN y.text ELSE '' END ELSE t.text END AS rejected
  FROM t JOIN ends e ON t.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN early y ON t.conv_id IS NOT DISTINCT FROM y.conv_id
  WHERE e.last IS NULL OR t.turn <= e.last),
cuts AS (SELECT conv_id, min(turn) FILTER (WHERE chosen <> rejected) AS cut FROM sides GROUP BY conv_id),
parts AS (
  SELECT s.conv_id, CASE WHEN c.cut IS NULL OR s.turn < c.cut THEN 'prompt' ELSE p.part END AS part, s.turn, s.role,
    CASE WHEN p.part = 'chosen' THEN s.chosen ELSE s.rejected END AS text
  FROM sides s JOIN cuts c ON s.conv_id IS NOT DISTINCT FROM c.conv_id, (VALUES ('chosen'), ('rejected')) AS p(part)
  WHERE p.part = 'chosen' OR NOT (c.cut IS NULL OR s.turn < c.cut)),
cut AS (SELECT *, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS segment FROM parts),
marked AS (SELECT *, CASE WHEN part <> 'prompt' AND role = 'assistant' THEN length(segment) - length(head) ELSE 0 END AS n_trained FROM cut)
SELECT conv_id AS pair_id, part, turn, role, segment, CAST(length(segment) - n_trained AS BIGINT) AS n_masked, CAST(n_trained AS BIGINT) AS n_trained
FROM marked
"""

QUERIES = {
    "op7_warc": (warc, None),
    "op8_preference": (preference, _PREFERENCE_SQL),
    "op9_html_cut": (html_cut, None),
}
