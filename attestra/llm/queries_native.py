"""Queries of the operators that are DataFrame code throughout, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stage
from .curriculum import mixed, plan_mix
from .host_rules import MEASURES, judge


def host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return judge(docs, with_text=False).select("doc_id", *MEASURES, "base_failed", "kept", "host_failed")


def curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in training order: the rows are sorted by the position of their first pass."""
    rows = mixed(stage(plan_mix(read_table(spark, sf_dir, "documents")), "planned"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", F.round("first_time", 6).alias("first_time"))


_BLANK = r"[\x20\x09-\x0D]"
_HOST_SQL = rf"""
WITH body AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
lists AS (
  SELECT doc_id, source, t, list_filter(string_split_regex(t, '{_BLANK}+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '{_BLANK}+', '', 'g') <> '') AS lines
  FROM body),
windows AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM lists WHERE len(words) >= 3)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) >= 2),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS x(d) GROUP BY doc_id),
measured AS (
  SELECT l.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '{_BLANK}+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM lists l LEFT JOIN covered c ON l.doc_id = c.doc_id),
failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f_base,
    n_symbols > 0.1 * greatest(n_words, 1) AS f_symbols, n_dup_lines > 0.3 * n_lines AS f_lines,
    word_chars < 3 * greatest(n_words, 1) OR word_chars > 10 * greatest(n_words, 1) AS f_length
  FROM measured),
long AS (
  SELECT source, r, f FROM failed, LATERAL (VALUES ('b', f_base), ('s', f_symbols), ('l', f_lines), ('w', f_length)) AS v(r, f)),
host AS (SELECT source, r, count(*) AS n, sum(CAST(f AS INT)) AS k FROM long GROUP BY source, r),
prior AS (
  SELECT r, sum(k) / sum(n) AS m, (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) AS chance,
    coalesce(var_samp(k / n), 0) - (sum(k) / sum(n)) * (1 - sum(k) / sum(n)) * avg(1.0 / n) AS spread
  FROM host GROUP BY r),
weighed AS (SELECT r, m, CASE WHEN spread > 0 THEN least(greatest(chance / spread - 1, 1.0), 1e6) ELSE 1e6 END AS w FROM prior),
rated AS (SELECT source, m, (k + m * w) / (n + w) AS rate, n + w + 1 AS weight FROM host JOIN weighed USING (r)),
verdict AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / weight) > greatest(0.5, m)) AS host_failed
  FROM rated GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
  NOT (f_base OR host_failed) AS kept, host_failed
FROM failed JOIN verdict ON failed.source IS NOT DISTINCT FROM verdict.source
"""

_MIX_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '{_BLANK}+'), lambda w: w <> '')) AS BIGINT) AS size
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE turn WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w,
    CASE turn WHEN 0 THEN -0.5 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS ramp, 2.0::DOUBLE * source_size AS most FROM src),
ordered AS (
  SELECT *, coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fixed,
    sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, most / w AS stop_at,
    (SELECT 1.5 * sum(source_size) FROM src) AS words
  FROM weighed WINDOW o AS (ORDER BY most / w, source)),
levels AS (
  SELECT coalesce(arg_min((words - fixed) / open, stop_at) FILTER (WHERE (words - fixed) / open <= stop_at), max(stop_at)) AS level
  FROM ordered),
targets AS (SELECT source, source_size, least(w * level, most) AS target, ramp FROM weighed, levels),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.ramp,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5(CAST(s.doc_id AS VARCHAR)), s.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
given AS (
  SELECT *, greatest(0, least(size, round(target) - start)) AS taken1,
    greatest(0, least(size, round(target) - source_size - start)) AS taken2 FROM placed),
timed AS (SELECT *, least((start + taken1 / 2) / greatest(round(target), 1), 1.0) AS part FROM given)
SELECT doc_id, size, source_size, target, CAST(taken1 + taken2 AS BIGINT) AS taken,
  CASE WHEN taken1 > 0 THEN round(2 * part / ((1 - ramp) + sqrt((1 - ramp) * (1 - ramp) + 4 * ramp * part)), 6) END AS first_time
FROM timed
"""

QUERIES = {"op4_host_rules": (host_rules, _HOST_SQL), "op6_curriculum": (curriculum, _MIX_SQL)}
