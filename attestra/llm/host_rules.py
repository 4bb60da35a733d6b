"""Host-level quality rules: documents are judged by the base rule and by their host's shrunk failure rates.

DataFrame functions only: nothing of this runs in Python on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, clear_of, stage, words_of

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = ("base", "symbols", "lines", "word_length")
ADDED = (*MEASURES, "n_lines", "base_failed", "host_failed", "host_key", "kept", *(f"fails_{r}" for r in RULES))


@dataclass(frozen=True)
class HostRules:
    """Limits of the rules.

    base: fewer than ``min_words`` words, or over half of the words in repeated three-word windows.
    symbols: more than ``max_symbols`` symbols a word. lines: more than ``max_dup_lines`` of the lines
    repeat an earlier one. word_length: the mean length is outside the two bounds.
    ``max_host_rate``: a host fails where one rule's shrunk failure rate is above it by ``margin`` deviations.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbols: float = 0.1
    max_dup_lines: float = 0.3
    min_word_length: float = 3.0
    max_word_length: float = 10.0
    max_host_rate: float = 0.5
    max_prior_weight: float = 1e6
    margin: float = 2.0


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five measures and ``n_lines`` (lines with a word) of each whole text.

    Windows are compared by a 64-bit hash of their words' hashes, sorted with their positions inside
    the row. Every helper array is used more than once by the next step, which keeps Spark from
    merging the steps into one expression that computes an array again for each element.
    """
    names = docs.columns
    w, h, s, p, n = (clear_of(x, names) for x in ("words_", "hashes_", "sorted_", "repeats_", "count_"))
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "")
    step = docs.withColumn(w, words_of(text)).withColumns(
        {
            h: F.transform(w, lambda x: F.xxhash64(x)),
            n: F.size(w),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit("[#*$%&|<>]")).cast("long"),
        }
    )
    window = F.transform(
        F.sequence(F.lit(0), F.col(n) - 3),
        lambda i: F.struct(
            F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"),
            i.alias("i"),
        ),
    )
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.withColumn(s, F.when(F.col(n) >= 3, F.sort_array(window)).otherwise(none))

    def hash_at(j: Column) -> Column:
        return F.get(s, j).getField("h")

    repeated = F.filter(
        F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0))),
        lambda j: F.coalesce((hash_at(j) == hash_at(j - 1)) & (j > 0), F.lit(False))
        | F.coalesce(hash_at(j) == hash_at(j + 1), F.lit(False)),
    )
    step = step.withColumn(p, F.sort_array(F.transform(repeated, lambda j: F.get(s, j).getField("i"))))
    covered = F.aggregate(
        p,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).cast("long").alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )
    step = step.withColumns(
        {"n_words": F.col(n).cast("long"), "n_repeat_words": covered, h: lines}
    ).withColumns(
        {
            "n_lines": F.size(h).cast("long"),
            "n_dup_lines": (F.size(h) - F.size(F.array_distinct(h))).cast("long"),
        }
    )
    return step.select(*names, *MEASURES, "n_lines")


def failures(rules: HostRules) -> dict[str, Column]:
    """A boolean per rule over measured rows."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "base": (F.col("n_words") < rules.min_words)
        | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words")),
        "symbols": F.col("n_symbols") > rules.max_symbols * words,
        "lines": F.col("n_dup_lines") > rules.max_dup_lines * F.col("n_lines"),
        "word_length": (F.col("word_chars") < rules.min_word_length * words)
        | (F.col("word_chars") > rules.max_word_length * words),
    }


def host_rates(judged: DataFrame, host: str, rules: HostRules) -> DataFrame:
    """A row per host (null is one): ``host_key``, ``n_docs``, a shrunk rate per rule, ``host_failed``.

    The prior of a rule is the beta distribution that has the mean of all documents and the spread of
    the hosts' rates beyond what chance gives at their sizes. Its weight is at most ``max_prior_weight``.
    A host fails a rule when its posterior rate, ``margin`` standard deviations taken off, is above the limit and
    above the rate of all documents: where most documents fail a rule, only hosts that stand out do.
    """
    hosts = stage(
        judged.groupBy(F.col(host).alias("host_key")).agg(
            F.count(F.lit(1)).alias("n_docs"), *[F.sum(F.col(f"fails_{r}").cast("long")).alias(f"k_{r}") for r in RULES]
        ),
        "hosts",
    )
    n = F.col("n_docs")
    parts = []
    for r in RULES:
        k = F.col(f"k_{r}")
        parts += [F.sum(k).alias(f"sum_{r}"), F.var_samp(k / n).alias(f"var_{r}")]
    total = hosts.agg(F.sum("n_docs").alias("docs"), F.avg(1 / n).alias("inverse"), *parts).first()
    columns, means = [], {}
    for r in RULES:
        mean = (total[f"sum_{r}"] or 0) / max(total["docs"] or 0, 1)
        means[r] = mean
        chance = mean * (1 - mean)
        spread = (total[f"var_{r}"] or 0.0) - chance * (total["inverse"] or 0.0)
        weight = min(max(chance / spread - 1, 1.0), rules.max_prior_weight) if spread > 0 else rules.max_prior_weight
        rate = (F.col(f"k_{r}") + mean * weight) / (n + weight)
        columns += [rate.alias(f"rate_{r}"), F.sqrt(rate * (1 - rate) / (n + weight + 1)).alias(f"deviation_{r}")]
    failed = F.lit(False)
    for r in RULES:
        low = F.col(f"rate_{r}") - rules.margin * F.col(f"deviation_{r}")
        failed = failed | (low > max(rules.max_host_rate, means[r]))
    rated = hosts.select("host_key", "n_docs", *columns).withColumn("host_failed", failed)
    return rated.drop(*[f"deviation_{r}" for r in RULES])


def judge(
    docs: DataFrame, host: str = "source", text: str = "text", rules: HostRules = HostRules(), with_text: bool = True
) -> DataFrame:
    """All rows and columns of ``docs`` with measures, ``base_failed``, ``fails_*``, ``host_failed`` and ``kept``.

    A document is kept if it does not fail the base rule and its host fails no rule by its shrunk rate; the other
    rules speak through the hosts only. Measured rows are staged once (without ``text`` if ``with_text`` is false);
    only one row per host is joined back, and Spark splits a hot host's rows where it doesn't broadcast that table.
    Columns of the same names as the added ones are replaced.

    Null text: no words, fails base. Null host: a host of its own. Repeated rows are judged like any
    other and count as often as they occur. No rows: no rows. Mostly failing tables: see ``host_rates``.
    """
    docs = docs.drop(*[c for c in docs.columns if c in ADDED and c not in (host, text)])
    judged = measure(docs, text).withColumns({f"fails_{r}": c for r, c in failures(rules).items()})
    judged = stage(judged if with_text or text == host else judged.drop(text), "judged")
    hosts = host_rates(judged, host, rules).select("host_key", "host_failed")
    joined = judged.join(hosts, judged[host].eqNullSafe(hosts["host_key"]), "left").drop("host_key")
    return joined.withColumn("base_failed", F.col("fails_base")).withColumn("kept", ~(F.col("fails_base") | F.col("host_failed")))


def keep_documents(docs: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """The documents that pass, with the columns of ``docs``, whatever their names."""
    names = docs.columns
    own = {c: clear_of(f"{c}_own", names) for c in names if c in ADDED}
    kept = judge(docs.withColumnsRenamed(own), rules=rules).where("kept")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in names])
