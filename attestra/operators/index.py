"""Lexical index: per-passage word strings, postings, document frequencies and pool statistics.

A question is matched against one of five pools of passages, chosen by its candidate languages.
Statistics are kept per language group and summed into pools, so passages are never duplicated.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import stage

#: fixed values: language groups that make up each pool
POOLS = {
    "en": ["en"],
    "hi": ["hi"],
    "mr": ["mr"],
    "hi_mr": ["hi", "mr"],
    "all": ["en", "hi", "mr", "other"],
}


def language_group(lang: Column) -> Column:
    return F.when(lang.isin("en", "hi", "mr"), lang).otherwise(F.lit("other"))


def pool_groups(pool: Column) -> Column:
    """Language groups of a pool name."""
    groups = F.when(F.lit(False), F.array(F.lit("")))
    for name, members in POOLS.items():
        groups = groups.when(pool == name, F.array(*[F.lit(m) for m in members]))
    return groups


def expand_pools(by_group: DataFrame) -> DataFrame:
    """Repeat rows keyed by ``lang_group`` for every pool holding that group, as column ``pool``."""
    pools = F.when(F.lit(False), F.array(F.lit("")))
    for group in POOLS["all"]:
        names = [name for name, members in POOLS.items() if group in members]
        pools = pools.when(F.col("lang_group") == group, F.array(*[F.lit(n) for n in names]))
    return by_group.withColumn("pool", F.explode(pools)).drop("lang_group")


def indexed_text(passages: DataFrame) -> Column:
    """Title and text, the part of a passage that is searched."""
    title = F.col("title") if "title" in passages.columns else F.lit("")
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(F.col("text"), F.lit("")))


def analyse(passages: DataFrame) -> DataFrame:
    """(pos, lang_group, doc_len, words): kept words of each passage as one string."""
    raw = passages.select("pos", "lang", tx.raw_tokens(indexed_text(passages)).alias("raw"))
    kept = F.expr(f"filter(raw, t -> NOT ({tx.stopword_sql('t', 'lang')}))").alias("kept")
    tokens = raw.select("pos", language_group(F.col("lang")).alias("lang_group"), kept)
    return tokens.select(
        "pos",
        "lang_group",
        tx.feature_count(F.col("kept")).alias("doc_len"),
        F.concat_ws(" ", "kept").alias("words"),
    )


def prepare(passages: DataFrame) -> DataFrame:
    """``analyse`` placed by passage.

    This is the one shuffle of the corpus. It carries only the kept words as one string, and every
    later per-passage aggregation finds its rows already together. The partition number is explicit
    because each byte here becomes about one feature row: merging small partitions by their size
    would leave the expansion to a few tasks.
    """
    return placed(analyse(passages))


def placed(analysed: DataFrame) -> DataFrame:
    tasks = int(analysed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return analysed.repartition(tasks, "pos")


def in_groups(passages: DataFrame, groups: list[str]) -> DataFrame:
    """Passages of some language groups; a plain predicate on ``lang`` the scan can use."""
    if "other" in groups:
        return passages
    return passages.where(F.col("lang").isin(*groups))


def explode_features(words: DataFrame, word: str) -> DataFrame:
    """One row per feature of ``word``: the word itself, then its 3-grams, as column ``term``."""
    last = F.greatest(F.lit(1), F.length(word) - 2)
    numbered = words.withColumn("_i", F.explode(F.sequence(F.lit(0), last)))
    gram = F.substring(F.col(word), F.col("_i"), F.lit(3))
    return numbered.withColumn("term", F.when(F.col("_i") == 0, F.col(word)).otherwise(gram)).drop(
        "_i", word
    )


def postings(prepared: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """(pos, lang_group, doc_len, term, tf), optionally for the terms of ``vocabulary`` only.

    Words are counted per passage before they are expanded into grams, so a repeated word is
    expanded once. Both aggregations run inside the partitions ``prepare`` made.
    """
    keys = ["pos", "lang_group", "doc_len"]
    words = (
        prepared.select(*keys, F.explode(F.split("words", " ")).alias("word"))
        .where("word <> ''")
        .groupBy(*keys, "word")
        .agg(F.count("*").alias("n"))
    )
    features = explode_features(words, "word")
    if vocabulary is not None:
        features = features.join(vocabulary, ["lang_group", "term"], "left_semi")
    return features.groupBy(*keys, "term").agg(F.sum("n").alias("tf"))


def document_frequency(index_postings: DataFrame) -> DataFrame:
    """(lang_group, term, df): number of passages with the term."""
    return index_postings.groupBy("lang_group", "term").agg(F.count("*").alias("df"))


def group_stats(analysed: DataFrame) -> DataFrame:
    """(lang_group, n, total_len): at most four rows."""
    return analysed.groupBy("lang_group").agg(
        F.count("*").alias("n"), F.sum("doc_len").alias("total_len")
    )


def pool_stats(stats_by_group: DataFrame) -> DataFrame:
    """(pool, n, avgdl): passage count and mean length of each non-empty pool, at most five rows."""
    return (
        expand_pools(stats_by_group)
        .groupBy("pool")
        .agg(F.sum("n").alias("n"), (F.sum("total_len") / F.sum("n")).alias("avgdl"))
    )


@dataclass(frozen=True)
class Index:
    """Reusable index tables; build once, share between question batches and setups."""

    postings: DataFrame
    term_df: DataFrame
    stats: DataFrame

    @classmethod
    def build(cls, passages: DataFrame) -> Index:
        """Analyses the passages once: their postings and lengths are staged and shared by all uses."""
        analysed = stage(analyse(passages), "analysed")
        entries = stage(postings(placed(analysed)), "postings")
        return cls(entries, stage(document_frequency(entries), "term-df"), stage(group_stats(analysed), "stats"))

    def save(self, path: str) -> None:
        """Write the tables. Range partitioning by term and passage splits frequent terms."""
        ordered = self.postings.repartitionByRange("lang_group", "term", "pos")
        ordered.sortWithinPartitions("lang_group", "term", "pos").write.partitionBy(
            "lang_group"
        ).parquet(f"{path}/postings")
        self.term_df.write.parquet(f"{path}/term_df")
        self.stats.write.parquet(f"{path}/stats")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "term_df", "stats")))
