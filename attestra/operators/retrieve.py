"""Language-routed BM25 retrieval of the best passages for a batch of questions."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from ..config import Config
from ..functions import text as tx
from ..functions.rounding import exact_round
from ..session import fits, stage, staging_dir, staging_scope
from . import index as ix
from . import score as sc

#: tasks a core that score a round: few, as each returns its best of every question
_TASKS = 3


def route(questions: DataFrame) -> DataFrame:
    """Add ``candidates``: the candidate languages of each question."""
    return questions.withColumn("candidates", tx.candidate_languages(F.col("question")))


def query_terms(questions: DataFrame, cfg: Config) -> DataFrame:
    """(qid, wanted, term, qtf): wanted pool and folded query terms of each question.

    One extra row per question has a NULL term, so questions without terms stay present.
    """
    single = F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0)))
    wanted = F.array_join("candidates", "_") if cfg.filter_language else F.lit("all")
    asked = route(questions).select(
        "qid",
        wanted.alias("wanted"),
        single.alias("query_lang"),
        tx.raw_tokens(F.col("question")).alias("raw"),
    )
    stopped = F.expr(f"filter(raw, t -> NOT ({tx.stopword_sql('t', 'query_lang')}))")
    marked = asked.select("qid", "wanted", F.explode(F.array_append(stopped, F.lit(""))).alias("word"))
    terms = ix.explode_features(marked, "word").withColumn("term", F.nullif("term", F.lit("")))
    return terms.groupBy("qid", "wanted", "term").agg(F.count("*").alias("qtf"))


def _used_groups(passages: DataFrame, index: ix.Index | None, wanted: set[str]) -> list[str]:
    """Language groups of the wanted pools, all groups when one of these pools has no passages."""
    if index:
        sizes = {r.lang_group: r.n for r in index.stats.collect()}
    else:
        grouped = passages.groupBy(ix.language_group(F.col("lang")).alias("lang_group"))
        sizes = {r.lang_group: r.n for r in grouped.agg(F.count("*").alias("n")).collect()}
    empty = any(not sum(sizes.get(g, 0) for g in ix.POOLS[pool]) for pool in wanted)
    return sorted({g for pool in (ix.POOLS if empty else wanted) for g in ix.POOLS[pool]})


def _figures(groups: dict[str, tuple[int, int]]) -> dict[str, tuple[int, float]]:
    """(n, avgdl) of each non-empty pool from (n, total length) of the language groups."""
    figures = {}
    for pool, members in ix.POOLS.items():
        n = sum(groups.get(g, (0, 0))[0] for g in members)
        if n:
            figures[pool] = (n, sum(groups.get(g, (0, 0))[1] for g in members) / n)
    return figures


def _first_passages(passages: DataFrame, pools: set[str], n: int) -> dict[str, list]:
    """The first ``n`` passage positions of each pool: n rows per pool, at most five pools."""
    firsts = {}
    for pool in sorted(pools):
        members = ix.in_groups(passages, ix.POOLS[pool]).select("pos")
        firsts[pool] = [r.pos for r in members.orderBy("pos").limit(n).collect()]
    return firsts


def _lookup(key: Column, values: dict, default: Column) -> Column:
    found = F.when(F.lit(False), default)
    for name, value in values.items():
        found = found.when(key == name, value)
    return found.otherwise(default)


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def _term_score(cfg: Config) -> Column:
    tf, length = F.col("tf"), F.col("doc_len") / F.col("avgdl")
    norm = tf + F.lit(cfg.k1) * (F.lit(1.0 - cfg.b) + F.lit(cfg.b) * length)
    return F.col("weight") * (tf * F.lit(cfg.k1 + 1.0) / norm)


def rank(
    questions: DataFrame,
    passages: DataFrame,
    cfg: Config = Config(),
    index: ix.Index | None = None,
) -> DataFrame:
    """(qid, rank, pos, score): the ``top_k`` passages of each question, ties in passage order.

    ``questions`` needs ``qid, question``; ``passages`` needs ``pos, text, lang`` (``title``
    optional). Passages without any matching term score zero and fill up short lists.

    The ranking runs here and its small result is staged. Without an ``index`` passages and questions meet
    in blocks (see ``score``), in as many rounds of questions as ``Config.broadcast_max_rows`` asks for.
    """
    staged = stage(query_terms(questions, cfg), "query-terms")
    # at most five pools
    profile = staged.groupBy("wanted").agg(F.count("*").alias("n")).collect()
    wanted = {r.wanted for r in profile}
    groups = _used_groups(passages, index, wanted)
    if index is None:
        best, used = _scored_in_rounds(staged, ix.in_groups(passages, groups), wanted, sum(r.n for r in profile), cfg)
    else:
        best, used = _scored_by_index(staged, index, groups, wanted, sum(r.n for r in profile), cfg)
    firsts = _first_passages(passages, used, 2 * cfg.top_k - 1)
    asked = staged.where("term IS NULL").select("qid", _pool_of(used).alias("pool"))
    return stage(_fill(_best(best, cfg.top_k), asked, firsts, cfg.top_k), "ranked")


def _pool_of(used: set[str]) -> Column:
    return F.when(F.col("wanted").isin(*used), F.col("wanted")).otherwise(F.lit("all"))


def _scored_in_rounds(
    staged: DataFrame, passages: DataFrame, wanted: set[str], rows: int, cfg: Config
) -> tuple[DataFrame, set[str]]:
    """(qid, pos, score) with the best ``top_k`` of each question and task, and the pools in use.

    Passages are packed and staged once. A round has so many questions that its query terms are at most
    ``broadcast_max_rows`` rows; these come to the driver and are broadcast. The next round is made ready
    while the tasks score one.
    """
    spark = staged.sparkSession
    terms = staged.where("term IS NOT NULL AND qid IS NOT NULL")
    rounds = max(1, min(-(-rows // max(1, cfg.broadcast_max_rows)), rows))
    fields = F.struct("lang_group", F.col("doc_len").cast("int").alias("doc_len"), "words")
    # as many parts of the corpus as give each task of a round the same number
    tasks = _TASKS * spark.sparkContext.defaultParallelism
    parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // tasks) * tasks
    words = ix.analyse(passages).repartition(parts, "pos").groupBy("pos").agg(F.collect_list(fields).alias("parts"))
    path = f"{staging_dir(spark)}/scored-{uuid.uuid4().hex}"
    used: set[str] = set()
    with staging_scope(spark):
        packed = stage(words.select(F.col("pos").cast("bigint").alias("pos"), "parts").mapInArrow(sc.pack, sc.PACKED), "packed")

        def ready(i: int) -> _Round:
            return _round(terms.where(F.pmod(F.xxhash64("qid"), F.lit(rounds)) == i), packed, wanted)

        with ThreadPoolExecutor(1) as ahead:
            following = ahead.submit(ready, 0)
            for i in range(rounds):
                now = following.result()
                if i + 1 < rounds:
                    following = ahead.submit(ready, i + 1)
                _score_round(now, packed.coalesce(tasks), path, cfg)
                used |= now.used
    schema = StructType([staged.schema["qid"], StructField("pos", LongType()), StructField("score", DoubleType())])
    return spark.read.schema(schema).parquet(path), used


@dataclass
class _Round:
    """Questions of a round: what workers need of them, their ids by number, and the pools in use."""

    vocabulary: Broadcast
    todo: Broadcast
    qids: DataFrame
    used: set[str]


def _round(terms: DataFrame, packed: DataFrame, wanted: set[str]) -> _Round:
    """The questions of ``terms``, with the weights of their terms among the ``packed`` passages."""
    spark = terms.sparkSession
    asked = terms.select("qid", "wanted", "term", "qtf").toArrow()
    term, own, qids = (asked[c].combine_chunks().dictionary_encode() for c in ("term", "wanted", "qid"))
    qtf = asked["qtf"].to_numpy()
    del asked  # the texts of millions of rows
    term, terms_asked = term.indices.to_numpy(zero_copy_only=False), term.dictionary
    question, qids = qids.indices.to_numpy(zero_copy_only=False), qids.dictionary
    vocabulary = spark.sparkContext.broadcast(terms_asked)
    all_groups = ix.POOLS["all"]
    counted = packed.select("terms").mapInArrow(sc.count_terms(vocabulary, all_groups), sc.counted(all_groups)).groupBy("term")
    table = counted.agg(*[F.sum(g).alias(g) for g in all_groups]).toArrow()
    numbers, counts = table["term"].to_numpy(), {g: table[g].to_numpy() for g in all_groups}
    sizes = {g: [int(c[numbers == x].sum()) for x in (sc.N, sc.TOTAL_LEN)] for g, c in counts.items()}
    figures = _figures({g: (n, total) for g, (n, total) in sizes.items() if n})
    used = {pool if pool in figures else "all" for pool in wanted}

    names = sorted(used)
    df = np.zeros((len(names), max(1, len(terms_asked))))
    for i, pool in enumerate(names):
        df[i][numbers[numbers >= 0]] = sum(counts[g] for g in ix.POOLS[pool])[numbers >= 0]
    pool_of = [names.index(w if w in used else "all") for w in own.dictionary.to_pylist()]
    pool = np.array(pool_of, np.int8)[own.indices.to_numpy(zero_copy_only=False)]
    known = np.flatnonzero(df[pool, term] > 0) if len(term) else np.zeros(0, np.int64)
    question, pool, term, qtf = question[known], pool[known], term[known], qtf[known]
    found, n = df[pool, term], np.array([figures.get(p, (0, 1.0))[0] for p in names], float)[pool]
    weight = qtf * np.log(1.0 + (n - found + 0.5) / (found + 0.5))
    todo = sc.plan(question, pool, term, weight, found / n, [(ix.POOLS[p], figures.get(p, (0, 1.0))[1]) for p in names])
    numbered = pa.table({"question": pa.array(np.arange(len(qids), dtype=np.int32)), "qid": qids})
    key = spark.createDataFrame(numbered, StructType([StructField("question", IntegerType()), terms.schema["qid"]]))
    return _Round(vocabulary, spark.sparkContext.broadcast(todo), key, used)


def _score_round(now: _Round, packed: DataFrame, path: str, cfg: Config) -> None:
    """Append the best passages of the questions of a round to ``path``."""
    scored = packed.mapInArrow(sc.score(now.vocabulary, now.todo, cfg.top_k, cfg.k1, cfg.b), sc.SCORED)
    best = scored.join(F.broadcast(now.qids), "question").select("qid", "pos", "score")
    best.write.mode("append").parquet(path)
    now.todo.unpersist()
    now.vocabulary.unpersist()


def _scored_by_index(
    staged: DataFrame, index: ix.Index, groups: list[str], wanted: set[str], rows: int, cfg: Config
) -> tuple[DataFrame, set[str]]:
    """(qid, pos, score) of all passages that match, and the pools in use, from the tables of an index."""
    stats = {r.lang_group: (r.n, r.total_len) for r in index.stats.where(F.col("lang_group").isin(groups)).collect()}
    figures = _figures(stats)
    used = {pool if pool in figures else "all" for pool in wanted}
    # every table broadcast below has at most four rows (language groups) per query term
    small = rows * 4 <= cfg.broadcast_max_rows
    hint = F.broadcast if small else (lambda df: df)
    terms = staged.where("term IS NOT NULL").select("qid", _pool_of(used).alias("pool"), "term", "qtf")
    # only terms that some question has are expanded to pools and summed
    term_df = index.term_df.join(hint(terms.select("term").distinct()), "term", "left_semi")
    pooled_df = ix.expand_pools(term_df).groupBy("pool", "term").agg(F.sum("df").alias("df"))
    n = _lookup(F.col("pool"), {k: F.lit(v[0]) for k, v in figures.items()}, F.lit(0))
    avgdl = _lookup(F.col("pool"), {k: F.lit(v[1]) for k, v in figures.items()}, F.lit(1.0))
    weights = (
        hint(terms)
        .join(pooled_df, ["pool", "term"])
        .select(
            "qid",
            "term",
            avgdl.alias("avgdl"),
            (F.col("qtf") * inverse_frequency(n, F.col("df"))).alias("weight"),
            F.explode(ix.pool_groups(F.col("pool"))).alias("lang_group"),
        )
    )
    if small:
        matches = index.postings.join(F.broadcast(weights), ["lang_group", "term"])
    else:
        # too many query terms for a broadcast: copies of them go to blocks of passages, which
        # also splits the passages of a frequent term over that many tasks
        blocks = F.explode(F.sequence(F.lit(0), F.lit(cfg.salt_blocks - 1)))
        block = F.pmod(F.hash("pos"), F.lit(cfg.salt_blocks))
        matches = index.postings.withColumn("block", block).join(
            weights.withColumn("block", blocks), ["block", "lang_group", "term"]
        )
    return matches.groupBy("pos", "qid").agg(F.sum(_term_score(cfg)).alias("score")), used


def _best(scored: DataFrame, k: int) -> DataFrame:
    """(qid, hits): best ``k`` of each question in order.

    Each task keeps only its own best before the shuffle by question.
    """
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "pos")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    hits = F.array_sort(F.collect_list(F.struct("rank", "pos", "score")))
    return ranked.groupBy("qid").agg(hits.alias("hits"))


def _fill(best: DataFrame, asked: DataFrame, firsts: dict[str, list], k: int) -> DataFrame:
    """Complete lists of fewer than ``k`` hits with the first unmatched passages of the pool.

    A list misses at most ``k`` passages and matches at most ``k - 1`` of the first ``2k - 1``.
    """
    none = F.array().cast(best.schema["hits"].dataType)
    listed = asked.select("qid", "pool").join(best, "qid", "left")
    hits = listed.withColumn("hits", F.coalesce("hits", none))
    heads = {
        pool: F.array(*[F.lit(p) for p in head]).cast("array<bigint>")
        for pool, head in firsts.items()
    }
    first = _lookup(F.col("pool"), heads, F.array().cast("array<bigint>"))
    missing = F.array_except(first, F.transform("hits", lambda h: h["pos"]))
    zeros = F.transform(
        missing,
        lambda p, i: F.struct(
            (F.size("hits") + i + 1).alias("rank"), p.alias("pos"), F.lit(0.0).alias("score")
        ),
    )
    full = hits.select("qid", F.explode(F.slice(F.concat("hits", zeros), 1, k)).alias("hit"))
    return full.select("qid", "hit.rank", "hit.pos", "hit.score")


def retrieve(
    questions: DataFrame,
    passages: DataFrame,
    cfg: Config = Config(),
    index: ix.Index | None = None,
    text: bool = True,
) -> DataFrame:
    """Questions with their retrieved passages.

    Adds ``candidates``, ``retrieved`` (array in rank order), ``top_score`` (three decimals),
    ``precheck_passed`` (on the unrounded score) and ``resolved_lang``. Without ``text``, for callers that
    need no title or text, the passages listed have neither and none is read or moved for the lists.
    """
    ranked = rank(questions, passages, cfg, index)
    if fits(questions.select("qid"), cfg.broadcast_max_rows // max(1, cfg.top_k)):
        ranked = F.broadcast(ranked)
    title = F.col("title") if "title" in passages.columns else F.lit("")
    texts = [F.coalesce(title, F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")] if text else []
    body = passages.select("pos", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "lang", *texts)
    found = body.join(ranked, "pos").withColumn("bm25_score", exact_round("score", 3))
    passage = F.struct("rank", *body.columns, "bm25_score")
    lists = found.groupBy("qid").agg(
        F.array_sort(F.collect_list(passage)).alias("retrieved"),
        F.max("score").alias("_top"),
    )
    joined = route(questions).join(lists, "qid", "left")
    none = F.array().cast(lists.schema["retrieved"].dataType)
    top_lang = F.get("retrieved", F.lit(0))["lang"]
    return (
        joined.withColumn("_top", F.coalesce("_top", F.lit(0.0)))
        .withColumn(
            "precheck_passed",
            F.col("retrieved").isNotNull() & (F.col("_top") >= F.lit(cfg.min_score)),
        )
        .withColumn("top_score", exact_round("_top", 3))
        .withColumn("retrieved", F.coalesce("retrieved", none))
        .withColumn(
            "resolved_lang",
            F.when(F.size("candidates") == 1, F.get("candidates", F.lit(0))).otherwise(
                F.coalesce(F.nullif(top_lang, F.lit("")), F.get("candidates", F.lit(0)))
            ),
        )
        .drop("_top")
    )
