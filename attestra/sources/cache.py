"""Completion cache: an append-only table keyed by the request hash."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.records import request_key
from ..session import stage

COMPLETION = (
    "struct<text:string,provider:string,model:string,latency:double,finish_reason:string>"
)
PARAMS = "struct<max_tokens:int,seed:int,temperature:double>"
MESSAGES = "array<struct<role:string,content:string>>"
SCHEMA = (
    f"key string, provider string, model string, messages {MESSAGES}, params {PARAMS}, "
    f"completion {COMPLETION}, written_at timestamp"
)


def params_of(cfg: Config) -> Column:
    return F.struct(
        F.lit(cfg.max_tokens).alias("max_tokens"),
        F.lit(cfg.seed).alias("seed"),
        F.lit(cfg.temperature).alias("temperature"),
    )


def latest(entries: DataFrame) -> DataFrame:
    """(key, completion): the last entry written for each key."""
    return entries.groupBy("key").agg(F.max_by("completion", "written_at").alias("completion"))


def lookup(
    requests: DataFrame, entries: DataFrame, models: dict[str, str], cfg: Config
) -> DataFrame:
    """Add ``completion``: the hit of the first provider, in configured order, that has one.

    ``requests`` needs ``messages`` and may have a boolean ``wanted``; other rows get no hit.
    The requests are staged with a number each, so that neither the keys nor the join below carry the
    plan that made the messages. Every (request, provider) is one small row; these are joined once with
    the entries, and the entry of the first provider goes back to the request by its number. Entries
    are reduced to requested keys before the newest of each is taken. A key that very many requests share is
    split by the adaptive skew join, since it meets one entry.
    """
    columns = requests.columns
    numbered = stage(requests.withColumn("_request", F.monotonically_increasing_id()), "requests")
    wanted = F.col("wanted") if "wanted" in columns else F.lit(True)
    offers = [
        F.struct(
            F.lit(i).alias("ord"),
            request_key(F.lit(p), F.lit(models[p]), F.col("messages"), params_of(cfg)).alias("key"),
        )
        for i, p in enumerate(cfg.provider_order)
    ]
    asked = stage(
        numbered.where(wanted).select("_request", F.explode(F.array(*offers)).alias("o")).select("_request", "o.*"), "asked"
    )
    hits = latest(entries.join(asked.select("key").distinct(), "key", "left_semi"))
    first = asked.join(hits, "key").groupBy("_request").agg(F.min_by("completion", "ord").alias("completion"))
    return numbered.join(first, "_request", "left").select(*columns, "completion")


@dataclass(frozen=True)
class CompletionCache:
    """Parquet folder of cached completions. Unreadable files count as misses."""

    spark: SparkSession
    path: str

    def entries(self) -> DataFrame:
        reader = self.spark.read.schema(SCHEMA).option("ignoreCorruptFiles", "true")
        try:
            return reader.option("ignoreMissingFiles", "true").parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], SCHEMA)  # nothing written yet

    def put(self, rows: DataFrame) -> bool:
        """Append (provider, model, messages, params, completion) rows; False if that fails."""
        key = request_key(F.col("provider"), F.col("model"), F.col("messages"), F.col("params"))
        stamped = rows.withColumns({"key": key, "written_at": F.current_timestamp()})
        columns = [part.split(" ")[0] for part in SCHEMA.split(", ")]
        try:
            stamped.select(*columns).write.mode("append").parquet(self.path)
        except Exception:
            return False
        return True

    def clear(self) -> None:
        self.spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(self.path)
