"""Exact deduplication of a stream of documents with keyed state on disk.

Two streams run over a folder of documents, each from its own checkpoint: the first turns every text into a key row
(digest of the normalised text, document id, file and row where the content is), the second folds key rows into
state of one entry per digest: how many rows have it, and id and locator of the one that stays. The state lives in
RocksDB and has no watermark, so no entry expires; files that arrive later are folded in by another ``ingest``.
The state is read as a table, and the digests hit twice or more have the full bytes of their texts compared.

DataFrame functions only: nothing of this runs in Python on the executors.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.session import broadcast_if_fits

from .common import BLANKS, stage

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # otherwise each partition's store takes 4 MB of disk ahead, however little it holds
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
_settings = threading.Lock()


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def normalised(text: Column) -> Column:
    """Each stretch of blanks is one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{BLANKS}]+", " ")


@dataclass(frozen=True)
class StreamDedup:
    """Where a deduplication keeps its keys and state, and how it reads documents.

    ``source`` is a folder of Parquet files, or one file; ``home`` a folder all executors share, which belongs to
    this source. ``digest`` maps a normalised text to its key in the state. A micro-batch takes ``files_per_batch``
    files. Up to ``broadcast_rows`` digests are broadcast to pick the texts whose bytes are compared.
    """

    source: str
    home: str
    doc_id: str = "doc_id"
    text: str = "text"
    digest: Callable[[Column], Column] = sha256
    files_per_batch: int = 1000
    broadcast_rows: int = 200_000

    def schema(self, spark: SparkSession):
        """Only the two columns that are read, so others may have any name."""
        return spark.read.parquet(self.source).select(self.doc_id, self.text).schema

    def located(self, docs: DataFrame) -> DataFrame:
        """``digest``, ``id``, locator (``file``, ``row``), ``sha`` and the normalised ``body`` of each row."""
        body = normalised(F.col(self.text))
        return docs.select(
            F.col(self.doc_id).alias("id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
            body.alias("body"),
        ).select(self.digest(F.col("body")).alias("digest"), "id", "file", "row", sha256(F.col("body")).alias("sha"), "body")

    def documents(self, spark: SparkSession) -> DataFrame:
        return self.located(spark.read.schema(self.schema(spark)).parquet(self.source))


@contextmanager
def _state_settings(spark: SparkSession) -> Iterator[None]:
    """A stream copies the session's settings when it starts; they are as before afterwards."""
    with _settings:
        before = {name: spark.conf.get(name, None) for name in STATE}
        for name, value in STATE.items():
            spark.conf.set(name, value)
        try:
            yield
        finally:
            for name, value in before.items():
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ingest(spark: SparkSession, job: StreamDedup) -> None:
    """Fold all files of the source that were not seen yet into keys and state. May be repeated, also after a failure."""
    folder, _, name = job.source.rstrip("/").rpartition("/")
    # as a pattern, the source may be a single file too
    docs = (
        spark.readStream.schema(job.schema(spark))
        .option("maxFilesPerTrigger", job.files_per_batch)
        .parquet(f"{folder}/{{{name}}}")
    )
    keys = job.located(docs).drop("body")
    sink = keys.writeStream.format("parquet").option("checkpointLocation", f"{job.home}/keys-checkpoint")
    sink.trigger(availableNow=True).start(f"{job.home}/keys").awaitTermination()
    rows = spark.readStream.schema(keys.schema).option("maxFilesPerTrigger", job.files_per_batch).parquet(f"{job.home}/keys")
    entries = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), F.min(_rank()).alias("keep"))
    with _state_settings(spark):
        fold = (
            entries.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", f"{job.home}/state")
            .trigger(availableNow=True)
            .start()
        )
    fold.awaitTermination()


def _rank() -> Column:
    """Smallest id first, null ids last; the place of the content decides among rows of one id."""
    return F.struct(F.col("id").isNull().alias("no_id"), "id", "file", "row")


def entries(spark: SparkSession, job: StreamDedup) -> DataFrame:
    """The state: ``digest``, ``size`` and ``keep`` (id and locator of the row that stays), a row per digest."""
    state = spark.read.format("statestore").load(f"{job.home}/state")
    size, keep = state.schema["value"].dataType.names
    return state.select("key.digest", F.col("value")[size].alias("size"), F.col("value")[keep].alias("keep"))


def collisions(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """Digests of ``hits`` whose texts in ``docs`` are not all the same bytes.

    The smallest and largest text of a digest meet, after each task has kept these two of its own copies.
    """
    picked = docs.join(hits.select("digest"), "digest", "left_semi")
    ends = picked.groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
    return ends.where("low != high").select("digest")


def report(spark: SparkSession, job: StreamDedup) -> DataFrame:
    """A row per document: ``id``, ``sha``, ``size`` of its group of equal texts, ``keep`` and ``kept``.

    Digests with more than ``1 / (4 * partitions)`` of all rows are at most ``4 * partitions``, so they are broadcast;
    all others are joined by shuffle, and none of them can fill a task.
    """
    keys = spark.read.parquet(f"{job.home}/keys")
    with _state_settings(spark):
        hits = stage(entries(spark, job).where("size > 1"), "hits")
    docs = job.documents(spark)
    collided = stage(collisions(docs, broadcast_if_fits(hits, job.broadcast_rows)), "collided")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    heavy_at = max(keys.count() // (4 * parts), 1)
    agreed = hits.join(collided, "digest", "left_anti")
    heavy, light = F.broadcast(agreed.where(F.col("size") > heavy_at)), agreed.where(F.col("size") <= heavy_at)
    simple = keys.join(broadcast_if_fits(collided, job.broadcast_rows), "digest", "left_anti")
    told = simple.join(heavy, "digest").unionByName(simple.join(heavy, "digest", "left_anti").join(light, "digest", "left"), True)
    # texts that share a digest without being equal: whole texts are the key
    mixed = docs.join(broadcast_if_fits(collided, job.broadcast_rows), "digest", "left_semi")
    classes = mixed.groupBy("digest", "body").agg(F.count(F.lit(1)).alias("size"), F.min(_rank()).alias("keep"))
    told = told.unionByName(mixed.join(classes, ["digest", "body"]).drop("body"))
    stays = F.coalesce(F.col("keep"), _rank())
    return told.select(
        "id", "sha", F.coalesce("size", F.lit(1).cast("long")).alias("size"), stays.alias("keep"),
        ((stays["file"] == F.col("file")) & (stays["row"] == F.col("row"))).alias("kept"),
    )


def deduplicate(spark: SparkSession, job: StreamDedup) -> DataFrame:
    """``ingest`` and ``report`` with the ids of the source.

    A row per document: its id, ``keep_id`` (id of the row that stays), ``group_size``, ``kept``, ``text_sha256``.
    Of equal texts the smallest id stays. Null text: empty. Null id: after all others, so it stays only among null ids,
    and ``keep_id`` is null then. Rows of one id and text: the first by file and row stays. No rows: no rows.
    """
    ingest(spark, job)
    return report(spark, job).select(
        F.col("id").alias(job.doc_id),
        F.col("keep.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
