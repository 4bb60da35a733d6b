"""Session helpers: shared staging folder, staged tables, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def staging_dir(spark: SparkSession) -> str:
    """Folder for staged tables: ``spark.checkpoint.dir``, which the cluster must share.

    Only a local session without that setting gets a folder of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_open = threading.local()


@contextmanager
def staging_scope(spark: SparkSession) -> Iterator[None]:
    """Tables staged by this thread inside the block are deleted at its end.

    For work whose result is written inside the block, such as a micro-batch or a stage of a pipeline.
    """
    outer, own = getattr(_open, "paths", None), []
    _open.paths = own
    try:
        yield
    finally:
        _open.paths = outer
        for path in own:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the staging folder and read it back.

    Lineage ends at the written files, so a lost executor re-reads them instead of repeating
    the work (or a remote call) above. Inside a ``staging_scope`` the table goes at its end; otherwise
    callers own the clean-up of the staging folder.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_open, "paths", None) is not None:
        _open.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows. A plain count: each task sends one number."""
    return df.count() <= max_rows


def broadcast_if_fits(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint behind a row-count check; otherwise the frame is returned unhinted."""
    return F.broadcast(df) if fits(df, max_rows) else df


def balanced(df: DataFrame, key: str) -> DataFrame:
    """Spread a plain scan that has fewer splits than shuffle partitions; leave others alone.

    One small or unsplittable file would otherwise be processed by one task. ``df`` must be a scan
    (asking a plan with shuffles for its partitions would run it).
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)
