"""What the operators share: words, folds, staged tables, running sums."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestra.session import stage, staging_dir

#: Characters between words, as the body of a character class.
BLANKS = r"\x20\x09-\x0D"
BLANK_CHARS = " \t\n\x0b\x0c\r"

__all__ = ["BLANKS", "BLANK_CHARS", "clear_of", "fold", "read_table", "running", "shared_path", "slices", "stage", "words_of"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table of the data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{staging_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clear_of(name: str, columns: list[str]) -> str:
    """``name``, or a longer name that clashes with none of ``columns`` (case-insensitive)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def words_of(text: str | Column) -> Column:
    """Words of a text, ``[^\\x20\\x09-\\x0D]+``; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANKS}]+"))


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; 0 (held out) for a null key."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(n)), F.lit(0))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task holds beside a batch stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def running(df: DataFrame, value: str, out: str, order: list[Column], group: str | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over earlier rows (of the same ``group``) in ``order``.

    Rows are range-sorted and staged; each range sums its own rows, and what lies before a range
    comes from one total per range and group. No task holds a group, however large it is. ``order``
    must be total up to rows that are alike. Column order is kept, ``out`` comes last.
    """
    spark, part = df.sparkSession, clear_of("range_", df.columns)
    keys = [F.col(group).asc_nulls_last()] if group else []
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stage(df.repartitionByRange(tasks, *keys, *order).withColumn(part, F.spark_partition_id()), "ranges")
    # a stand-in that is never null, as windows and joins need no second rule then
    label = clear_of("group_", placed.columns)
    name = F.concat(F.lit("="), F.col(group).cast("string")) if group else F.lit("=")
    placed = placed.withColumn(label, F.coalesce(name, F.lit("")))
    totals = placed.groupBy(part, label).agg(F.sum(value).alias("sum_"))
    before = totals.select(
        F.col(part).alias("part_r"),
        F.col(label).alias("label_r"),
        F.coalesce(
            F.sum("sum_").over(W.partitionBy(label).orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
        ).alias("before_"),
    )
    inside = F.sum(value).over(W.partitionBy(part, label).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = placed.withColumn(out, inside - F.col(value))
    joined = rows.join(before, (F.col(part) == F.col("part_r")) & (F.col(label) == F.col("label_r")))
    return joined.select(*[F.col(c) for c in df.columns], (F.col(out) + F.col("before_")).alias(out))
