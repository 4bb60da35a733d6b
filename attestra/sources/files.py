"""JSON Lines packs, recorded traces, result documents and settings files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.text import strip_space
from ..session import broadcast_if_fits, stage

PASSAGE = "id string, topic_id string, title string, text string, lang string, source_url string"
QUESTION = (
    "id string, question string, lang string, answerable boolean, expected_sources array<string>"
)


#: Up to so many ranges of files, a row each, are broadcast to number the lines.
MAX_RANGES = 500_000


def _numbered(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the number of a row by file path, then place in the file; ``rows`` is a scan with the three parts of ``_place``.

    Tasks read ranges of files in any order (large ones first), but each range from its start on. So the rows
    of a range are counted, and ranges get their first number in the order of files.
    """
    ranges = stage(rows.groupBy("file_", "block_").agg(F.min("seq_").alias("first_"), F.count(F.lit(1)).alias("n_")), "ranges")
    before = W.orderBy("file_", "block_").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("file_", "block_", "first_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("before_"))
    placed = rows.join(broadcast_if_fits(starts, MAX_RANGES), ["file_", "block_"])
    pos = (F.col("before_") + F.col("seq_") - F.col("first_")).alias("pos")
    return placed.select(pos, *[c for c in rows.columns if c not in ("file_", "block_", "seq_")])


def _place() -> list[Column]:
    return [
        F.col("_metadata.file_path").alias("file_"),
        F.col("_metadata.file_block_start").alias("block_"),
        F.monotonically_increasing_id().alias("seq_"),
    ]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return _numbered(spark.read.text(path).select(*_place(), strip_space(F.col("value")).alias("line")))


def read_jsonl(
    spark: SparkSession, path: str, schema: str, comments: bool = False, strict: bool = True
) -> DataFrame:
    """Rows of a JSON Lines file, or a folder of them, with ``pos`` (line number over the files by path), blank lines skipped.

    ``comments`` also skips lines starting with '#'. A malformed line raises when ``strict`` and is
    dropped otherwise; a missing file then reads as empty.
    """
    try:
        lines = _lines(spark, path).where("line <> ''")
    except AnalysisException:
        if strict:
            raise
        return spark.createDataFrame([], f"pos bigint, {schema}")
    if comments or not strict:
        lines = lines.where(~F.startswith("line", F.lit("#")))
    mode = "FAILFAST" if strict else "PERMISSIVE"
    options = {"mode": mode}
    if strict:
        parsed = lines.withColumn("row", F.from_json("line", schema, options))
    else:
        checked = f"{schema}, _corrupt string"
        options["columnNameOfCorruptRecord"] = "_corrupt"
        parsed = lines.withColumn("row", F.from_json("line", checked, options)).where(
            "row IS NOT NULL AND row._corrupt IS NULL"
        )
    return parsed.select("pos", "row.*").drop("_corrupt")


def read_passages(spark: SparkSession, path: str, **options) -> DataFrame:
    """A passage pack; ``content`` is accepted for ``text``."""
    rows = read_jsonl(spark, path, PASSAGE + ", content string", **options)
    return rows.withColumn("text", F.coalesce("text", "content")).drop("content")


def read_questions(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_jsonl(spark, path, QUESTION, **options).withColumnRenamed("id", "qid")


def read_traces(
    spark: SparkSession, path: str, schema: str | None = None, lines: bool = False
) -> DataFrame | None:
    """Recorded runs from a JSON array file, or from JSON ``lines`` as ``write_runs`` makes them.

    None when the path is absent or holds no run records.
    """
    reader = spark.read.option("multiLine", not lines)
    try:
        rows = (reader.schema(schema) if schema else reader).json(path)
    except AnalysisException:
        return None
    if "question" not in rows.columns:
        return None
    # file order decides between runs of one question
    return rows if "pos" in rows.columns else _numbered(rows.select(*_place(), "*"))


def read_results(spark: SparkSession, path: str, caveats: tuple[str, ...] = ()) -> DataFrame:
    """One row (status, data, caveats): status ok, not_found or error; ``caveats`` are the caller's."""
    caveats = F.array(*[F.lit(c) for c in caveats]).cast("array<string>")
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        absent = spark.range(1).select(F.lit("not_found").alias("status"))
        return absent.select("status", F.lit(None).cast("string").alias("data"), caveats.alias("caveats"))
    valid = F.try_parse_json("value").isNotNull()
    return text.select(
        F.when(valid, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(valid, F.col("value")).alias("data"),
        caveats.alias("caveats"),
    )


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of a ``key=value`` file; comments and other lines skipped, quotes removed.

    The first line of a key wins, as settings are never overwritten.
    """
    lines = _lines(spark, path).where("line LIKE '%=%' AND line NOT LIKE '#%'")
    parts = F.split("line", "=", 2)
    rows = lines.select(
        "pos",
        strip_space(parts[0]).alias("key"),
        F.btrim(strip_space(parts[1]), F.lit("'\"")).alias("value"),
    )
    return rows.groupBy("key").agg(F.min_by("value", "pos").alias("value"))
