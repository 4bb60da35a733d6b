"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b); the root is the smallest node of its component.

    Each round is staged, so lineage stays short and a lost executor re-reads files. A round moves
    links only, at most as many as there are; the number of rounds grows with the logarithm of the
    longest chain. Links to itself and null ends are left out; a node without other links has no row.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = stage(links.where("a <> b").select(a.alias("a"), b.alias("b")).distinct(), "links")
    before = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))).alias("sum")).first()
        if (row["n"], row["sum"]) == before or not row["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select("b", "b").distinct()
            )
        before = (row["n"], row["sum"])
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "links")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("l"))
        now = stage(small.select("l.a", F.col("l.m").alias("b")).where("a <> b").distinct(), "links")
