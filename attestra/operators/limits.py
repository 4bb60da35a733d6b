"""Request admission: per-client sliding window, global daily cap, and minimum-interval pacing.

Input rows have ``event_id, client, ts`` (timestamp); order is by (ts, event_id).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..session import stage

#: time slice (micros) over which a busy client is spread
SLICE = 60_000_000

ADMITTED, WINDOW_FULL, DAY_FULL = "admitted", "window_full", "day_full"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def busy_periods(events: DataFrame, window_seconds: float) -> DataFrame:
    """Add ``period``: the start (micros) of the client's run of events without a full-window gap.

    A limiter forgets everything over such a gap, so periods are independent of each other. Gaps
    are found inside (client, time slice) groups and carried between slices on slice summaries
    only, so a client holding much of the data is spread over its slices.
    """
    width = int(window_seconds * 1_000_000)
    timed = events.withColumn("at", micros(F.col("ts"))).withColumn(
        "_slice", F.floor(F.col("at") / F.lit(SLICE))
    )
    inside = Window.partitionBy("client", "_slice").orderBy("at", "event_id")
    gap = F.col("at") - F.lag("at").over(inside) >= width
    local = timed.withColumn("_starts", F.when(gap, F.col("at"))).withColumn(
        "_local", F.max("_starts").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    slices = local.groupBy("client", "_slice").agg(
        F.min("at").alias("_first"), F.max("at").alias("_last"), F.max("_starts").alias("_start")
    )
    across = Window.partitionBy("client").orderBy("_slice")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(across) >= width, F.lit(True))
    opened = slices.withColumn("_opens", F.when(fresh, F.col("_first")))
    newest = F.coalesce("_start", "_opens")  # latest period start known in this slice
    before = F.max(newest).over(across.rowsBetween(Window.unboundedPreceding, -1))
    carried = opened.withColumn("_carried", F.coalesce("_opens", before))
    return (
        local.join(carried.select("client", "_slice", "_carried"), ["client", "_slice"])
        .withColumn("period", F.coalesce("_local", "_carried"))
        .drop("_slice", "_starts", "_local", "_carried")
    )


def _window_fold(limit: int, width: int):
    """Ordered pass over rows sorted by (client, period, at): keeps one client's last hits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, hits = None, deque(maxlen=limit)
        for batch in batches:
            verdicts = []
            for key, at in zip(zip(batch["client"], batch["period"]), batch["at"]):
                if key != current:
                    current = key
                    hits.clear()
                free = len(hits) < limit or hits[0] <= at - width
                if free:
                    hits.append(at)
                verdicts.append(free)
            yield pd.DataFrame({"event_id": batch["event_id"], "free": verdicts})

    return run


def sliding_window(events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``admitted``: at most ``hits_per_window`` admitted hits in any trailing window.

    Rejected hits do not count. Periods no longer than the limit are admitted without leaving the
    JVM; only crowded ones are folded, in sorted order and with the last hits as the only state.
    """
    limit, width = cfg.hits_per_window, int(cfg.window_seconds * 1_000_000)
    timed = busy_periods(events, cfg.window_seconds)
    sizes = timed.groupBy("client", "period").agg(F.count("*").alias("_size"))
    sized = timed.join(sizes, ["client", "period"])
    crowded = sized.where(F.col("_size") > limit).select("event_id", "client", "period", "at")
    folded = (
        crowded.repartition("client", "period")
        .sortWithinPartitions("client", "period", "at", "event_id")
        .mapInPandas(_window_fold(limit, width), "event_id long, free boolean")
    )
    return (
        sized.join(folded, "event_id", "left")
        .withColumn("admitted", F.coalesce("free", F.lit(True)))
        .select(*events.columns, "admitted")
    )


def _day_cuts(admitted: DataFrame, cap: int) -> DataFrame:
    """(day, cut_at, cut_id): the last admitted hit of each day that reaches the cap."""
    order = Window.partitionBy("day").orderBy("ts", "event_id")
    # only the first `cap` rows of a day per task reach the shuffle
    first = (
        admitted.where("admitted")
        .withColumn("_n", F.row_number().over(order))
        .where(F.col("_n") <= cap)
    )
    return first.where(F.col("_n") == cap).select(
        "day", F.col("ts").alias("cut_at"), F.col("event_id").alias("cut_id")
    )


def _after_cut() -> Column:
    late = (F.col("ts") > F.col("cut_at")) | (
        (F.col("ts") == F.col("cut_at")) & (F.col("event_id") > F.col("cut_id"))
    )
    return F.coalesce(late, F.lit(False))


def admission(events: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Add ``verdict``: admitted, window_full or day_full.

    Hits refused by the daily cap do not enter a client's window, which matters just after
    midnight. The cut of each day is therefore recomputed from the hits before the cuts known so
    far until nothing changes; each round settles at least one more day, and two usually suffice.
    Cuts (one row per day) are staged, so rounds do not pile up in one plan.
    """
    dated = events.withColumn("day", F.to_date("ts"))
    cuts = stage(_day_cuts(sliding_window(dated, cfg), cfg.daily_cap), "cuts")
    while True:
        kept = dated.join(F.broadcast(cuts), "day", "left").where(~_after_cut())  # a row per day
        limited = sliding_window(kept.select(*dated.columns), cfg)
        again = stage(_day_cuts(limited, cfg.daily_cap), "cuts")
        if again.exceptAll(cuts).isEmpty() and cuts.exceptAll(again).isEmpty():
            break
        cuts = again
    return _verdicts(dated, limited, cuts, cfg).select(*events.columns, "verdict")


def _verdicts(dated: DataFrame, limited: DataFrame, cuts: DataFrame, cfg: Config) -> DataFrame:
    """After a day's cut the window still refuses first: compare with the hits before the cut."""
    width = int(cfg.window_seconds * 1_000_000)
    marked = dated.join(F.broadcast(cuts), "day", "left").withColumn("late", _after_cut())
    decided = marked.join(limited.select("event_id", "admitted"), "event_id", "left")
    # a slice is one window wide: hits that can still count lie in the same or the previous slice
    slot = F.floor(micros(F.col("ts")) / F.lit(width))
    late = decided.where("late").withColumn("_slot", slot)
    hits = (
        decided.where("admitted")
        .select(
            "client",
            micros(F.col("ts")).alias("_hit"),
            F.explode(F.array(slot, slot + 1)).alias("_slot"),
        )
        .groupBy("client", "_slot")
        .agg(F.collect_list("_hit").alias("_hits"))  # at most twice hits_per_window
    )
    counted = late.join(hits, ["client", "_slot"], "left").select(
        "event_id",
        F.size(F.filter("_hits", lambda h: h > micros(F.col("ts")) - width)).alias("_recent"),
    )
    full = F.coalesce("_recent", F.lit(0)) >= cfg.hits_per_window
    return decided.join(counted, "event_id", "left").withColumn(
        "verdict",
        F.when(F.col("late"), F.when(full, WINDOW_FULL).otherwise(DAY_FULL))
        .when(F.col("admitted"), ADMITTED)
        .otherwise(WINDOW_FULL),
    )


def pacing(requests: DataFrame, requests_per_minute: int) -> DataFrame:
    """Add ``starts_at`` (micros): starts keep arrival order and a gap of 60/rpm seconds.

    start_i = max(arrival_i, start_{i-1} + gap) = gap*i + max over j <= i of (arrival_j - gap*j).
    Ranks and running maxima are computed per second and shifted by the totals of earlier seconds. The
    seconds are range-sorted; what lies before a range comes from one summary row per range, so
    nothing but those few rows is ordered in one task.
    """
    timed = requests.withColumn("at", micros(F.col("ts")))
    if requests_per_minute <= 0:
        return timed.withColumn("starts_at", F.col("at")).drop("at")
    gap = 60_000_000 // requests_per_minute
    sliced = timed.withColumn("_slice", F.floor(F.col("at") / F.lit(1_000_000)))
    inside = Window.partitionBy("_slice").orderBy("at", "event_id")
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    ranked = sliced.withColumn("_i", F.row_number().over(inside)).withColumn(
        "_lead", F.col("at") - F.col("_i") * gap
    )
    running = ranked.withColumn("_peak", F.max("_lead").over(upto))
    totals = ranked.groupBy("_slice").agg(
        F.count("*").alias("_n"), F.max("_lead").alias("_slice_peak")
    )
    tasks = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = stage(
        totals.repartitionByRange(tasks, "_slice").withColumn("_range", F.spark_partition_id()), "seconds"
    )
    earlier = Window.partitionBy("_range").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    within = ranges.withColumn("_own", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    own_peak = F.col("_slice_peak") - F.col("_own") * gap
    within = within.withColumn("_own_before", F.max(own_peak).over(earlier))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    heads = within.groupBy("_range").agg(F.sum("_n").alias("_count"), F.max(own_peak).alias("_top"))
    heads = heads.withColumn("_shift", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    heads = heads.withColumn("_prior", F.max(F.col("_top") - F.col("_shift") * gap).over(before))
    shifted = within.join(F.broadcast(heads), "_range").select(
        "_slice",
        (F.col("_shift") + F.col("_own")).alias("_offset"),
        F.greatest("_prior", F.col("_own_before") - F.col("_shift") * gap).alias("_before"),
    )
    joined = running.join(shifted, "_slice")
    peak = F.greatest(F.col("_peak") - F.col("_offset") * gap, F.col("_before"))
    starts = gap * (F.col("_offset") + F.col("_i")) + peak
    return joined.withColumn("starts_at", starts).select(*requests.columns, "starts_at")
