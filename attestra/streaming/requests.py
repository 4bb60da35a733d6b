"""Streaming admission and answering of question requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..config import Config
from ..operators.limits import micros
from ..session import staging_scope

ADMISSION = "client string, event_id long, at long, admitted boolean"


class _SlidingWindow(StatefulProcessor):
    """Per client: hits that wait for the watermark, and the admitted hit times that can still count.

    A hit is decided once the watermark has passed it, in the order of time, so neither the order of
    arrival nor the size of batches matters. Hits that wait are those of the watermark's delay; admitted
    ones are at most the limit. A client without hits for a whole window leaves no state.
    """

    def __init__(self, limit: int, width: int):
        self.limit, self.width = limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long")
        self.hits = handle.getListState("hits", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        for batch in rows:
            new = [(int(at), int(i)) for at, i in zip(batch["at"], batch["event_id"])]
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(map(tuple, self.waiting.get())) if self.waiting.exists() else []
        recent = [row[0] for row in self.hits.get()] if self.hits.exists() else []
        due, verdicts = [hit for hit in waiting if hit[0] < passed], []
        for at, _ in due:
            recent = [hit for hit in recent if hit > at - self.width]
            verdicts.append(len(recent) < self.limit)
            if verdicts[-1]:
                recent.append(at)
        left = waiting[len(due) :]
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        recent = [hit for hit in recent if left or hit > passed - self.width]
        if recent:
            self.hits.put([(hit,) for hit in recent])
            self.handle.registerTimer((recent[-1] + self.width) // 1000 + 1)
        else:
            self.hits.clear()
        if due:
            yield pd.DataFrame(
                {
                    "client": key[0],
                    "event_id": [i for _, i in due],
                    "at": [at for at, _ in due],
                    "admitted": verdicts,
                }
            )

    def close(self) -> None:
        pass


def admit_stream(requests: DataFrame, cfg: Config = Config(), delay: str = "10 seconds") -> DataFrame:
    """Sliding-window admission of a stream of (event_id, client, ts), equal to the batch result.

    Hits are decided by time, ties by id, when the watermark (``delay`` behind the newest hit) has passed
    them; hits that come later than that are dropped. The daily cap needs all clients of a day in one
    order and is left to the batch operator. Needs the RocksDB state store provider.
    """
    keyed = requests.withWatermark("ts", delay).select(
        F.col("client").cast("string").alias("client"), "event_id", micros(F.col("ts")).alias("at"), "ts"
    )
    width = int(cfg.window_seconds * 1_000_000)
    return keyed.groupBy("client").transformWithStateInPandas(
        statefulProcessor=_SlidingWindow(cfg.hits_per_window, width),
        outputStructType=ADMISSION,
        outputMode="Append",
        timeMode="eventTime",
    )


def answer_stream(
    requests: DataFrame,
    answer: Callable[[DataFrame], DataFrame],
    output: str,
    checkpoint: str,
) -> StreamingQuery:
    """Answer each micro-batch with ``answer`` and append the result as Parquet under ``output``.

    A batch writes its own folder, overwritten when the batch is repeated after a failure. What it staged
    meanwhile is deleted after that.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        with staging_scope(batch.sparkSession):
            answer(batch).write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
