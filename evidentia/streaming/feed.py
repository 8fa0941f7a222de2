"""The ordered change feed with Structured Streaming: the checkpoint is the cursor."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evidentia import schema
from evidentia.config import DEFAULT


def changes(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema.OUTBOX)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


class Dispatcher:
    """Handlers by kind of change. A batch reaches each handler ordered by lane; a handler that fails fails the batch, which is retried."""

    def __init__(self) -> None:
        self.handlers: dict[str, list[Callable[[DataFrame], Any]]] = {}
        self.unmatched: Callable[[DataFrame], Any] | None = None

    def subscribe(self, change: str, handler: Callable[[DataFrame], Any]) -> None:
        self.handlers.setdefault(change, []).insert(0, handler)

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        ordered = batch.dropDuplicates(["idem_key"]).repartition("target_key").sortWithinPartitions("target_key", "seq").persist()
        try:
            for change, handlers in self.handlers.items():
                rows = ordered.filter(F.col("change") == change)
                for handle in handlers:
                    handle(rows)
            if self.unmatched is not None:
                self.unmatched(ordered.filter(~F.col("change").isin(*self.handlers)))
        finally:
            ordered.unpersist()


def tail(feed: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, drain: bool = True):
    """Runs the feed through ``handle``; with drain, what is there now and no more."""
    writer = feed.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=f"{DEFAULT.poll_ms} milliseconds")
    return writer.start()


def in_order(feed: DataFrame, lane: str = "lane", gap_ms: int = DEFAULT.gap_ms, start: int = 0) -> DataFrame:
    """(lane, seq, change, target_key, idem_key, skipped): each lane's rows in sequence.

    A missing number holds a lane back until it comes, or until ``gap_ms`` of processing time have passed;
    then it counts as rolled back, and the row behind it tells how many were skipped. State holds the
    waiting rows only.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expect, waiting = state.get if state.exists else (start + 1, "[]")
        import json

        held = {r[0]: r for r in json.loads(waiting)}
        for pdf in batches:
            for r in pdf[["seq", "change", "target_key", "idem_key"]].itertuples(index=False):
                if r.seq >= expect:
                    held[int(r.seq)] = [int(r.seq), r.change, r.target_key, r.idem_key]
        out = []
        skip = 0
        if state.hasTimedOut and held:
            skip = min(held) - expect
            expect = min(held)
        while expect in held:
            out.append((key[0], *held.pop(expect), skip))
            skip, expect = 0, expect + 1
        state.update((expect, json.dumps(sorted(held.values()))))
        if held:
            state.setTimeoutDuration(gap_ms)
        if out:
            yield pd.DataFrame(out, columns=["lane", "seq", "change", "target_key", "idem_key", "skipped"])

    return feed.groupBy(lane).applyInPandasWithState(step, "lane string, seq long, change string, target_key string, idem_key string, skipped long", "expect long, waiting string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def distinct_events(events: DataFrame, within: str = "1 day") -> DataFrame:
    """First events of each provenance, with bounded state."""
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(["provenance"])
