"""Stateful counters over event streams; each has a batch form that gives the same rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_usage(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, total per tumbling window; on a stream, windows close `late` behind the newest event."""
    # watermarks need instants; naive times are taken in the session's zone and given back naive
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    counted = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


class SlidingLog:
    """Accepts at most `limit` calls within `span` seconds; rejected calls leave no trace."""

    def __init__(self, limit: int, span: float, stamps: list[float] | None = None):
        self.limit, self.span, self.stamps = limit, span, deque(stamps or [])

    def __call__(self, now: float) -> bool:
        while self.stamps and self.stamps[0] < now - self.span:
            self.stamps.popleft()
        if len(self.stamps) >= self.limit:
            return False
        self.stamps.append(now)
        return True


def rate_limited(calls: DataFrame, limit: int, span: float = 60.0) -> DataFrame:
    """key, ts, accepted of every call, in order within each key. Calls stream through sorted tasks; a task holds the
    log of one key, `limit` stamps at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, log = None, None
        for batch in batches:
            accepted = []
            for k, ts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if log is None or k != key:
                    key, log = k, SlidingLog(limit, span)
                accepted.append(log(ts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(accepted, pa.bool_())], ["key", "ts", "accepted"])

    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("double").alias("ts"))
    return rows.repartition("key").sortWithinPartitions("key", "ts").mapInArrow(run, "key string, ts double, accepted boolean")


def rate_limited_stream(calls: DataFrame, limit: int, span: float = 60.0) -> DataFrame:
    """The same on a stream, with each key's log as its state; a log goes when its key has been idle for `span`."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        log = SlidingLog(limit, span, list(state.get[0]) if state.exists else [])
        for frame in frames:
            stamps = sorted(frame["ts"].tolist())
            yield pd.DataFrame({"key": key[0], "ts": stamps, "accepted": [log(t) for t in stamps]})
        state.update((list(log.stamps),))
        state.setTimeoutDuration(int(span * 1000))

    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("ts").cast("double").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(run, "key string, ts double, accepted boolean", "stamps array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def newest_lines(lines: DataFrame, by: str, order: Column, keep: int) -> DataFrame:
    """The last `keep` lines of each log, oldest first, as an array."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(by).orderBy(order.desc()))
    kept = lines.withColumn("__p", place).filter(F.col("__p") <= keep)
    return kept.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("__p")).alias("p"), "line"))), lambda x: x["line"]).alias("lines"))
