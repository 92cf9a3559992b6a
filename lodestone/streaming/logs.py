"""Tailing logs that grow: what each snapshot adds, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_SCHEMA = "log string, at long, line long, text string, reset boolean"


def tailed(snapshots: DataFrame) -> DataFrame:
    """log, at, line, text, reset: the lines that each snapshot (log, at, lines) adds to the one before it, by number. A log
    that is shorter than before was begun anew: all its lines are new, and marked. Null lines are an empty log; of equal
    times the shorter snapshot comes first. Snapshots without a log take no part."""
    size = F.coalesce(F.size("lines"), F.lit(0))
    rows = snapshots.filter("log IS NOT NULL").select(F.col("log").cast("string").alias("log"), F.col("at").cast("long").alias("at"), F.when(size < 0, 0).otherwise(size).alias("n"), "lines")
    before = F.coalesce(F.lag("n").over(W.partitionBy("log").orderBy("at", "n")), F.lit(0))
    rows = rows.withColumn("reset", F.col("n") < before).withColumn("from", F.when(F.col("reset"), 0).otherwise(before))
    lines = rows.filter("n > from").select("log", "at", "reset", "from", F.posexplode(F.slice("lines", F.col("from") + 1, F.col("n"))).alias("i", "text"))
    return lines.select("log", "at", (F.col("from") + F.col("i")).cast("long").alias("line"), "text", "reset")


def tailed_stream(snapshots: DataFrame, silent_ms: int = 60_000) -> DataFrame:
    """The same rows of a stream of snapshots, with each log's cursor as its state. A log without a snapshot for
    `silent_ms` gives a row without text once, and its cursor stays."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        cursor, at = state.get if state.exists else (0, 0)
        if state.hasTimedOut:
            state.update((cursor, at))  # without a timer, until the next snapshot
            yield pd.DataFrame({"log": [key[0]], "at": [at], "line": [cursor], "text": pd.Series([None], dtype=object), "reset": [False]})
            return
        found = []
        for at, n, lines in _ordered(pd.concat(list(frames))):
            reset = n < cursor
            cursor = 0 if reset else cursor
            found += [(key[0], at, k, lines[k], reset) for k in range(cursor, n)]
            cursor = n
        state.update((cursor, at))
        state.setTimeoutDuration(silent_ms)
        yield pd.DataFrame(found, columns=["log", "at", "line", "text", "reset"])

    rows = snapshots.filter("log IS NOT NULL").select(F.col("log").cast("string").alias("log"), F.col("at").cast("long").alias("at"), "lines")
    return rows.groupBy("log").applyInPandasWithState(run, _SCHEMA, "cursor long, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def _ordered(frame: pd.DataFrame) -> list[tuple]:
    """at, number of lines and lines of the snapshots, in order."""
    rows = [(int(a), 0 if x is None else len(x), x) for a, x in zip(frame["at"], frame["lines"], strict=True)]
    return sorted(rows, key=lambda r: r[:2])
