"""Keyed writes, deletions and state as set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """One row for each key: the first in the order `newest`."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*newest))
    return rows.withColumn("__place", place).filter("__place = 1").drop("__place")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], *newest: Column) -> DataFrame:
    """The table with the newest change of each key in place of its row."""
    fresh = latest(changes, keys, *newest)
    return table.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str], *first: Column) -> DataFrame:
    """The rows whose key the table lacks, one for each key."""
    return latest(rows, keys, *first).join(table.select(*keys).distinct(), keys, "left_anti")


def delete(table: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(ids.select(*keys).distinct(), keys, "left_anti")


def cache_lookup(requests: DataFrame, cache: DataFrame, now: Column, width: Column) -> DataFrame:
    """requests with `hit`: whether the cache holds a fresh entry of the right width under the key."""
    live = cache.filter((F.col("expires_at") > now) & (F.col("width") == width)).select("key").distinct().withColumn("hit", F.lit(True))
    return requests.join(live, "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def page(rows: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """One page, from 1; sizes are held between 1 and 100."""
    number, size = max(1, number), min(100, max(1, size))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def stale(rows: DataFrame, state: Column, stamp: Column, now: Column, idle: str = "30 minutes") -> DataFrame:
    """Rows in a state that were last touched longer ago than `idle`."""
    return rows.filter(state & (stamp < now - F.expr(f"INTERVAL {idle}")))
