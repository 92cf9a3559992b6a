"""Dashboards, time series, logs and budgets. Times are naive UTC; days are those of a fixed offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHANGHAI = "INTERVAL 8 HOURS"


def local_day(ts: Column) -> Column:
    return F.to_date(ts + F.expr(SHANGHAI))


def daily_series(events: DataFrame, now: str, days: int, kinds: list[str], value: Column) -> DataFrame:
    """day, event_type, n, total for each of the last days and each kind, zeros included."""
    spark = events.sparkSession
    last = F.to_date(F.expr(f"TIMESTAMP_NTZ '{now}' + {SHANGHAI}"))
    calendar = spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("day"), F.array(*map(F.lit, kinds)).alias("k"))
    calendar = calendar.select("day", F.explode("k").alias("event_type"))  # days x kinds rows
    sums = events.filter(F.col("event_type").isin(kinds)).groupBy(local_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    full = calendar.join(sums, ["day", "event_type"], "left")
    return full.select(F.date_format("day", "MM-dd").alias("label"), "event_type", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("total", F.lit(0.0)).alias("total"))


def daily_quota(events: DataFrame, key: str, limit: int) -> DataFrame:
    """Per key and UTC day, the calls that a counter with a cap lets through and those that it rejects."""
    n = events.groupBy(key, F.to_date("ts").alias("day")).agg(F.count("*").alias("calls"))
    return n.select(key, "day", F.least("calls", F.lit(limit)).alias("accepted"), F.greatest(F.col("calls") - limit, F.lit(0)).alias("rejected"))


def token_budget(messages: DataFrame, session: str, order: str, tokens: Column, last: int, budget: int) -> DataFrame:
    """The newest messages of each session, `last` at most, as long as their tokens fit the budget."""
    newest = W.partitionBy(session).orderBy(F.desc(order))
    rows = messages.withColumn("__n", F.row_number().over(newest)).filter(F.col("__n") <= last)
    rows = rows.withColumn("tokens", tokens).withColumn("running", F.sum("tokens").over(newest.rowsBetween(W.unboundedPreceding, 0)))
    return rows.filter(F.col("running") <= budget).drop("__n")


def batch_status(items: DataFrame, batch: str, status: Column, finished: Column) -> DataFrame:
    """Per batch: items by state, the state of the whole, and when it ended unless it still runs."""
    s = status
    counts = items.groupBy(batch).agg(
        F.count("*").alias("total"), F.count_if(s == "success").alias("success"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "running").alias("running"), F.max(finished).alias("__end")
    )
    state = F.when(F.col("running") > 0, "running").when(F.col("failed") == 0, "success").when(F.col("success") == 0, "failed").otherwise("partial")
    return counts.withColumn("status", state).withColumn("finished_at", F.when(F.col("running") == 0, F.col("__end"))).drop("__end")


def top_titles(rows: DataFrame, by: str, title: Column, n: int, budget: int, *order: Column) -> DataFrame:
    """Per group its first titles, as many as fit the character budget, joined in order."""
    w = W.partitionBy(by).orderBy(*order)
    kept = rows.withColumn("__t", title).withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= n)
    kept = kept.withColumn("__run", F.sum(F.length("__t")).over(W.partitionBy(by).orderBy("__i").rowsBetween(W.unboundedPreceding, 0))).filter(F.col("__run") <= budget)
    pairs = F.array_sort(F.collect_list(F.struct("__i", "__t")))
    return kept.groupBy(by).agg(F.count("*").alias("titles"), F.array_join(F.transform(pairs, lambda x: x["__t"]), "; ").alias("body"))


def time_group(ts: Column, now: str) -> Column:
    """today, yesterday, day:YYYY-MM-DD within a month, else YYYY-MM; unknown without a time."""
    day, today = local_day(ts), F.to_date(F.expr(f"TIMESTAMP_NTZ '{now}' + {SHANGHAI}"))
    gone = F.datediff(today, day)
    return (
        F.when(ts.isNull(), "unknown")
        .when(gone == 0, "today")
        .when(gone == 1, "yesterday")
        .when((gone > 1) & (gone < 30), F.concat(F.lit("day:"), F.date_format(day, "yyyy-MM-dd")))
        .otherwise(F.date_format(day, "yyyy-MM"))
    )
