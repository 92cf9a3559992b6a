"""Joins and windows over records: tiers, merges, traces and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_match(rows: DataFrame, names: DataFrame, tiers: list[tuple[str, str]], key: str, *order: Column) -> DataFrame:
    """rows with the columns of the first match in `names`; tiers: (column of rows, column of names), the best first."""
    found = None
    for tier, (left, right) in enumerate(tiers):
        hit = rows.join(names, rows[left] == names[right]).withColumn("tier", F.lit(tier))
        found = hit if found is None else found.union(hit)
    place = F.row_number().over(W.partitionBy(key).orderBy("tier", *order))
    return found.withColumn("__p", place).filter("__p = 1").drop("__p")


def merged_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, state: 'added', 'updated' or 'disabled' (known, but no longer offered)."""
    both = old.select(key, F.lit(True).alias("o")).join(new.select(key, F.lit(True).alias("n")), key, "full")
    return both.select(key, F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "disabled").otherwise("updated").alias("state"))


def repeats(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """The rows that a row of the same keys and a smaller id stands before."""
    least = rows.groupBy(*keys).agg(F.min(key).alias("__least"))
    return rows.join(least, keys).filter(F.col(key) > F.col("__least")).drop("__least")


def last_before(rows: DataFrame, by: str, order: list[str], value: Column, wanted: Column) -> DataFrame:
    """`previous`: the value of the nearest row before for which `wanted` holds."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("previous", F.last(F.when(wanted, value), ignorenulls=True).over(w))


def leading_text(rows: DataFrame, by: str, order: str, text: Column, most: int, size: int) -> DataFrame:
    """The first rows' texts joined until `size` characters are reached, cut there with an ellipsis."""
    w = W.partitionBy(by).orderBy(order)
    kept = rows.withColumn("__t", text).withColumn("__i", F.row_number().over(w)).filter(F.col("__i") <= most)
    before = F.coalesce(F.sum(F.length("__t")).over(W.partitionBy(by).orderBy("__i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = kept.withColumn("__before", before).filter(F.col("__before") < size)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__t"))), lambda x: x["__t"]), "\n\n")
    joined = kept.groupBy(by).agg(body.alias("body"))
    return joined.withColumn("body", F.when(F.length("body") > size, F.concat(F.substring("body", 1, size), F.lit("…"))).otherwise(F.col("body")))


def graded(candidates: DataFrame, grades: DataFrame, least_score: float = 0.3) -> DataFrame:
    """Candidates with a grade from 0 to 2 (by score where none was given) and whether they are relevant."""
    rows = candidates.join(grades, ["query_id", "index"], "left")
    grade = F.coalesce(F.col("grade"), F.when(F.col("score") >= least_score, 1).otherwise(0))
    grade = F.least(F.greatest(grade, F.lit(0)), F.lit(2))
    return rows.withColumn("relevant", F.coalesce(F.col("relevant"), F.lit(False)) | (grade >= 1)).withColumn("grade", grade)


def ordered_union(first: DataFrame, second: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of both in order, the first of each key."""
    both = first.withColumn("source", F.lit(0)).unionByName(second.withColumn("source", F.lit(1)))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("source", order))
    return both.withColumn("__p", place).filter("__p = 1").drop("__p")


def counts_with_zeros(names: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return names.select(key).distinct().join(n, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def undirected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct pairs of different known nodes, the smaller first."""
    known = nodes.select(F.col("id"))
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(known.withColumnRenamed("id", "a"), "a", "left_semi").join(known.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b")


def phase_percent(phase: Column, current: Column, total: Column, spans: dict[str, tuple[float, float]]) -> Column:
    """Progress within a phase's span of percents, to two places."""
    start = F.create_map(*(F.lit(x) for k, (a, _) in spans.items() for x in (k, a)))[phase]
    end = F.create_map(*(F.lit(x) for k, (_, b) in spans.items() for x in (k, b)))[phase]
    share = F.when(total > 0, F.least(F.greatest(current / total, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return F.round(start + (end - start) * share, 2)


def falling_scores(rows: DataFrame, by: str, order: str, scores: list[str]) -> DataFrame:
    """The first known of several scores, else one that falls with the place, 0.1 at least."""
    place = F.row_number().over(W.partitionBy(by).orderBy(order)) - 1
    return rows.withColumn("score", F.coalesce(*scores, F.greatest(F.lit(0.1), 1 - 0.05 * place)))


def pseudo_ranks(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Scores (n - i) / n by place, as a reranker that failed leaves them."""
    w = W.partitionBy(by)
    place = F.row_number().over(w.orderBy(order)) - 1
    return rows.withColumn("score", (F.count("*").over(w) - place) / F.count("*").over(w))
