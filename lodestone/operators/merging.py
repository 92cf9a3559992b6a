"""Order-dependent merging of a query's ranked rows: greedy near-duplicate removal and fair merging with floors.

Removal is a fold over the rows of one query, as an aggregate over their array, WAVE rows at a time: what is kept so far
meets the next rows, until as many are kept as are asked for or the rows end. Queries run in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .written import written

#: Overlap from which two rows of a document are the same, and how a common beginning counts.
OVERLAP, PREFIX, LEAST_PREFIX = 0.72, 120, 40
TYPE_SHARE = 0.3
#: Rows of one query that the fold takes at once.
WAVE = 2000


def bare(c: Column) -> Column:
    """A text without white space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")


def overlap(a: Column, b: Column) -> Column:
    """Share of the longer of two bare texts that the shorter covers, as a part of it or as its first characters."""
    n, m = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    inside = F.contains(a, b) | F.contains(b, a)
    head = F.least(n, F.lit(PREFIX))
    covered = F.when(inside, n).when((head >= LEAST_PREFIX) & (F.substr(a, F.lit(1), head) == F.substr(b, F.lit(1), head)), head)
    return F.when(n > 0, F.coalesce(covered / m, F.lit(0.0))).otherwise(0.0)


def dedupe(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The rows of each query in order (of `ord`, unless given), `limit` at most, without those that repeat an earlier one
    of their document; body text takes the place of an image's that came before it."""
    columns = rows.columns
    place = F.row_number().over(W.partitionBy("query_id").orderBy(*(order or (F.col("ord"),)), bare(F.col("content")), F.struct(*columns)))
    ranked = written(rows.select(place.alias("place"), F.struct(bare(F.col("content")).alias("bare"), F.struct(*columns).alias("row")).alias("x")), "hits")
    kind = f"array<{ranked.schema['x'].dataType.simpleString()}>"

    def step(kept: Column, x: Column) -> Column:
        same = lambda k: (k["row"]["document_id"] == x["row"]["document_id"]) & (overlap(k["bare"], x["bare"]) >= OVERLAP)
        twin = F.array_position(F.transform(kept, lambda k: F.coalesce(same(k), F.lit(False))), F.lit(True)) - 1
        swap = F.transform(kept, lambda k, i: F.when((i == twin) & k["row"]["is_image"] & ~x["row"]["is_image"], x).otherwise(k))
        return F.when(F.size(kept) >= limit, kept).when(twin < 0, F.concat(kept, F.array(x))).otherwise(swap)

    most = ranked.agg(F.max("place")).first()[0] or 0
    state = None
    for first in range(0, max(most, 1), WAVE):
        part = ranked.filter((F.col("place") > first) & (F.col("place") <= first + WAVE)).groupBy(F.col("x.row.query_id").alias("query"))
        rows_of = part.agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda y: y["x"]).alias("rows"))
        met = rows_of.withColumn("kept", F.array().cast(kind)) if state is None else state.join(rows_of.withColumnRenamed("query", "of"), F.col("query").eqNullSafe(F.col("of")), "left")
        state = met.select("query", F.aggregate(F.coalesce("rows", F.array().cast(kind)), F.col("kept"), step).alias("kept"))
        if most > WAVE:
            state = written(state, "kept")
            if state.filter(F.size("kept") < limit).isEmpty():
                break
    return state.select(F.explode("kept").alias("x")).select("x.row.*")


def merge_collections(rows: DataFrame, limit: int) -> DataFrame:
    """Rows of several collections (query_id, kb_id, kb_type, uid, score, content, document_id, is_image) merged per query:
    the best of each collection, then of each type up to its floor, then by the score within the collection; last the
    repeats go. Of rows that repeat (kb_id, uid) the best counts."""
    by = W.partitionBy("query_id", "kb_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    scored = rows.withColumn("merge_score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))
    best_first = [F.desc("merge_score"), F.col("kb_id"), F.col("uid")]
    place = lambda *keys: F.row_number().over(W.partitionBy("query_id", *keys).orderBy(*best_first))
    ranked = scored.withColumn("copy", place("kb_id", "uid")).filter("copy = 1").drop("copy").withColumn("in_kb", place("kb_id"))
    reserved = (F.col("in_kb") == 1).cast("int")
    of_type = W.partitionBy("query_id", "kb_type")
    ranked = ranked.withColumn("held", F.sum(reserved).over(of_type)).withColumn("many", F.size(F.collect_set("kb_type").over(W.partitionBy("query_id"))))
    within = F.row_number().over(of_type.orderBy(reserved, *best_first))  # among those that aren't reserved
    floor = F.greatest(F.lit(1), F.floor(F.lit(limit * TYPE_SHARE)))
    tier = F.when(reserved == 1, 0).when((F.col("many") > 1) & (within <= floor - F.col("held")), 1).otherwise(2)
    order = W.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 0, F.col("kb_id")), *best_first)
    chosen = ranked.withColumn("tier", tier).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    negative = -F.col("merge_score")
    return dedupe(chosen.select(*scored.columns, "place"), limit, negative, F.col("place")).drop("place")
