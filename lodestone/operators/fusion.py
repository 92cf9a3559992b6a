"""Fusion of ranked channels as windows over (query, channel): normalisation, gates, weighted and reciprocal-rank scores.

Candidate tables have query_id, channel ('vector' or 'keyword'), uid, ord (the channel's order), score and, where a
query is an identifier, ident_hit (the text holds it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed values of the gates.
KEYWORD_FLOOR, IDENTIFIER_FLOOR = 3.0, 1.0
KEYWORD_SHARE, VECTOR_SHARE = 0.45, 0.55
VECTOR_FALLBACK = 0.45
RRF_K = 60


def min_max(score: Column, by: W, flat_floor: Column | float | None = None) -> Column:
    """0 for the least and 1 for the greatest; where all are equal 1 if positive, or 0 under `flat_floor`."""
    low, high = F.min(score).over(by), F.max(score).over(by)
    flat = F.when(high > 0, 1.0).otherwise(0.0)
    if flat_floor is not None:
        flat = F.when(high < flat_floor, 0.0).otherwise(flat)
    return F.when(high == low, flat).otherwise((score - low) / (high - low))


def relative(score: Column, by: W, flat_floor: Column | float | None = None) -> Column:
    """Share of the greatest, negatives 0; where all are equal 1, or 0 under `flat_floor`."""
    low, high = F.min(score).over(by), F.max(score).over(by)
    flat = F.lit(1.0)
    if flat_floor is not None:
        flat = F.when(high < flat_floor, 0.0).otherwise(flat)
    return F.when(high <= 0, 0.0).when(high == low, flat).otherwise(F.greatest(score, F.lit(0.0)) / high)


def vector_gate(rows: DataFrame) -> DataFrame:
    """Keeps a vector hit among the first quarter (three at least) that comes near the best, or that holds the identifier."""
    by = W.partitionBy("query_id")
    place = F.row_number().over(by.orderBy("ord"))
    best, many = F.max("score").over(by), F.count("*").over(by)
    near = (place <= F.greatest(F.lit(3), F.floor(many / 4))) & (F.col("score") >= best * VECTOR_SHARE) & (F.col("score") > 0)
    return rows.withColumn("keep", near | (F.col("ident_hit") & (F.col("score") > 0))).filter("keep").drop("keep")


def keyword_gate(rows: DataFrame, floor: Column) -> DataFrame:
    """Keeps keyword hits that reach the floor and near half of the query's best."""
    best = F.max("score").over(W.partitionBy("query_id"))
    return rows.withColumn("best", best).filter((F.col("best") >= floor) & (F.col("score") >= F.greatest(F.col("best") * KEYWORD_SHARE, floor))).drop("best")


def threshold_gate(rows: DataFrame, threshold: float, flat_floor: Column | None = None) -> DataFrame:
    by = W.partitionBy("query_id")
    return rows.withColumn("norm", min_max(F.col("score"), by, flat_floor)).filter(F.col("norm") >= threshold).drop("norm")


def hybrid(candidates: DataFrame, w_vector: float = 0.3, method: str = "weighted", identifier: bool = False) -> DataFrame:
    """query_id, uid, vector_score, keyword_score, score: where a query has keyword hits they alone are members and vectors
    raise them; without keyword hits vectors stand in if the best is good enough. Vectors pass their gate twice."""
    floor = F.lit(IDENTIFIER_FLOOR if identifier else KEYWORD_FLOOR)
    by = W.partitionBy("query_id")
    vector = vector_gate(candidates.filter("channel = 'vector'")).withColumn("v_rank", F.row_number().over(by.orderBy("ord")))
    keyword = keyword_gate(candidates.filter("channel = 'keyword'"), floor).withColumn("k_rank", F.row_number().over(by.orderBy("ord")))
    boost = vector_gate(vector).select("query_id", "uid", F.col("score").alias("vector_score"))
    members = keyword.select("query_id", "uid", F.col("score").alias("keyword_score"), "k_rank").join(boost, ["query_id", "uid"], "left")
    members = members.join(vector.select("query_id", "uid", "v_rank"), ["query_id", "uid"], "left")
    alone = vector.join(keyword.select("query_id").distinct(), "query_id", "left_anti").withColumn("top", F.max("score").over(by)).filter(F.col("top") >= VECTOR_FALLBACK)
    none = F.lit(None).cast("double")
    rows = members.select("query_id", "uid", "vector_score", "keyword_score", "v_rank", "k_rank").unionByName(
        alone.select("query_id", "uid", F.col("score").alias("vector_score"), none.alias("keyword_score"), "v_rank", F.lit(None).cast("int").alias("k_rank"))
    )
    if method == "rrf":
        one = lambda score, rank, w: F.when(score.isNotNull() & rank.isNotNull(), w / (RRF_K + rank)).otherwise(0.0)
        raw = one(F.col("vector_score"), F.col("v_rank"), w_vector) + one(F.col("keyword_score"), F.col("k_rank"), 1 - w_vector)
        rows = rows.withColumn("raw", raw).withColumn("score", relative(F.col("raw"), by))
    else:
        v = F.coalesce(relative(F.col("vector_score"), by), F.lit(0.0))
        k = F.coalesce(relative(F.col("keyword_score"), by, floor), F.lit(0.0))
        vn = F.when(F.col("vector_score").isNotNull(), v).otherwise(0.0)
        kn = F.when(F.col("keyword_score").isNotNull(), k).otherwise(0.0)
        rows = rows.withColumn("score", w_vector * vn + (1 - w_vector) * kn)
    return rows.select("query_id", "uid", "vector_score", "keyword_score", "score")


def merge_scores(rows: DataFrame) -> DataFrame:
    """merge_score: the score within its collection, from 0 to 1; 1 where all are equal."""
    by = W.partitionBy("query_id", "kb_id")
    low, high = F.min("score").over(by), F.max("score").over(by)
    return rows.withColumn("merge_score", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(1.0))


def fair_merge(rows: DataFrame, limit: int) -> DataFrame:
    """The first row of each collection, then the best of the rest, `limit` in all, in order of score."""
    first = F.row_number().over(W.partitionBy("query_id", "kb_id").orderBy(F.desc("score"), "uid"))
    tier = rows.withColumn("tier", F.when(first == 1, 0).otherwise(1))
    order = W.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 0, F.col("kb_id")), F.desc("score"), "uid")
    return tier.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit).drop("tier", "place")
