"""Questions answered in rounds: retrieve, grade, rewrite what found too little, and search again.

All open questions of a round are one batch. What a round finds and what it leaves open is written to the folder that
spark.checkpoint.dir names, so that each retrieval runs once. Retrieval, grading and rewriting are functions over
DataFrames, so a model takes part as an Arrow function inside one of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .written import written

MOST_ROUNDS = 5


def answer_rounds(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    grade: Callable[[DataFrame], DataFrame],
    rewrite: Callable[[DataFrame], DataFrame],
    rounds: int = 3,
    least_relevant: int = 1,
) -> DataFrame:
    """query_id, round and the rows of the round that settled each question, the last round for those that none did.

    questions: query_id, text. retrieve gives query_id, uid, score; grade adds `relevant`; rewrite maps questions."""
    rounds = max(1, min(MOST_ROUNDS, rounds))
    found, open_ = None, questions
    for step in range(1, rounds + 1):
        rows = written(grade(retrieve(open_)).withColumn("round", F.lit(step)), "round")
        enough = rows.groupBy("query_id").agg(F.count_if("relevant").alias("__n")).filter(F.col("__n") >= least_relevant).select("query_id")
        kept = rows if step == rounds else rows.join(enough, "query_id", "left_semi")
        found = kept if found is None else found.unionByName(kept)
        if step < rounds:
            open_ = written(rewrite(open_.join(enough, "query_id", "left_anti")), "open")
    return found


def recent_turns(messages: DataFrame, turns: int, size: int) -> DataFrame:
    """conv_id, history: the last turns of the user and the assistant as lines, each cut to `size` characters."""
    spoken = messages.filter(F.col("role").isin("user", "assistant"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    kept = spoken.withColumn("__p", place).filter(F.col("__p") <= turns)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, size))
    pairs = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(pairs, lambda x: x["line"]), "\n").alias("history"))


def knowledge_blocks(rows: DataFrame, size: int) -> DataFrame:
    """query_id, block: numbered passages with their titles, cut to `size` characters each."""
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "uid"))
    line = F.concat(F.lit("["), place.cast("string"), F.lit("]《"), F.col("title"), F.lit("》"), F.substring("content", 1, size))
    numbered = rows.select("query_id", place.alias("ref"), line.alias("line"))
    pairs = F.array_sort(F.collect_list(F.struct("ref", "line")))
    return numbered.groupBy("query_id").agg(F.array_join(F.transform(pairs, lambda x: x["line"]), "\n\n").alias("block"))
