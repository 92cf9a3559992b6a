"""What needs all rows in one order, without all rows in one task: running totals, caps, and stitched texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip
from .written import written

#: Most parts of a range partitioning whose sums are added up in one window.
PARTS = 4096
#: Where a long piece may end, the best first.
ENDS = ("\n\n", "\n", "。", "！", "？", "；", "，", "、", ";", ",", " ")


def with_total_before(rows: DataFrame, value: str, order: list[str], name: str = "before") -> DataFrame:
    """The rows with `name`: the sum of `value` over all rows that come before in the order, which must be total.

    Two passes: rows are dealt by ranges of the order and written; the parts' sums, a row for each, are added up; within
    a part a window adds the rest. No task holds more than its part."""
    parts = min(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    sums = dealt.groupBy("__part").agg(F.sum(value).alias("__sum"))
    start = F.coalesce(F.sum("__sum").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("__part", start.alias("__start"))  # PARTS rows at most
    within = W.partitionBy("__part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    full = dealt.join(F.broadcast(starts), "__part")
    return full.withColumn(name, (F.col("__start") + F.coalesce(F.sum(value).over(within), F.lit(0))).cast("long")).drop("__part", "__start")


def preview_pieces(text: Column, most: int = 88) -> Column:
    """A text's pieces of `most` characters at most. A piece ends behind the last best mark in its later two thirds (from
    character 12 on at least), or where it is full. Blank pieces go; a blank text has none."""
    least = max(12, most // 3)
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  body(value), computed once
    state = "struct<left:string,out:array<string>>"

    def end(window: Column) -> Column:
        def behind(back: Column) -> Column:
            at = lambda mark: F.when(F.instr(back, mark[::-1]) > 0, most - F.instr(back, mark[::-1]) + 1)  # noqa: E731  behind the last one
            return F.coalesce(*(F.when(at(mark) - len(mark) >= least, at(mark)) for mark in ENDS), F.lit(most))

        return let(F.reverse(window), behind)

    def step(s: Column, _: Column) -> Column:
        def cut(size: Column) -> Column:
            piece = let(strip(F.substr(s["left"], F.lit(1), size)), lambda x: F.when(x != "", F.concat(s["out"], F.array(x))).otherwise(s["out"]))
            return F.struct(F.substr(s["left"], size + 1).alias("left"), piece.alias("out")).cast(state)

        size = F.when(F.length(s["left"]) <= most, F.length(s["left"])).otherwise(end(F.substring(s["left"], 1, most)))
        return F.when(s["left"] == "", s).otherwise(let(size, cut))

    def pieces(t: Column) -> Column:
        turns = F.sequence(F.lit(0), F.ceil(F.length(t) / least).cast("int"))
        start = F.struct(t.alias("left"), F.array().cast("array<string>").alias("out")).cast(state)
        folded = F.aggregate(turns, start, step, lambda s: s["out"])
        return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(folded)

    return let(strip(F.coalesce(text, F.lit(""))), pieces)


def preview_groups(segments: DataFrame, most: int, piece: int = 88) -> DataFrame:
    """doc_id, parent_index, chunk_index, content, char_count: the first `most` pieces of all children (doc_id,
    parent_index, seq, text) in order, numbered through from 0. Documents come by id; a document's parents in the order in
    which they first appear, each with all its children. Children without a parent take no part."""
    first = F.min("seq").over(W.partitionBy("doc_id", "parent_index"))
    # a child that isn't blank has a piece at least: documents before which there are `most` such children show nothing
    named = written(segments.filter("parent_index IS NOT NULL"), "children")
    shown = F.count_if(strip(F.coalesce("text", F.lit(""))) != "")
    counts = with_total_before(named.groupBy("doc_id").agg(shown.alias("__some")), "__some", ["doc_id"], "__earlier")
    reached = written(counts.filter(F.col("__earlier") < most).select(F.col("doc_id").alias("__doc")), "reached")  # `most` documents with text at most
    named = named.join(reached, F.col("doc_id").eqNullSafe(F.col("__doc")), "left_semi")
    rows = named.withColumn("__first", first).withColumn("__pieces", preview_pieces(F.col("text"), piece))
    rows = rows.withColumn("__n", F.size("__pieces")).filter("__n > 0")
    placed = with_total_before(rows.select("doc_id", "__first", "parent_index", "seq", "__n", "__pieces"), "__n", ["doc_id", "__first", "parent_index", "seq"], "__before")
    kept = placed.filter(F.col("__before") < most).select("doc_id", "parent_index", "__before", F.posexplode("__pieces").alias("__i", "content"))
    kept = kept.withColumn("chunk_index", F.col("__before") + F.col("__i")).filter(F.col("chunk_index") < most)
    return kept.select("doc_id", "parent_index", "chunk_index", "content", F.length("content").cast("long").alias("char_count"))


def stitched(chunks: DataFrame) -> DataFrame:
    """doc_id, text, gaps and covered of every document, from its overlapping chunks (doc_id, start_offset, content): each
    character once, from the first chunk that holds it. Where no chunk holds a place, a line break stands for the gap.

    A chunk gives what lies beyond the farthest end before it, by a window; a chunk within others gives nothing."""
    rows = chunks.filter(F.col("content").isNotNull() & (F.col("content") != "") & F.col("start_offset").isNotNull())
    rows = rows.withColumn("__end", F.col("start_offset") + F.length("content"))
    order = W.partitionBy("doc_id").orderBy("start_offset", F.desc("__end"), "content")
    far = F.max("__end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("__far", far)
    gap = F.col("__far").isNotNull() & (F.col("start_offset") > F.col("__far"))
    skip = F.greatest(F.coalesce(F.col("__far") - F.col("start_offset"), F.lit(0)), F.lit(0)).cast("int")
    rows = rows.withColumns({"__gap": gap, "__new": F.substr("content", skip + 1)}).filter("__new <> ''")
    piece = F.concat(F.when(F.col("__gap"), "\n").otherwise(""), F.col("__new"))
    texts = F.array_sort(F.collect_list(F.struct(F.col("start_offset") + skip, piece.alias("t"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(texts, lambda x: x["t"]), "").alias("text"), F.count_if("__gap").alias("gaps"), F.sum(F.length("__new")).cast("long").alias("covered"))


def best_source(sources: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """key, text, source: each document's text from the first source (key, text) that has one that isn't blank; source is
    that source's number, from 0. So a parsed layout, the original and stitched chunks can stand in for one another."""
    every = reduce(DataFrame.unionByName, [s.select(key, "text", F.lit(i).alias("source")) for i, s in enumerate(sources)])
    rows = every.filter(strip(F.coalesce("text", F.lit(""))) != "")
    return rows.groupBy(key).agg(F.min_by("text", F.struct("source", "text")).alias("text"), F.min("source").alias("source"))
