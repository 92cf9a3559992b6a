"""Markdown texts to sections, in windows over their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip

HEADING = r"(?U)^\s*(#{1,6})\s+(.*?)\s*$"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def markdown_sections(docs: DataFrame) -> DataFrame:
    """doc_id, seq, text, start_offset, end_offset, heading_path: a section for each heading with what follows it, and one
    for what comes before the first. Offsets count two characters between sections; blank sections are left out.

    A heading of level n stands n deep at most, and one deeper than the heading before it at most: the i-th stands
    i + min(0, min(level - place)) deep, taken over the headings up to it."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split("text", LINE_END, -1).alias("lines"))
    rows = rows.select("doc_id", "row", F.posexplode("lines").alias("i", "line"))
    level = F.length(F.regexp_extract("line", HEADING, 1))
    rows = rows.withColumn("level", F.when(level > 0, level))
    by = W.partitionBy("doc_id", "row").orderBy("i")
    rows = rows.withColumn("section", F.count("level").over(by))
    slack = F.min(F.col("level") - F.col("section")).over(by)
    rows = rows.withColumn("deep", F.when(F.col("section") > 0, F.col("section") + F.least(F.lit(0), slack)).otherwise(0))
    title = F.when(F.col("level").isNotNull(), F.regexp_extract("line", HEADING, 2))
    last = lambda k: F.last(F.when(F.col("deep") == k, title), ignorenulls=True).over(by)
    rows = rows.withColumn("path", F.concat_ws(" / ", *(F.when(F.col("deep") >= k, last(k)) for k in range(1, 7))))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"])
    sections = rows.groupBy("doc_id", "row", "section").agg(strip(F.array_join(lines, "\n")).alias("text"), F.max("path").alias("path")).filter("text <> ''")
    order = W.partitionBy("doc_id", "row").orderBy("section")
    start = F.coalesce(F.sum(F.length("text") + 2).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sections.select(
        "doc_id",
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        "text",
        start.cast("long").alias("start_offset"),
        (start + F.length("text")).cast("long").alias("end_offset"),
        F.when(F.col("path") != "", F.col("path")).alias("heading_path"),
    )
