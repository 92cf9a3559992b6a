"""Ordered operators on segments (doc_id, seq, text, block, page_no, heading_path, start_offset, end_offset).

Runs and prefixes are windows inside a document; only bin packing by budget is a fold, one document at a time."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BLANKS, strip, strip_column, strip_markdown

#: How chapters, sections and list items begin, and which blocks stay whole.
NUMERAL = "[一二三四五六七八九十百千]+"
ITEM_LINE = r"^\d+\s*[、.．)）]"
CHAPTER_LINE = rf"^(?:第\s*)?{NUMERAL}\s*[、.．]"
SECTION_LINE = rf"^[(（]\s*{NUMERAL}\s*[)）]"
NUMBERED_LINE = r"^第\s*\d+\s*[章节篇部条款]"
#: The first characters of the lines above.
FIRST = (*NUMERAL[1:-2], *"第(（0123456789")
ATOMIC = ("table", "image", "document_preamble")


def _begins(c: Column, *lines: str) -> Column:
    """Whether a text without its marks begins as one of the patterns does. Marks are looked for only where the first character
    that is neither white space nor a mark could begin one. A pattern that begins with its anchor is tried at the start of a
    text alone, one that has it in each branch at every place."""
    return F.left(F.ltrim(c, F.lit(BLANKS + "*_")), F.lit(1)).isin(*FIRST) & strip_markdown(c).rlike(f"^(?:{'|'.join(lines)})")


def starts_section(c: Column) -> Column:
    return _begins(c, CHAPTER_LINE, SECTION_LINE, NUMBERED_LINE)


def starts_body(c: Column) -> Column:
    return _begins(c, CHAPTER_LINE, SECTION_LINE, NUMBERED_LINE, ITEM_LINE)


def inline_item(line: Column, before: Column, short: int = 40) -> Column:
    """Whether a bracketed numeral begins an item of a list rather than a section."""
    after_colon = strip(F.coalesce(before, F.lit(""))).rlike("[：:]$")
    return strip_markdown(line).rlike(SECTION_LINE) & (after_colon | (F.length(strip_markdown(line)) <= short))


def section_key(path: Column) -> Column:
    """The last section of a heading path, else its last part that is no list item; null without a path."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  body(value), computed once
    last = lambda a: F.element_at(a, -1)
    some = lambda a, body: F.when(F.size(a) > 0, body(a))
    plain = lambda parts: F.filter(parts, lambda p: ~p.rlike(ITEM_LINE))
    marked = lambda parts: F.filter(parts, lambda p: p.rlike(f"{CHAPTER_LINE}|{SECTION_LINE}|{NUMBERED_LINE}"))
    chosen = lambda parts: F.coalesce(let(plain(parts), lambda a: F.coalesce(let(marked(a), lambda b: some(b, last)), some(a, last))), some(parts, last))
    return let(F.filter(F.transform(F.split(path, " / "), lambda p: strip_markdown(p)), lambda p: p != ""), chosen)


def _doc() -> W:
    return W.partitionBy("doc_id").orderBy("seq")


def _joined(rows: DataFrame, others: W, which: Column, joiner: str, *carried: str) -> DataFrame:
    """The rows with those in their frame `others` for which `which` holds: texts joined in order of seq, offsets from the first
    to the last. Rows that others take must be left out by the caller; what is carried is a row's own."""
    text = strip_column(F.col("text"))
    at = lambda how, c: how(F.when(which, F.col(c))).over(others)
    rows = rows.withColumns({
        "__texts": F.collect_list(F.when(which, F.struct("seq", text.alias("t")))).over(others), "__seq": at(F.min, "seq"),
        "__start": at(F.min, "start_offset"), "__end": at(F.max, "end_offset"),
    })
    every = F.concat("__texts", F.array(F.struct("seq", text.alias("t"))))
    joined = F.array_join(F.transform(F.array_sort(every), lambda x: x["t"]), joiner)
    alone = F.size("__texts") == 0
    return rows.select(
        "doc_id", F.least("seq", "__seq").alias("seq"), F.when(alone, F.coalesce(text, F.lit(""))).otherwise(joined).alias("text"), F.least("start_offset", "__start").alias("start_offset"),
        F.greatest("end_offset", "__end").alias("end_offset"), (F.size("__texts") + 1).cast("long").alias("merged"), *carried, "__left",
    ).filter("NOT __left").drop("__left")


def _grouped(rows: DataFrame, joiner: str, *carried: str, first: bool = False, order: W | None = None) -> DataFrame:
    """One row for each (doc_id, g), whose rows follow one another: texts joined in order; offsets from the first to the last;
    what is carried is that of the last row, or of the first.

    Most groups are of one row, so they aren't aggregated, which would hold, sort and write each text twice: the row that stays
    stands just behind the others of its group, which are its frame, and theirs are empty."""
    beside = (F.lag if first else F.lead)("g").over(order or _doc())
    rows = rows.withColumn("__left", F.coalesce(beside == F.col("g"), F.lit(False)))
    rows = rows.withColumn("__at", F.col("g").cast("long") * 2 + F.when(F.col("__left"), 0).otherwise(1))
    return _joined(rows, W.partitionBy("doc_id").orderBy("__at").rangeBetween(-1, -1), F.col("__left"), joiner, *carried)


def merge_preamble(segments: DataFrame, short: int = 280, budget: int = 1800, most: int = 16) -> DataFrame:
    """The leading short segments of each document as one with block 'document_preamble', if there are two or more."""
    rows = segments.filter(F.ltrim("text", F.lit(BLANKS)) != "").withColumn("text", strip_column(F.col("text")))
    n = F.length("text")
    stops = F.coalesce((F.col("block") == "table") | starts_body(F.col("text")) | ((F.col("block") == "heading") & (n > short)), F.lit(False))
    size = F.sum(n + 1).over(_doc()) - 1
    rows = rows.withColumns({"__size": size, "__place": F.row_number().over(_doc())})
    # a text is told by its marks only where it may still belong to the preamble
    rows = rows.withColumn("__stop", (F.col("__place") > most) | (F.col("__size") > budget) | stops)
    rows = rows.withColumn("__lead", ~F.max("__stop").over(_doc()))
    rows = rows.withColumn("__many", F.count_if("__lead").over(W.partitionBy("doc_id")) >= 2)
    lead = F.col("__lead") & F.col("__many")
    rows = rows.withColumn("g", F.when(lead, -1).otherwise(F.col("seq"))).withColumn("block", F.when(lead, "document_preamble").otherwise(F.col("block")))
    return _grouped(rows, "\n", "block", "page_no", "heading_path")


def merge_orphan_headings(segments: DataFrame, most: int = 120, body: int = 40, joiner: str = "\n\n", carry: Sequence[str] = ()) -> DataFrame:
    """Runs of segments that are headings alone join the next segment, unless that is a table, an image or missing."""
    text = strip_markdown(F.col("text"))
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")
    orphan = (F.col("block") == "heading") & (text != "") & (F.length(text) <= most) & F.forall(lines, lambda x: (F.length(x) < body) & ~x.rlike(ITEM_LINE))
    rows = segments.withColumn("__orphan", F.coalesce(orphan, F.lit(False)))
    run = F.coalesce(F.sum(F.when(F.col("__orphan"), 0).otherwise(1)).over(_doc().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a run stands before the segment that ends it, whose frame it is; that of a heading is empty, however long the run
    rows = rows.withColumns({"__at": run * 3 + F.when(F.col("__orphan"), 0).otherwise(1), "__takes": ~F.col("__orphan") & ~F.coalesce(F.col("block").isin(*ATOMIC), F.lit(False))})
    order = W.partitionBy("doc_id").orderBy("__at")
    taken = F.coalesce(F.max("__takes").over(order.rangeBetween(1, 1)), F.lit(False))
    rows = rows.withColumn("__left", F.col("__orphan") & taken)
    return _joined(rows, order.rangeBetween(-2, -1), F.col("__left"), joiner, "block", "page_no", "heading_path", *carry)


def merge_orphan_titles(segments: DataFrame, most: int = 120, joiner: str = "\n\n", carry: Sequence[str] = ()) -> DataFrame:
    """A short title joins the segment after it; the pair is used up, so of a run of titles every second one begins a pair."""
    text = strip_markdown(F.col("text"))
    atomic = lambda c: F.coalesce(c.isin(*ATOMIC), F.lit(False))
    title = ~atomic(F.col("block")) & (text != "") & (F.length(text) <= most) & ~starts_body(F.col("text")) & (F.length(F.regexp_replace(text, "[^\n]", "")) < 2)
    follows = F.lead("seq").over(_doc()).isNotNull() & ~atomic(F.lead("block").over(_doc()))
    rows = segments.withColumn("__opens", title & follows)
    rows = rows.withColumn("__run", F.sum(F.when(F.col("__opens"), 0).otherwise(1)).over(_doc().rowsBetween(W.unboundedPreceding, -1)))
    place = F.row_number().over(W.partitionBy("doc_id", F.coalesce("__run", F.lit(0))).orderBy("seq"))
    rows = rows.withColumn("__first", F.col("__opens") & (place % 2 == 1))
    rows = rows.withColumn("g", F.when(F.lag("__first").over(_doc()), F.lag("seq").over(_doc())).otherwise(F.col("seq")))
    return _grouped(rows, joiner, "block", "page_no", "heading_path", *carry)


def split_at_sections(segments: DataFrame) -> DataFrame:
    """Segments cut before each line that begins a section, but for items of lists."""
    rows = segments.select("doc_id", "seq", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    w = W.partitionBy("doc_id", "seq").orderBy("i")
    full = rows.withColumn("line", F.col("line")).withColumn("__before", F.last(F.when(strip(F.col("line")) != "", F.col("line")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    cut = F.when(starts_section(F.col("line")) & ~inline_item(F.col("line"), F.col("__before")) & F.col("__before").isNotNull(), 1).otherwise(0)
    full = full.withColumn("part", F.sum(cut).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return full.groupBy("doc_id", "seq", "part").agg(strip(body).alias("text")).filter("text <> ''")


def merge_by_budget(segments: DataFrame, budget: int | Column, joiner: str = "\n\n", carry: Sequence[str] = (), least: int = 80) -> DataFrame:
    """Neighbours of one page and section packed into the budget, which may differ from document to document; a heading opens
    a new one. A pack has the block, page and path of its first segment; below the least budget nothing is packed. Packing
    is sequential, so the numbers of the packs come from a fold over the segments in order, a task's documents one after the
    other; joining is a grouped aggregation."""
    rows = segments.filter(strip(F.col("text")) != "").withColumn("__n", F.length(strip(F.col("text"))))
    rows = rows.withColumn("__key", F.concat_ws("|", F.coalesce(F.col("page_no").cast("string"), F.lit("-")), F.coalesce(section_key(F.col("heading_path")), F.lit("-"))))
    rows = rows.withColumn("__budget", budget if isinstance(budget, Column) else F.lit(budget))

    rows = rows.withColumn("__head", F.coalesce(F.col("block") == "heading", F.lit(False)))
    rows = rows.select("doc_id", "seq", "text", "start_offset", "end_offset", "block", "page_no", "heading_path", *carry, "__n", "__key", "__budget", "__head")
    gap = len(joiner)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, at, used, key = None, -1, 0, None
        for batch in batches:
            packs = []
            for d, n, k, head, most in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "__n", "__key", "__head", "__budget")), strict=True):
                if d != doc:
                    doc, at, used, key = d, -1, 0, None
                joins = most >= least and used > 0 and not head and k == key and used + gap + n <= most
                at += not joins
                used = used + gap + n if joins else 0 if n >= most and not head else n
                key = k
                packs.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(packs, pa.int64())], names=[*batch.schema.names, "g"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    packs = rows.repartition("doc_id").sortWithinPartitions("doc_id", "seq").mapInArrow(pack, f"{kinds}, g long")
    in_order = W.partitionBy("doc_id").orderBy("seq", "g")  # rows of one place may be of two packs
    return _grouped(packs, joiner, "block", "page_no", "heading_path", *carry, first=True, order=in_order)
