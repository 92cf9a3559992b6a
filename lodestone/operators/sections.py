"""Chunks of laid-out documents: segments merged by section and budget, cut again at sections, orphans joined.

Rows are segments: doc_id, seq, text, block, page_no, heading_path, start_offset, end_offset. What a row does depends on
those before it (the open section, headings and noise that wait for text, what is left of the budget), so a document is
folded by one `aggregate` whose state is a struct. A document is cut beforehand where nothing before can matter any more: at
headings that begin a section, unless a table may follow that takes back lines before them, and at texts that begin a page
if no chunk crosses pages and no later page goes back. Only such a piece is in one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import layout_noise, retrievable, strip, strip_markdown
from .segments import ATOMIC, inline_item, merge_orphan_headings, merge_orphan_titles, section_key, starts_section
from .written import once

#: Most characters of a line that may introduce a table, and most segments that are taken back for it.
CONTEXT_CHARS, CONTEXT_SEGMENTS = 120, 6
#: A budget below which nothing is merged.
LEAST_BUDGET = 80
_FIELDS = ["doc_id", "seq", "text", "block", "page_no", "heading_path", "start_offset", "end_offset"]
_OUT = "array<struct<members:array<int>,whole:int>>"
_TAIL = "array<struct<i:int,page:int>>"
_OPEN = "struct<first:int,n:int,size:int,key:string,page:int,heads:boolean,context:boolean,line:boolean,poppable:boolean>"


def merges_sections(backend: Column, kind: Column) -> Column:
    """Whether the layouts of a parser's backend are merged by section, by the type of the document."""
    return F.coalesce(F.when(backend == "opendataloader", kind == "pdf").when(backend == "mineru", kind.isin("docx", "pptx", "ppt", "pdf", "mineru")), F.lit(False))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _run(first: Column, n: Column) -> Column:
    return F.when(n > 0, F.sequence(first, first + n - 1)).otherwise(F.array().cast("array<int>"))


def _empty() -> Column:
    no = F.lit(False)
    return F.struct(F.lit(0), F.lit(0), F.lit(0), F.lit(None), F.lit(None), no, no, no, no).cast(_OPEN)


def _opened(i: Column, r: Column) -> Column:
    return F.struct(i, F.lit(1), r["n"], r["key"], r["page"], r["head"], r["context"], r["line"], r["poppable"]).cast(_OPEN)


def _extended(b: Column, r: Column, joiner: int) -> Column:
    every = lambda c: b[c] & r[{"heads": "head"}.get(c, c)]
    return F.struct(b["first"], b["n"] + 1, b["size"] + joiner + r["n"], b["key"], b["page"], every("heads"), every("context"), b["line"] | r["line"], F.lit(False)).cast(_OPEN)


def _put(state: Column, members: Column, whole: Column, page: Column, poppable: Column) -> Column:
    """The chunks so far and one more; the last single ones that a table may take back."""
    tail = F.concat(state["tail"], F.array(F.struct(F.element_at(members, -1).alias("i"), page.alias("page")))).cast(_TAIL)
    kept = F.slice(tail, F.greatest(F.size(tail) - CONTEXT_SEGMENTS + 1, F.lit(1)), CONTEXT_SEGMENTS)
    return F.struct(
        F.concat(state["out"], F.array(F.struct(members.alias("members"), whole.alias("whole")))).cast(_OUT).alias("out"),
        F.when(poppable, kept).otherwise(F.array().cast(_TAIL)).alias("tail"),
    )


def _flushed(s: Column) -> Column:
    """out and tail once the open segments are a chunk; noise alone goes."""
    b = s["open"]
    put = _put(s, _run(b["first"], b["n"]), F.lit(0), b["page"], b["poppable"])
    return F.when((b["n"] > 0) & ((b["size"] > 24) | b["line"]), put).otherwise(F.struct(s["out"].alias("out"), s["tail"].alias("tail")))


def _state(i: Column, b: Column, done: Column) -> Column:
    return F.struct(i.alias("i"), b.alias("open"), done["out"].alias("out"), done["tail"].alias("tail"))


def _whole(s: Column, i: Column, r: Column, rows: Column) -> Column:
    """After a table, picture or preamble: it takes the headings and short lines before it, unless it shows half of them."""
    b = s["open"]
    own = (b["n"] > 0) & b["context"]
    apart = F.transform(s["tail"], lambda x, j: F.when(r["page"].isNotNull() & ~x["page"].eqNullSafe(r["page"]), j + 1).otherwise(0))
    back = F.when(r["table"] & ~own, F.size(s["tail"]) - F.coalesce(F.array_max(apart), F.lit(0))).otherwise(0)

    def placed(k: Column) -> Column:
        taken = F.transform(F.slice(s["tail"], F.size(s["tail"]) - k + 1, k), lambda x: x["i"])
        members = F.when(own, _run(b["first"], b["n"])).when(k > 0, taken).otherwise(F.array().cast("array<int>"))
        left = F.struct(F.slice(s["out"], 1, F.size(s["out"]) - k).alias("out"), s["tail"].alias("tail"))
        before = F.when(own | (k > 0), left).otherwise(_flushed(s))
        shown = F.size(F.filter(members, lambda m: F.contains(r["t"], rows[m - 1]["t"])))
        repeats = (F.length(r["t"]) > 0) & (shown >= F.greatest(F.lit(1), F.floor((F.size(members) + 1) / 2)))
        kept = F.when(repeats, F.array().cast("array<int>")).otherwise(members)
        return _state(i, _empty(), _put(before, kept, i, r["page"], F.lit(False)))

    return _let(back, placed)


def _text(s: Column, i: Column, r: Column, budget: Column, joiner: int) -> Column:
    """After any other segment: it joins the open ones, or they become a chunk and it opens the next."""
    b = s["open"]
    chain = b["heads"] & r["head"] & r["page"].eqNullSafe(b["page"])
    ends = r["opens"] | (~r["key"].eqNullSafe(b["key"]) & ~chain) | (b["size"] + joiner + r["n"] > budget)

    def after(done: Column) -> Column:
        alone = (r["n"] >= budget) & ~r["head"] & ~r["noise"]
        put = _put(done, F.array(i), F.lit(0), r["page"], r["poppable"])
        return F.when(alone, _state(i, _empty(), put)).otherwise(_state(i, _opened(i, r), done))

    kept = F.struct(s["out"].alias("out"), s["tail"].alias("tail"))
    return F.when((b["n"] > 0) & ~ends, _state(i, _extended(b, r, joiner), kept)).otherwise(_let(_flushed(s), after))


def _prepared(segments: DataFrame, keep_pages: Column) -> DataFrame:
    """What the fold reads of each segment, and the number of its piece."""
    doc = W.partitionBy("doc_id").orderBy("seq")
    backwards = W.partitionBy("doc_id").orderBy(F.desc("seq"))  # a frame that shrinks would be gone through anew for each row
    every = W.partitionBy("doc_id")
    t = strip(F.coalesce(F.col("text"), F.lit("")))
    no = F.lit(False)
    rows = segments.withColumns({"whole": F.coalesce(F.col("block").isin(*ATOMIC), no), "head": F.coalesce(F.col("block") == "heading", no), "many": F.count("*").over(every), "pages": keep_pages})
    rows = once(rows, t=t).filter((F.col("t") != "") | F.col("whole") | (F.col("many") < 2))
    short = F.col("head") | F.col("block").isNull() | (F.col("block") == "paragraph")
    rows = once(rows, n=F.length("t"), noise=layout_noise(F.col("t")), section=starts_section(F.col("t")))
    lines = F.exists(F.split("t", r"[\n\r]+"), lambda x: ~layout_noise(x))
    rows = rows.withColumn("line", F.when(F.contains("t", F.lit("\n")) | F.contains("t", F.lit("\r")), lines).otherwise(~F.col("noise")))
    context = F.coalesce(F.col("head") | (short & (F.col("n") <= CONTEXT_CHARS)), no)
    poppable = F.coalesce(short & (F.col("n") <= CONTEXT_CHARS) & ~F.col("section"), no)
    page = F.when(F.col("pages"), F.coalesce(F.col("page_no").cast("string"), F.lit("-"))).otherwise("")
    key = F.concat(page, F.lit("|"), F.coalesce(F.concat(F.lit("/"), section_key(F.when(strip(F.col("heading_path")) != "", F.col("heading_path")))), F.lit("")))
    rows = once(rows, opens=F.col("head") & ~F.col("noise") & F.col("section") & ~F.col("whole"), context=context, poppable=poppable, key=key)
    before = F.max("page_no").over(doc.rowsBetween(W.unboundedPreceding, -1))
    least = F.min("page_no").over(backwards.rowsBetween(W.unboundedPreceding, W.currentRow))
    turns = F.col("pages") & ~F.col("whole") & (F.count_if(F.col("page_no").isNull()).over(every) == 0) & (least > before)
    # a table takes back lines from before a heading if text that can't introduce it came between; what ends such a run of
    # lines is a whole segment or a chunk that isn't one of them
    clears = F.col("whole") | (~F.col("poppable") & F.col("line"))
    rows = rows.withColumn("clears", F.coalesce(clears, no))
    end = F.when(F.col("whole") | F.col("opens"), F.struct(F.coalesce(F.col("block") == "table", no).alias("table"), F.col("seq").alias("at")))
    end = F.last(end, ignorenulls=True).over(backwards.rowsBetween(W.unboundedPreceding, -1))
    back = F.coalesce(end["table"], no) & (end["at"] > F.lead("seq").over(doc)) & ~F.coalesce(F.lag("clears").over(doc), F.lit(True))
    cut = F.when((F.col("opens") & ~back) | F.coalesce(turns, no), 1).otherwise(0)
    return rows.withColumn("piece", F.sum(cut).over(doc))


def merge_sections(segments: DataFrame, budget: int | Column, joiner: str = "\n\n", keep_pages: bool | Column = True) -> DataFrame:
    """Neighbours of one section (and page, if `keep_pages`) joined within the budget. Tables, pictures and preambles stay
    whole and take the headings and short lines right before them. Headings wait for what follows; noise joins text at
    hand, and goes if no text does. Adds merged (segments of a chunk) and context (segments that a whole one took).

    A document of one segment, and any document if the budget is below LEAST_BUDGET, stays as it is. As in the rule that
    this follows, an open chunk that can't introduce a table goes if the table takes back lines that stand before it."""
    if not isinstance(budget, Column):
        if budget < LEAST_BUDGET:
            return segments.select("*", F.lit(1).alias("merged"), F.lit(0).alias("context"))
        return _merged(segments, F.lit(budget), joiner, keep_pages)
    small = segments.filter(budget < LEAST_BUDGET).select(*_FIELDS, F.lit(1).alias("merged"), F.lit(0).alias("context"))
    return _merged(segments.filter(budget >= LEAST_BUDGET), budget, joiner, keep_pages).unionByName(small)


def _merged(segments: DataFrame, budget: Column, joiner: str, keep_pages: bool | Column) -> DataFrame:
    rows = _prepared(segments, keep_pages if isinstance(keep_pages, Column) else F.lit(keep_pages)).withColumn("budget", budget)
    fields = ["seq", "text", "t", "n", "block", "whole", "head", "noise", "opens", "context", "poppable", "line", "key", "heading_path", "start_offset", "end_offset"]
    row = F.struct(*fields, F.col("page_no").cast("int").alias("page"), F.coalesce(F.col("block") == "table", F.lit(False)).alias("table"))
    pieces = rows.groupBy("doc_id", "piece").agg(F.array_sort(F.collect_list(row)).alias("rows"), F.max("many").alias("many"), F.max("budget").alias("budget"))
    start = F.struct(F.lit(0).alias("i"), _empty().alias("open"), F.array().cast(_OUT).alias("out"), F.array().cast(_TAIL).alias("tail"))
    step = lambda s, r: _let(s["i"] + 1, lambda i: F.when(r["whole"], _whole(s, i, r, F.col("rows"))).otherwise(_text(s, i, r, F.col("budget"), len(joiner))))
    folded = pieces.withColumn("out", F.aggregate("rows", start, step, lambda s: _flushed(s)["out"]))
    alone = F.array(F.struct(F.array(F.lit(1)).alias("members"), F.lit(0).alias("whole"))).cast(_OUT)
    chunks = folded.select("doc_id", F.explode(F.when(F.col("many") < 2, alone).otherwise(F.col("out"))).alias("o"), "rows")
    members = F.transform("o.members", lambda m: F.col("rows")[m - 1])
    chunks = chunks.select("doc_id", members.alias("m"), F.get("rows", F.col("o.whole") - 1).alias("w"))
    first, last = F.coalesce(F.get("m", F.lit(0)), F.col("w")), F.coalesce("w", F.get("m", F.size("m") - 1))
    joined = F.array_join(F.concat(F.transform("m", lambda x: x["t"]), F.filter(F.array("w.t"), lambda x: x.isNotNull())), joiner)
    parts = F.size("m") + F.col("w").isNotNull().cast("int")
    return chunks.select(
        "doc_id", first["seq"].alias("seq"),
        F.when(parts == 1, first["text"]).otherwise(joined).alias("text"),
        F.when(F.col("w").isNotNull(), F.col("w.block")).otherwise(first["block"]).alias("block"),
        F.coalesce("w.page", first["page"]).alias("page_no"),
        F.coalesce(F.when(F.col("w.heading_path") != "", F.col("w.heading_path")), first["heading_path"]).alias("heading_path"),
        first["start_offset"].alias("start_offset"), last["end_offset"].alias("end_offset"),
        F.when(F.col("w").isNull(), F.size("m")).otherwise(1).alias("merged"), F.when(F.col("w").isNull(), 0).otherwise(F.size("m")).alias("context"),
    )


def _pieces(items: Column, starts: Column, joiner: str) -> Column:
    """The items from each start to the next, joined; `starts` are places from 0 on."""
    end = lambda j: F.coalesce(F.get(starts, j + 1), F.size(items))
    return F.transform(starts, lambda s, j: F.array_join(F.slice(items, s + 1, end(j) - s), joiner))


def split_merged_sections(chunks: DataFrame, joiner: str = "\n\n", carry: Sequence[str] = ()) -> DataFrame:
    """Chunks in which two or more sections begin, cut before each; what is before the first is a chunk of its own. Lines
    of lists in brackets don't begin a section; tables and pictures are cut only with what they took. Adds part; carried
    columns are kept."""
    places = lambda a: F.transform(a, lambda _, i: i)
    line = lambda a, i: F.element_at(F.split(strip(F.get(a, i)), "\n"), 1)
    rows = chunks.withColumn("lines", F.split(strip(F.coalesce(F.col("text"), F.lit(""))), "\n", -1))
    cuts = lambda a, i: starts_section(strip(F.get(a, i))) & ~inline_item(strip(F.get(a, i)), F.get(a, i - 1))
    lines = F.col("lines")
    rows = rows.withColumn("cut", F.filter(places(lines), lambda i: (i == 0) | ((F.length(strip(F.get(lines, i))) > 0) & F.coalesce(cuts(lines, i), F.lit(False)))))
    blocks = F.filter(F.transform(_pieces(lines, F.col("cut"), "\n"), strip), lambda x: x != "")
    paragraphs = F.filter(F.transform(F.split(strip(F.coalesce(F.col("text"), F.lit(""))), r"\n\n+"), strip), lambda x: x != "")
    rows = rows.withColumn("blocks", blocks).withColumn("blocks", F.when((F.size("blocks") <= 1) & (F.size(paragraphs) > 1), paragraphs).otherwise(F.col("blocks")))
    parts = F.col("blocks")
    opens = lambda i: F.coalesce(starts_section(line(parts, i)) & ~inline_item(line(parts, i), F.when(i > 0, line(parts, i - 1))), F.lit(False))
    rows = rows.withColumn("starts", F.filter(places(parts), opens))
    whole = F.coalesce(F.col("block").isin("table", "image"), F.lit(False)) & (F.col("context") == 0)
    several = ~whole & (F.size("starts") > 1)
    lead = F.when(several & (F.get("starts", F.lit(0)) > 0), F.array(F.struct(F.array_join(F.slice(parts, 1, F.get("starts", F.lit(0))), joiner).alias("text"), F.lit(None).cast("string").alias("title"))))
    titles = F.transform("starts", lambda s: strip_markdown(F.get(parts, s)))
    cut = F.arrays_zip(_pieces(parts, F.col("starts"), joiner).alias("text"), titles.alias("title"))
    rows = rows.withColumn("cells", F.when(several, F.concat(F.coalesce(lead, F.array().cast("array<struct<text:string,title:string>>")), cut)))
    rows = rows.withColumn("several", several).select("*", F.posexplode_outer("cells").alias("part", "cell"))
    block = F.when(~F.col("several"), F.col("block")).when(F.col("cell.title").isNull() & (F.col("block") == "document_preamble"), F.col("block")).otherwise("paragraph")
    return rows.select(
        "doc_id", "seq", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce(F.when(F.col("several"), F.col("cell.text")), "text").alias("text"), block.alias("block"), "page_no",
        F.when(F.col("several"), F.coalesce("cell.title", "heading_path")).otherwise(F.col("heading_path")).alias("heading_path"), "start_offset", "end_offset", "merged", "context", *carry,
    )


def prebuilt_segments(segments: DataFrame, budget: int | Column, joiner: str = "\n\n") -> DataFrame:
    """Segments as a parser's layout becomes chunks: of documents (parser_type, parser_backend) whose layouts are merged by
    section, chunks are merged, cut at sections, and titles and headings that stand alone join what follows; pdf chunks
    cross pages, those of other types don't. Segments of other documents stay. seq is numbered anew from 0."""
    applies = merges_sections(F.col("parser_backend"), F.col("parser_type"))
    base = _FIELDS
    merged = merge_sections(segments.filter(applies), budget, joiner, ~F.col("parser_type").isin("pdf", "mineru"))
    cut = split_merged_sections(merged, joiner)
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("seq", "part")) - 1
    cut = cut.withColumn("seq", number).select(base)
    joined = merge_orphan_headings(merge_orphan_titles(cut, joiner=joiner).select(base), body=24, joiner=joiner).select(base)
    rest = segments.filter(~applies).withColumn("page_no", F.col("page_no").cast("int")).select(base)
    every = joined.unionByName(rest)
    return every.withColumn("seq", F.row_number().over(W.partitionBy("doc_id").orderBy("seq")) - 1)
