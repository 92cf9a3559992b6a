"""Layouts of documents: nested JSON of elements, lists of content, tables with spans and headings by class."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, strip, strip_markdown
from ..operators.segments import ITEM_LINE, NUMERAL
from ..operators.written import once, written

#: Height of a page that doesn't tell its own, and most levels of nesting.
PAGE_HEIGHT, DEEPEST = 792.0, 200
#: Levels of nesting that are taken at once.
LEVELS = 4
#: Names of fields, types of page furniture and of pictures, lines that introduce an attachment, and endings
#: and words of lines that aren't titles.
PAGE_FIELDS, BOX_FIELDS = ("page number", "page_number", "pageNumber", "page"), ("bounding box", "bounding_box", "bbox")
LEVEL_FIELDS, TEXT_FIELDS = ("heading level", "heading_level", "level", "text_level"), ("content", "text")
FURNITURE, PICTURES = ("header", "footer", "page_number", "watermark"), ("picture", "image", "figure")
ATTACHMENT = r"(?i)^附件\s*[\d一二三四五六七八九十]*\s*[：:]?\s*$"
SENTENCE, FOOTER = r"[。！？；;]$", r"(?i)(文件下载链接|https?://|\.pdf\s*$|分享到|【打印】|【关闭】|版权所有|ICP备|政府网站)"
CELLS = "array<array<struct<text:string,rows:int,columns:int,head:boolean>>>"


def _field(node: Column, kind: str, *names: str) -> Column:
    """The first of the fields that is there and can be read as the type."""
    return F.coalesce(*(F.try_variant_get(node, f"$['{name}']", kind) for name in names))


def flattened(docs: DataFrame, *shown: Column) -> DataFrame:
    """doc_id, path, type and what is `shown` of the `node` of every element of the documents (doc_id, json), the node itself
    if nothing is named: nodes below `kids`, whose type is known and isn't document, pages too. Each document is an element
    as well, with an empty path and no type. The order of paths is depth-first: a node comes before its kids, and these before
    its next sibling. Text that isn't JSON has no elements.

    The depth isn't known: each round takes LEVELS levels at once, in one row, and writes what is shown of their nodes; a node
    is written whole, with all below it, only if the next round must go on from it."""
    kids = lambda node: F.coalesce(F.try_variant_get(node, "$.kids", "array<variant>"), F.array().cast("array<variant>"))
    below = lambda x: F.transform(kids(x["node"]), lambda node, at: F.struct(F.concat(x["path"], F.array(at)).alias("path"), node.alias("node")))
    kind = F.lower(F.coalesce(F.try_variant_get("node", "$.type", "string"), F.lit("")))
    root = F.struct(F.array().cast("array<int>").alias("path"), F.try_parse_json("json").alias("node"))
    start, found = docs.select("doc_id", F.array(root).alias("level0")), None
    for first in range(0, DEEPEST, LEVELS):
        for k in range(LEVELS):
            start = start.withColumn(f"level{k + 1}", F.flatten(F.transform(f"level{k}", below)))
        mark = lambda k: F.transform(f"level{k}", lambda x: F.struct(x["path"], x["node"], F.lit(k == LEVELS).alias("last")))
        each = start.select("doc_id", F.explode(F.concat(*(mark(k) for k in range(1 if first else 0, LEVELS + 1)))).alias("e")).select("doc_id", "e.path", "e.node", "e.last")
        on = F.when(F.col("last") & (F.size(kids(F.col("node"))) > 0), F.col("node"))
        part = written(each.select("doc_id", "path", F.when(F.size("path") > 0, kind).alias("type"), *(shown or [F.col("node")]), on.alias("on")), "elements")
        found = part if found is None else found.unionByName(part)
        deeper = part.filter("on IS NOT NULL")
        if deeper.isEmpty():
            break
        start = deeper.select("doc_id", F.array(F.struct("path", F.col("on").alias("node"))).alias("level0"))
    return found.drop("on").filter("type IS NULL OR type NOT IN ('', 'document')")


def _listed_type(kind: Column, level: Column) -> Column:
    level = F.coalesce(level, F.lit(1))
    return F.when(kind == "heading", F.when(level <= 1, "title").otherwise("text")).when(kind.isin("list", "caption", "footnote", "table", "equation", "code"), kind).when(kind.isin(*PICTURES), "image").otherwise("text")


def cells_of(node: Column) -> Column:
    """The cells of a table element: text, spans, and whether it is in one of the first two rows."""
    rows = F.try_variant_get(node, "$.rows", "array<variant>")
    inner = lambda cell: F.array_join(F.filter(F.transform(F.coalesce(F.try_variant_get(cell, "$.kids", "array<variant>"), F.array().cast("array<variant>")), lambda k: strip(_field(k, "string", *TEXT_FIELDS))), lambda t: t.isNotNull() & (t != "")), " ")
    own = lambda cell: strip(F.coalesce(_field(cell, "string", *TEXT_FIELDS), F.lit("")))
    one = lambda cell: F.struct(
        collapse_whitespace(F.when(own(cell) != "", own(cell)).otherwise(inner(cell))).alias("text"), F.coalesce(_field(cell, "int", "row span", "rowspan"), F.lit(1)).alias("rows"),
        F.coalesce(_field(cell, "int", "column span", "colspan"), F.lit(1)).alias("columns"), F.coalesce(_field(cell, "int", "row number", "row_number") <= 2, F.lit(False)).alias("head"))
    return F.transform(rows, lambda row: F.transform(F.coalesce(F.try_variant_get(row, "$.cells", "array<variant>"), F.array().cast("array<variant>")), one)).cast(CELLS)


def content_list(docs: DataFrame) -> DataFrame:
    """doc_id, index, type, page_idx, bbox, text_level, text, cells, caption of every element that shows something, in
    order. Boxes [left, bottom, right, top] become [left, top, right, bottom] from the page's upper edge. Headers, footers
    and the like go, but not what is nested in them."""
    node = F.col("node")
    page = _field(node, "double", *PAGE_FIELDS)
    told = F.lower(F.coalesce(F.try_variant_get(node, "$.type", "string"), F.lit("")))
    nodes = flattened(
        docs, F.when(page >= 1, F.floor(page).cast("int")).alias("page"), _field(node, "double", "height", "page height", "page_height").alias("height"), _field(node, "double", "page height", "page_height").alias("tall"),
        _field(node, "array<double>", *BOX_FIELDS).alias("raw"), _field(node, "int", *LEVEL_FIELDS).alias("level"), strip(F.coalesce(_field(node, "string", *TEXT_FIELDS, "code_body"), F.lit(""))).alias("content"),
        collapse_whitespace(_field(node, "string", "description", "alt", "caption", "image_caption", "table_caption")).alias("told"), F.when(told == "table", cells_of(node)).alias("cells"), _field(node, "string", "image path", "image_path", "img_path").alias("img_path"))
    own = nodes.filter("type IS NULL").groupBy("doc_id").agg(F.max(F.when(F.col("tall") > 0, F.col("tall"))).alias("tall"))
    pages = nodes.filter("type = 'page' AND page IS NOT NULL").drop("tall").join(own, "doc_id", "left")
    pages = pages.groupBy("doc_id", "page").agg(F.coalesce(F.max_by("height", F.when(F.col("height") > 0, F.col("path"))), F.max("tall"), F.lit(PAGE_HEIGHT)).alias("high"))
    rows = nodes.filter("type IS NOT NULL").filter(~F.col("type").isin("page", *FURNITURE)).join(pages, ["doc_id", "page"], "left")
    raw = F.col("raw")
    high, b = F.coalesce("high", F.lit(PAGE_HEIGHT)), F.when(F.size(raw) >= 4, raw)
    box = F.when(b.isNotNull(), F.array(b[0], F.least(high - b[3], high - b[1]), b[2], F.greatest(high - b[3], high - b[1])))
    level = F.when(F.col("level") >= 1, F.col("level"))
    kind = _listed_type(F.col("type"), level)
    text, caption = F.col("content"), F.col("told")
    rows = rows.select("doc_id", "path", kind.alias("type"), (F.col("page") - 1).alias("page_idx"), box.alias("bbox"), F.when(F.col("type") == "heading", F.coalesce(level, F.lit(1))).alias("text_level"),
                       F.when(~kind.isin("table", "image") & (text != ""), text).alias("text"), F.when(kind == "table", F.col("cells")).alias("cells"), F.when(kind.isin("table", "image") & (caption != ""), caption).alias("caption"), "img_path")
    shows = F.when(F.col("type") == "table", F.lit(True)).when(F.col("type") == "image", F.col("caption").isNotNull() | F.col("img_path").isNotNull()).otherwise(F.col("text").isNotNull() | F.col("bbox").isNotNull())
    return rows.filter(shows).withColumn("index", F.row_number().over(W.partitionBy("doc_id").orderBy("path")) - 1).drop("path", "img_path")


# --- tables --------------------------------------------------------------------------------------------------------


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def html_cells(html: Column) -> Column:
    """The cells of an HTML table, row by row; rows without text go. Entities of marks are read, tags inside cells go."""
    entities = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

    def plain(c: Column) -> Column:
        untagged = lambda c: F.when(F.contains(c, F.lit("<")), F.regexp_replace(F.regexp_replace(c, r"(?is)<br\s*/?>|</p>|</div>", " "), r"(?s)<[^>]*>", "")).otherwise(c)

        def read(c: Column) -> Column:
            marks = c
            for name, mark in entities:
                marks = F.replace(marks, F.lit(name), F.lit(mark))
            return F.when(F.contains(c, F.lit("&")), marks).otherwise(c)

        return collapse_whitespace(_let(_let(c, untagged), read))

    bare = lambda cell: F.substring(cell, 1, 4).isin("<td>", "<th>")  # noqa: E731  without attributes
    span = lambda cell, name: F.when(bare(cell), 1).otherwise(tagged(cell, name))
    tagged = lambda cell, name: F.greatest(F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(cell, rf"(?is)^<t[dh][^>]*\b{name}\s*=\s*[\"']?(\d{{1,4}})", 1), F.lit("")), F.lit("9999")).cast("int"), F.lit(1)), F.lit(1))
    one = lambda cell: F.struct(plain(F.when(bare(cell), F.substr(cell, F.lit(5))).otherwise(F.regexp_replace(cell, r"(?is)^<t[dh]\b[^>]*>", ""))).alias("text"), span(cell, "rowspan").alias("rows"), span(cell, "colspan").alias("columns"), cell.rlike("(?i)^<th").alias("head"))
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)(?:</tr>|(?=<tr\b)|$)"), F.lit(1))
    cells = F.transform(rows, lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>.*?(?=</t[dh]>|<t[dh]\b|$)"), F.lit(0)), one))
    return F.filter(cells, lambda row: F.exists(row, lambda c: c["text"] != "")).cast(CELLS)


def spanned_grid(cells: Column, repeat: bool = True) -> Column:
    """The table's cells as rows of equal length. A cell stands in the first column that is free: columns that a cell from
    above still spans are passed over. Spanned places repeat the cell's text, or are empty if not `repeat`.

    One fold over the rows: its state holds the rectangles that reach further down."""
    rect = "array<struct<at:int,columns:int,text:string,rows:int>>"
    none = F.array().cast(rect)
    columns = lambda r: F.sequence(r["at"], r["at"] + r["columns"] - 1)

    def row_of(open_: Column, row: Column) -> Column:
        """The rectangles that begin in this row."""

        def placed(taken: Column) -> Column:
            def put(s: Column, c: Column) -> Column:
                new = lambda at: F.struct((at + c["columns"]).alias("x"), F.concat(s["put"], F.array(F.struct(at.alias("at"), c["columns"].alias("columns"), c["text"].alias("text"), c["rows"].alias("rows")))).alias("put"))
                free = F.array_min(F.array_except(F.sequence(s["x"], F.greatest(s["x"], F.array_max(taken) + 1)), taken))
                return _let(F.when(F.array_contains(taken, s["x"]), free).otherwise(s["x"]), new)

            return F.aggregate(row, F.struct(F.lit(0).alias("x"), none.alias("put")), put, lambda s: s["put"])

        return _let(F.flatten(F.transform(open_, columns)), placed)

    def step(s: Column, row: Column) -> Column:
        def after(every: Column) -> Column:
            below = F.filter(F.transform(every, lambda r: F.struct(r["at"], r["columns"], F.when(F.lit(repeat), r["text"]).otherwise("").alias("text"), (r["rows"] - 1).alias("rows"))).cast(rect), lambda r: r["rows"] > 0)
            wide = F.coalesce(F.array_max(F.transform(every, lambda r: r["at"] + r["columns"])), F.lit(0))
            covers = lambda k: F.get(F.filter(every, lambda r: (r["at"] <= k) & (k < r["at"] + r["columns"])), F.lit(0))
            shown = lambda k: _let(covers(k), lambda r: F.when(F.lit(repeat) | (r["at"] == k), r["text"]))
            line = F.when(wide > 0, F.transform(F.sequence(F.lit(0), wide - 1), lambda k: F.coalesce(shown(k), F.lit("")))).otherwise(F.array().cast("array<string>"))
            return F.struct(F.concat(s["grid"], F.array(line)).alias("grid"), below.alias("open"))

        return _let(F.concat(row_of(s["open"], row), s["open"]), after)

    start = F.struct(F.array().cast("array<array<string>>").alias("grid"), none.alias("open"))
    padded = lambda x: F.transform(x["grid"], lambda r: F.concat(r, F.array_repeat(F.lit(""), x["wide"] - F.size(r))))
    sized = lambda g: _let(F.struct(g.alias("grid"), F.coalesce(F.array_max(F.transform(g, F.size)), F.lit(0)).alias("wide")), padded)
    return F.aggregate(cells, start, step, lambda s: _let(s["grid"], sized))


def cells_html(cells: Column) -> Column:
    """The cells as an HTML table that keeps their spans; empty without text."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    span = lambda n, name: F.when(n > 1, F.concat(F.lit(f' {name}="'), n.cast("string"), F.lit('"'))).otherwise("")
    tag = lambda c: F.when(c["head"], "th").otherwise("td")
    one = lambda c: F.concat(F.lit("<"), tag(c), span(c["rows"], "rowspan"), span(c["columns"], "colspan"), F.lit(">"), escaped(c["text"]), F.lit("</"), tag(c), F.lit(">"))
    body = F.array_join(F.transform(cells, lambda row: F.concat(F.lit("<tr>"), F.array_join(F.transform(row, one), ""), F.lit("</tr>"))), "")
    shows = F.exists(cells, lambda row: F.exists(row, lambda c: c["text"] != ""))
    return F.when(F.coalesce(shows, F.lit(False)), F.concat(F.lit("<table>"), body, F.lit("</table>"))).otherwise("")


# --- headings ------------------------------------------------------------------------------------------------------


def heading_class(text: Column, style: Column | None = None) -> Column:
    """1 (chapter), 2 (section) or 3 (item) of a heading by its style, else by how its text begins; null for other texts, as
    for lines that begin with a number and a mark, which are items of lists."""
    t = strip_markdown(strip(F.coalesce(text, F.lit(""))))
    chapter = t.rlike(rf"^第\s*{NUMERAL}\s*[章节篇部].{{0,60}}$") | t.rlike(rf"^{NUMERAL}\s*[、.．].{{0,60}}$") | t.rlike(r"^第\s*\d+\s*[章节篇部条款].{0,60}$")
    section = t.rlike(rf"^[(（]\s*{NUMERAL}\s*[)）].{{0,60}}$")
    fits = (strip(text) != "") & (F.length(strip(text)) <= 60) & ~t.rlike(ITEM_LINE)
    by_text = F.when(fits, F.when(chapter, 1).when(section, 2))
    if style is None:
        return by_text
    level = F.regexp_extract(strip(F.coalesce(style, F.lit(""))), r"(?i)^(?:Heading|标题)\s*(\d{1,9})$", 1)
    return F.coalesce(F.when(level != "", F.least(F.greatest(level.cast("int"), F.lit(1)), F.lit(3))), by_text)


def with_heading_paths(rows: DataFrame, rank: Column, title: Column) -> DataFrame:
    """The rows (doc_id, seq) with heading_path: the titles that a row stands under, its own included.

    A heading ends all before it of its rank or a greater one. So of each rank the last title counts if no heading of a
    smaller rank came after it: windows over the document, no stack."""
    doc = W.partitionBy("doc_id").orderBy("seq")
    last = lambda k: F.last(F.when(rank == k, F.struct(F.col("seq").alias("at"), strip(title).alias("title"))), ignorenulls=True).over(doc)
    rows = rows.withColumns({f"__h{k}": last(k) for k in (1, 2, 3)})
    at = lambda k: F.coalesce(F.col(f"__h{k}.at"), F.lit(-(1 << 62)))
    parts = [F.col("__h1.title"), F.when(at(2) > at(1), F.col("__h2.title")), F.when(at(3) > F.greatest(at(1), at(2)), F.col("__h3.title"))]
    path = F.concat_ws(" / ", *parts)
    return rows.withColumn("heading_path", F.when(F.coalesce(F.col("__h1"), F.col("__h2"), F.col("__h3")).isNotNull(), path)).drop("__h1", "__h2", "__h3")


def looks_like_title(text: Column) -> Column:
    """A short line that doesn't end a sentence, isn't a footer, and doesn't tell an attachment at length."""
    title = lambda t: (t != "") & (F.length(t) <= 80) & ~t.rlike(SENTENCE) & ~t.rlike(FOOTER) & ~(t.rlike("^附件[：:]") & (F.length(t) > 24))
    return _let(collapse_whitespace(F.coalesce(text, F.lit(""))), title)


def layout_segments(items: DataFrame, short: int = 120) -> DataFrame:
    """Segments of a list of content (doc_id, index, type, page_idx, text, text_level, cells, caption): doc_id, seq, text,
    block, rank, heading_path, page_no.

    Titles, texts with a level and short lines that end no sentence are headings: level 1 is a chapter, 2 or none a
    section, others items. A table is its rows as Markdown after the headings and short texts of its page since the last
    table there. A picture is its caption. Headers and footers go, but a header that names an attachment is a heading."""
    text = collapse_whitespace(F.coalesce(F.col("text"), F.lit("")))
    rows = once(items.withColumn("seq", F.col("index")), t=text)
    attachment = (F.col("type") == "header") & F.col("t").rlike(ATTACHMENT)
    rows = rows.filter(~F.col("type").isin("header", "footer", "page_number") | attachment)
    heading = (F.col("type") == "title") | ((F.col("type") == "text") & (F.coalesce("text_level", F.lit(0)) > 0)) | attachment | ((F.col("type") == "text") & looks_like_title(F.col("t")))
    rows = once(rows, block=F.when(heading, "heading").when(F.col("type").isin("text", "list", "equation", "code"), "paragraph").when(F.col("type").isin("table", "image"), F.col("type")))
    rank = F.when(F.col("block") == "heading", F.when(F.col("text_level").isNull() | (F.col("text_level") == 2), 2).when(F.col("text_level") == 1, 1).otherwise(3))
    rows = rows.filter("block IS NOT NULL").withColumn("rank", rank).filter((F.col("t") != "") | F.col("block").isin("table", "image"))
    rows = with_heading_paths(rows, F.col("rank"), strip_markdown(F.col("t")))
    # what introduces a table: lines of its page since the last table, without immediate repeats
    page = W.partitionBy("doc_id", "page_idx").orderBy("seq")
    table = F.col("block") == "table"
    rows = rows.withColumn("run", F.sum(F.when(table, 1).otherwise(0)).over(page) - F.when(table, 1).otherwise(0))
    line = F.when(F.col("page_idx").isNull(), None).when(F.col("block") == "heading", F.col("t")).when((F.col("block") == "paragraph") & (F.length("t") <= short), F.col("t"))
    rows = rows.withColumn("line", F.when(table, F.when(F.col("page_idx").isNotNull(), F.col("caption"))).otherwise(line))
    run = W.partitionBy("doc_id", "page_idx", "run").orderBy("seq")
    fresh = F.col("line").isNotNull() & ~F.col("line").eqNullSafe(F.last("line", ignorenulls=True).over(run.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("fresh", F.when(fresh, F.col("line")))
    before = F.array_join(F.collect_list("fresh").over(run), "\n\n")
    rows = rows.withColumn("before", F.when(table, before))
    rows, grid = once(rows, grid=F.when(table, spanned_grid(F.coalesce("cells", F.array().cast(CELLS))))), F.col("grid")
    bar = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(grid[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.when(F.size(grid) >= 2, F.concat(F.array(bar(grid[0]), rule), F.transform(F.slice(grid, 2, F.size(grid)), bar))).otherwise(F.transform(grid, bar))
    body = F.concat_ws("\n\n", F.nullif("before", F.lit("")), F.nullif(F.array_join(lines, "\n"), F.lit("")))
    shown = F.when(table, body).when(F.col("block") == "image", F.coalesce("caption", F.lit(""))).otherwise(F.col("t"))
    out = once(rows.drop("text"), text=shown).filter("text <> ''")
    return out.select("doc_id", "seq", "text", "block", "rank", "heading_path", (F.col("page_idx") + 1).alias("page_no"))
