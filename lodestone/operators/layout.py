"""Pages, tables and images of laid-out documents, on segments (doc_id, seq, text, block, page_no, heading_path).

Whatever looks at neighbours is a window inside a document. Null texts count as empty, null blocks as paragraphs; rows that
share doc_id and seq have no defined order among themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import strip, strip_markdown
from .segments import starts_section

#: What the text in a picture of a form or a menu looks like, and what asks the reader to do something.
FORM = r"(?i)##|<table>|是\s*/\s*否|否\s*/\s*是"
PROMPT = "请选择|请点击|点击.*按钮|下拉框|立即办理|阅读申报须知|申报须知"
TEXT_BLOCKS = ("paragraph", "heading", "list")


def _doc(*by: str) -> W:
    return W.partitionBy("doc_id", *by).orderBy("seq")


def _before() -> W:
    return _doc().rowsBetween(W.unboundedPreceding, -1)


def _text() -> Column:
    return strip(F.coalesce(F.col("text"), F.lit("")))


def paged(rows: DataFrame, breaks: Column, leading: Column) -> DataFrame:
    """page_no from page breaks: all breaks of the rows before, and those of the row itself before its first text."""
    return rows.withColumn("page_no", (1 + F.coalesce(F.sum(breaks).over(_before()), F.lit(0)) + leading).cast("long"))


def indexed(rows: DataFrame) -> DataFrame:
    """block_index, from 0 in each document, and page_no and page_idx; a page that is missing or below 1 is the first."""
    page = F.greatest(F.coalesce(F.col("page_no"), F.lit(1)), F.lit(1)).cast("long")
    numbered = rows.withColumn("block_index", (F.row_number().over(_doc()) - 1).cast("long"))
    return numbered.withColumn("page_no", page).withColumn("page_idx", page - 1)


def as_chunks(rows: DataFrame) -> DataFrame:
    """doc_id, chunk_index, content, page_no, heading_path: one chunk for each segment that isn't blank."""
    kept = rows.filter(_text() != "")
    index = (F.row_number().over(_doc()) - 1).cast("long").alias("chunk_index")
    return kept.select("doc_id", index, _text().alias("content"), "page_no", "heading_path")


def page_marked(rows: DataFrame) -> DataFrame:
    """doc_id, markdown: the segments of each document, headings marked, with a line where a page begins."""
    page = F.greatest(F.coalesce(F.col("page_no"), F.lit(1)), F.lit(1)).cast("int")
    lines = rows.select("doc_id", "seq", page.alias("page"), F.when(F.col("block") == "heading", F.concat(F.lit("## "), _text())).otherwise(_text()).alias("line"))
    lines = lines.filter("line NOT IN ('', '## ')").withColumn("last", F.lag("page").over(_doc()))
    marker = F.concat(F.when(F.col("last").isNull(), "").otherwise("\n\n"), F.lit("[第"), F.col("page").cast("string"), F.lit("页]\n\n\n\n"))
    piece = F.concat(F.when(F.col("last").eqNullSafe(F.col("page")), "").otherwise(marker), "line")
    ordered = F.array_sort(F.collect_list(F.struct("seq", piece.alias("piece"))))
    return lines.groupBy("doc_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x["piece"]), "\n\n"), F.lit("\n")).alias("markdown"))


def table_like(rows: DataFrame) -> DataFrame:
    """doc_id, table_like: whether a document is tables above all: three or more, and half of its segments."""
    tables = F.count_if(F.col("block") == "table")
    return rows.groupBy("doc_id").agg((tables >= F.greatest(F.lit(3), F.floor(F.count("*") / 2))).alias("table_like"))


def with_table_context(rows: DataFrame, most: int = 6, short: int = 120) -> DataFrame:
    """Each table takes the short headings and paragraphs right before it on its page, `most` at most, as context.

    Context goes before the table's text, unless half of it stands in the table already; then it is dropped. Columns:
    doc_id, seq, block, page_no, heading_path, text, n_context. A row that begins a section is no context, nor is a blank one;
    a table without a page takes rows of any."""
    small = F.coalesce(F.col("block"), F.lit("paragraph")).isin("heading", "paragraph") & F.length(_text()).between(1, short)
    marked = rows.withColumn("__context", small & ~starts_section(_text()))
    marked = marked.withColumn("__run", F.coalesce(F.sum(F.when(F.col("__context"), 0).otherwise(1)).over(_before()), F.lit(0)))
    back = W.partitionBy("doc_id", "__run").orderBy(F.desc("seq"))
    end = F.first(F.struct("seq", "block", "page_no")).over(back)
    marked = marked.withColumn("__end", end).withColumn("__back", F.row_number().over(back) - 1)
    elsewhere = F.col("__end.page_no").isNotNull() & ~F.col("__end.page_no").eqNullSafe(F.col("page_no"))
    marked = marked.withColumn("__apart", F.max(elsewhere).over(back))
    taken = F.col("__context") & (F.col("__end.block") == "table") & F.col("__back").between(1, most) & ~F.col("__apart")
    marked = marked.withColumn("__taken", F.coalesce(taken, F.lit(False)))
    marked = marked.withColumn("__to", F.when(F.col("__taken"), F.col("__end.seq")).otherwise(F.col("seq")))
    pieces = F.array_sort(F.collect_list(F.when(F.col("__taken"), F.struct("seq", _text().alias("t")))))
    own = lambda c: F.max(F.when(~F.col("__taken"), c))
    grouped = marked.groupBy("doc_id", F.col("__to").alias("seq")).agg(
        F.transform(pieces, lambda x: x["t"]).alias("context"), own(_text()).alias("own"), own(F.col("block")).alias("block"), own(F.col("page_no")).alias("page_no"),
        F.coalesce(own(F.col("heading_path")), F.min_by("heading_path", "seq")).alias("heading_path"))
    held = F.size(F.filter("context", lambda t: F.contains(F.col("own"), t)))
    many = F.size("context")
    inside = (many > 0) & (held >= F.floor((many + 1) / 2))
    text = F.when(inside, F.col("own")).otherwise(F.array_join(F.concat("context", F.array("own")), "\n\n"))
    return grouped.select("doc_id", "seq", "block", "page_no", "heading_path", text.alias("text"), F.when(inside, 0).otherwise(many).cast("long").alias("n_context"))


def form_noise(c: Column) -> Column:
    """Whether text in a picture comes from a form, a menu or the ticks of an axis."""
    return c.rlike(FORM) | (F.regexp_count(c, F.lit("是|否")) >= 8) | (F.regexp_count(c, F.lit(r"(?m)^-?\d+$")) >= 5)


def asks(c: Column) -> Column:
    """Whether text in a picture is a short prompt that belongs to the step before it."""
    n = F.length(c)
    return ((n <= 120) & c.rlike(f"(?i){PROMPT}")) | ((n > 0) & (n <= 40) & c.rlike("[：:。]$"))


def says_the_same(a: Column, b: Column) -> Column:
    """Whether two texts without white space hold one another, or are of like length (80 or more characters, over 0.6)
    and one in twelve of the shorter's eight-character pieces stands in the longer."""
    first = F.length(a) <= F.length(b)
    less, more = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    n = F.length(less)
    starts = F.when(n >= 80, F.sequence(F.lit(1), n - 7)).otherwise(F.array().cast("array<int>"))
    shared = F.size(F.filter(starts, lambda i: F.contains(more, F.substr(less, i, F.lit(8)))))
    return (n > 0) & (F.contains(more, less) | ((n >= 80) & (n / F.length(more) > 0.6) & (shared >= F.greatest(F.lit(3), F.floor(n / 12)))))


def settled_images(rows: DataFrame, recent: int = 5) -> DataFrame:
    """doc_id, seq, block, text, role, n_attached: what becomes of the texts in pictures.

    A blank one goes. A prompt, or a form's text under the same heading, joins the last text segment before it (role
    'step_with_ocr'). One of 24 characters or more that says the same as a text among the `recent` segments before it goes,
    where joined and blank pictures don't count as segments, and texts stand as they were before anything joined them. Any
    other stays alone (role 'image_ocr')."""
    image = F.coalesce(F.col("block") == "image", F.lit(False))
    is_text = F.coalesce(F.col("block"), F.lit("paragraph")).isin(*TEXT_BLOCKS)
    path = strip(F.coalesce(F.col("heading_path"), F.lit("")))
    flat = F.regexp_replace(strip_markdown(_text()), r"(?U)\s+", "")
    marked = rows.withColumn("__image", image).withColumn("__path", path)
    marked = marked.withColumn("__host", F.last(F.when(is_text, F.struct("seq", "__path")), ignorenulls=True).over(_before()))
    together = (path == "") | (F.col("__host.__path") == "") | (path == F.col("__host.__path"))
    joins = image & (_text() != "") & F.col("__host").isNotNull() & (asks(_text()) | (form_noise(_text()) & together))
    marked = marked.withColumn("__joins", F.coalesce(joins, F.lit(False))).filter(~(F.col("__image") & (_text() == "")))
    stays = marked.filter("NOT __joins").withColumn("__flat", flat)
    near = F.collect_list(F.when(~F.col("__image"), F.col("__flat")).otherwise("")).over(_doc().rowsBetween(-recent, -1))
    said = F.col("__image") & (F.length("__flat") >= 24) & F.exists("__near", lambda t: says_the_same(F.col("__flat"), t))
    stays = stays.withColumn("__near", near).filter(~said)
    more = F.array_sort(F.collect_list(F.struct("seq", _text().alias("t"))))
    joined = marked.filter("__joins").groupBy("doc_id", F.col("__host.seq").alias("seq")).agg(F.transform(more, lambda x: x["t"]).alias("__more"))
    stays = stays.alias("a").join(joined.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.seq") == F.col("b.seq")), "left")
    extra = F.coalesce(F.col("b.__more"), F.array().cast("array<string>"))
    text = F.when(F.size(extra) > 0, F.array_join(F.concat(F.array(_text()), extra), "\n\n")).otherwise(_text())
    role = F.when(F.col("__image"), "image_ocr").when(F.size(extra) > 0, "step_with_ocr")
    return stays.select("a.doc_id", "a.seq", F.col("block"), text.alias("text"), role.alias("role"), F.size(extra).cast("long").alias("n_attached"))


def grid(markdown: Column) -> Column:
    """Rows of cells of a Markdown table; lines outside it and rules go. Null stays null."""
    lines = F.filter(F.transform(F.split(markdown, r"\r\n|\n|\r"), strip), lambda s: s.rlike(r"^\|.*\|$"))
    cells = F.transform(lines, lambda s: F.transform(F.split(F.substr(s, F.lit(2), F.length(s) - 2), r"\|", -1), strip))
    return F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-+:?$") | (c == "")))


def table_segments(rows: DataFrame, by: str, order: str, line: Column, batch: Column, most_chars: int = 12_000, most_rows: int = 100, sampled: int = 48) -> DataFrame:
    """by, part, n, text: each table whole if it is small, else in batches of rows, as many as `batch` says for the number
    of rows (__n) and the mean size of the first `sampled` (__mean). `line` is a row as text."""
    within = W.partitionBy(by).orderBy(order)
    all_rows = W.partitionBy(by)
    lines = rows.select(by, F.col(order).alias("__o"), line.alias("__line"), (F.row_number().over(within) - 1).alias("__i"))
    lines = lines.withColumn("__n", F.count("*").over(all_rows)).withColumn("__chars", F.sum(F.length("__line") + 1).over(all_rows) - 1)
    lines = lines.withColumn("__mean", F.avg(F.when(F.col("__i") < sampled, F.length("__line"))).over(all_rows))
    whole = (F.col("__chars") <= most_chars) & (F.col("__n") <= most_rows)
    lines = lines.withColumn("part", F.when(whole, 0).otherwise(F.floor(F.col("__i") / batch)).cast("long"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("__i", "__line"))), lambda x: x["__line"])
    return lines.groupBy(by, "part").agg(F.count("*").alias("n"), F.array_join(body, "\n").alias("text"))
