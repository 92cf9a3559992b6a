"""How each document is chunked: its settings, its route, and the chunks of all routes.

Segments are doc_id, seq, text, block, page_no, heading_path, start_offset, end_offset, and table_role if there is one. Each
document brings its own settings, so delimiters, sizes and overlaps are columns and one plan serves all documents. Windows
and folds stay inside a document. Null texts are blank, blank ones give nothing; segments without a document, and documents
without segments, give no chunks. A doc_id is that of one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, strip
from . import sections
from .chunking import sliding_chunks
from .segments import ATOMIC, merge_by_budget, merge_orphan_headings, merge_orphan_titles
from .written import written

#: A document of more chunks is told of by plan_outcomes; its chunks are made like those of any other.
MOST_CHUNKS = 3600
#: Documents whose text is short get about this many chunks, none of them meant to be below this size.
LEAST_CHUNKS, LEAST_SIZE = 4, 160
#: What a parser leaves when its segments are chunks already.
SHEET_TYPES, SHEET_ENGINES, LAYOUT_BACKENDS = ("xlsx", "xlsm", "xls"), ("html_table", "tsv"), ("mineru", "opendataloader")
_CONFIG = (
    "mode string, general struct<delimiter:string,max_length:int,overlap:int,collapse_whitespace:boolean>, parent_child struct<parent_mode:string,"
    "parent_delimiter:string,child_delimiter:string,child_max_length:int,child_overlap:int,collapse_whitespace:boolean>"
)
_PIECES = ["doc_id", "route", "place", "part", "text", "start_offset", "size", "overlap", "page_no", "heading_path", "parent_index"]
_CHUNKS = ["doc_id", "route", "place", "part", "content", "start_offset", "end_offset", "page_no", "heading_path", "parent_index"]


def _shown(c: Column) -> Column:
    """A delimiter with its written escapes as the characters that they stand for."""
    for written, meant in (("\\r", "\r"), ("\\n", "\n"), ("\\t", "\t")):
        c = F.replace(c, F.lit(written), F.lit(meant))
    return c


def chunk_settings(documents: DataFrame) -> DataFrame:
    """The settings of each document: doc_id, mode, delimiter, size, overlap, collapse, parent_mode, parent_delimiter.

    documents: doc_id, own (JSON of the document's settings), shared (JSON whose `chunking` holds those of its collection),
    chunk_size, chunk_overlap. The document's own settings replace the shared ones as a whole; what is missing, empty, zero or
    no JSON comes from chunk_size, chunk_overlap and the defaults. In parent_child mode delimiter, size, overlap and collapse
    are those of the children."""
    own = F.from_json("own", _CONFIG)
    shared = F.from_json("shared", f"chunking struct<{_CONFIG.replace('mode string', 'mode:string').replace('general struct', 'general:struct').replace('parent_child struct', 'parent_child:struct')}>")
    object_like = F.coalesce(F.col("own").rlike(r"^\s*\{"), F.lit(False))
    rows = documents.withColumn("c", F.when(object_like, own).otherwise(shared["chunking"]))
    pairs = F.coalesce(F.col("c.mode") == "parent_child", F.lit(False))
    some = lambda c: F.when(c != "", c)
    least = lambda c: F.when(c != 0, c)
    pick = lambda child, general: F.when(pairs, child).otherwise(general)
    return rows.select(
        "doc_id",
        F.when(pairs, "parent_child").otherwise("general").alias("mode"),
        _shown(pick(F.coalesce(some(F.col("c.parent_child.child_delimiter")), F.lit("\n")), F.coalesce(some(F.col("c.general.delimiter")), F.lit("\n\n")))).alias("delimiter"),
        F.coalesce(least(pick(F.col("c.parent_child.child_max_length"), F.col("c.general.max_length"))), F.col("chunk_size")).cast("int").alias("size"),
        F.coalesce(least(pick(F.col("c.parent_child.child_overlap"), F.col("c.general.overlap"))), F.col("chunk_overlap")).cast("int").alias("overlap"),
        F.coalesce(pick(F.col("c.parent_child.collapse_whitespace"), F.col("c.general.collapse_whitespace")), F.lit(True)).alias("collapse"),
        F.when(F.col("c.parent_child.parent_mode") == "full_document", "full_document").otherwise("paragraph").alias("parent_mode"),
        _shown(F.coalesce(some(F.col("c.parent_child.parent_delimiter")), F.lit("\n\n"))).alias("parent_delimiter"),
    )


def chunk_routes(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """The settings of each document and its `route`: prebuilt where a parser's segments are chunks already (a sheet, a table
    cut into rows, a layout that has segments, or tables for three or more and half of its segments), else its mode.

    documents: as for chunk_settings, with parser_type, parser_backend, strategy and excel_engine."""
    no = F.lit(False)
    role = F.count_if(F.col("table_role") == "body") if "table_role" in segments.columns else F.lit(0)
    counts = segments.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("block") == "table").alias("tables"), role.alias("bodies"))
    said = (F.col("strategy") == "table_segments", F.col("excel_engine").isin(*SHEET_ENGINES), F.col("parser_type").isin(*SHEET_TYPES))
    marks = documents.select("doc_id", "parser_type", "parser_backend", (F.coalesce(said[0], no) | F.coalesce(said[1], no) | F.coalesce(said[2], no)).alias("said"))
    rows = chunk_settings(documents).join(marks, "doc_id").join(counts, "doc_id", "left")
    laid_out = F.col("parser_backend").isin(*LAYOUT_BACKENDS) & (F.col("n") > 0)
    many = F.col("tables") >= F.greatest(F.lit(3), F.floor(F.col("n") / 2))
    prebuilt = F.col("said") | F.coalesce(laid_out, no) | F.coalesce(many, no) | F.coalesce(F.col("bodies") > 0, no)
    return rows.withColumn("route", F.when(prebuilt, "prebuilt").otherwise(F.col("mode"))).drop("said", "n", "tables", "bodies")


def _clean(text: Column) -> Column:
    s = F.coalesce(text, F.lit(""))
    return F.when(F.col("collapse"), collapse_whitespace(s)).otherwise(strip(s))


def _cut(rows: DataFrame, text: str, delimiter: str, place: str) -> DataFrame:
    """The stripped parts of a text that aren't blank, with `place` (i of the part) and `at`, where the part begins."""
    parts = F.split(F.col(text), F.concat(F.lit("\\Q"), F.col(delimiter), F.lit("\\E")), F.lit(-1))
    others = [c for c in rows.columns if c != text]
    rows = rows.select(*others, F.posexplode(parts).alias(place, "raw"))
    keys = [c for c in ("doc_id", "seq", "parent_index") if c in others]
    before = W.partitionBy(*keys).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("raw") + F.length(delimiter)).over(before), F.lit(0)).cast("long")
    return rows.withColumn("at", at).withColumn(text, strip(F.col("raw"))).drop("raw").filter(F.col(text) != "")


def _numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    return rows.withColumn(name, (F.row_number().over(W.partitionBy("doc_id").orderBy(*order)) - 1).cast("long"))


def general_pieces(segments: DataFrame) -> DataFrame:
    """The segments (with the settings of their documents) split by delimiter, with `size` and `overlap` made smaller where a
    document is short and holds no table, picture or preamble."""
    rows = segments.withColumn("text", _clean(F.col("text"))).filter("text <> ''")
    rows = _cut(rows, "text", "delimiter", "i")
    rows = rows.withColumn("start_offset", F.coalesce("start_offset", F.lit(0)) + F.col("at")).withColumn("end_offset", F.col("start_offset") + F.length("text"))
    doc = W.partitionBy("doc_id")
    rows = rows.withColumns({"total": F.sum(F.length("text")).over(doc), "atomic": F.max(F.coalesce(F.col("block").isin(*ATOMIC), F.lit(False))).over(doc)})
    target = F.greatest(F.lit(LEAST_SIZE), F.floor(F.col("total") / LEAST_CHUNKS)).cast("int")
    shrinks = ~F.col("atomic") & (F.col("size") > LEAST_SIZE) & (target < F.col("size"))
    less = F.greatest(F.lit(0), F.least(F.floor(F.col("overlap") * (target / F.col("size"))).cast("int"), target - 1))
    rows = rows.withColumn("overlap", F.when(shrinks, less).otherwise(F.col("overlap"))).withColumn("size", F.when(shrinks, target).otherwise(F.col("size")))
    return _numbered(rows, "place", "seq", "i").drop("seq", "i", "at", "total", "atomic").withColumnRenamed("place", "seq")


def _slid(pieces: DataFrame) -> DataFrame:
    """The pieces (_PIECES) cut into overlapping chunks."""
    kept = ["route", "part_of", "page_no", "heading_path", "parent_index"]
    rows = pieces.withColumnsRenamed({"place": "seq", "part": "part_of", "text": "segment"})
    slid = sliding_chunks(rows, F.col("size"), F.col("overlap"), kept)
    order = F.struct("part_of", "part")
    return slid.select("doc_id", "route", F.col("seq").alias("place"), order.alias("part"), "content", "start_offset", "end_offset", "page_no", "heading_path", "parent_index")


def _general(rows: DataFrame) -> DataFrame:
    """What is cut by length (_PIECES): split, packed by budget, cut where sections begin, titles and headings that stand alone
    joined to what follows; tables, pictures and preambles stay whole. The packs are written, as each step after them reads
    their texts several times."""
    kept = ["size", "overlap"]
    merged = written(merge_by_budget(general_pieces(rows), F.col("size"), carry=kept), "packs")
    cut = sections.split_merged_sections(merged.withColumn("context", F.lit(0)), carry=kept)
    fields = [c for c in cut.columns if c not in ("part", "merged", "context")]
    cut = _numbered(cut.withColumnRenamed("seq", "old"), "seq", "old", "part").select(fields)
    joined = merge_orphan_headings(merge_orphan_titles(cut, carry=kept).select(fields), body=24, carry=kept)
    whole = F.coalesce(F.col("block").isin(*ATOMIC), F.lit(False))
    joined = joined.withColumn("size", F.when(whole, F.length("text") + 1).otherwise(F.col("size")))
    return joined.withColumnRenamed("seq", "place").withColumns({"route": F.lit("general"), "part": F.lit(0), "parent_index": F.lit(None).cast("long")}).select(_PIECES)


def _parents(rows: DataFrame) -> DataFrame:
    """doc_id, parent_index, text, page_no, heading_path and the settings: the parts of segments, or whole documents."""
    keep = ["doc_id", "delimiter", "size", "overlap"]
    rows = rows.withColumn("text", _clean(F.col("text"))).filter("text <> ''")
    paragraphs = _cut(rows.filter("parent_mode = 'paragraph'"), "text", "parent_delimiter", "i")
    paragraphs = _numbered(paragraphs, "parent_index", "seq", "i").select(*keep, "parent_index", "text", "page_no", "heading_path")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    whole = rows.filter("parent_mode = 'full_document'").groupBy(*keep).agg(F.array_join(texts, "\n\n").alias("text"))
    nothing = {"parent_index": F.lit(0).cast("long"), "page_no": F.lit(None).cast(rows.schema["page_no"].dataType), "heading_path": F.lit(None).cast("string")}
    return paragraphs.unionByName(whole.withColumns(nothing))


def _parent_child(rows: DataFrame) -> DataFrame:
    """The children of each parent, which are cut by length (_PIECES); their offsets count from the start of the parent."""
    children = _cut(_parents(rows), "text", "delimiter", "i")
    children = _numbered(children.withColumn("start_offset", F.col("at")), "place", "parent_index", "i")
    return children.withColumns({"route": F.lit("parent_child"), "part": F.lit(0)}).select(_PIECES)


def _prebuilt(rows: DataFrame) -> DataFrame:
    """The segments as they are; those of layouts whose sections are merged, merged within the document's size."""
    merged = sections.prebuilt_segments(rows, F.col("size"))
    merged = merged.withColumn("content", strip(F.coalesce(F.col("text"), F.lit("")))).filter("content <> ''")
    part = F.struct(F.lit(0).alias("part_of"), F.lit(0).cast("long").alias("part"))
    return merged.select(
        "doc_id", F.lit("prebuilt").alias("route"), F.col("seq").cast("long").alias("place"), part.alias("part"), "content",
        F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"), "page_no", "heading_path", F.lit(None).cast("long").alias("parent_index"),
    )


def planned_chunks(segments: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, route, chunk_index, content, start_offset, end_offset, page_no, heading_path, parent_index: the chunks of each
    document by its route. Row segments of sheets are taken as they come, however many they are.

    The routes are written, so that a document's settings are read once and not for each of its segments, then the segments
    with them, which every route reads."""
    base = ["doc_id", "seq", "text", "block", "page_no", "heading_path", "start_offset", "end_offset"]
    routes = written(chunk_routes(segments, documents), "routes")
    rows = written(segments.select(*base).withColumn("page_no", F.col("page_no").cast("int")).join(routes, "doc_id"), "routed")
    on = lambda name: rows.filter(F.col("route") == name)
    slid = _slid(_general(on("general")).unionByName(_parent_child(on("parent_child"))))
    every = slid.select(_CHUNKS).unionByName(_prebuilt(on("prebuilt")).withColumn("page_no", F.col("page_no").cast("int")).select(_CHUNKS))
    return _numbered(every, "chunk_index", "place", "part").drop("place", "part")


def plan_outcomes(chunks: DataFrame, documents: DataFrame, most: int = MOST_CHUNKS) -> DataFrame:
    """doc_id, n_chunks, outcome: `empty` without a chunk, `too_many` beyond `most`, else `ready`."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    rows = documents.select("doc_id").join(n, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))
    return rows.withColumn("outcome", F.when(F.col("n_chunks") == 0, "empty").when(F.col("n_chunks") > most, "too_many").otherwise("ready"))


def ready_chunks(chunks: DataFrame, documents: DataFrame, most: int | None = None) -> DataFrame:
    """The chunks of known documents, however many a document has. Only a caller who names `most` leaves out the documents of
    more; their chunks are counted where they are, so that they are made once."""
    if most is not None:
        chunks = chunks.withColumn("__n", F.count("*").over(W.partitionBy("doc_id"))).filter(F.col("__n") <= most).drop("__n")
    return chunks.join(documents.select("doc_id"), "doc_id", "left_semi")


def graph_inserts(chunks: DataFrame, documents: DataFrame, boundary: str, base_size: int, margin: int = 256, most: int = 32_768) -> DataFrame:
    """doc_id, reuses, token_size, text: how a document goes into a graph index.

    chunks: doc_id, chunk_index, content. documents: doc_id, n_chars, index_mode (auto, reuse_parse, native; others are auto),
    least_chars. The chunks are used again if the mode says so or, in auto, if the document has least_chars or more; a document
    without chunks uses none. `text` is then the chunks joined by the boundary, and token_size is raised so that the longest
    chunk fits, at three characters for two tokens and up to `most`; else `text` is null and token_size is base_size."""
    by_index = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])
    longest = F.max(F.when(strip(F.col("content")) != "", F.floor(F.length("content") / 1.5)))
    joined = chunks.filter("content IS NOT NULL").groupBy("doc_id").agg(F.array_join(by_index, boundary).alias("joined"), F.coalesce(longest, F.lit(0)).alias("longest"))
    rows = documents.select("doc_id", "n_chars", "index_mode", "least_chars").join(joined, "doc_id", "left")
    large = F.coalesce(F.col("n_chars") >= F.col("least_chars"), F.lit(False))
    asked = F.when(F.col("index_mode") == "native", False).when(F.col("index_mode") == "reuse_parse", True).otherwise(large)
    rows = rows.withColumn("reuses", asked & F.col("joined").isNotNull())
    needed = F.least(F.lit(most), F.greatest(F.lit(base_size), F.col("longest") + margin))
    return rows.select("doc_id", "reuses", F.when(F.col("reuses"), needed).otherwise(base_size).cast("long").alias("token_size"), F.when(F.col("reuses"), F.col("joined")).alias("text"))
