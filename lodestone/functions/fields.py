"""Fields of records and of messages as column expressions: labels, names, times, counts, and JSON that models wrote."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: File types that can be read, the label of a collection without a name, and how progress shows in a log.
FILE_TYPES = ("txt", "md", "pdf", "doc", "docx", "csv", "xls", "xlsx", "xlsm")
NO_NAME = "未知知识库"
PHASES = (
    ("indexing", ("Milvus 写入完成", "Milvus 插入成功", "正在写入 Milvus", "Milvus 集合就绪")),
    ("embedding", ("向量生成", "正在生成向量", "准备生成向量")),
    ("chunking", ("分块", "CHUNKING")),
    ("parsing", ("解析", "PARSING")),
    ("queued", ("Celery", "队列")),
)
INDEXED, FAILED = ("indexed", "graph_indexed"), ("failed", "graph_failed")
IN_PROGRESS = ("parsing", "chunking", "indexing", "graph_indexing")


def real_delimiter(c: Column) -> Column:
    """A delimiter in which line ends and tabs were written out."""
    for written, meant in (("\\r", "\r"), ("\\n", "\n"), ("\\t", "\t")):
        c = F.replace(c, F.lit(written), F.lit(meant))
    return c


def stored_text(c: Column, most: int | None = None) -> Column:
    """Without NUL, cut to `most` characters; null becomes empty."""
    clean = F.replace(F.coalesce(c, F.lit("")), F.char(F.lit(0)), F.lit(""))
    return clean if most is None else F.substring(clean, 1, most)


def upload_name(c: Column) -> Column:
    """A file's name with slashes one way, stripped and cut; null if nothing is left."""
    name = stored_text(strip(F.replace(c, F.lit("\\"), F.lit("/"))), 255)
    return F.when(name != "", name)


def file_type(c: Column) -> Column:
    """The suffix in lower case, if files of the type can be read; else null."""
    suffix = F.when(F.contains(c, F.lit(".")), F.lower(F.substring_index(c, ".", -1)))
    return F.when(suffix.isin(*FILE_TYPES), suffix)


def iso_time(c: Column) -> Column:
    """A time in ISO form as UTC without a zone; null if it is none."""
    return F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone()).cast("timestamp_ntz")


def extraction_counts(c: Column) -> Column:
    """Number of the chunk, of all chunks, entities and relations of a progress line; null for another line."""
    pattern = r"^Chunk (\d+) of (\d+) extracted (\d+) Ent \+ (\d+) Rel(?:\s+\S+)?$"
    part = lambda k: F.regexp_extract(strip(c), pattern, k).try_cast("long")
    return F.when(strip(c).rlike(pattern), F.struct(*(part(k + 1).alias(n) for k, n in enumerate(("chunk", "chunks", "entities", "relations")))))


def graph_label(c: Column) -> Column:
    """A label to search, without leading asterisks; one asterisk means the whole graph."""
    bare = strip(F.regexp_replace(strip(F.coalesce(c, F.lit("*"))), r"(?U)^(\*\s*)+(?=\S)", ""))
    return F.when(bare == "", "*").otherwise(bare)


def workspace_label(c: Column) -> Column:
    name = strip(F.coalesce(c, F.lit("")))
    return F.replace(F.when(name == "", "base").otherwise(name), F.lit("`"), F.lit("``"))


def plain_fence(c: Column) -> Column:
    """Text without the code fence that a model put around it."""
    return F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def enrichment(c: Column) -> Column:
    """Keywords (12 at most) and questions (5 at most) of a model's JSON answer; none where it can't be read."""
    read = F.from_json(plain_fence(c), "keywords array<string>, questions array<string>")
    kept = lambda name, most: F.slice(F.filter(F.transform(F.coalesce(read[name], F.array().cast("array<string>")), strip), lambda x: x != ""), 1, most)
    return F.struct(kept("keywords", 12).alias("keywords"), kept("questions", 5).alias("questions"))


def clamped(c: Column, low: int, high: int, default: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(c, F.lit(default))))


def collection_type(source: Column) -> Column:
    """Whether a result came from a graph or a classic collection."""
    return F.when(source == "lightrag", "lightrag").otherwise("classic")


def image_keywords(caption: Column, heading: Column, content: Column, size: int = 120) -> Column:
    """What an image's chunk is found by: its caption, its heading and the beginning of its text."""
    body = strip(F.coalesce(content, F.lit("")))
    summary = F.when(F.length(body) > size, F.concat(F.substring(body, 1, size), F.lit("…"))).otherwise(body)
    return F.array_join(F.filter(F.array(*(strip(F.coalesce(x, F.lit(""))) for x in (caption, heading)), summary), lambda x: x != ""), "\n")


def markdown_table(grid: Column) -> Column:
    """Rows of cells as a Markdown table: blank rows go, short rows are filled up, a rule follows the first row."""
    let = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  body(value), computed once
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")  # noqa: E731  as strip; the pattern is what the test counts

    def lines(t: Column) -> Column:
        rows, width = t["rows"], t["width"]
        full = lambda r: line(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
        rule = F.when(F.size(rows) >= 2, F.array(line(F.array_repeat(F.lit("---"), width)))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.transform(F.slice(rows, 1, 1), full), rule, F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), full))

    sized = lambda rows: let(F.struct(rows.alias("rows"), F.array_max(F.transform(rows, F.size)).alias("width")), lambda t: F.array_join(lines(t), "\n"))
    rows = F.filter(F.transform(grid, lambda r: F.transform(r, bare)), lambda r: F.exists(r, lambda c: c != ""))
    return let(rows, lambda x: F.when(F.size(x) > 0, sized(x)).otherwise(""))


def table_batch(rows: Column, mean_size: Column, most_chars: int = 6500, most_rows: int = 10, most_segments: int = 3200) -> Column:
    """How many rows of a table go into a segment, by their mean size; more where there would be too many segments."""
    by_size = F.least(F.greatest(F.lit(1), F.floor(most_chars / F.greatest(mean_size, F.lit(80)))), F.lit(most_rows))
    return F.when(rows <= 1, 1).when(rows > most_segments, F.greatest(by_size, F.ceil(rows / most_segments))).otherwise(by_size).cast("long")


def process_mode(status: Column, force: Column, graph: Column) -> Column:
    """Whether a document is parsed or indexed anew, and whether by force; null if its status takes part in neither."""
    active = status.isin(*IN_PROGRESS)
    again = status.isin(*INDEXED) | (graph & (status == "graph_indexing"))
    takes_part = active | status.isin("uploaded", *FAILED, *INDEXED)
    return F.when(takes_part, F.struct(F.when(again, "reindex").otherwise("parse").alias("mode"), (force | active).alias("force")))


def inferred_outcome(status: Column) -> Column:
    """How a run ended, from the status of its document (null: it is gone); null while it goes on."""
    return F.when(status.isNull() | status.isin(*FAILED, "deleted"), "failed").when(status.isin(*INDEXED), "success").when(status == "uploaded", "cancelled")


def progress_phase(recent: Column) -> Column:
    """The phase that the last lines of a log speak of."""
    found = None
    for phase, words in PHASES:
        held = recent.rlike("|".join(words)) if phase != "chunking" else recent.rlike("|".join(words)) | F.lower(recent).contains("chunk")
        found = F.when(held, phase) if found is None else found.when(held, phase)
    return found


def uses_parsed_chunks(size: Column, chunks: Column, mode: Column, least: int = 150_000) -> Column:
    """Whether a graph is built from the parser's chunks rather than from its own."""
    return (mode != "native") & (chunks > 0) & ((mode == "reuse_parse") | (size >= least))
