"""Segments into chunks: splits as generators, ordered folds inside a document."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapse_whitespace, strip, strip_column

#: Where a chunk may end, the best first.
BREAKS = (("\n\n",), ("\n",), ("。", "！", "？", "!", "?", ". "), ("；", ";"), ("，", ",", "、"), (" ",))


def split_segments(docs: DataFrame, delimiter: str, collapse: bool = False) -> DataFrame:
    """doc_id, seq, start_offset, end_offset, segment: the stripped non-blank parts of each text, with the offset of the part.
    A null or blank text has none; rows that repeat a doc_id are numbered each."""
    text = collapse_whitespace(F.col("text")) if collapse else F.col("text")
    plain = len(delimiter) == 1 and delimiter not in ".$|()[{^?*+\\"  # for which no pattern is compiled and run for each text
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.split(text, delimiter if plain else "\\Q" + delimiter + "\\E", -1).alias("parts"))
    rows = rows.select("doc_id", "row", F.posexplode("parts").alias("i", "raw"))
    by = W.partitionBy("doc_id", "row").orderBy("i")
    before = F.sum(F.length("raw") + len(delimiter)).over(by.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.select("doc_id", "row", "i", F.coalesce(before, F.lit(0)).cast("long").alias("start_offset"), strip_column(F.col("raw")).alias("segment")).filter("segment <> ''")
    seq = F.row_number().over(by) - 1
    return rows.select("doc_id", seq.cast("long").alias("seq"), "start_offset", (F.col("start_offset") + F.length("segment")).alias("end_offset"), "segment")


def parent_children(docs: DataFrame, parent_delimiter: str, child_delimiter: str, preview: int = 400) -> DataFrame:
    """doc_id, parent_index, child_index, parent_preview, segment: children of the parts of each text."""
    parents = split_segments(docs, parent_delimiter).select("doc_id", F.col("seq").alias("parent_index"), "segment")
    rows = parents.select("doc_id", "parent_index", F.substring("segment", 1, preview).alias("parent_preview"), F.posexplode(F.split("segment", "\\Q" + child_delimiter + "\\E", -1)).alias("i", "raw"))
    rows = rows.withColumn("segment", strip(F.col("raw"))).filter("segment <> ''")
    child = F.row_number().over(W.partitionBy("doc_id", "parent_index").orderBy("i")) - 1
    return rows.select("doc_id", "parent_index", child.cast("long").alias("child_index"), "parent_preview", "segment")


class Breaks:
    """The places of all break marks of a text, found once, kind by kind."""

    def __init__(self, text: str):
        self.size = len(text)
        self.places: list[tuple[list[int], list[int]]] = []  # of each kind, where marks begin and end
        for kind in BREAKS:
            found = [(m.start(), m.start() + len(m[1])) for m in re.finditer("(?=(%s))" % "|".join(map(re.escape, kind)), text)]
            self.places.append(([a for a, _ in found], [b for _, b in found]))

    def last(self, least: int, most: int) -> int | None:
        """Where the last mark of the best kind begins that lies within least..most."""
        for begins, ends in self.places:
            at = bisect.bisect_left(begins, most) - 1
            if at >= 0 and ends[at] > most:
                at -= 1  # it reaches beyond; the one before it can't, as marks have two characters at most
            if at >= 0 and begins[at] >= least:
                return begins[at]
        return None


def chunk_spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of overlapping chunks of up to `size` characters; each ends after a mark in its second half, if any."""
    breaks = Breaks(text) if len(text) > size else None
    start = 0
    while True:
        end = start + size
        if breaks is None or end >= len(text):
            yield start, len(text)
            return
        mark = breaks.last(start + max(size // 2, 1), end)
        end = end if mark is None else mark + 1
        yield start, end
        start = max(end - overlap, start + 1)


def windows_of(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """Start, end and stripped content of the overlapping chunks of a text, but for blank ones."""
    for a, b in chunk_spans(text, size, overlap):
        raw = text[a:b]
        if content := raw.strip():
            begin = a + raw.index(content[0])
            yield begin, begin + len(content), content


def sliding_chunks(segments: DataFrame, size: int | Column, overlap: int | Column, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, seq, part, start_offset, end_offset, content and the carried columns: chunks of each segment; the fold stays
    inside a segment. Sizes and overlaps may differ from segment to segment."""

    column = lambda c: c if isinstance(c, Column) else F.lit(c)
    rows = segments.select("doc_id", "seq", "start_offset", F.col("segment"), column(size).cast("int").alias("__size"), column(overlap).cast("int").alias("__overlap"), *carry)
    names = ["doc_id", "seq", "part", "start_offset", "end_offset", "content", *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, part, begin, end, content = [], [], [], [], []
            base, sizes, overlaps = (pc.fill_null(batch.column(c), 0).to_pylist() for c in (2, 4, 5))
            for row, text in enumerate(batch.column(3).to_pylist()):
                for i, (a, b, piece) in enumerate(windows_of(text or "", sizes[row], overlaps[row])):
                    source.append(row)
                    part.append(i)
                    begin.append(base[row] + a)
                    end.append(base[row] + b)
                    content.append(piece)
            at = pa.array(source, pa.int64())
            keys, kept = ([batch.column(c).take(at) for c in some] for some in ((0, 1), range(6, 6 + len(carry))))
            yield pa.RecordBatch.from_arrays([*keys, *(pa.array(x, pa.int64()) for x in (part, begin, end)), pa.array(content, pa.string()), *kept], names)

    kept = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "doc_id long, seq long, part long, start_offset long, end_offset long, content string" + kept)


def adapted_sizes(segments: DataFrame, size: int, overlap: int, least_chunks: int = 4, least: int = 160) -> DataFrame:
    """doc_id, chunk_size, chunk_overlap: smaller for short documents, so that they give a few chunks."""
    total = segments.groupBy("doc_id").agg(F.sum(F.length(strip(F.col("segment")))).alias("total"))
    target = F.greatest(F.lit(least), F.floor(F.col("total") / least_chunks))
    shrink = (F.col("total") < size * least_chunks) & (target < size)
    return total.select(
        "doc_id",
        F.when(shrink, target).otherwise(F.lit(size)).cast("long").alias("chunk_size"),
        F.when(shrink, F.least(F.floor(overlap * target / size), target - 1)).otherwise(F.lit(overlap)).cast("long").alias("chunk_overlap"),
    )


def batched(rows: DataFrame, keys: list[str], order: str, size: int, line: Column, joiner: str = "\n") -> DataFrame:
    """keys, batch, n, body: consecutive rows of each key joined `size` at a time."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1
    numbered = rows.withColumn("__i", place).withColumn("batch", F.floor(F.col("__i") / size).cast("long")).withColumn("__line", line)
    pairs = F.array_sort(F.collect_list(F.struct("__i", "__line")))
    return numbered.groupBy(*keys, "batch").agg(F.count("*").alias("n"), F.array_join(F.transform(pairs, lambda x: x["__line"]), joiner).alias("body"))
