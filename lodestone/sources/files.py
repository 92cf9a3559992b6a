"""Files to segments: Spark lists and reads the files, each is parsed in a task into ordered segments."""

from __future__ import annotations

import csv
import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (text, heading path, block)
Part = tuple[str, str | None, str | None]
SCHEMA = "path string, seq int, text string, start_offset int, end_offset int, heading_path string, block string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decoded(data: bytes) -> str:
    """Text by the first charset that fits: UTF-8 with or without its mark, GB 18030, Latin-1."""
    for charset in ("utf-8-sig", "gb18030"):
        try:
            return data.decode(charset)
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1")


def plain(data: bytes) -> Iterator[Part]:
    yield decoded(data), None, None


def delimited(data: bytes) -> Iterator[Part]:
    """One part: non-blank rows with stripped cells, tab-joined; the delimiter is found from the first 4096 characters."""
    text = decoded(data)
    try:
        dialect: type[csv.Dialect] | csv.Dialect = csv.Sniffer().sniff(text[:4096])
    except csv.Error:
        dialect = csv.excel
    rows = ([c.strip() for c in row] for row in csv.reader(io.StringIO(text), dialect))
    yield "\n".join("\t".join(row) for row in rows if any(row)), None, "table"


class _Text(HTMLParser):
    """Text outside scripts and styles, with a line for each block."""

    BLOCKS = frozenset("address article aside br div dd dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden = max(0, self.hidden - (tag in ("script", "style")))
        if tag in self.BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def html_lines(text: str) -> list[str]:
    """The non-blank lines of a page's text."""
    parser = _Text()
    parser.feed(text)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.out).split("\n"))
    return [x for x in lines if x]


def html(data: bytes) -> Iterator[Part]:
    for line in html_lines(decoded(data)):
        yield line, None, None


def docx(data: bytes) -> Iterator[Part]:
    """Paragraphs and tables in order, headings by style; text that was deleted under revision is left out."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_WORD}body")
    path: list[tuple[int, str]] = []
    say = lambda node: "".join(t.text or "" for t in node.iter(f"{_WORD}t")).strip()
    for node in body if body is not None else ():
        where = " / ".join(t for _, t in path) or None
        if node.tag == f"{_WORD}tbl":
            rows = [[say(c) for c in r.iter(f"{_WORD}tc")] for r in node.iter(f"{_WORD}tr")]
            yield "\n".join(" | ".join(r) for r in rows), where, "table"
        elif node.tag == f"{_WORD}p" and (text := say(node)):
            style = node.find(f"{_WORD}pPr/{_WORD}pStyle")
            level = re.match(r"(?i)heading\s*(\d)", style.get(f"{_WORD}val", "")) if style is not None else None
            if level:
                path[:] = [x for x in path if x[0] < int(level[1])] + [(int(level[1]), text)]
                where = " / ".join(t for _, t in path)
            yield text, where, "heading" if level else None


def xlsx(data: bytes) -> Iterator[Part]:
    """A part for each sheet: its non-empty rows, tab-joined."""
    book = zipfile.ZipFile(io.BytesIO(data))
    names = {n.replace("\\", "/"): n for n in book.namelist()}  # some writers use the wrong separator
    shared: list[str] = []
    if "xl/sharedStrings.xml" in names:
        for item in ElementTree.fromstring(book.read(names["xl/sharedStrings.xml"])):
            shared.append("".join(t.text or "" for t in item.iter(f"{_SHEET}t")))
    for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
        lines = []
        for row in ElementTree.fromstring(book.read(names[name])).iter(f"{_SHEET}row"):
            cells = []
            for c in row.iter(f"{_SHEET}c"):
                v = c.find(f"{_SHEET}v")
                value = "".join(t.text or "" for t in c.iter(f"{_SHEET}t")) if v is None else v.text or ""
                cells.append(shared[int(value)] if c.get("t") == "s" and value else value)
            if any(x.strip() for x in cells):
                lines.append("\t".join(x.strip() for x in cells))
        if lines:
            yield "\n".join(lines), name.rpartition("/")[2].removesuffix(".xml"), "table"


def pdf_literals(data: bytes) -> Iterator[Part]:
    """The string literals of a PDF's content streams, for files without a better reader."""
    found: list[str] = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        try:
            stream = zlib.decompress(m[1])
        except zlib.error:
            stream = m[1]
        for text in re.findall(rb"\(((?:[^()\\]|\\.)*)\)", stream, re.S):
            found.append(re.sub(rb"\\([()\\])", rb"\1", text).decode("latin-1"))
    yield " ".join(" ".join(found).split()), None, None


#: Parsers by suffix; a file of another suffix is plain text (Markdown is cut by markdown.markdown_sections).
PARSERS: dict[str, Callable[[bytes], Iterator[Part]]] = {"csv": delimited, "html": html, "htm": html, "docx": docx, "xlsx": xlsx, "xlsm": xlsx, "pdf": pdf_literals}


def read_segments(spark: SparkSession, path: str, parsers: dict[str, Callable[[bytes], Iterator[Part]]] = PARSERS) -> DataFrame:
    """path, seq, text, start_offset, end_offset, heading_path, block of every file under `path`; offsets count one
    separator between segments. A file that its parser can't read gives one segment with block 'error'."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                name = batch.column("path")[k].as_py()
                try:
                    found = list(parsers.get(name.rpartition(".")[2].lower(), plain)(batch.column("content")[k].as_py()))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError) as e:
                    found = [(str(e), None, "error")]
                at, rows = 0, []
                for seq, (text, heading, block) in enumerate(x for x in found if x[0]):
                    rows.append({"path": name, "seq": seq, "text": text, "start_offset": at, "end_offset": at + len(text), "heading_path": heading, "block": block})
                    at += len(text) + 1
                if rows:
                    kinds = [("path", pa.string()), ("seq", pa.int32()), ("text", pa.string()), ("start_offset", pa.int32()), ("end_offset", pa.int32()), ("heading_path", pa.string()), ("block", pa.string())]
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, SCHEMA)


def page_segments(pages: DataFrame) -> DataFrame:
    """page_id, seq, text: the lines of each web page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, i, x) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, x in enumerate(html_lines(h or ""))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["page_id", "seq", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, seq long, text string")


def key_values(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and the fields of its value, of JSON files that hold one object of objects each. value: a DDL struct body."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string, struct<{value}>>")).alias("key", "v")).select("key", "v.*")
