"""Layout JSON, tables with spans, heading classes and the blocks of chunks on literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.operators import focus as B
from lodestone.sources import layouts as L


def tree():
    deep = {"type": "paragraph", "content": "deepest"}
    for _ in range(6):
        deep = {"type": "section", "kids": [deep]}
    page1 = {"type": "page", "page number": 1, "height": 100, "kids": [
        {"type": "heading", "page number": 1, "heading level": 1, "content": "标题", "bounding box": [10, 80, 60, 90]},
        {"type": "footer", "content": "foot", "kids": [{"type": "paragraph", "content": "in the foot"}]},
        {"type": "list", "content": " items ", "kids": [{"type": "paragraph", "content": "one"}, {"type": "paragraph", "text": "two"}]},
        deep, {"type": "paragraph"}, {"type": "picture"}, {"type": "image", "alt": " a  chart "}]}
    cells = [[{"content": "a", "row span": 2, "row number": 1}, {"kids": [{"content": "b"}, {"content": "c"}], "column span": 2, "row number": 1}], [{"content": "d", "row number": 2}, {"content": "e<", "row number": 3}]]
    page2 = {"type": "page", "page number": 2, "kids": [{"type": "table", "page number": 2, "rows": [{"cells": r} for r in cells], "bbox": [1, 2, 3, 4]}, {"type": "code", "content": "x = 1"}]}
    return {"page height": 50, "kids": [page1, page2, "odd", {"kids": [{"type": "paragraph", "content": "untyped parent"}]}]}


@pytest.fixture(scope="module")
def listed(spark):
    docs = spark.createDataFrame([(1, json.dumps(tree())), (2, "not json"), (3, None), (4, "{}"), (5, '{"kids": []}'), (6, '{"kids": [{"type": "text", "content": "only"}]}')], "doc_id long, json string")
    return L.content_list(docs).orderBy("doc_id", "index").collect()


def test_depth_first(listed):
    assert [(r["index"], r.type, r.text or r.caption) for r in listed if r.doc_id == 1] == [
        (0, "title", "标题"), (1, "text", "in the foot"), (2, "list", "items"), (3, "text", "one"), (4, "text", "two"), (5, "text", "deepest"), (6, "image", "a chart"), (7, "table", None), (8, "code", "x = 1"), (9, "text", "untyped parent")]
    assert [r.text for r in listed if r.doc_id == 6] == ["only"]
    assert {r.doc_id for r in listed} == {1, 6}


def test_nodes_are_written_without_what_is_below(spark, monkeypatch):
    """Only a node from which the next round goes on is written whole; the others as the columns that are shown."""
    tables, keep = [], L.written
    monkeypatch.setattr(L, "written", lambda frame, name: tables.append(keep(frame, name)) or tables[-1])
    docs = spark.createDataFrame([(1, json.dumps(tree()))], "doc_id long, json string")
    assert L.content_list(docs).count() == 10
    assert all("node" not in t.columns for t in tables)
    assert [t.filter("on IS NOT NULL").count() for t in tables] == [1, 0]  # eight levels


def test_boxes_and_pages(listed):
    title, table = (next(r for r in listed if r.type == t) for t in ("title", "table"))
    assert (title.page_idx, title.bbox, title.text_level) == (0, [10, 10, 60, 20], 1)
    assert (table.page_idx, table.bbox) == (1, [1, 46, 3, 48])  # the document's own height


def test_cells_with_spans(spark, listed):
    table = next(r for r in listed if r.type == "table")
    frame = spark.createDataFrame([(table.cells,)], f"cells {L.CELLS}")
    got = frame.select(L.spanned_grid(F.col("cells")).alias("g"), L.spanned_grid(F.col("cells"), repeat=False).alias("bare"), L.cells_html(F.col("cells")).alias("h")).first()
    assert got.g == [["a", "b c", "b c"], ["a", "d", "e<"]]
    assert got.bare == [["a", "b c", ""], ["", "d", "e<"]]
    assert got.h == '<table><tr><th rowspan="2">a</th><th colspan="2">b c</th></tr><tr><th>d</th><td>e&lt;</td></tr></table>'


@pytest.mark.parametrize(("html", "grid"), [
    ("<table><tr><th>序号</th><th>对象</th></tr><tr><td>1</td><td>医药&amp;企业</td></tr></table>", [["序号", "对象"], ["1", "医药&企业"]]),
    ("<table><tr><td rowspan=3>A</td><td colspan='2'>B</td></tr><tr><td>c</td><td rowspan=\"2\">d</td></tr><tr><td>e</td><td>f</td></tr></table>", [["A", "B", "B", ""], ["A", "c", "d", ""], ["A", "e", "d", "f"]]),
    ("<TABLE><TR><TD>x<br>y</TD></TR><tr><td></td></tr><tr><td><b>z</b>", [["x y"], ["z"]]),
    ("no table", []),
    ("<table></table>", []),
])
def test_html_grids(spark, html, grid):
    row = spark.createDataFrame([(html,)], "h string").select(L.spanned_grid(L.html_cells(F.col("h"))).alias("g")).first()
    assert row.g == grid


@pytest.mark.parametrize(("text", "style", "rank"), [("第一章 总则", None, 1), ("一、背景", None, 1), ("第3条 范围", None, 1), ("（一）对象", None, 2), ("1.2 说明", None, None), ("1、条目", None, None), ("正文", None, None), ("正文", "Heading 2", 2), ("正文", "标题 5", 3), ("一、" + "长" * 61, None, None), ("", None, None), (None, None, None)])
def test_heading_classes(spark, text, style, rank):
    frame = spark.createDataFrame([(text, style)], "t string, s string")
    assert frame.select(L.heading_class(F.col("t"), F.col("s")).alias("r")).first().r == rank


def test_heading_paths(spark):
    ranks = [3, 2, 3, 1, 3, 2, 3, None, 2, None, 1, None]
    stack, want = [], []
    for i, k in enumerate(ranks):
        if k:
            stack = [x for x in stack if x[0] < k] + [(k, f"t{i}")]
        want.append(" / ".join(t for _, t in stack) or None)
    rows = spark.createDataFrame([(1, i, k, f" t{i} ") for i, k in enumerate(ranks)] + [(2, 0, None, "x")], "doc_id long, seq long, k int, t string")
    got = L.with_heading_paths(rows, F.col("k"), F.col("t")).orderBy("doc_id", "seq").collect()
    assert [r.heading_path for r in got] == [*want, None]


def test_segments_of_a_layout(spark):
    cells = [[("序号", 1, 1, True), ("对象", 1, 1, True)], [("1", 1, 1, False), ("医药企业", 1, 1, False)]]
    items = [("header", "附件 1", None, None, None), ("header", "某某网站", None, None, None), ("text", "重点事项清单", 2, None, None), ("text", "下文列出各项。", None, None, None), ("text", "下文列出各项。", None, None, None), ("table", None, None, cells, "表一"), ("text", "文件下载链接：清单.pdf", None, None, None), ("table", None, None, None, None), ("image", None, None, None, "图一"), ("footer", "第 4 页", None, None, None), ("title", "附录", 1, None, None), ("text", "  ", None, None, None)]
    frame = spark.createDataFrame([(1, i, *x, 4) for i, x in enumerate(items)], f"doc_id long, index long, type string, text string, text_level int, cells {L.CELLS}, caption string, page_idx int")
    got = L.layout_segments(frame).orderBy("seq").collect()
    assert [(r.seq, r.block, r.rank, r.heading_path) for r in got] == [(0, "heading", 2, "附件 1"), (2, "heading", 2, "重点事项清单"), (3, "paragraph", None, "重点事项清单"), (4, "paragraph", None, "重点事项清单"), (5, "table", None, "重点事项清单"), (6, "paragraph", None, "重点事项清单"), (7, "table", None, "重点事项清单"), (8, "image", None, "重点事项清单"), (10, "heading", 1, "附录")]
    assert got[4].text == "附件 1\n\n重点事项清单\n\n下文列出各项。\n\n表一\n\n| 序号 | 对象 |\n| --- | --- |\n| 1 | 医药企业 |"
    assert got[6].text == "文件下载链接：清单.pdf"
    assert {r.page_no for r in got} == {5}


def test_focus(spark):
    blocks = [(1, 10, 0, "第一章 总则规定"), (1, 11, 0, "正文的第一段"), (1, 12, 0, "正文的第二段"), (1, 13, 1, "短"), (1, 14, 1, "别处的一段话在这里"), (1, 15, 1, None), (2, 10, 0, "第一章 总则规定")]
    frame = spark.createDataFrame([(d, i, p, t, [float(i), 0.0, 50.0, 5.0]) for d, i, p, t in blocks], "doc_id long, index long, page_idx int, text string, bbox array<double>")
    far, near = [900.0] * 4, [14.0, 3.0, 50.0, 0.0]
    chunks = [(1, 1, "第一章  总则规定\n正文的第一段 正文的第二段", 1, None, 0), (2, 1, "第一章总则规定正文的第一段正文的第二段", 1, None, 2), (3, 1, "无关的文字", 2, near, 0), (4, 1, "前言。别处的一段话在这里。", 2, far, 0), (5, 1, "前言。别处的一段话在这里。", 1, None, 0), (6, 1, None, None, None, None), (7, 3, "第一章 总则规定", 1, None, 0), (8, 1, "长短", None, [float("nan"), 0.0, 0.0, 0.0], 0)]
    got = B.focus(spark.createDataFrame(chunks, "chunk_id long, doc_id long, content string, page_no int, bbox array<double>, merged int"), frame).orderBy("chunk_id").collect()
    assert [(r.found, r.blocks) for r in got] == [("text", [10, 11, 12]), ("text", [10, 11]), ("place", [14]), ("alike", [14]), (None, []), (None, []), (None, []), ("alike", [13])]


def test_segments_make_a_grid_and_test_a_line_once(spark):
    items = spark.createDataFrame([], f"doc_id long, index long, type string, page_idx int, text string, text_level int, cells {L.CELLS}, caption string")
    plan = L.layout_segments(items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") <= 2  # rows and the cells of a row
    assert plan.count("文件下载链接") == 1
