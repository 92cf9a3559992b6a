"""Chunks by section on literal cases: layouts of reports, tables with their headings, statutes."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sections as S

SCHEMA = "doc_id long, seq long, text string, block string, page_no int, heading_path string, start_offset int, end_offset int"
TABLE = "| 场景 | 设备 |\n| --- | --- |\n| 门诊 | 摄像头 |"


def segments(spark, *rows, doc=1):
    """rows: text, block, path, page."""
    cells = [(doc, i, t, b, page, path, 100 * i, 100 * i + len(t)) for i, (t, b, path, page) in enumerate(rows)]
    return spark.createDataFrame(cells, SCHEMA)


def merged(frame, budget=512, pages=False, **kw):
    return S.merge_sections(frame, budget, keep_pages=pages, **kw).orderBy("doc_id", "seq").collect()


def test_noise_joins_text_or_goes(spark):
    path = "研报 / 市场表现"
    chart = segments(spark, ("市场表现", "heading", path, 1), *((t, "paragraph", path, 1) for t in ("-10", "0", "10", "(%) 长电科技 沪深300")))
    assert [r.text for r in merged(chart)] == ["市场表现\n\n-10\n\n0\n\n10\n\n(%) 长电科技 沪深300"]
    assert merged(segments(spark, ("A", "paragraph", "节一", 1), ("B", "paragraph", "节一", 2))) == []
    # noise that waits opens a chunk of its own section
    two = segments(spark, ("7", "paragraph", "节一", 1), ("正文开始", "paragraph", "节一", 1), ("8", "paragraph", "节二", 1))
    assert [r.text for r in merged(two)] == ["7\n\n正文开始"]


def test_sections_cross_pages_unless_kept(spark):
    rows = segments(spark, ("段落一", "paragraph", "节一", 1), ("段落二", "paragraph", "节一", 2))
    assert [(r.text, r.merged, r.page_no, r.start_offset, r.end_offset) for r in merged(rows)] == [("段落一\n\n段落二", 2, 1, 0, 103)]
    assert [r.text for r in merged(rows, pages=True)] == ["段落一", "段落二"]


def test_heading_chain_joins_the_table(spark):
    rows = segments(spark, ("附件2", "heading", "附件2", 15), ("监控终端设备", "heading", "附件2 / 监控终端设备", 15), ("参考", "heading", "附件2 / 监控终端设备 / 参考", 15), (TABLE, "table", "附件2 / 监控终端设备 / 参考", 15))
    (one,) = merged(rows)
    assert one.text == f"附件2\n\n监控终端设备\n\n参考\n\n{TABLE}"
    assert (one.block, one.context, one.seq, one.heading_path) == ("table", 3, 0, "附件2 / 监控终端设备 / 参考")
    shown = rows.withColumn("text", F.when(F.col("seq") == 3, F.concat(F.lit("附件2\n\n监控终端设备\n\n参考\n\n"), "text")).otherwise(F.col("text")))
    (one,) = merged(shown)
    assert (one.text.count("附件2"), one.context, one.seq) == (1, 0, 3)


def test_headings_without_a_table(spark):
    rows = segments(spark, ("附件2", "heading", "附件2", 15), ("监控终端设备", "heading", "附件2 / 监控终端设备", 15), ("正文段落开始。", "paragraph", "附件2 / 监控终端设备", 15))
    assert [r.text for r in merged(rows)] == ["附件2\n\n监控终端设备", "正文段落开始。"]


def test_table_takes_back_short_lines(spark):
    """Lines of other sections that are chunks of their own already; those of another page stay."""
    rows = segments(spark, ("旧页", "paragraph", "甲", 1), ("说明甲", "paragraph", "甲", 2), ("说明乙", "paragraph", "乙", 2), ("长" * 121, "paragraph", "丙", 2), ("表注", "list", "丁", 2), (TABLE, "table", "丁", 2))
    assert [r.text for r in merged(rows, pages=True)] == ["旧页", "说明甲", "说明乙", "长" * 121, "表注", TABLE]
    rows = rows.filter("seq <> 3")
    assert [r.text for r in merged(rows, pages=True)] == ["旧页", f"说明甲\n\n说明乙\n\n{TABLE}"]  # the open list goes with them
    many = segments(spark, *((f"行{k}", "paragraph", f"节{k}", 1) for k in range(9)), ("列", "list", "x", 1), (TABLE, "table", None, 1))
    assert [r.context for r in merged(many)] == [0, 0, 0, 6]


def test_budget_and_long_texts(spark):
    rows = segments(spark, ("甲" * 60, "paragraph", "a", 1), ("乙" * 60, "paragraph", "a", 1), ("丙" * 30, "paragraph", "a", 1), ("丁" * 200, "paragraph", "a", 1), ("戊" * 30, "paragraph", "a", 1), ("一、标题", "heading", "a", 1), ("己" * 30, "paragraph", "a", 1))
    assert [len(r.text) for r in merged(rows, 100)] == [60, 92, 200, 30, 36]
    assert [r.text for r in merged(rows, 79)] == [r.text for r in rows.orderBy("seq").collect()]
    alone = segments(spark, ("报", "paragraph", None, None), doc=7)
    assert [r.text for r in merged(alone)] == ["报"]
    assert merged(rows.limit(0)) == []


def test_pieces_change_no_result(spark):
    """A document that is cut at headings and pages gives what the fold over its rows says, whatever the cuts."""
    rows = segments(spark, *(x for k in range(40) for x in ((f"第{k}章 总则", "heading", f"第{k}章 总则", k // 3), ("短说明", "paragraph", f"第{k}章 总则", k // 3), (TABLE, "table", None, k // 3), ("正文" * 20, "paragraph", f"第{k}章 总则", k // 3))))
    want = [x for k in range(40) for x in (f"第{k}章 总则\n\n短说明\n\n{TABLE}", "正文" * 20)]
    assert [r.text for r in merged(rows)] == want == [r.text for r in merged(rows, pages=True)]
    turned = segments(spark, ("附件", "heading", "甲", 1), ("图", "image", None, 2), ("说明", "paragraph", "甲", 2), ("续页文", "paragraph", "甲", 3))
    assert [r.text for r in merged(turned, pages=True)] == ["附件\n\n图", "说明", "续页文"]


def test_table_takes_back_lines_from_before_a_section(spark):
    """A heading that begins a section is no cut if text that can't introduce the table comes after it, nor is a page to
    which a later one goes back; the open list goes, as in the rule."""
    rows = segments(spark, ("说明甲", "paragraph", "甲", 1), ("第 1 章 总则", "heading", "乙", 1), ("列", "list", "乙", 1), (TABLE, "table", None, 1))
    for pages in (False, True):
        assert [r.text for r in merged(rows, pages=pages)] == [f"说明甲\n\n{TABLE}"]
        # a long text before the heading, or a heading right before the table, leaves nothing to take back
        long = rows.withColumn("text", F.when(F.col("seq") == 0, "长" * 121).otherwise(F.col("text")))
        assert [r.text for r in merged(long, pages=pages)] == ["长" * 121, "第 1 章 总则\n\n列", TABLE]
        assert [r.text for r in merged(rows.filter("seq <> 2"), pages=pages)] == ["说明甲", f"第 1 章 总则\n\n{TABLE}"]
    turned = segments(spark, ("说明甲", "paragraph", "甲", 1), ("列", "list", "乙", 2), (TABLE, "table", None, 1))
    assert [r.text for r in merged(turned, pages=True)] == [f"说明甲\n\n{TABLE}"]


def test_split_merged(spark):
    joined = segments(spark, ("标题行\n一、对象\n甲\n二、材料\n乙\n（一）丙", "paragraph", "x", 1), ("一、表\n| a |\n二、表\n| b |", "table", None, 1), ("第三十三条 种类如下：\n（一）管制；\n（二）拘役；", "paragraph", None, 1), ("只有一节\n一、对象", "paragraph", "y", 1))
    joined = joined.withColumns({"merged": F.lit(2), "context": F.lit(0)})
    cut = S.split_merged_sections(joined).orderBy("seq", "part").collect()
    assert [(r.seq, r.part, r.text) for r in cut[:3]] == [(0, 0, "标题行"), (0, 1, "一、对象\n甲"), (0, 2, "二、材料\n乙\n（一）丙")]
    assert [r.heading_path for r in cut[:2]] == ["x", "一、对象\n甲"]
    assert [r.text.count("\n") for r in cut[3:]] == [3, 2, 1]
    (took,) = S.split_merged_sections(joined.filter("seq = 1").withColumn("context", F.lit(1))).filter("part = 0").collect()
    assert (took.text, took.block) == ("一、表\n| a |", "paragraph")


@pytest.mark.parametrize(("backend", "kind", "want"), [("mineru", "docx", True), ("opendataloader", "docx", False), ("opendataloader", "pdf", True), ("mineru", "csv", False), (None, "pdf", False)])
def test_which_layouts_are_merged(spark, backend, kind, want):
    assert spark.range(1).select(S.merges_sections(F.lit(backend).cast("string"), F.lit(kind)).alias("x")).first().x is want


def test_prebuilt(spark):
    law = "第三章 刑罚 / 第一节 种类"
    rows = segments(spark, ("第三章 刑罚", "heading", "第三章 刑罚", 5), ("第一节 种类", "heading", law, 5), ("第三十二条 刑罚分为主刑和附加刑，附加刑也可以独立适用。", "paragraph", law, 5), ("（一）管制；", "paragraph", law, 5), ("续页的条文。", "paragraph", law, 6))
    for kind, pages in (("pdf", 1), ("docx", 2)):
        found = S.prebuilt_segments(rows.withColumns({"parser_type": F.lit(kind), "parser_backend": F.lit("mineru")}), 512).orderBy("seq").collect()
        assert [r.seq for r in found] == list(range(pages))
        assert found[0].text.startswith("第三章 刑罚\n\n第一节 种类\n\n第三十二条")
    plain = S.prebuilt_segments(rows.withColumns({"parser_type": F.lit("md"), "parser_backend": F.lit(None).cast("string")}), 512)
    assert plain.count() == 5


def test_merging_goes_through_a_document_once(spark):
    """No frame that shrinks towards the end of a document, and each pattern of a text in one place."""
    frame = segments(spark, ("正文", "paragraph", None, 1))
    plan = S.merge_sections(frame, 200)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing$()" not in plan.replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")
    assert plan.count("网站地图") <= 2  # of the text and of its lines
