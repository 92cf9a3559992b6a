"""Laid-out documents on literal cases."""

from pyspark.sql import functions as F

from lodestone.operators import layout

SCHEMA = "doc_id long, seq long, text string, block string, page_no int, heading_path string"


def segments(spark, *rows):
    return spark.createDataFrame([(d, s, *(list(rest) + [None] * (4 - len(rest)))) for d, s, *rest in rows], SCHEMA)


def rows(frame, *columns):
    return [tuple(r) for r in frame.orderBy("doc_id", "seq").select(*columns).collect()]


def test_context_moves_into_the_table(spark):
    found = layout.with_table_context(segments(
        spark, (1, 0, "正文" * 80, "paragraph", 1), (1, 1, "费用表", "heading", 1, "甲"), (1, 2, " 单位：元 ", None, 1), (1, 3, "| 项 | 价 |", "table", 1),
        (2, 0, "前一页", "paragraph", 1), (2, 1, "本页", "paragraph", 2), (2, 2, "| a |", "table", 2),
        (3, 0, "费用", "heading", 1), (3, 1, "费用 | 10", "table", 1), (4, 0, None, None, None), (4, 1, None, "table", None)))
    assert rows(found, "doc_id", "seq", "text", "n_context", "heading_path") == [
        (1, 0, "正文" * 80, 0, None), (1, 3, "费用表\n\n单位：元\n\n| 项 | 价 |", 2, "甲"), (2, 0, "前一页", 0, None), (2, 2, "本页\n\n| a |", 1, None),
        (3, 1, "费用 | 10", 0, None), (4, 0, "", 0, None), (4, 1, "", 0, None)]


def test_no_more_than_six_rows_of_context(spark):
    found = layout.with_table_context(segments(spark, *((1, i, f"行{i}", "paragraph", 1) for i in range(8)), (1, 8, "| t |", "table", 1)))
    assert rows(found, "seq", "n_context") == [(0, 0), (1, 0), (8, 6)]


def test_pictures_join_go_or_stay(spark):
    long = "以下内容逐条列出如下请仔细核对各项材料后再行提交以免退回"
    found = layout.settled_images(segments(
        spark, (1, 0, "第一步", "paragraph", 1, "甲"), (1, 1, "请选择事项", "image", 1, "甲"), (1, 2, "是/否", "image", 1, "乙"), (1, 3, " ", "image", 1),
        (1, 4, f"见：{long}", "list", 1, "甲"), (1, 5, long, "image", 1, "甲"), (1, 6, "一张风景照片", "image", 1, "甲"), (2, 0, "请点击", "image", 1)))
    assert rows(found, "doc_id", "seq", "text", "role", "n_attached") == [
        (1, 0, "第一步\n\n请选择事项", "step_with_ocr", 1), (1, 2, "是/否", "image_ocr", 0), (1, 4, f"见：{long}", None, 0), (1, 6, "一张风景照片", "image_ocr", 0),
        (2, 0, "请点击", "image_ocr", 0)]


def test_texts_that_say_the_same(spark):
    a = "".join(chr(0x4E00 + i) for i in range(100))
    pairs = [(a, a[:60]), (a, a[:90] + "x" * 5), (a, "x" * 100), ("", a), (a[:50], a[1:52])]
    found = spark.createDataFrame(pairs, "a string, b string").select(layout.says_the_same(F.col("a"), F.col("b")).alias("same")).collect()
    assert [r.same for r in found] == [True, True, False, False, False]


def test_pages_and_markdown(spark):
    broken = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 2, 1), (1, 2, 1, 0), (1, 3, 0, 0)], "doc_id long, seq long, breaks int, leading int")
    assert rows(layout.paged(broken, F.col("breaks"), F.col("leading")), "page_no") == [(1,), (2,), (3,), (4,)]
    found = layout.page_marked(segments(spark, (1, 0, "标题", "heading", 1), (1, 1, "文", None, 1), (1, 2, " ", None, 2), (1, 3, "末", None, 3))).collect()
    assert [r.markdown for r in found] == ["[第1页]\n\n\n\n## 标题\n\n文\n\n\n\n[第3页]\n\n\n\n末\n"]


def test_grids(spark):
    texts = ["| a | b |\n|---|:-:|\n| 1 | |", "no table", "", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(layout.grid(F.col("t")).alias("g")).collect()
    assert [r.g for r in found] == [[["a", "b"], ["1", ""]], [], [], None]


def test_empty_tables(spark):
    none = segments(spark, (1, 0, "x")).filter("false")
    for f in (layout.with_table_context, layout.settled_images, layout.page_marked, layout.as_chunks, layout.indexed, layout.table_like):
        assert f(none).count() == 0
