"""Segment operators on literal cases."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import segments as S

SCHEMA = "doc_id long, seq long, text string, block string, page_no int, heading_path string, start_offset int, end_offset int"


def table(spark, *rows):
    return spark.createDataFrame([(1, i, t, b, 1, h, 10 * i, 10 * i + len(t)) for i, (t, b, h) in enumerate(rows)], SCHEMA)


def texts(frame):
    return [r.text for r in frame.orderBy("doc_id", "seq").collect()]


@pytest.mark.parametrize(
    ("path", "want"), [("新生儿一件事办理指南 / 一、适用对象", "一、适用对象"), ("一、适用对象 / 1、短条目", "一、适用对象"), ("**一、适用对象** / **1、短条目**", "一、适用对象"), ("a / b", "b"), (None, None)]
)
def test_section_key(spark, path, want):
    assert spark.range(1).select(S.section_key(F.lit(path).cast("string")).alias("k")).first().k == want


def test_split_at_sections(spark):
    two = table(spark, ("一、标题\n正文\n二、标题\n正文", None, None))
    assert [r.text for r in S.split_at_sections(two).orderBy("part").collect()] == ["一、标题\n正文", "二、标题\n正文"]
    one = table(spark, ("第三十三条 种类如下：\n\n（一）管制；\n（二）拘役；", None, None))
    assert S.split_at_sections(one).count() == 1


def test_preamble(spark):
    rows = table(spark, ("cover", None, None), ("title", None, None), ("一、body", None, None), ("rest", None, None))
    found = S.merge_preamble(rows)
    assert texts(found) == ["cover\ntitle", "一、body", "rest"]
    assert found.filter("block = 'document_preamble'").count() == 1
    assert texts(S.merge_preamble(table(spark, ("cover", None, None), ("一、body", None, None)))) == ["cover", "一、body"]


def test_orphan_headings(spark):
    rows = table(spark, ("第三章 刑罚", "heading", None), ("第一节 种类", "heading", None), ("body text", None, None), ("第二节", "heading", None), ("t", "table", None), ("end", "heading", None))
    assert texts(S.merge_orphan_headings(rows)) == ["第三章 刑罚\n\n第一节 种类\n\nbody text", "第二节", "t", "end"]


def test_orphan_titles_use_up_pairs(spark):
    rows = table(spark, ("title", None, None), ("一、a", None, None), ("x" * 200, None, None), ("t1", None, None), ("t2", None, None), ("t3", None, None), ("y" * 200, None, None))
    assert texts(S.merge_orphan_titles(rows)) == ["title\n\n一、a", "x" * 200, "t1\n\nt2", "t3\n\n" + "y" * 200]


def test_budget(spark):
    rows = table(spark, ("a" * 30, None, "A"), ("b" * 30, None, "A"), ("c" * 50, None, "A"), ("d" * 10, None, "B"), ("H", "heading", "B"), ("e" * 10, None, "B"), ("f" * 120, None, "B"), ("g" * 5, None, "B"))
    assert texts(S.merge_by_budget(rows, 100)) == ["a" * 30 + "\n\n" + "b" * 30, "c" * 50, "d" * 10, "H\n\n" + "e" * 10, "f" * 120, "g" * 5]


def test_packs_do_not_depend_on_batches(spark):
    """Documents follow one another in a task's batches, whatever their size; no group is handed over as a whole, none is joined."""
    rows = spark.createDataFrame([(d, i, "x" * (5 + (d * 7 + i) % 40), "heading" if i % 9 == 4 else None, i // 6, None, i, i + 1) for d in range(5) for i in range(30)], SCHEMA)
    want = {(r.doc_id, r.seq, r.text, r.merged) for r in S.merge_by_budget(rows, 100).collect()}
    assert len(want) > 30
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        packed = S.merge_by_budget(rows, 100)
        assert {(r.doc_id, r.seq, r.text, r.merged) for r in packed.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and "Join" not in plan


def test_segments_are_joined_in_windows(spark):
    """Texts aren't aggregated, and a long run of headings goes to the one segment that ends it."""
    names = [f"h{i}" for i in range(400)]
    rows = table(spark, *((x, "heading", None) for x in names), ("body text", None, "A"), ("t", "heading", None), ("u", "table", None), ("end", "heading", None))
    found = S.merge_orphan_headings(rows)
    assert texts(found) == ["\n\n".join([*names, "body text"]), "t", "u", "end"]
    first = found.orderBy("seq").first()
    assert (first.seq, first.start_offset, first.end_offset, first.merged, first.block, first.heading_path) == (0, 0, 4009, 401, None, "A")
    for frame in (found, S.merge_preamble(rows), S.merge_orphan_titles(rows), S.merge_by_budget(rows, 100)):
        assert "Aggregate" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_one_place(spark):
    """Two segments of one place are one where nothing else joins them; none is lost or joined twice."""
    pair = spark.createDataFrame([(1, 0, "一、a", None, 1, None, 0, 3), (1, 0, "b", None, 1, None, 0, 1), (1, 1, "c", None, 1, None, 4, 5)], SCHEMA)
    assert texts(S.merge_preamble(pair)) == ["b\n一、a", "c"]
    rows = spark.createDataFrame([(1, i // 3, f"{i:04d}" + "x" * (i % 50), None, 1, None, i, i + 1) for i in range(300)], SCHEMA)
    joined = " ".join(texts(S.merge_by_budget(rows, 100, joiner=" "))).split(" ")
    assert sorted(x[:4] for x in joined) == [f"{i:04d}" for i in range(300)]


def test_lines_are_not_shuffled(spark):
    from conftest import SF
    from lodestone.plans.search import headed_segments

    plan = headed_segments(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("text", ["一、a", " **一、** a", "**　二、**a", "__（三）__", "第 3 章", "　第三章、", "**__ 十、__**", "(一) z", "第　1 节"])
def test_begins_behind_marks(spark, text):
    plain = S.strip_markdown(F.lit(text)).rlike(f"{S.CHAPTER_LINE}|{S.SECTION_LINE}|{S.NUMBERED_LINE}")
    row = spark.range(1).select(S.starts_section(F.lit(text)).alias("a"), plain.alias("b")).first()
    assert row.a == row.b
