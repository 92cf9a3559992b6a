"""The chunk planner on literal documents, and its routes without sections against a plain fold."""

import json
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import chunking, planning as P

SEGMENTS = "doc_id long, seq long, text string, block string, page_no int, heading_path string, start_offset int, end_offset int, table_role string"
DOCUMENTS = "doc_id long, own string, shared string, parser_type string, parser_backend string, excel_engine string, strategy string, chunk_size int, chunk_overlap int"


def segments(spark, docs):
    """docs: of each document the segments as text, or (text, block, page, path, role)."""
    rows = []
    for doc, cells in docs.items():
        for i, cell in enumerate(cells):
            text, *rest = (cell,) if cell is None or isinstance(cell, str) else cell
            block, page, path, role = [*rest, None, None, None, None][:4]
            rows.append((doc, i, text, block, page, path, 1000 * i, 1000 * i + len(text or ""), role))
    return spark.createDataFrame(rows, SEGMENTS)


def documents(spark, *rows):
    """rows: doc_id and what differs from a plain text file with chunks of 100 characters that share 10."""
    plain = dict(own=None, shared=None, parser_type="txt", parser_backend=None, excel_engine=None, strategy=None, chunk_size=100, chunk_overlap=10)
    return spark.createDataFrame([(doc, *({**plain, **more}.values())) for doc, more in rows], DOCUMENTS)


def chunks(spark, docs, *rows):
    found = P.planned_chunks(segments(spark, docs), documents(spark, *rows)).orderBy("doc_id", "chunk_index").collect()
    return {doc: [r for r in found if r.doc_id == doc] for doc in docs}


def test_settings(spark):
    own = json.dumps({"mode": "parent_child", "parent_child": {"parent_mode": "full_document", "child_delimiter": "\\t", "child_max_length": 0, "child_overlap": 7, "collapse_whitespace": False}})
    shared = json.dumps({"chunking": {"general": {"delimiter": "\\r\\n", "max_length": 300, "overlap": 0}}})
    got = P.chunk_settings(documents(spark, (1, {}), (2, {"own": own, "shared": shared}), (3, {"shared": shared}), (4, {"own": "[1]", "shared": shared}), (5, {"own": "{}", "shared": shared}), (6, {"shared": "{broken"})))
    got = {r.doc_id: tuple(r)[1:7] for r in got.collect()}
    plain = ("general", "\n\n", 100, 10, True, "paragraph")
    of_collection = ("general", "\r\n", 300, 10, True, "paragraph")
    assert got == {1: plain, 2: ("parent_child", "\t", 100, 7, False, "full_document"), 3: of_collection, 4: of_collection, 5: plain, 6: plain}


def test_routes(spark):
    docs = {1: ["a"], 2: ["a"], 3: ["a"], 5: [("t", "table")] * 3 + ["a"] * 3, 6: [("t", "table")] * 2 + ["a"], 7: [("a", None, None, None, "body")], 8: ["a"], 9: [("t", "table")] * 3 + ["a"] * 5}
    rows = [(1, {}), (2, {"parser_type": "xls"}), (3, {"parser_backend": "mineru"}), (4, {"parser_backend": "mineru"}), (5, {}), (6, {}), (7, {}), (8, {"excel_engine": "tsv"}), (9, {}), (10, {"strategy": "table_segments"})]
    got = {r.doc_id: r.route for r in P.chunk_routes(segments(spark, docs), documents(spark, *rows)).collect()}
    assert {d for d, r in got.items() if r == "prebuilt"} == {2, 3, 5, 7, 8, 10}
    assert {d for d, r in got.items() if r == "general"} == {1, 4, 6, 9}


def test_general_documents(spark):
    own = json.dumps({"general": {"delimiter": "\\n\\n", "collapse_whitespace": False}})
    table = "| 列 |\n" * 40
    docs = {
        1: ["甲" * 50 + "\n\n \n\n" + "乙" * 30, None, "  ", "丙" * 10],  # packed into one
        2: [("一、范围", "heading", 1), ("正文" * 20, None, 1), ("二、对象", "heading", 1), ("短", None, 1)],  # headings open packs
        3: [(table, "table", 2), ("说明", None, 3)],  # a table is never cut
        4: ["句子结束。" * 60],  # cut after marks, with overlap
        5: [("总则\n一、甲\n甲文\n二、乙\n乙文", None, 1)],  # cut where sections begin
    }
    got = chunks(spark, docs, *((d, {"own": own}) for d in docs))
    assert [r.content for r in got[1]] == ["甲" * 50 + "\n\n" + "乙" * 30 + "\n\n" + "丙" * 10]
    assert [(r.content, r.page_no) for r in got[2]] == [("一、范围\n\n" + "正文" * 20, 1), ("二、对象\n\n短", 1)]
    assert [(r.content, r.page_no, r.start_offset) for r in got[3]] == [(table.strip(), 2, 0), ("说明", 3, 1000)]
    spans = [(a, b) for a, b, _ in chunking.windows_of("句子结束。" * 60, 100, 10)]
    assert [(r.start_offset, r.end_offset) for r in got[4]] == spans and len(spans) > 3
    assert [(r.content, r.heading_path) for r in got[5]] == [("总则\n\n一、甲\n甲文", "一、甲\n甲文"), ("二、乙\n乙文", "二、乙\n乙文")]
    assert all([r.chunk_index for r in rows] == list(range(len(rows))) for rows in got.values())


def test_short_documents_get_smaller_chunks(spark):
    text = "字" * 1200
    pieces = P.general_pieces(segments(spark, {1: [text]}).join(P.chunk_routes(segments(spark, {1: [text]}), documents(spark, (1, {"chunk_size": 800, "chunk_overlap": 100}))), "doc_id"))
    assert [(r["size"], r.overlap) for r in pieces.collect()] == [(300, 37)]
    got = chunks(spark, {1: [text], 2: [(text, "table")]}, (1, {"chunk_size": 800, "chunk_overlap": 100}), (2, {"chunk_size": 800, "chunk_overlap": 100}))
    assert [len(r.content) for r in got[1]] == [300, 300, 300, 300, 148]
    assert [len(r.content) for r in got[2]] == [1200]


def test_parents_and_children(spark):
    own = json.dumps({"mode": "parent_child", "parent_child": {"parent_delimiter": "##", "child_delimiter": "|", "child_max_length": 30, "child_overlap": 5, "collapse_whitespace": False}})
    whole = json.dumps({"mode": "parent_child", "parent_child": {"parent_mode": "full_document", "child_delimiter": "\\n\\n", "collapse_whitespace": False}})
    texts = ["a|b ## | c", None, "x" * 70 + "|d"]
    got = chunks(spark, {1: texts, 2: ["一", "  ", ("二", "table", 3)]}, (1, {"own": own}), (2, {"own": whole}))
    want, parent = [], 0
    for text in texts:
        for raw in (text or "").split("##"):
            if p := raw.strip():
                for m in re.finditer(r"[^|]+", p):
                    if c := m[0].strip():
                        want += [(parent, m.start() + a, m.start() + b, t) for a, b, t in chunking.windows_of(c, 30, 5)]
                parent += 1
    assert [(r.parent_index, r.start_offset, r.end_offset, r.content) for r in got[1]] == want and len(want) == 7
    assert [(r.parent_index, r.content, r.page_no) for r in got[2]] == [(0, "一", None), (0, "二", None)]


def test_prebuilt_documents(spark):
    rows = [("一、范围", "heading", 1, "一、范围"), ("甲" * 40, None, 1, "一、范围"), ("乙" * 40, None, 2, "一、范围"), ("二、对象", "heading", 2, "二、对象"), ("丙" * 40, None, 2, "二、对象")]
    docs = {1: rows, 2: rows, 3: rows, 4: [" 甲 ", None, " "]}
    got = chunks(spark, docs, (1, {"parser_backend": "mineru", "parser_type": "pdf"}), (2, {"parser_backend": "mineru", "parser_type": "html"}), (3, {"parser_backend": "mineru", "parser_type": "pdf", "chunk_size": 60}), (4, {"parser_type": "xlsx"}))
    assert [r.content for r in got[1]] == ["一、范围\n\n" + "甲" * 40 + "\n\n" + "乙" * 40, "二、对象\n\n" + "丙" * 40]
    assert [r.content for r in got[2]] == [t for t, *_ in rows]  # layouts of this type aren't merged
    # nothing is packed below the least budget; a short text joins the one after it, then headings join what follows
    assert [r.content for r in got[3]] == [r.content for r in got[1]]
    assert [(r.content, r.chunk_index, r.start_offset) for r in got[4]] == [("甲", 0, 0)]


def test_outcomes(spark):
    docs = segments(spark, {1: ["a"] * 3, 2: [" ", None], 4: ["a"] * 2})
    sheets = documents(spark, *((d, {"parser_type": "xlsx"}) for d in (1, 2, 3, 4)))
    found = P.planned_chunks(docs, sheets)
    assert {r.doc_id: (r.n_chunks, r.outcome) for r in P.plan_outcomes(found, sheets, 2).collect()} == {1: (3, "too_many"), 2: (0, "empty"), 3: (0, "empty"), 4: (2, "ready")}
    assert {r.doc_id for r in P.ready_chunks(found, sheets, 2).collect()} == {4}


def test_no_rows(spark):
    none = segments(spark, {1: ["a"]}).limit(0)
    assert P.planned_chunks(none, documents(spark, (1, {}))).count() == 0
    assert P.planned_chunks(segments(spark, {1: ["a"]}), documents(spark, (1, {})).filter(F.lit(False))).count() == 0


@pytest.mark.parametrize("budget", [60, 100])
def test_packs_take_the_first_block(spark, budget):
    from lodestone.operators.segments import merge_by_budget

    rows = segments(spark, {1: [("表", "table", 1, "甲 / 一、乙"), ("注", None, 1, "丙 / 一、乙")]})
    got = merge_by_budget(rows, F.lit(budget)).orderBy("seq").collect()
    assert [(r.block, r.heading_path) for r in got] == ([("table", "甲 / 一、乙")] if budget == 100 else [("table", "甲 / 一、乙"), (None, "丙 / 一、乙")])


def test_ready_chunks_are_made_once(spark):
    """Settings are parsed a document at a time, before the segments meet them, and chunks aren't made again to be counted."""
    rows, docs = segments(spark, {1: ["one", "two"], 2: ["three"]}), documents(spark, (1, {}), (2, {}))
    plan = P.ready_chunks(P.planned_chunks(rows, docs), docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan
    assert plan.count("MapInArrow") == 1


def test_ready_chunks_of_known_documents(spark):
    rows, docs = segments(spark, {1: ["one", "two"], 2: ["three"], 3: ["four"]}), documents(spark, (1, {}), (2, {}), (3, {}))
    chunks = P.planned_chunks(rows, docs)
    n = {r.doc_id: r.n_chunks for r in P.plan_outcomes(chunks, docs).collect()}
    ready = P.ready_chunks(chunks, docs.filter("doc_id < 3"), most=1)
    assert sorted(r.doc_id for r in ready.collect()) == [d for d in (1, 2) if n[d] == 1]
    assert ready.columns == chunks.columns


def test_documents_of_many_chunks_are_whole(spark):
    """No cap: a document of more chunks than MOST_CHUNKS keeps all of them, by each route; its outcome tells of it."""
    many = P.MOST_CHUNKS + 5
    pairs = json.dumps({"mode": "parent_child", "parent_child": {"child_delimiter": "|"}})
    rows = segments(spark, {1: ["a"] * many, 2: ["|".join("b" * many)], 3: ["c" * 60 * many]})
    docs = documents(spark, (1, {"parser_type": "xlsx"}), (2, {"own": pairs}), (3, {"chunk_size": 60, "chunk_overlap": 0}))
    chunks = P.planned_chunks(rows, docs)
    got = {r.doc_id: (r.n, r.last, r.size) for r in P.ready_chunks(chunks, docs).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.sum(F.length("content")).alias("size")).collect()}
    assert got == {1: (many, many - 1, many), 2: (many, many - 1, many), 3: (many, many - 1, 60 * many)}
    assert {r.outcome for r in P.plan_outcomes(chunks, docs).collect()} == {"too_many"}
