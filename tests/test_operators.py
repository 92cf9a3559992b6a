"""Operators on literal cases, among them those that the tables don't hold."""

import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import chunking, fusion, graph, merging, retrieval
from lodestone.sources import files
from lodestone.streaming import usage


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"), [("依据[1]与[2]说明", [1, 2]), ("重复[1]再[1]", [1]), ("全角［3］", [3]), ("根据片段 ① ② 说明", [1, 2]), ("无引文", [])]
)
def test_cited_references(spark, text, want):
    assert one(spark, T.cited_references(F.lit(text))) == want


@pytest.mark.parametrize(("seconds", "want"), [(None, "—"), (0.4, "不足 1 秒"), (65.0, "1 分 5 秒"), (3661.0, "1 小时 1 分 1 秒")])
def test_duration_label(spark, seconds, want):
    assert one(spark, T.duration_label(F.lit(seconds).cast("double"))) == want


@pytest.mark.parametrize(("text", "noise"), [("报", True), ("10", True), ("-10", True), ("a.b@mail.example.com", True), ("投资要点", False), ("", True)])
def test_layout_noise(spark, text, noise):
    assert one(spark, T.layout_noise(F.lit(text))) == noise


def test_retrievable(spark):
    assert not one(spark, T.retrievable(F.lit("0\n10\n20\n30")))
    assert one(spark, T.retrievable(F.lit("投资要点\n0\n10")))


def test_identifiers_and_weights(spark):
    assert one(spark, T.dominant_identifier(F.lit("YZ0000000QR13010003"))) == "YZ0000000QR13010003"
    assert one(spark, T.dominant_identifier(F.lit("新生儿医保"))) is None
    assert [one(spark, T.anchor_weight(F.lit(t))) for t in ("新生儿医保", "医保参保", "新生儿", "医保", "abc", "abcdef1")] == [3.0, 2.5, 2.0, 1.5, 1.2, 4.0]


def test_markdown_and_space(spark):
    assert one(spark, T.strip_markdown(F.lit("**一、适用对象**　__x__"))) == "一、适用对象 x"
    assert one(spark, T.collapse_whitespace(F.lit("  a b \n\n c　"))) == "a b c"
    assert one(spark, T.expand_colloquial(F.lit(" 被动防御判刑 "))) == "正当防卫判刑"
    assert one(spark, T.keyword_text(F.lit("c"), F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"))) == "c\n关键词：a；b"
    assert one(spark, T.table_row(F.array(F.lit("1"), F.lit("")), F.array(F.lit("h"), F.lit("k")))) == "h：1"


def test_normalised_scores(spark):
    from pyspark.sql import Window as W

    rows = spark.createDataFrame([(1, 5.45), (1, 5.0), (1, 4.0), (2, 1.0), (2, 1.0), (3, 5.0), (3, 5.0), (4, 0.0)], "q int, s double")
    by = W.partitionBy("q")
    found = rows.select("q", "s", fusion.min_max(F.col("s"), by, 3.0).alias("m"), fusion.relative(F.col("s"), by, 3.0).alias("r")).collect()
    got = sorted((x.q, x.s, round(x.m, 6), round(x.r, 6)) for x in found)
    assert got == [(1, 4.0, 0.0, round(4 / 5.45, 6)), (1, 5.0, round(1 / 1.45, 6), round(5 / 5.45, 6)), (1, 5.45, 1.0, 1.0), (2, 1.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 5.0, 1.0, 1.0), (3, 5.0, 1.0, 1.0), (4, 0.0, 0.0, 0.0)]


def test_vector_gate_twice(spark):
    rows = [(1, "vector", i, i, 0.9, False) for i in range(1, 21)] + [(1, "keyword", i, i, 5.0, False) for i in range(1, 21)]
    found = fusion.hybrid(spark.createDataFrame(rows, "query_id long, channel string, uid long, ord long, score double, ident_hit boolean"))
    assert sorted(r.uid for r in found.filter("vector_score IS NOT NULL").collect()) == [1, 2, 3]
    assert found.count() == 20


def test_vector_fallback(spark):
    rows = [(1, "vector", 1, 1, 0.44, False), (2, "vector", 1, 1, 0.45, False)]
    found = fusion.hybrid(spark.createDataFrame(rows, "query_id long, channel string, uid long, ord long, score double, ident_hit boolean"))
    assert [r.query_id for r in found.collect()] == [2]


def test_rrf_prefers_both(spark):
    rows = [(1, "keyword", 1, 1, 5.0, False), (1, "keyword", 2, 2, 4.9, False), (1, "vector", 1, 1, 0.9, False)]
    found = fusion.hybrid(spark.createDataFrame(rows, "query_id long, channel string, uid long, ord long, score double, ident_hit boolean"), method="rrf")
    score = {r.uid: r.score for r in found.collect()}
    assert score[1] == 1.0 > score[2] > 0


def test_fair_merge_keeps_each_collection(spark):
    rows = [(1, 2, i, 0.99 - i / 100) for i in range(5)] + [(1, 1, 10 + i, 0.45 - i / 100) for i in range(5)]
    found = fusion.fair_merge(spark.createDataFrame(rows, "query_id int, kb_id int, uid int, score double"), 5).collect()
    assert len(found) == 5
    assert {r.kb_id for r in found} == {1, 2}


def test_graph_counts(spark):
    nodes = spark.createDataFrame([("a", "T", "x"), ("b", "T", "y"), ("c", "T", "z")], "entity_id string, entity_type string, description string")
    edges = spark.createDataFrame([("a", "a", "DIRECTED"), ("a", "b", "DIRECTED"), ("b", "a", "DIRECTED"), ("b", "c", "OTHER")], "src string, dst string, rel_type string")
    assert tuple(graph.totals(nodes, edges).first()) == (3, 3)
    assert {r.entity_id: r.degree for r in graph.degrees(nodes, edges).collect()} == {"a": 3, "b": 3, "c": 1}
    assert [tuple(r) for r in graph.induced_edges(edges, nodes).collect()] == [("a", "b")]
    assert [(r.entity_id, r.hop) for r in graph.ego(nodes, edges, "a", 2, 9).collect()] == [("a", 0), ("b", 1), ("c", 2)]
    assert graph.find_center(nodes, edges, "Y").first().entity_id == "b"
    assert "<node id=\"a\"/>" in graph.graphml(nodes, edges).first().graphml


def test_chunk_ends():
    text = "x" * 70 + "。" + "x" * 29
    assert list(chunking.chunk_spans(text, 80, 10))[0] == (0, 71)
    assert list(chunking.windows_of("ab", 1, 5)) == [(0, 1, "a"), (1, 2, "b")]
    assert list(chunking.windows_of("  \n ", 4, 1)) == []


def test_adapted_sizes(spark):
    rows = spark.createDataFrame([(1, "x" * 1000), (2, "x" * 100), (3, "x" * 5000)], "doc_id long, segment string")
    assert {tuple(r) for r in chunking.adapted_sizes(rows, 512, 50).collect()} == {(1, 250, 24), (2, 160, 15), (3, 512, 50)}


def test_keyword_search_ties_and_nulls(spark):
    chunks = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None), (4, "")], "chunk_id long, text string")
    queries = spark.createDataFrame([(7, "alpha zz"), (8, None), (9, "")], "query_id long, text string")
    assert [tuple(r) for r in retrieval.keyword_search(chunks, queries, 1).collect()] == [(7, 1, 1.2, 1)]


def test_keyword_search_in_several_passes(spark, monkeypatch):
    """More queries than a block, repeated and null ids; the same result as in one pass."""
    chunks = spark.createDataFrame([(i, f"alpha{i % 7} beta{i % 3} 新生儿医保 {i}") for i in range(60)] + [(None, "alpha1")], "chunk_id long, text string")
    queries = spark.createDataFrame([(i, f"alpha{i % 7} 新生儿") for i in range(40)] + [(3, "beta2"), (None, "alpha1")], "query_id long, text string")
    whole = sorted(map(tuple, retrieval.keyword_search(chunks, queries, 4).collect()))
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 9)
    assert sorted(map(tuple, retrieval.keyword_search(chunks, queries, 4).collect())) == whole
    assert len(whole) == 160
    assert retrieval.keyword_search(chunks, queries.limit(0), 4).count() == 0


def test_keyword_search_bounds_the_pairs_it_scores_at_once(spark, monkeypatch):
    """Long texts of frequent words meet all terms of all queries: fewer of them are scored together, with the same hits."""
    queries = spark.createDataFrame([(i, f"alpha beta gamma term{i}") for i in range(6)], "query_id long, text string")
    chunks = spark.createDataFrame([(i, f"alpha beta gamma term{i % 4}") for i in range(40)], "chunk_id long, text string")
    rows = retrieval.query_needles(queries).toArrow()
    needles = retrieval._Needles(np.arange(6), rows)
    texts = pa.array([r.text for r in chunks.collect()])
    whole = list(needles.groups(needles.automaton(), texts))
    monkeypatch.setattr(retrieval, "PAIRS", 100)
    few = list(needles.groups(needles.automaton(), texts))
    cost = needles.terms[1] + needles.must[1]
    assert len(whole) == 1 and len(few) > 1
    assert all(sum(cost[x].sum() for x in group) <= 100 for _, group in few)
    assert [at for at, _ in few] == [sum(len(g) for _, g in few[:i]) for i in range(len(few))]
    assert [x.tolist() for _, group in few for x in group] == [x.tolist() for x in whole[0][1]]


def test_keyword_search_scores_layers(spark):
    from lodestone.functions import terms

    passages = ["城乡居民参保登记（新生儿）需在出生后办理医保参保手续。", "医保基金结算政策", "事项编号：YZ0000000QR13010003", "新生儿落户", "杀人者处有期徒刑"]
    questions = ["新生儿医保如何办理", "YZ0000000QR13010003", "落户怎么办", "杀了人判刑吗", ""]
    chunks = spark.createDataFrame(list(enumerate(passages)), "chunk_id long, text string")
    queries = spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r.score for r in retrieval.keyword_search(chunks, queries, 9).collect()}
    both = chunks.withColumnRenamed("text", "passage").crossJoin(queries)
    plain = both.select("query_id", "chunk_id", terms.layered_score(F.col("passage"), terms.term_layers(F.col("text"))).alias("s")).collect()
    assert got == {(r.query_id, r.chunk_id): round(r.s, 9) for r in plain if r.s > 0}
    assert got[0, 0] >= 3.0
    assert (0, 1) not in got
    assert got[1, 2] >= 4.0


def test_term_layers(spark):
    from lodestone.functions import terms

    layers = one(spark, terms.term_layers(F.lit("新生儿医保如何办理")))
    assert {"新生儿医保", "新生儿", "医保"} <= set(layers.anchors)
    assert not {"如何", "办理"} & set(layers.anchors)
    assert layers.required == ["新生儿医保"]
    layers = one(spark, terms.term_layers(F.lit("落户怎么办")))
    assert layers.anchors == layers.required == ["落户"] or "落户" in layers.anchors
    assert one(spark, terms.fallback_terms(F.lit("医"))) == ["医"]
    assert one(spark, terms.flat_score(F.lit("医保 abc"), F.array(F.lit("医保"), F.lit("abc"), F.lit("正当")))) == 2.7


def test_vector_search_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [0.0, 3.0]), (8, [1.0]), (None, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in retrieval.vector_search(table, F.col("vec_id") % 2 == 0, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1), (0, 7)]


def test_markdown_sections(spark):
    from lodestone.sources.markdown import markdown_sections

    texts = ["intro\n# A\nx\n## B\ny\n# C\nz\n", "### deep\n  ## less\n###### six\n# top", "", None, "#no heading\nplain"]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [tuple(r) for r in markdown_sections(table).orderBy("doc_id", "seq").collect()]
    assert got == [
        (0, 0, "intro", 0, 5, None),
        (0, 1, "# A\nx", 7, 12, "A"),
        (0, 2, "## B\ny", 14, 20, "A / B"),
        (0, 3, "# C\nz", 22, 27, "C"),
        (1, 0, "### deep", 0, 8, "deep"),
        (1, 1, "## less", 10, 17, "deep / less"),
        (1, 2, "###### six", 19, 29, "deep / less / six"),
        (1, 3, "# top", 31, 36, "top"),
        (4, 0, "#no heading\nplain", 0, 17, None),
    ]


def test_files(spark, tmp_path):
    (tmp_path / "b.txt").write_bytes("中文".encode("gb18030"))
    (tmp_path / "c.csv").write_text("a;b\n; \n1; 2\n")
    (tmp_path / "d.html").write_text("<p>one<script>no</script></p><p>two</p>")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "f.xlsx", "w") as z:
        s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/sharedStrings.xml", f"<sst {s}><si><t>k</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>')
    (tmp_path / "g.docx").write_bytes(b"broken")
    found = {}
    for r in files.read_segments(spark, str(tmp_path)).orderBy("path", "seq").collect():
        found.setdefault(r.path[-4:], []).append((r.text, r.heading_path, r.block))
    assert found[".txt"][0][0] == "中文"
    assert found[".csv"][0][0] == "a\tb\n1\t2"
    assert [x[0] for x in found["html"]] == ["one", "two"]
    assert found["docx"][:2] == [("T", "T", "heading"), ("body", "T", None)]
    assert found["docx"][2][2] == "error"
    assert found["xlsx"][0][0] == "k\t5"


def test_key_values(spark, tmp_path):
    (tmp_path / "kv.json").write_text('{"a": {"n": 1, "s": "x"}, "b": {"n": 2}}')
    assert sorted(map(tuple, files.key_values(spark, str(tmp_path), "n int, s string").collect())) == [("a", 1, "x"), ("b", 2, None)]


def test_sliding_log(spark):
    log = usage.SlidingLog(3, 60.0)
    assert [log(t) for t in (0, 1, 2, 3, 60.5)] == [True, True, True, False, True]
    calls = spark.createDataFrame([("a", float(t)) for t in (0, 1, 2, 3)] + [("b", 5.0)] + [("a", 60.5)], "key string, ts double")
    got = sorted((r.key, r.ts, r.accepted) for r in usage.rate_limited(calls, 3).collect())
    assert got == [("a", 0.0, True), ("a", 1.0, True), ("a", 2.0, True), ("a", 3.0, False), ("a", 60.5, True), ("b", 5.0, True)]


def test_stream_equals_batch(spark, tmp_path):
    from conftest import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = usage.windowed_usage(stream).writeStream.outputMode("complete").format("memory").queryName("usage_windows").start()
    q.processAllAvailable()
    q.stop()
    key = lambda r: (str(r.start), r.event_type, r.n, round(r.total, 6))
    assert sorted(map(key, spark.table("usage_windows").collect())) == sorted(map(key, usage.windowed_usage(events).collect()))


def test_overlap(spark):
    text = "".join(chr(0x4E00 + i) for i in range(100))
    cases = [(text, text[:72]), (text, text[:71]), ("a b", "ab"), ("", "x"), (None, None), (text[:50] + "q", text[:50] + "r"), (text + text[:20] + "q" * 10, text + text[:20] + "r" * 10)]
    both = [merging.bare(F.lit(x).cast("string")) for pair in cases for x in pair]
    got = spark.range(1).select(*(merging.overlap(a, b).alias(f"x{i}") for i, (a, b) in enumerate(zip(both[::2], both[1::2], strict=True)))).first()
    assert list(got) == [0.72, 0.71, 1.0, 0.0, 0.0, 0.0, 120 / 130]


HITS = "query_id long, kb_id int, kb_type string, uid long, score double, document_id long, content string, is_image boolean, ord int"


def test_dedupe_prefers_body_text(spark):
    rows = [(1, 1, "classic", 1, 0.9, 5, "same words", True, 1), (1, 1, "classic", 2, 0.8, 5, "same words", False, 2), (1, 1, "classic", 3, 0.7, 6, "same words", False, 3), (2, 1, "classic", 4, 0.7, 6, None, False, 1)]
    found = merging.dedupe(spark.createDataFrame(rows, HITS), 5).collect()
    assert sorted(r.uid for r in found) == [2, 3, 4]


def test_dedupe_in_waves(spark, monkeypatch):
    """More rows of a query than the fold takes at once give what one fold gives."""
    import random

    r = random.Random(6)
    words = ["alpha beta gamma delta", "alpha beta gamma delta epsilon", "other words here", "quite another text", "last one of them"]
    rows = [(q, 1, "classic", 100 * (q or 0) + i, 0.5, r.randrange(3), r.choice(words) + r.choice(["", " x", " yz"]), r.random() < 0.3, i) for q in (1, 2, None) for i in range(40)]
    frame = spark.createDataFrame(rows, HITS)
    whole = sorted((str(x.query_id), x.uid) for x in merging.dedupe(frame, 12).collect())
    monkeypatch.setattr(merging, "WAVE", 3)
    assert sorted((str(x.query_id), x.uid) for x in merging.dedupe(frame, 12).collect()) == whole


def test_merge_reserves_collections_and_types(spark):
    rows = [(1, 2, "graph", i, 0.99 - i / 100, i, f"g{i}", False, i) for i in range(5)] + [(1, 1, "classic", 10 + i, 0.45 - i / 100, 10 + i, f"c{i}", False, i) for i in range(5)]
    found = merging.merge_collections(spark.createDataFrame(rows, HITS), 5).collect()
    assert len(found) == 5
    assert {r.kb_id for r in found} == {1, 2}


def test_search_terms(spark):
    from lodestone.functions import search as S

    assert one(spark, S.expanded_terms(S.search_terms(F.lit("新生儿医保如何 abc x")))) == ["新生", "生儿", "儿医", "医保", "保如", "如何", "abc"]
    assert one(spark, S.search_terms(F.lit(" ? "))) == ["?"]
    assert [one(spark, S.least_matches(F.array(*map(F.lit, "abcdefghijklmnop"[:n])))) for n in (1, 2, 3, 12, 16)] == [1, 1, 2, 3, 3]
    assert one(spark, S.cjk_share(F.lit("新生ab"))) == 0.5
    assert one(spark, S.location_label(F.lit("a / b / "), F.lit("table"), F.lit(3))) == "b"
    assert one(spark, S.location_label(F.lit(None).cast("string"), F.lit("text"), F.lit(1))) is None
    assert one(spark, S.with_prefix(F.lit("body"), F.lit("附件2"))) == "附件2\n\nbody"
    assert one(spark, S.with_prefix(F.lit("附件2 body"), F.lit("附件2"))) == "附件2 body"
    assert one(spark, S.flipped_box(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0))), F.lit(10.0))) == [1.0, 6.0, 3.0, 8.0]
    assert [one(spark, S.skips_retrieval(F.lit(t))) for t in ("你好", "What can you do?", "故意杀人怎么判刑")] == [True, True, False]
    assert one(spark, S.placeholder_share(F.lit("![a](b)\n\n![c](d)\nx\n![e](f)"))) == 0.75
    assert one(spark, S.prepared_for_embedding(F.lit("\x00 \n"))) == " "
