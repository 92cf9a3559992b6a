"""The inverted index on literal cases."""

import math

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical as L

CHUNKS = [(1, "医保卡办理指南", "门诊报销需要医保卡"), (2, None, "报销门诊 门诊报销 API_key v2"), (3, "报销", ""), (4, "the Quick brown-fox", "quick the fox"), (5, "THE quick", "the the the quick"), (None, "医保卡", "医保卡")]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id long, title string, content string").repartition(2)
    return L.build_index(chunks, "chunk_id", {"title": F.col("title"), "content": F.col("content")}, f"file://{tmp_path_factory.mktemp('index')}")


def phrases(spark, index, *wanted):
    rows = spark.createDataFrame([(list(p),) for p in wanted], "phrase array<string>")
    return sorted(("".join(r.phrase), r.field, r.chunk_id, r.times) for r in L.phrase_hits(index, rows).collect())


def test_tokens(spark):
    got = spark.range(1).select(L.tokens(F.lit("医保 API_key-v2，Ünder 3.5")).alias("t")).first().t
    assert got == ["医", "保", "api_key", "v2", "ünder", "3", "5"]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_phrases_are_in_order(spark, index, monkeypatch, broadcast):
    monkeypatch.setattr(L, "BROADCAST_ROWS", broadcast)
    assert phrases(spark, index, "门诊报销", "报销", "医保卡", "医卡保") == [("医保卡", "content", 1, 1), ("医保卡", "title", 1, 1), ("报销", "content", 1, 1), ("报销", "content", 2, 2), ("报销", "title", 3, 1), ("门诊报销", "content", 1, 1), ("门诊报销", "content", 2, 1)]
    assert phrases(spark, index, ["the", "quick"], ["quick", "the"], ["the", "the"], ["no", "quick"]) == [("quickthe", "content", 4, 1), ("thequick", "content", 5, 1), ("thequick", "title", 4, 1), ("thequick", "title", 5, 1), ("thethe", "content", 5, 2)]


def ask(spark, index, text, k=10, **kw):
    rows = L.search(index, spark.createDataFrame([(7, text), (None, text)], "query_id long, text string"), k, **kw).orderBy("rank").collect()
    assert all(r.query_id == 7 for r in rows)
    return [(r.chunk_id, r.matched) for r in rows], rows


def test_search_needs_enough_clauses(spark, index):
    assert sorted(ask(spark, index, "quick fox unheard")[0]) == [(4, 2)]  # three clauses: two must be held
    assert sorted(ask(spark, index, "quick fox")[0]) == [(4, 2), (5, 1)]  # two clauses: one is enough
    assert ask(spark, index, "")[0] == []
    assert ask(spark, index, "？")[0] == []
    assert sorted(ask(spark, index, "门")[0]) == [(1, 1), (2, 1)]  # no clause: the text is a phrase


def test_scores(spark, index):
    (hit,) = ask(spark, index, "brown")[1]
    idf = math.log(1 + (4 - 1 + 0.5) / 1.5)  # four chunks have a title
    mean = (7 + 2 + 4 + 2) / 4
    assert hit.score == pytest.approx(idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / mean)), abs=1e-6)
    assert ask(spark, index, "brown", boosts={"title": 3.0})[1][0].score == pytest.approx(3 * hit.score, abs=1e-5)
    keep = spark.createDataFrame([(5,)], "chunk_id long")
    assert ask(spark, index, "quick", keep=keep)[0] == [(5, 1)]
    assert len(ask(spark, index, "quick", k=1)[0]) == 1


def test_empty_index(spark, tmp_path):
    nothing = spark.createDataFrame([], "chunk_id long, t string")
    found = L.build_index(nothing, "chunk_id", {"t": F.col("t")}, f"file://{tmp_path}/x")
    assert ask(spark, found, "quick")[0] == []


def test_a_large_side_is_not_broadcast_by_its_file_size(spark, index, monkeypatch):
    monkeypatch.setattr(L, "BROADCAST_ROWS", 0)
    small = L.written(spark.createDataFrame([("quick", 0)], "term string, lead int"), "leads")
    met = L._met(index.postings, small, "term")
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 4  # two titles and two contents


def test_copies_are_one_group_and_ties_go_to_the_smallest(spark, tmp_path, monkeypatch):
    chunks = spark.range(500).select(F.col("id").alias("chunk_id"), F.when(F.col("id") % 100 == 7, "quick fox").otherwise("slow fox quick fox").alias("t"))
    asked = spark.createDataFrame([("a", "fox quick"), ("b", "Fox fox"), ("c", "nothing here")], "query_id string, text string")
    for only, cell in ((None, 2_000_000), (L.asked_terms(asked), 1)):
        monkeypatch.setattr(L, "CELL_POSTINGS", cell)
        monkeypatch.setattr(L, "CELL_CLAUSES", cell)
        found = L.build_index(chunks, "chunk_id", {"t": F.col("t")}, f"file://{tmp_path}/{cell}", only)
        got = L.search(found, asked, 7).orderBy("query_id", "rank").collect()
        assert {r.query_id for r in got} == {"a", "b"}
        assert [r.chunk_id for r in got if r.query_id == "a"] == [7, 107, 207, 307, 407, 0, 1]  # shorter texts score higher
        assert [(r.chunk_id, r.matched) for r in got if r.query_id == "b"] == [(i, 2) for i in (0, 1, 2, 3, 4, 5, 6)]  # a phrase asked twice counts twice
        assert (found.postings.filter("term = 'slow'").count() > 0) == (only is None)


def test_chunks_of_one_task_are_dealt_out(spark, tmp_path):
    """A file that one task reads is taken apart by several."""
    chunks = spark.range(64).coalesce(1).withColumnRenamed("id", "chunk_id")
    built = L.build_index(chunks, "chunk_id", {"task": F.concat(F.lit("task"), F.spark_partition_id())}, f"file://{tmp_path}/index")
    assert built.postings.select("term").distinct().count() > 1


@pytest.mark.parametrize("k", [3, 50])
def test_equal_chunks_are_indexed_once(spark, tmp_path, k):
    """An index of distinct chunks holds one of each text and finds all copies, with the scores of the index of all chunks."""
    texts = ["quick fox", "slow fox quick fox", "slow hare", "quick quick hare", "", None]
    chunks = spark.createDataFrame([(100 - i, texts[i * i % 7 % 6], "fox" if i % 5 else None) for i in range(60)], "chunk_id long, t string, name string")
    asked = spark.createDataFrame([("a", "fox quick"), ("b", "hare"), ("c", "slow quick hare"), ("d", "unheard")], "query_id string, text string")
    fields = {"t": F.col("t"), "name": F.col("name")}
    plain = L.build_index(chunks, "chunk_id", fields, f"file://{tmp_path}/plain")
    firsts, copies = L.distinct_chunks(chunks, "chunk_id", fields)
    once = L.build_index(firsts, "chunk_id", fields, f"file://{tmp_path}/once", copies=copies)
    assert once.postings.select("chunk_id").distinct().count() < 12 < plain.postings.select("chunk_id").distinct().count()
    for a, b in ((plain.terms, once.terms), (plain.fields, once.fields)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    for keep in (None, chunks.filter("chunk_id % 3 = 0").select("chunk_id")):
        want, got = (sorted(map(tuple, L.search(index, asked, k, {"t": 2.0}, keep).collect())) for index in (plain, once))
        assert got == want and {r[0] for r in got} == {"a", "b", "c"}
