"""Embedding, answering in rounds, and graph search on literal cases."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import agent, embedding, graph


def test_embeddings_once_and_in_order(spark):
    rows = spark.createDataFrame([(1, "red fox"), (2, "red fox"), (3, None), (4, "blue sea")], "id long, text string")
    got = {r.id: r.embedding for r in embedding.with_embeddings(rows, "text", embedding.hashing_provider(16)).collect()}
    assert got[1] == got[2] != got[4]
    assert np.isclose(np.linalg.norm(got[1]), 1)
    assert got[3] == [0.0] * 16


def test_refused_batches_are_halved_and_cut():
    calls = []

    def provider(texts):
        calls.append(len(texts))
        if len(texts) > 2 or any(len(t) > 100 for t in texts):
            raise ValueError
        return [[float(len(t))] for t in texts]

    assert embedding.embedded(provider, ["a", "bb", "c" * 300, "dddd"]) == [[1.0], [2.0], [64.0], [4.0]]
    assert calls[0] == 4

    def never(texts):
        raise ValueError

    assert embedding.embedded(never, ["x" * 99]) == [None]


def test_rounds(spark):
    index = spark.createDataFrame([("fox", 1, 0.9), ("sea", 2, 0.8)], "word string, uid long, score double")
    retrieve = lambda q: q.join(index, F.contains(F.col("text"), F.col("word"))).select("query_id", "uid", "score")
    grade = lambda r: r.withColumn("relevant", F.col("score") >= 0.5)
    rewrite = lambda q: q.withColumn("text", F.replace("text", F.lit("ocean"), F.lit("sea")))
    questions = spark.createDataFrame([(1, "a fox"), (2, "the ocean"), (3, "nothing")], "query_id long, text string")
    got = sorted((r.query_id, r.round, r.uid) for r in agent.answer_rounds(questions, retrieve, grade, rewrite, 3).collect())
    assert got == [(1, 1, 1), (2, 2, 2)]


def test_history_and_blocks(spark):
    rows = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "first"), (1, 2, "assistant", "second"), (1, 3, "user", "third")], "conv_id long, turn long, role string, text string")
    assert agent.recent_turns(rows, 2, 4).first().history == "assistant: seco\nuser: thir"
    hits = spark.createDataFrame([(1, 7, 0.5, "T", "abcdef"), (1, 8, 0.9, "U", "xyz")], "query_id long, uid long, score double, title string, content string")
    assert agent.knowledge_blocks(hits, 3).first().block == "[1]《U》xyz\n\n[2]《T》abc"


def test_graph_search(spark):
    chunks = spark.createDataFrame([(1, "Anna met Bob."), (2, "bob, carl"), (3, "nobody"), (4, "Anna and BOB")], "chunk_id long, text string")
    entities = spark.createDataFrame([("Anna",), ("Bob",), ("Carl",)], "entity_id string")
    edges = graph.cooccurrences(chunks, entities)
    assert sorted(map(tuple, edges.collect())) == [("Anna", "Bob", 2), ("Bob", "Carl", 1)]
    sources = spark.createDataFrame([("Anna", 1), ("Bob", 2), ("Carl", 2)], "entity_id string, chunk_id long")
    hits = spark.createDataFrame([(9, "Anna", 0.7)], "query_id long, entity_id string, score double")
    assert [tuple(r) for r in graph.graph_search(hits, edges, sources).collect()] == [(9, 1, 0.7)]
    for mode in ("global", "hybrid"):
        assert sorted(map(tuple, graph.graph_search(hits, edges, sources, mode).collect())) == [(9, 1, 0.7), (9, 2, 0.7)]
    nodes = spark.createDataFrame([("Anna", "PERSON", "x|||y|||x|||")], "entity_id string, entity_type string, source_id string")
    assert graph.node_detail(nodes, edges.withColumnsRenamed({"weight": "w"})).first().tags == ["PERSON", "x", "y"]
