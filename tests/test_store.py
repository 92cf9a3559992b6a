"""Versions of chunks, rules, edits, running totals, stitched texts and tailed logs on literal cases."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ordered as O
from lodestone.operators.embedding import hashing_provider
from lodestone.operators.store import ChunkStore, RuleError, broken_rules
from lodestone.streaming import logs

CHUNK = "kb_id long, document_id long, chunk_index int, chunk_uid string, content string, keyword_text string, embedding array<double>, source string"


def chunks(spark, *rows):
    """rows: document, index, uid, content, source."""
    return spark.createDataFrame([(d % 2, d, i, u, c, c, [0.5], s) for d, i, u, c, s in rows], CHUNK)


def held(store, *columns):
    return sorted(tuple(r) for r in store.read().select(*columns or ("document_id", "chunk_index", "content")).collect())


@pytest.fixture
def store(spark, tmp_path):
    return ChunkStore(spark, f"file://{tmp_path}/store")


def test_documents_are_replaced_whole(spark, store):
    with pytest.raises(ValueError, match="nothing is stored"):
        store.read()
    assert store.overwrite(chunks(spark, (1, 0, "a", "one", None), (1, 1, "b", "two", None), (2, 0, "c", "three", None)), "x") == 1
    assert store.overwrite(chunks(spark, (1, 0, "d", "new", None)), "y") == 2
    assert store.overwrite(chunks(spark, (9, 0, "z", "not written", None)), "y") == 2  # the batch is known
    assert held(store) == [(1, 0, "new"), (2, 0, "three")]
    store.remove(spark.createDataFrame([(2,)], "document_id long"))
    assert held(store) == [(1, 0, "new")]
    assert store.overwrite(chunks(spark, (2, 0, "c", "again", None))) == 4
    assert held(store) == [(1, 0, "new"), (2, 0, "again")]


def test_rules_refuse_a_write_whole(spark, store):
    store.overwrite(chunks(spark, (1, 0, "a", "one", None), (2, 0, "b", "two", None)))
    for rows, rule, key in (
        ([(3, 0, "c", "x", None), (3, 1, "c", "y", None)], "chunk_uid", {"chunk_uid": "c"}),
        ([(3, 0, "c", "x", None), (3, 0, "d", "y", None)], "document_id,chunk_index", {"document_id": 3, "chunk_index": 0}),
        ([(3, 0, "a", "x", None)], "chunk_uid", {"chunk_uid": "a"}),  # document 1 has it
        ([(3, 0, None, "x", None)], "chunk_uid", {"chunk_uid": None}),
    ):
        with pytest.raises(RuleError) as e:
            store.overwrite(chunks(spark, *rows))
        assert [(r, k) for r, k, _ in broken_rules(spark, e.value)] == [(rule, key)]
        assert held(store) == [(1, 0, "one"), (2, 0, "two")]
    assert store.overwrite(chunks(spark, (1, 0, "a", "same key again", None))) == 2


def test_an_unfinished_write_is_not_seen(spark, store):
    store.overwrite(chunks(spark, (1, 0, "a", "one", None)))
    chunks(spark, (1, 0, "a", "lost", None)).write.partitionBy("kb_id").parquet(f"{store.folder}/data/version=2")
    assert held(store) == [(1, 0, "one")]
    assert store.overwrite(chunks(spark, (1, 0, "a", "two", None))) == 2
    assert held(store) == [(1, 0, "two")]


def test_edits_embed_what_changed(spark, store):
    store.overwrite(chunks(spark, (1, 0, "a", "one", None), (1, 1, "b", "two", None), (2, 0, "c", "three", "lightrag"), (3, 0, "d", "four", None)))
    edits = spark.createDataFrame([("a", [" k ", "", "k", "m"], ["q?"]), ("c", ["no"], []), ("zz", ["no"], []), ("d", [], [])], "chunk_uid string, keywords array<string>, questions array<string>")
    store.edit(edits, hashing_provider(4))
    assert held(store, "chunk_uid", "keyword_text", "version") == [("a", "one\n关键词：k；m\n问题：q?", 2), ("b", "two", 2), ("c", "three", 1), ("d", "four", 2)]
    vectors = {r.chunk_uid: list(r.embedding) for r in store.read().collect()}
    assert vectors["a"] == hashing_provider(4)(["one\n关键词：k；m\n问题：q?"])[0]
    assert vectors["b"] == vectors["c"] == vectors["d"] == [0.5]
    store.append_vectors(spark.createDataFrame([("b", [9.0]), ("zz", [1.0])], "chunk_uid string, embedding array<double>"))
    assert {r.chunk_uid: list(r.embedding) for r in store.read().collect()} == {**vectors, "b": [9.0]}


def test_totals_before(spark):
    r = random.Random(4)
    rows = [(r.randrange(50), i, r.randrange(9)) for i in range(700)]
    got = {(x.a, x.b): x.before for x in O.with_total_before(spark.createDataFrame(rows, "a long, b long, n long"), "n", ["a", "b"]).collect()}
    total = 0
    for a, b, n in sorted(rows):
        assert got[a, b] == total
        total += n
    assert O.with_total_before(spark.createDataFrame([], "a long, n long"), "n", ["a"]).count() == 0


def plain_pieces(text, most):
    t, out, i = (text or "").strip(), [], 0
    if len(t) <= most:
        return [t] if t else []
    while i < len(t):
        j = min(len(t), i + most)
        if j < len(t):
            for mark in O.ENDS:
                p = t[i:j].rfind(mark)
                if p >= max(12, most // 3):
                    j = i + p + len(mark)
                    break
        if t[i:j].strip():
            out.append(t[i:j].strip())
        i = j
    return out


def test_preview_pieces(spark):
    r = random.Random(8)
    texts = [None, "", "  ", "short", "字" * 300, " " * 100 + "x"] + ["".join(r.choice(["字", "a", "。", "，", " ", "\n", "\n\n", ",", "词语"]) for _ in range(r.randrange(400))) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    for most in (88, 20):
        got = dict(tuple(x) for x in frame.select("i", O.preview_pieces(F.col("t"), most).alias("p")).collect())
        assert got == {i: plain_pieces(t, most) for i, t in enumerate(texts)}


def test_preview_groups(spark):
    rows = [(1, 7, 0, "a"), (1, 3, 1, "b"), (1, 7, 2, "c"), (1, None, 3, "no parent"), (2, 0, 0, " "), (2, 0, 1, "d"), (3, 0, 0, "e")]
    got = O.preview_groups(spark.createDataFrame(rows, "doc_id long, parent_index long, seq long, text string"), 4)
    assert sorted((r.chunk_index, r.doc_id, r.parent_index, r.content) for r in got.collect()) == [(0, 1, 7, "a"), (1, 1, 7, "c"), (2, 1, 3, "b"), (3, 2, 0, "d")]


def test_chunks_to_stitch_are_cut_once(spark, monkeypatch):
    """The text isn't copied into a row for each of its chunks, which made the work grow with the square of its length."""
    from lodestone.plans import store as plan

    monkeypatch.setattr(plan.ordered, "stitched", lambda rows: rows)
    rows = plan.stitched_texts(spark, "/root/testdata/sf0.001")
    assert "explode(sequence" not in rows._jdf.queryExecution().analyzed().toString()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {}
    for r in rows.collect():
        size = 60 if r.doc_id % 2 == 0 else 30
        assert r.content == texts[r.doc_id][r.start_offset : r.start_offset + size]
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {d: (len(t) + 39) // 40 for d, t in texts.items() if t}


def test_preview_cuts_only_documents_that_show(spark, monkeypatch):
    """Documents before which there are enough children with text are not cut into pieces; blank children don't count."""
    rows = spark.createDataFrame([(d, d and d % 2, i, "  " if i == 0 else f"text {d} {i}") for d in (None, *range(20)) for i in range(3)], "doc_id long, parent_index long, seq long, text string")
    rows = rows.withColumn("parent_index", F.coalesce("parent_index", F.lit(0)))
    total, seen = O.with_total_before, []
    monkeypatch.setattr(O, "with_total_before", lambda frame, *a: seen.append({r.doc_id for r in frame.collect()}) or total(frame, *a))
    got = O.preview_groups(rows, 5).orderBy("chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, r.content) for r in got] == [(None, 0, "text None 1"), (None, 1, "text None 2"), (0, 2, "text 0 1"), (0, 3, "text 0 2"), (1, 4, "text 1 1")]
    assert len(seen[0]) == 21 and seen[-1] == {None, 0, 1}


def test_stitched(spark):
    rows = [(1, 0, "abcdef"), (1, 4, "efgh"), (1, 2, "cd"), (1, 4, "efgh"), (1, 10, "xy"), (1, 12, "z"), (2, 5, "late"), (3, 0, None), (3, 0, ""), (3, None, "lost")]
    got = O.stitched(spark.createDataFrame(rows, "doc_id long, start_offset long, content string").repartition(3))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "abcdefgh\nxyz", 1, 11), (2, "late", 0, 4)]


def test_best_source(spark):
    make = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    got = O.best_source([make((1, "parsed"), (2, " "), (3, None)), make((1, "original"), (2, "second")), make((3, "stitched"), (4, ""))])
    assert sorted(tuple(r) for r in got.collect()) == [(1, "parsed", 0), (2, "second", 1), (3, "stitched", 2)]


SNAPSHOTS = [("a", 1, ["x"]), ("a", 2, ["x", "y", "z"]), ("a", 3, ["x", "y", "z"]), ("a", 4, ["n"]), ("a", 5, None), ("a", 6, ["p", "q"]), ("b", 1, []), ("b", 2, ["o"]), (None, 1, ["lost"])]
TAILED = [("a", 1, 0, "x", False), ("a", 2, 1, "y", False), ("a", 2, 2, "z", False), ("a", 4, 0, "n", True), ("a", 6, 0, "p", False), ("a", 6, 1, "q", False), ("b", 2, 0, "o", False)]


def test_tailed(spark):
    frame = spark.createDataFrame(SNAPSHOTS, "log string, at long, lines array<string>")
    assert sorted(tuple(r) for r in logs.tailed(frame).collect()) == TAILED


def test_tailed_stream(spark, tmp_path):
    """The stream's rows are the batch's, however the snapshots are dealt into files."""
    schema = "log string, at long, lines array<string>"
    for k in range(0, len(SNAPSHOTS), 3):
        spark.createDataFrame(SNAPSHOTS[k : k + 3], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
    query = logs.tailed_stream(stream, 10 * 60 * 1000).writeStream.format("memory").queryName("tailed").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.table("tailed").filter("text IS NOT NULL").collect()) == TAILED


def test_edited_rows_are_put_together_once(spark, monkeypatch):
    """The rows of an edit are written before those that are embedded anew are told from the others."""
    from lodestone.operators import store as stores
    from lodestone.plans import store as plan

    names, write = [], stores.written
    monkeypatch.setattr(stores, "written", lambda frame, name: (names.append(name), write(frame, name))[1])
    plan.stored_chunks(spark, "/root/testdata/sf0.001")
    assert names == ["edits", "edited"]
