"""Texts for a graph index and page furniture on literal cases."""

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import planning as P


def test_graph_inserts(spark):
    chunks = spark.createDataFrame([(1, 1, "乙" * 30), (1, 0, "甲"), (2, 0, " "), (3, 0, "c" * 9000), (4, 0, "d"), (5, 0, None), (7, 0, "g"), (9, 0, "no document")], "doc_id long, chunk_index long, content string")
    documents = spark.createDataFrame(
        [(1, 100, "auto", 100), (2, 99, "auto", 100), (3, 0, "reuse_parse", 100), (4, 999, "native", 100), (5, 999, "auto", 100), (6, 999, "reuse_parse", 100), (7, None, None, 100)],
        "doc_id long, n_chars long, index_mode string, least_chars long",
    )
    got = {r.doc_id: tuple(r)[1:] for r in P.graph_inserts(chunks, documents, "|", 200, margin=190, most=5000).collect()}
    assert got[1] == (True, 210, "甲|" + "乙" * 30)  # thirty characters are twenty tokens
    assert got[3] == (True, 5000, "c" * 9000)
    assert {d: got[d] for d in (2, 4, 5, 6, 7)} == dict.fromkeys((2, 4, 5, 6, 7), (False, 200, None))


def test_furniture_of_any_script(spark):
    lines = {"张三@例子.cn": True, "zhang.三+1@x-y.cn": True, "12": True, "１２": True, "1234": False, "": True, None: True, "网站地图": True, "a@b": False, "x" * 30 + "@y.cn": False}
    rows = spark.createDataFrame([(k,) for k in lines], "line string").withColumn("noise", T.layout_noise(F.col("line")))
    assert {r.line: r.noise for r in rows.collect()} == lines


def test_markdown_table_strips_each_cell_once(spark):
    from lodestone.functions.fields import markdown_table

    rows = spark.createDataFrame([([[" a", "b "], [" "], ["c"], ["d", "e", "f"]],), ([["x"]],), ([[" "]],), ([],)], "grid array<array<string>>").select(markdown_table(F.col("grid")).alias("t"))
    want = ["| a | b |  |\n| --- | --- | --- |\n| c |  |  |\n| d | e | f |", "| x |", "", ""]
    assert [r.t for r in rows.collect()] == want
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1  # not once more for each row of the table
