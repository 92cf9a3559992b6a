"""Queries of layout JSON, tables with spans and headings by class, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import layouts
from .queries import big, query, table

_KINDS = ("heading", "list", "section", "footer", "image")


@query("""WITH line AS (SELECT l_suppkey AS doc_id, l_orderkey AS o, l_orderkey % 3 + 1 AS page, l_linenumber AS n, l_partkey AS p, CAST(floor(l_quantity) AS DOUBLE) AS q FROM lineitem),
element AS (SELECT DISTINCT doc_id, page, o, o % 5 AS k, 0 AS n, 0 AS p, CAST(0 AS DOUBLE) AS q, 0 AS below FROM line UNION ALL SELECT doc_id, page, o, 5, n, p, q, 1 FROM line)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, o, below, n, p, q) - 1 AS index, CASE k WHEN 0 THEN CASE WHEN o % 3 = 0 THEN 'title' ELSE 'text' END WHEN 1 THEN 'list' WHEN 4 THEN 'image' ELSE 'text' END AS type,
page - 1 AS page_idx, CASE WHEN below = 1 THEN q END AS x0, CASE WHEN below = 1 THEN 100 + page - q - 20 END AS y0, CASE WHEN below = 1 THEN q + 10 END AS x1, CASE WHEN below = 1 THEN 100 + page - q END AS y1,
CASE WHEN k = 0 THEN o % 3 + 1 END AS text_level, CASE k WHEN 0 THEN 'heading ' || o WHEN 1 THEN 'list ' || o WHEN 5 THEN 'part ' || p END AS text, CASE WHEN k = 4 THEN 'image ' || o END AS caption FROM element WHERE k NOT IN (2, 3)""")
def flattened_layouts(spark, sf_dir):
    """Suppliers' order lines as nested JSON: pages of elements, one for each order, with its lines below."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("o"), (F.col("l_orderkey") % 3 + 1).cast("int").alias("page"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.floor("l_quantity").cast("double").alias("q"))
    ordered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    number = F.col("page").alias("page number")
    lines = F.transform("lines", lambda x: F.struct(F.lit("paragraph").alias("type"), number, F.concat(F.lit("part "), x["p"]).alias("content"), F.array(x["q"], x["q"], x["q"] + 10, x["q"] + 20).alias("bounding box")))
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("o") % 5).cast("int"))
    told = F.concat_ws(" ", kind, "o")
    orders = rows.groupBy("doc_id", "page", "o").agg(ordered("n", "p", "q").alias("lines"))
    node = F.struct(kind.alias("type"), number, F.when(F.col("o") % 5 == 0, F.col("o") % 3 + 1).alias("heading level"), F.when(~(F.col("o") % 5).isin(2, 4), told).alias("content"), F.when(F.col("o") % 5 == 4, told).alias("alt"), lines.alias("kids"))
    pages = orders.groupBy("doc_id", "page").agg(ordered("o", node.alias("node")).alias("nodes"))
    page = F.struct(F.lit("page").alias("type"), number, (F.col("page") + 100).alias("height"), F.transform("nodes", lambda x: x["node"]).alias("kids"))
    docs = pages.groupBy("doc_id").agg(ordered("page", page.alias("node")).alias("pages"))
    docs = docs.select("doc_id", F.to_json(F.struct(F.lit(90).alias("page height"), F.transform("pages", lambda x: x["node"]).alias("kids"))).alias("json"))
    box = lambda k, name: F.get("bbox", F.lit(k)).alias(name)
    return layouts.content_list(docs).select("doc_id", big("index").alias("index"), "type", big("page_idx").alias("page_idx"), box(0, "x0"), box(1, "y0"), box(2, "x1"), box(3, "y1"), big("text_level").alias("text_level"), "text", "caption")


@query("""WITH line AS (SELECT l_orderkey AS o, l_partkey AS p, CAST(floor(l_quantity) AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem),
wide AS (SELECT o, max(CASE WHEN p % 2 = 1 THEN 1 ELSE 0 END) AS w FROM line GROUP BY o)
SELECT o AS order_id, i - 1 AS row, 'order ' || o || '|' || 'p<' || p || '|' || CASE WHEN p % 2 = 1 THEN 'p<' || p || '|' ELSE '' END || q || CASE WHEN p % 2 = 0 AND w = 1 THEN '|' ELSE '' END AS cells FROM line JOIN wide USING (o)""")
def spanned_tables(spark, sf_dir):
    """An HTML table for each order: the first cell spans all rows, odd parts span two columns."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.floor("l_quantity").cast("string").alias("q"), place.alias("i"), F.count("*").over(W.partitionBy("l_orderkey")).alias("n"))
    first = F.when(F.col("i") == 1, F.concat(F.lit("<th rowspan='"), F.col("n"), F.lit("'>order "), F.col("o"), F.lit("</th>"))).otherwise("")
    line = F.concat(F.lit("<tr>"), first, F.when(F.col("p") % 2 == 1, F.lit('<td colspan="2">')).otherwise("<td>"), F.lit("p&lt;"), F.col("p"), F.lit("</td><td> "), F.col("q"), F.lit("</td></tr>"))
    tables = rows.groupBy("o").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    grid = layouts.spanned_grid(layouts.html_cells(F.concat(F.lit("<table>"), F.col("body"), F.lit("</table>"))))
    return tables.select(F.col("o").alias("order_id"), F.posexplode(grid).alias("row", "cells")).select("order_id", big("row").alias("row"), F.array_join("cells", "|").alias("cells"))


_TITLES = ("第{n}章 总则", "一、范围{n}", "（二）对象{n}", "小标题{n}", "1、条目{n}", "正文{n}", "正文{n}。", "第 {n} 条 规定")
_ROWS_SQL = f"""row AS (SELECT o_custkey // 8 AS doc_id, o_orderkey AS seq, v, replace([{", ".join(f"'{t}'" for t in _TITLES)}][v + 1], '{{n}}', CAST(n AS VARCHAR)) AS text, CASE v WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 7 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN n % 4 + 1 END AS level
FROM (SELECT *, p % 211 % 8 AS v, p % 17 AS n FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)))"""
_PATHS_SQL = """up AS (SELECT a.doc_id, a.seq, b.rank, max(b.seq) AS at FROM ranked a JOIN ranked b ON b.doc_id = a.doc_id AND b.seq <= a.seq AND b.rank IS NOT NULL GROUP BY 1, 2, 3),
path AS (SELECT u.doc_id, u.seq, string_agg(trim(h.title), ' / ' ORDER BY u.rank) AS heading_path FROM up u JOIN ranked h ON h.doc_id = u.doc_id AND h.seq = u.at
WHERE NOT EXISTS (SELECT 1 FROM up s WHERE s.doc_id = u.doc_id AND s.seq = u.seq AND s.rank < u.rank AND s.at > u.at) GROUP BY 1, 2)"""


def _titled(spark, sf_dir):
    p = F.floor("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.floor(F.col("o_custkey") / 8).alias("doc_id"), F.col("o_orderkey").alias("seq"), (p % 211 % 8).alias("v"), (p % 17).alias("n"))
    return rows.withColumn("text", F.replace(F.get(F.array(*map(F.lit, _TITLES)), F.col("v").cast("int")), F.lit("{n}"), F.col("n").cast("string")))


@query(f"""WITH {_ROWS_SQL}, ranked AS (SELECT *, text AS title, CASE WHEN v = 3 THEN least(level, 3) ELSE level END AS rank FROM row), {_PATHS_SQL}
SELECT doc_id, seq, rank, heading_path FROM ranked LEFT JOIN path USING (doc_id, seq)""")
def heading_paths(spark, sf_dir):
    rows = _titled(spark, sf_dir)
    style = F.when(F.col("v") == 3, F.concat(F.lit("Heading "), F.col("n") % 4 + 1))
    rows = layouts.with_heading_paths(rows.withColumn("rank", layouts.heading_class(F.col("text"), style)), F.col("rank"), F.col("text"))
    return rows.select("doc_id", "seq", big("rank").alias("rank"), "heading_path")


@query(f"""WITH {_ROWS_SQL}, item AS (SELECT doc_id, seq, seq // 1000 AS page_idx, text, v, CASE v WHEN 3 THEN NULL WHEN 2 THEN 2 WHEN 0 THEN 1 WHEN 7 THEN 3 END AS level FROM row),
ranked AS (SELECT *, text AS title, CASE WHEN v IN (4, 6) THEN NULL WHEN level = 1 THEN 1 WHEN level = 3 THEN 3 ELSE 2 END AS rank, v = 4 AS tab FROM item), {_PATHS_SQL},
run AS (SELECT *, sum(CASE WHEN tab THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_idx ORDER BY seq) - CASE WHEN tab THEN 1 ELSE 0 END AS run FROM ranked),
fresh AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER (PARTITION BY doc_id, page_idx, run ORDER BY seq) THEN text END AS line FROM run),
context AS (SELECT doc_id, page_idx, run, string_agg(line, chr(10) || chr(10) ORDER BY seq) AS before FROM fresh GROUP BY 1, 2, 3)
SELECT doc_id, seq, CASE WHEN tab THEN before || chr(10) || chr(10) || '| a | ' || text || ' |' || chr(10) || '| --- | --- |' || chr(10) || '| a | c |' ELSE text END AS text, CASE WHEN tab THEN 'table' WHEN rank IS NULL THEN 'paragraph' ELSE 'heading' END AS block, CAST(rank AS BIGINT) AS rank, heading_path, page_idx + 1 AS page_no
FROM run JOIN context USING (doc_id, page_idx, run) LEFT JOIN path USING (doc_id, seq)""")
def layout_segments(spark, sf_dir):
    """Orders as a list of content: titles, texts and tables, of which the first cell spans two rows."""
    v = F.col("v")
    kind = F.when(v == 4, "table").when(v == 2, "title").otherwise("text")
    level = F.when(v == 2, 2).when(v == 0, 1).when(v == 7, 3)
    cell = lambda text, rows: F.struct(text.alias("text"), F.lit(rows).alias("rows"), F.lit(1).alias("columns"), F.lit(False).alias("head"))
    cells = F.array(F.array(cell(F.lit("a"), 2), cell(F.col("text"), 1)), F.array(cell(F.lit("c"), 1)))
    items = _titled(spark, sf_dir).select("doc_id", F.col("seq").alias("index"), kind.alias("type"), F.floor(F.col("seq") / 1000).cast("int").alias("page_idx"), F.when(v != 4, F.col("text")).alias("text"), level.alias("text_level"), F.when(v == 4, cells).alias("cells"), F.when(v == 4, F.col("text")).alias("caption"))
    rows = layouts.layout_segments(items)
    return rows.select("doc_id", "seq", "text", "block", big("rank").alias("rank"), "heading_path", big("page_no").alias("page_no"))
