"""Queries of laid-out documents, with their DuckDB SQL: orders stand for the segments of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fields
from ..operators import layout
from .queries import query, table

_CELLS_SQL = """cell AS (SELECT o_custkey // 8 AS doc, o_orderkey AS seq, p % 1009 AS p, p // 7 % 7 + 1 AS n, p // 49 % 51 AS q
FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders))"""


def _cells(spark, sf_dir):
    p = F.floor("o_totalprice")
    n, q = (F.floor(p / 7) % 7 + 1).cast("int"), F.floor(p / 49) % 51
    rows = table(spark, sf_dir, "orders")
    return rows.select(F.floor(F.col("o_custkey") / 8).alias("doc_id"), F.col("o_orderkey").alias("seq"), (p % 1009).alias("p"), n.alias("n"), q.alias("q"))


_BLOCKS = ("table", "heading", "image", "paragraph", "list", None, "paragraph")
_SEGMENTS_SQL = _CELLS_SQL + """, seg AS (SELECT doc AS doc_id, seq,
['table', 'heading', 'image', 'paragraph', 'list', NULL, 'paragraph'][p % 7 + 1] AS block,
CASE WHEN q > 48 THEN repeat('长', 130) WHEN q > 46 THEN '  ' WHEN q > 44 THEN '第 2 章 总则' WHEN p % 7 = 0 AND q > 30 THEN '| 段1 | 段2 | 段3 | 段4 |'
ELSE ' 段' || n || ' ' END AS text, CASE WHEN q < 3 THEN NULL ELSE seq // 100 END AS page_no,
CASE WHEN n > 4 THEN '第' || n || '节' END AS heading_path FROM cell)"""


def _segments(spark, sf_dir):
    q, n = F.col("q"), F.col("n").cast("string")
    text = F.when(q > 48, "长" * 130).when(q > 46, "  ").when(q > 44, "第 2 章 总则").when((F.col("p") % 7 == 0) & (q > 30), "| 段1 | 段2 | 段3 | 段4 |")
    return _cells(spark, sf_dir).select(
        "doc_id", "seq",
        F.get(F.array(*map(F.lit, _BLOCKS)), (F.col("p") % 7).cast("int")).alias("block"),
        text.otherwise(F.concat(F.lit(" 段"), n, F.lit(" "))).alias("text"), F.when(~(q < 3), F.floor(F.col("seq") / 100)).alias("page_no"),
        F.when(F.col("n") > 4, F.concat(F.lit("第"), n, F.lit("节"))).alias("heading_path"))


@query(f"""WITH {_CELLS_SQL}, r AS (SELECT doc AS doc_id, seq, q % 3 AS b FROM cell)
SELECT doc_id, seq, CAST(1 + coalesce(sum(b) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + b // 2 AS BIGINT) AS page_no FROM r""")
def running_pages(spark, sf_dir):
    rows = _cells(spark, sf_dir).select("doc_id", "seq", (F.col("q") % 3).alias("b"))
    return layout.paged(rows, F.col("b"), F.floor(F.col("b") / 2)).drop("b")


@query(f"""WITH {_SEGMENTS_SQL} SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS block_index,
greatest(coalesce(page_no, 1), 1) AS page_no, greatest(coalesce(page_no, 1), 1) - 1 AS page_idx FROM seg""")
def block_indices(spark, sf_dir):
    return layout.indexed(_segments(spark, sf_dir)).select("doc_id", "seq", "block_index", "page_no", "page_idx")


@query(f"""WITH {_SEGMENTS_SQL} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS chunk_index, trim(text) AS content, page_no, heading_path FROM seg WHERE trim(text) <> ''""")
def prebuilt_chunks(spark, sf_dir):
    return layout.as_chunks(_segments(spark, sf_dir))


@query(f"""WITH {_SEGMENTS_SQL}, l AS (SELECT doc_id, seq, greatest(coalesce(page_no, 1), 1) AS page, CASE WHEN block = 'heading' THEN '## ' ELSE '' END || trim(text) AS line FROM seg WHERE trim(text) <> ''),
p AS (SELECT *, lag(page) OVER (PARTITION BY doc_id ORDER BY seq) AS last FROM l)
SELECT doc_id, string_agg(CASE WHEN last = page THEN '' ELSE CASE WHEN last IS NULL THEN '' ELSE chr(10) || chr(10) END || '[第' || page || '页]' || repeat(chr(10), 4) END || line, chr(10) || chr(10) ORDER BY seq) || chr(10) AS markdown FROM p GROUP BY doc_id""")
def page_marked_markdown(spark, sf_dir):
    return layout.page_marked(_segments(spark, sf_dir))


@query("""SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE l_returnflag = 'N') >= greatest(3, count(*) // 2) AS table_like FROM lineitem GROUP BY 1""")
def table_like_documents(spark, sf_dir):
    block = F.when(F.col("l_returnflag") == "N", "table")
    return layout.table_like(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), block.alias("block")))


@query(f"""WITH {_SEGMENTS_SQL}, c AS (SELECT *, trim(text) AS t, coalesce(block, 'paragraph') IN ('heading', 'paragraph') AND length(trim(text)) BETWEEN 1 AND 120 AND NOT regexp_matches(trim(text), '^第 2 章') AS cand FROM seg),
r AS (SELECT *, coalesce(sum(CASE WHEN cand THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM c),
b AS (SELECT *, row_number() OVER w - 1 AS back, first_value(seq) OVER w AS e_seq, first_value(block) OVER w AS e_block, first_value(page_no) OVER w AS e_page FROM r WINDOW w AS (PARTITION BY doc_id, run ORDER BY seq DESC)),
a AS (SELECT *, bool_or(e_page IS NOT NULL AND e_page IS DISTINCT FROM page_no) OVER (PARTITION BY doc_id, run ORDER BY seq DESC) AS apart FROM b),
k AS (SELECT *, coalesce(cand AND e_block = 'table' AND back BETWEEN 1 AND 6 AND NOT apart, false) AS taken FROM a),
x AS (SELECT doc_id, e_seq, list(t ORDER BY seq) AS ctx, arg_min_null(heading_path, seq) AS ctx_path FROM k WHERE taken GROUP BY ALL),
j AS (SELECT k.*, coalesce(ctx, []) AS ctx, ctx_path, len(list_filter(coalesce(ctx, []), lambda y: contains(t, y))) AS held FROM k LEFT JOIN x ON x.doc_id = k.doc_id AND x.e_seq = k.seq WHERE NOT taken)
SELECT doc_id, seq, block, page_no, coalesce(heading_path, ctx_path) AS heading_path, CASE WHEN len(ctx) > 0 AND held < (len(ctx) + 1) // 2 THEN array_to_string(ctx, chr(10) || chr(10)) || chr(10) || chr(10) || t ELSE t END AS text,
CASE WHEN len(ctx) > 0 AND held >= (len(ctx) + 1) // 2 THEN 0 ELSE len(ctx) END AS n_context FROM j""")
def tables_in_context(spark, sf_dir):
    return layout.with_table_context(_segments(spark, sf_dir))


_OCR = ("请选择日期", "注意：", "图中文字", "", "是/否", "1\n2\n3\n4\n5", "图" * 30, "abcdefghij" * 10)
_OCR_SQL = "['请选择日期', '注意：', '图中文字', '', '是/否', '1\n2\n3\n4\n5', repeat('图', 30), repeat('abcdefghij', 10)]"


@query(f"""WITH {_CELLS_SQL}, s AS (SELECT doc AS doc_id, seq, CASE n % 3 WHEN 0 THEN 'image' WHEN 1 THEN CASE WHEN p % 5 = 0 THEN 'table' END ELSE 'heading' END AS block,
CASE WHEN n % 3 = 0 THEN {_OCR_SQL}[p % 8 + 1] WHEN p % 11 = 0 THEN repeat('图', 40) WHEN p % 13 = 0 THEN repeat('abcdefghij', 9) || repeat('z', 30) ELSE '正文' || p END AS text,
CASE WHEN p % 3 > 0 THEN '第' || p % 3 || '节' ELSE '' END AS path FROM cell),
m AS (SELECT *, coalesce(block = 'image', false) AS image, max(CASE WHEN coalesce(block, 'paragraph') IN ('paragraph', 'heading') THEN seq END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS host FROM s WHERE NOT (coalesce(block = 'image', false) AND text = '')),
h AS (SELECT m.*, o.path AS host_path, image AND host IS NOT NULL AND (m.text IN ('请选择日期', '注意：') OR (m.text IN ('是/否', '1\n2\n3\n4\n5') AND (m.path = '' OR o.path = '' OR m.path = o.path))) AS joins FROM m LEFT JOIN s o ON o.doc_id = m.doc_id AND o.seq = host),
n AS (SELECT *, list(CASE WHEN image THEN '' ELSE text END) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS near FROM h WHERE NOT joins),
k AS (SELECT * FROM n WHERE NOT (image AND length(text) >= 24 AND len(list_filter(coalesce(near, []), lambda y: y <> '' AND (contains(y, text) OR contains(text, y) OR (y[1] = 'a' AND text[1] = 'a')))) > 0)),
g AS (SELECT doc_id AS d, host AS s, string_agg(text, chr(10) || chr(10) ORDER BY seq) AS more, count(*) AS n FROM h WHERE joins GROUP BY ALL)
SELECT doc_id, seq, block, CASE WHEN more IS NULL THEN text ELSE text || chr(10) || chr(10) || more END AS text, CASE WHEN image THEN 'image_ocr' WHEN more IS NOT NULL THEN 'step_with_ocr' END AS role, coalesce(g.n, 0) AS n_attached
FROM k LEFT JOIN g ON d = doc_id AND s = seq""")
def settled_images(spark, sf_dir):
    n, p = F.col("n") % 3, F.col("p")
    block = F.when(n == 0, "image").when(n == 1, F.when(p % 5 == 0, "table")).otherwise("heading")
    text = F.when(n == 0, F.get(F.array(*map(F.lit, _OCR)), (p % 8).cast("int"))).when(p % 11 == 0, "图" * 40).when(p % 13 == 0, "abcdefghij" * 9 + "z" * 30)
    path = F.when(p % 3 > 0, F.concat(F.lit("第"), (p % 3).cast("string"), F.lit("节")))
    rows = _cells(spark, sf_dir).select(
        "doc_id", "seq", block.alias("block"),
        text.otherwise(F.concat(F.lit("正文"), p.cast("string"))).alias("text"), path.alias("heading_path"))
    return layout.settled_images(rows)


@query("""SELECT c_custkey AS row_id, [[c_name, c_mktsegment], ['1', ''], ['', CAST(c_nationkey AS VARCHAR)]] AS grid FROM customer""")
def markdown_grids(spark, sf_dir):
    body = F.concat(
        F.lit("表 1\n| "), "c_name", F.lit(" |"), "c_mktsegment", F.lit(" |\n| :--- | --- |\n |1||\r\n|| "), F.col("c_nationkey").cast("string"), F.lit(" |\n| 断行\n"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), layout.grid(body).alias("grid"))


@query("""WITH l AS (SELECT CAST(floor(sqrt(o_custkey)) AS BIGINT) AS table_id, o_orderkey AS o, o_orderstatus || ': ' || o_orderpriority || '; ' || repeat('值', CAST(o_orderkey % 71 AS INTEGER)) AS line FROM orders),
i AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY o) - 1 AS i FROM l),
t AS (SELECT table_id, count(*) AS n, sum(length(line) + 1) - 1 AS chars, avg(length(line)) FILTER (WHERE i < 48) AS mean FROM i GROUP BY 1),
z AS (SELECT *, least(greatest(1, floor(6500 / greatest(mean, 80))), 10) AS by_size FROM t),
s AS (SELECT table_id, n <= 100 AND chars <= 12000 AS whole, CASE WHEN n <= 1 THEN 1 WHEN n > 3200 THEN greatest(by_size, ceil(n / 3200)) ELSE by_size END AS batch FROM z)
SELECT i.table_id, CASE WHEN whole THEN 0 ELSE CAST(floor(i / batch) AS BIGINT) END AS part, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM i JOIN s USING (table_id) GROUP BY ALL""")
def whole_or_batched_tables(spark, sf_dir):
    line = F.concat("o_orderstatus", F.lit(": "), "o_orderpriority", F.lit("; "), F.repeat(F.lit("值"), (F.col("o_orderkey") % 71).cast("int")))
    rows = table(spark, sf_dir, "orders").withColumn("table_id", F.floor(F.sqrt("o_custkey"))).withColumn("o", F.col("o_orderkey"))
    return layout.table_segments(rows, "table_id", "o", line, fields.table_batch(F.col("__n"), F.col("__mean")))
