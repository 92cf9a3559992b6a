"""Queries of what goes into answers, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search
from ..operators import answers
from .queries import _GRAPH_SQL, _graph, big, query, table

_HITS_SQL = """hits AS (SELECT o_custkey AS query_id, o_orderkey AS rank, 'd' || (CAST(floor(o_totalprice) AS BIGINT) % 300) AS chunk_uid, floor(o_totalprice) / 7 AS score FROM orders)"""


def _hits(spark, sf_dir):
    """Orders as a customer's hits among the documents."""
    whole = F.floor("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("rank"), F.concat(F.lit("d"), (whole % 300).cast("string")).alias("chunk_uid"), (whole / 7).alias("score"))


@query(f"""WITH {_HITS_SQL}, d AS (SELECT 'd' || doc_id AS chunk_uid, source AS document_name, n_chars FROM documents WHERE lang <> 'de')
SELECT query_id, rank, chunk_uid, document_name, n_chars, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_uid) AS place FROM hits JOIN d USING (chunk_uid)""")
def found_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chunk_uid"), F.col("doc_id").alias("document_id"), "n_chars")
    names = docs.select(F.col("doc_id").alias("document_id"), F.col("source").alias("document_name"), F.when(F.col("lang") == "de", "failed").otherwise("indexed").alias("status"))
    return answers.found_rows(_hits(spark, sf_dir), chunks, names).select("query_id", "rank", "chunk_uid", "document_name", "n_chars", "place")


_CHUNK_SQL = """c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey % 3 AS kb, CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'indexed' END AS status, [NULL, 'image', 'table'][l_partkey % 3 + 1] AS block,
CASE WHEN l_quantity > 25 THEN '1' END AS attached FROM lineitem)"""


@query(f"""WITH {_CHUNK_SQL} SELECT kb, count(*) FILTER (WHERE status = 'indexed') AS with_images, count(*) FILTER (WHERE status = 'indexed' AND (block IS NULL OR block <> 'image' OR attached IS NOT NULL)) AS without FROM c WHERE kb = 1 GROUP BY kb""")
def searchable_chunks(spark, sf_dir):
    block = F.get(F.array(F.lit(None).cast("string"), F.lit("image"), F.lit("table")), (F.col("l_partkey") % 3).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 3).alias("kb"), F.when(F.col("l_returnflag") == "R", "failed").otherwise("indexed").alias("status"), block.alias("block"), F.when(F.col("l_quantity") > 25, "1").alias("attached"))
    read = lambda images: answers.searchable(F.col("kb"), F.col("status"), F.col("block"), F.col("attached"), 1, images)
    return rows.filter(read(True)).groupBy("kb").agg(F.count("*").alias("with_images"), F.count_if(read(False)).alias("without"))


@query("""WITH r AS (SELECT p_partkey, p_name, p_size, CASE WHEN p_size % 2 = 0 THEN 'parent_child' ELSE 'general' END AS mode, CASE WHEN p_size % 3 > 0 THEN p_type || '  ' ELSE ' ' END AS parent, CASE WHEN p_size % 5 > 0 THEN ' ' || p_name || ' ' END AS content,
CASE WHEN p_size % 7 = 0 THEN p_brand || ' / ' || p_type END AS path, CASE p_size % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'image' END AS block FROM part)
SELECT p_partkey AS chunk_id, CASE WHEN mode = 'parent_child' AND trim(parent) <> '' THEN CASE WHEN trim(coalesce(content, '')) = '' THEN trim(parent) ELSE rtrim(parent) || chr(10) || chr(10) || '—— 命中片段 ——' || chr(10) || trim(content) END ELSE coalesce(content, '') END AS content,
{'document_name': p_name, 'page_no': p_size, 'chunk_index': p_partkey, 'heading_path': path, 'location_label': CASE WHEN path IS NOT NULL THEN split_part(path, ' / ', 2) WHEN block = 'image' THEN '图片 OCR' WHEN block = 'table' THEN '表格' WHEN p_size > 1 THEN '第 ' || p_size || ' 页' END, 'block': block}::VARCHAR AS citation FROM r""")
def result_rows(spark, sf_dir):
    size = F.col("p_size")
    parent = F.when(size % 3 > 0, F.concat("p_type", F.lit("  "))).otherwise(" ")
    content = F.when(size % 5 > 0, F.concat(F.lit(" "), "p_name", F.lit(" ")))
    path = F.when(size % 7 == 0, F.concat_ws(" / ", "p_brand", "p_type"))
    block = F.when(size % 4 == 0, "table").when(size % 4 == 1, "image")
    cite = answers.citation(F.col("p_name"), size, F.col("p_partkey"), path, search.location_label(path, block, size), block)
    shown = answers.shown_content(F.when(size % 2 == 0, "parent_child").otherwise("general"), parent, content)
    names = ("document_name", "page_no", "chunk_index", "heading_path", "location_label", "block")
    written = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f"'{n}': "), F.coalesce(F.col("cite")[n].cast("string"), F.lit("NULL"))) for n in names)), F.lit("}"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("chunk_id"), shown.alias("content"), cite.alias("cite")).select("chunk_id", "content", written.alias("citation"))


_PASSAGE_SQL = f"""{_HITS_SQL}, p AS (SELECT query_id, rank AS uid, score, CASE WHEN rank % 5 > 0 THEN chunk_uid END AS title, CASE WHEN rank % 3 > 0 THEN rank % 40 END AS page_no, CASE WHEN rank % 4 > 0 THEN ' ' || repeat(chunk_uid || '段', rank % 60) || ' ' END AS content FROM hits),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, uid) AS ref, trim(coalesce(content, '')) AS body, coalesce(title, '文献') AS name FROM p)"""


def _passages(spark, sf_dir):
    rank = F.col("rank")
    text = F.when(rank % 4 > 0, F.concat(F.lit(" "), F.repeat(F.concat("chunk_uid", F.lit("段")), (rank % 60).cast("int")), F.lit(" ")))
    return _hits(spark, sf_dir).select(
        "query_id", rank.alias("uid"), "score", F.when(rank % 5 > 0, F.col("chunk_uid")).alias("title"), F.when(rank % 3 > 0, rank % 40).alias("page_no"), text.alias("content"))


@query(f"""WITH {_PASSAGE_SQL} SELECT query_id, string_agg('[' || ref || '] 《' || name || '》' || CASE WHEN page_no IS NULL THEN '' ELSE ' 第' || page_no || '页' END || chr(10) || body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY ref) AS knowledge,
string_agg(ref || ':' || uid || ':' || printf('%.4f', round(score, 4)), ',' ORDER BY ref) AS citations FROM n WHERE ref <= 5 GROUP BY query_id""")
def answer_blocks(spark, sf_dir):
    return answers.answer_blocks(_passages(spark, sf_dir), 5)


@query(f"""WITH {_PASSAGE_SQL}, g AS (SELECT query_id, string_agg('[' || ref || '] 《' || name || '》 score=' || printf('%.2f', score) || chr(10) || left(body, 200), chr(10) || chr(10) ORDER BY ref) AS summary FROM n WHERE ref <= 3 GROUP BY query_id)
SELECT c_custkey AS query_id, coalesce(summary, '（无召回片段）') AS summary FROM customer LEFT JOIN g ON query_id = c_custkey""")
def hit_summaries(spark, sf_dir):
    return answers.hit_summaries(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id")), _passages(spark, sf_dir), 3)


@query(r"""SELECT conv_id, count(*) AS messages, coalesce(arg_max(text, turn) FILTER (WHERE role = 'user'), '') AS question FROM conversations WHERE role IN ('system', 'user', 'assistant') AND regexp_matches(text, '\S') GROUP BY conv_id""")
def last_questions(spark, sf_dir):
    return answers.last_questions(table(spark, sf_dir, "conversations"))


_BARE = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@query(f"""WITH t AS (SELECT conv_id, turn, role, {_BARE} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations)
SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '用户' ELSE '助手' END || '：' || CASE WHEN length(s) <= 200 THEN s ELSE left(s, 199) || '…' END, chr(10) ORDER BY turn) AS history FROM t WHERE p <= 4 AND role IN ('user', 'assistant') AND s <> '' GROUP BY conv_id""")
def conversation_history(spark, sf_dir):
    return answers.history(table(spark, sf_dir, "conversations"))


@query(f"""WITH t AS (SELECT conv_id, turn, s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM (SELECT *, {_BARE} AS s FROM conversations) WHERE role = 'user' AND s <> '')
SELECT conv_id, string_agg('- ' || CASE WHEN length(s) <= 300 THEN s ELSE left(s, 299) || '…' END, chr(10) ORDER BY turn) AS questions FROM t WHERE p <= 3 GROUP BY conv_id""")
def asked_before(spark, sf_dir):
    return answers.asked_before(table(spark, sf_dir, "conversations"), 3)


_ANSWERS = ('{"decision": " Direct ", "confidence": "LOW", "reason": " r "}', '```json\n{"decision": "other"}\n```', "no json", "", '{"reason": "", "confidence": "low"}')
_ROUTES_SQL = "[['direct', 'r', 'low'], ['retrieve', '默认进入知识库检索', 'high'], ['retrieve', '默认进入知识库检索', 'high'], ['retrieve', '默认进入知识库检索', 'high'], ['retrieve', '默认进入知识库检索', 'low']]"


@query(f"SELECT c_custkey AS row_id, r[1] AS decision, r[2] AS reason, r[3] AS confidence FROM (SELECT c_custkey, {_ROUTES_SQL}[CAST(c_custkey % 5 AS INTEGER) + 1] AS r FROM customer)")
def routes(spark, sf_dir):
    answer = F.get(F.array(*map(F.lit, _ANSWERS)), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), answers.route(answer).alias("r")).select("row_id", "r.*")


@query("""SELECT p_partkey AS row_id, CASE WHEN p_size % 3 = 0 THEN 'Use ' || CASE WHEN p_size % 2 = 0 THEN p_name ELSE '（本轮尚未注入检索片段）' END || '.' WHEN p_size % 2 = 0 THEN 'From: ' || p_name ELSE 'Answer.' END AS prompt FROM part""")
def system_prompts(spark, sf_dir):
    size = F.col("p_size")
    own = F.when(size % 3 == 0, " Use {knowledge}. ").when(size % 3 == 1, "  ")
    prompt = answers.system_prompt(own, F.when(size % 2 == 0, F.concat(F.lit(" "), "p_name")), "From: {knowledge}", "Answer.")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), prompt.alias("prompt"))


@query("""SELECT o_orderkey AS request_id, CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey IS NULL THEN 5 ELSE greatest(1, least(50, c_nationkey * 4)) END AS top_k FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def default_top_ks(spark, sf_dir):
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), F.array("o_custkey", "o_orderkey").alias("kb_ids"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "deleted").otherwise("active")
    return answers.default_top_k(requests, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("kb_id"), status.alias("status"), (F.col("c_nationkey") * 4).alias("default_top_k")))


_STORE_SQL = """st AS (SELECT 'k' || o_orderkey AS key, o_custkey AS document_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 100 END AS chunk_order, CASE WHEN o_orderkey % 6 > 0 THEN repeat('Order ' || o_orderpriority || ' ', o_orderkey % 40) END AS content FROM orders),
ks AS (SELECT c_custkey AS document_id, CAST(i AS BIGINT) AS place, 'k' || (c_custkey * 3 + i) AS key FROM customer, (VALUES (0), (1), (2)) v(i) WHERE c_nationkey < 12
UNION ALL SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_order NULLS LAST, key) - 1, key FROM st JOIN customer ON c_custkey = document_id WHERE c_nationkey >= 12)"""


def _store(spark, sf_dir):
    """Orders as the chunks that a graph's store keeps of customers' documents, and the documents with the keys they list."""
    key = F.col("o_orderkey")
    content = F.when(key % 6 > 0, F.repeat(F.concat(F.lit("Order "), "o_orderpriority", F.lit(" ")), (key % 40).cast("int")))
    store = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("k"), key.cast("string")).alias("key"), F.col("o_custkey").alias("document_id"), F.when(key % 4 > 0, key % 100).alias("chunk_order"), content.alias("content"))
    listed = F.transform(F.array(*map(F.lit, range(3))), lambda i: F.concat(F.lit("k"), (F.col("c_custkey") * 3 + i).cast("string")))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_nationkey") < 12, listed).alias("keys")), store


@query(f"WITH {_STORE_SQL} SELECT * FROM ks")
def graph_chunk_keys(spark, sf_dir):
    return answers.chunk_keys(*_store(spark, sf_dir))


@query(f"""WITH {_STORE_SQL}, r AS (SELECT ks.document_id, place, ks.key, coalesce(content, '') AS content, coalesce(chunk_order, place) AS chunk_index FROM ks JOIN st ON st.key = ks.key WHERE contains(coalesce(content, ''), 'HIGH'))
SELECT document_id, -row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, place) AS id, key, chunk_index, CASE WHEN length(content) <= 240 THEN content ELSE left(content, 240) || '…' END AS preview, length(content) AS char_count FROM r""")
def graph_chunk_list(spark, sf_dir):
    documents, store = _store(spark, sf_dir)
    return answers.graph_chunks(answers.chunk_keys(documents, store), store, "HIGH")


@query(f"WITH {_STORE_SQL} SELECT key, document_id FROM st WHERE key NOT IN (SELECT key FROM ks JOIN customer ON c_custkey = document_id WHERE c_mktsegment = 'BUILDING')")
def kept_keys(spark, sf_dir):
    documents, store = _store(spark, sf_dir)
    gone = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("document_id"))
    return answers.without_keys(store, answers.chunk_keys(documents, store).join(gone, "document_id")).select("key", "document_id")


@query("""SELECT o_orderkey AS batch_id, o_custkey AS owner FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')""")
def first_endings(spark, sf_dir):
    o = F.col("o_orderstatus")
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("owner"), F.when(o == "F", "success").when(o == "P", "partial").otherwise("running").alias("status"))
    recorded = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("batch_id"))
    return answers.first_endings(batches, recorded).select("batch_id", "owner")


@query(_GRAPH_SQL + ", t AS (SELECT entity_id, degree FROM deg ORDER BY degree DESC, entity_id LIMIT 60) SELECT *, (SELECT count(*) FROM t) AS node_shown, (SELECT count(*) FROM nodes) AS node_total, (SELECT count(*) FROM edges WHERE src <> dst) AS edge_total FROM t")
def shown_part(spark, sf_dir):
    return answers.shown_part(*_graph(spark, sf_dir), "*", 60, 1)


@query("""WITH s AS (SELECT o_custkey AS doc_id, min(o_orderkey % 500) AS a, max(o_orderkey % 2000) AS b FROM orders GROUP BY 1), r AS (SELECT doc_id, CASE WHEN b > a THEN substring(text, CAST(a + 1 AS BIGINT), CAST(b - a AS BIGINT)) ELSE '' END AS raw FROM documents JOIN s USING (doc_id))
SELECT doc_id, left(raw, 600) AS excerpt, length(raw) > 600 AS truncated FROM r""")
def span_excerpts(spark, sf_dir):
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), (F.col("o_orderkey") % 500).alias("start_offset"), (F.col("o_orderkey") % 2000).alias("end_offset"))
    return answers.span_excerpts(table(spark, sf_dir, "documents").select("doc_id", "text"), spans, 600)


@query("""WITH m AS (SELECT p_partkey, p_name, CASE p_size % 4 WHEN 0 THEN 'overview' WHEN 1 THEN 'body' WHEN 2 THEN 'row' END AS role, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN repeat('<td>', 20000) WHEN 2 THEN '' ELSE '<table>' END AS html FROM part)
SELECT p_partkey AS row_id, role AS table_role, CASE WHEN html <> '' AND (coalesce(role = 'overview', false) OR html = p_name OR length(html) > greatest(8 * length(p_name), 65536)) THEN NULL ELSE length(html) END AS html_chars FROM m""")
def compacted_metadata(spark, sf_dir):
    size = F.col("p_size")
    role = F.when(size % 4 == 0, "overview").when(size % 4 == 1, "body").when(size % 4 == 2, "row")
    html = F.when(size % 5 == 0, F.col("p_name")).when(size % 5 == 1, "<td>" * 20_000).when(size % 5 == 2, "").otherwise("<table>")
    meta = F.create_map(F.lit("table_role"), role, F.lit("table_body_html"), html)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), answers.compacted_metadata(meta, F.col("p_name")).alias("m"))
    return rows.select("row_id", F.col("m")["table_role"].alias("table_role"), big(F.length(F.col("m")["table_body_html"])).alias("html_chars"))


@query("SELECT item_id, list_transform(string_split(left(text, 40) || '😀', ''), lambda x: unicode(x)) AS points FROM benchmark")
def character_codes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", answers.code_points(F.concat(F.substring("text", 1, 40), F.lit("😀"))).alias("points"))
