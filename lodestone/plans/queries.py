"""Queries over the driver's tables, one for each operator family, with their DuckDB SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import analytics as A
from ..operators import chunking, fusion, graph, lifecycle, retrieval
from ..sources import files
from ..streaming import usage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
NOW = "2024-01-30 16:00:00"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# --- projections and text functions -------------------------------------------------------------------------------


@query(r"""SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE regexp_replace(s[1:239], '\s+$', '') || '…' END AS preview
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS s FROM documents)""")
def content_preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


@query(r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents""")
def collapsed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse_whitespace(F.col("text")).alias("flat"))


@query(r"""SELECT item_id, replace(replace(replace(text, '\', '\\'), '%', '\%'), '_', '\_') AS pattern FROM benchmark""")
def escaped_patterns(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.escape_like(F.col("text")).alias("pattern"))


@query("""SELECT conv_id, CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id""")
def token_estimates(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(T.estimated_tokens(F.col("text"))).alias("tokens"))


@query(r"""SELECT doc_id, list_filter(string_split_regex(trim(text), '\s+'), lambda t: length(t) >= 6 AND regexp_full_match(t, '[A-Za-z0-9][A-Za-z0-9_-]*'))[1] AS identifier FROM documents""")
def dominant_identifiers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.dominant_identifier(F.col("text")).alias("identifier"))


@query(r"""SELECT item_id, term, CAST(CASE WHEN length(term) >= 6 THEN 4.0 ELSE 1.2 END AS DOUBLE) AS weight FROM
(SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(string_split_regex(trim(text), '\s+')) AS term FROM benchmark) WHERE length(term) >= 2 AND regexp_matches(term, '[A-Za-z0-9]'))""")
def query_anchors(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.query_terms(items).select(F.col("query_id").alias("item_id"), "term", "weight")


@query(r"""SELECT doc_id, line, noise FROM (SELECT doc_id, i - 1 AS line, length(s) <= 1 OR (length(s) <= 3 AND regexp_full_match(s, '-?\d+')) OR (length(s) <= 32 AND regexp_full_match(s, '[\w.+-]+@[\w.-]+\.\w+')) AS noise
FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, regexp_replace(unnest(x), '^\s+|\s+$', '', 'g') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)))""")
def layout_noise_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "s"))
    return lines.select("doc_id", big("line").alias("line"), T.layout_noise(F.col("s")).alias("noise"))


@query("""SELECT doc_id, text[greatest(n - 100, 0) + 1 : least(n + 120, length(text))] AS excerpt, least(n, 100) AS a, n > 100 AS cut_before, n + 120 < length(text) AS cut_after FROM
(SELECT doc_id, text, length(text) // 2 AS n FROM documents)""")
def excerpts(spark, sf_dir):
    middle = F.floor(F.length("text") / 2).cast("int")
    e = T.excerpt(F.col("text"), middle, F.least(F.length("text"), middle + 20), 100)
    return table(spark, sf_dir, "documents").select("doc_id", e.alias("e")).select("doc_id", "e.excerpt", big("e.from").alias("a"), "e.cut_before", "e.cut_after")


@query("""SELECT doc_id, sha256('7' || chr(0) || text) AS key, printf('doc%d-%04d-', doc_id, 3) || substring(sha256(doc_id || ':3'), 1, 12) AS uid FROM documents""")
def cache_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.cache_key(F.lit(7), F.col("text")).alias("key"), T.chunk_uid(F.col("doc_id"), F.lit(3)).alias("uid"))


@query("""SELECT o_orderkey, CASE WHEN s < 60 THEN printf('%d 秒', s) WHEN s < 3600 THEN printf('%d 分 %d 秒', s // 60, s % 60) ELSE printf('%d 小时 %d 分 %d 秒', s // 3600, s % 3600 // 60, s % 60) END AS label
FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)""")
def duration_labels(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", T.duration_label(F.col("o_totalprice") / 10).alias("label"))


@query(r"""SELECT doc_id, list_distinct_in_order AS terms FROM (SELECT doc_id, list_filter(x, lambda t, i: t <> '' AND list_position(x, t) = i)[1:12] AS list_distinct_in_order FROM
(SELECT doc_id, list_transform(string_split(text, ','), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')) AS x FROM documents))""")
def cleaned_keywords(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.cleaned_terms(F.split("text", ",", -1), 12).alias("terms"))


# --- scores and fusion ---------------------------------------------------------------------------------------------


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels of candidates for each supplier, from its order lines."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), (F.col("l_quantity") / 50).alias("v"), (F.col("l_tax") * 80).alias("k"), "l_linenumber"
    )
    rows = rows.groupBy("query_id", "uid").agg(F.max("v").alias("v"), F.max("k").alias("k"), F.first("l_linenumber").alias("line"))
    order = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), "uid"))
    vector = rows.filter("line <= 4").withColumn("ord", order("v")).select("query_id", F.lit("vector").alias("channel"), "uid", "ord", F.col("v").alias("score"))
    keyword = rows.filter("line % 2 = 1 AND query_id % 5 <> 0 AND k > 0").withColumn("ord", order("k")).select("query_id", F.lit("keyword").alias("channel"), "uid", "ord", F.col("k").alias("score"))
    return vector.union(keyword).withColumn("ident_hit", F.lit(False))


_CHANNELS_SQL = """rows0 AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS uid, max(l_quantity / 50) AS v, max(l_tax * 80) AS k, max(l_linenumber) AS line FROM lineitem GROUP BY 1, 2),
vec AS (SELECT query_id, uid, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, uid) AS ord, v AS score FROM rows0 WHERE line <= 4),
kw AS (SELECT query_id, uid, row_number() OVER (PARTITION BY query_id ORDER BY k DESC, uid) AS ord, k AS score FROM rows0 WHERE line % 2 = 1 AND query_id % 5 <> 0 AND k > 0)"""
_HYBRID_SQL = f"""WITH {_CHANNELS_SQL},
v1 AS (SELECT query_id, uid, ord, score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best, count(*) OVER (PARTITION BY query_id) AS many FROM vec) WHERE ord <= greatest(3, many // 4) AND score >= best * 0.55 AND score > 0),
v2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS v_rank, max(score) OVER (PARTITION BY query_id) AS best, count(*) OVER (PARTITION BY query_id) AS many FROM v1),
boost AS (SELECT query_id, uid, score FROM v2 WHERE v_rank <= greatest(3, many // 4) AND score >= best * 0.55),
k1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ord) AS k_rank FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM kw) WHERE best >= 3 AND score >= greatest(best * 0.45, 3)),
members AS (SELECT k1.query_id, k1.uid, boost.score AS vector_score, k1.score AS keyword_score, v2.v_rank, k_rank FROM k1 LEFT JOIN boost ON k1.query_id = boost.query_id AND k1.uid = boost.uid LEFT JOIN v2 ON k1.query_id = v2.query_id AND k1.uid = v2.uid
  UNION ALL SELECT query_id, uid, score, NULL, v_rank, NULL FROM v2 WHERE best >= 0.45 AND query_id NOT IN (SELECT query_id FROM k1)),
n AS (SELECT *, max(vector_score) OVER w AS vh, min(vector_score) OVER w AS vl, max(keyword_score) OVER w AS kh, min(keyword_score) OVER w AS kl FROM members WINDOW w AS (PARTITION BY query_id)),
raw AS (SELECT *, CASE WHEN vector_score IS NOT NULL THEN 0.3 / (60 + v_rank) ELSE 0 END + CASE WHEN keyword_score IS NOT NULL THEN 0.7 / (60 + k_rank) ELSE 0 END AS r FROM n)"""


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, CASE WHEN hi = lo THEN CASE WHEN hi > 0 THEN 1.0 ELSE 0.0 END ELSE (l_quantity - lo) / (hi - lo) END AS norm,
CASE WHEN hi <= 0 THEN 0.0 WHEN hi = lo THEN 1.0 ELSE greatest(l_quantity, 0) / hi END AS share
FROM (SELECT *, min(l_quantity) OVER (PARTITION BY l_suppkey) AS lo, max(l_quantity) OVER (PARTITION BY l_suppkey) AS hi FROM lineitem)""")
def normalised_scores(spark, sf_dir):
    by = W.partitionBy("l_suppkey")
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", fusion.min_max(q, by).alias("norm"), fusion.relative(q, by).alias("share"))


@query(_HYBRID_SQL + """ SELECT query_id, uid, round(coalesce(CASE WHEN vector_score IS NULL THEN 0 WHEN vh <= 0 THEN 0 WHEN vh = vl THEN 1 ELSE greatest(vector_score, 0) / vh END, 0) * 0.3
 + 0.7 * coalesce(CASE WHEN keyword_score IS NULL THEN 0 WHEN kh <= 0 THEN 0 WHEN kh = kl THEN CASE WHEN kh < 3 THEN 0 ELSE 1 END ELSE greatest(keyword_score, 0) / kh END, 0), 9) AS score, vector_score, keyword_score FROM raw""")
def hybrid_weighted(spark, sf_dir):
    return fusion.hybrid(_channels(spark, sf_dir)).withColumn("score", F.round("score", 9))


@query(_HYBRID_SQL + """ SELECT query_id, uid, vector_score, keyword_score, round(CASE WHEN max(r) OVER (PARTITION BY query_id) <= 0 THEN 0 ELSE r / max(r) OVER (PARTITION BY query_id) END, 9) AS score FROM raw""")
def hybrid_rrf(spark, sf_dir):
    return fusion.hybrid(_channels(spark, sf_dir), method="rrf").withColumn("score", F.round("score", 9))


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("query_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("kb_id"), F.col("o_orderkey").alias("uid"), F.col("o_totalprice").alias("score"))


_COLLECTIONS_SQL = "(SELECT o_custkey % 50 AS query_id, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS kb_id, o_orderkey AS uid, o_totalprice AS score FROM orders)"


@query(f"""SELECT query_id, kb_id, uid, score, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 1.0 END AS merge_score FROM
(SELECT *, min(score) OVER (PARTITION BY query_id, kb_id) AS lo, max(score) OVER (PARTITION BY query_id, kb_id) AS hi FROM {_COLLECTIONS_SQL})""")
def merge_scores(spark, sf_dir):
    return fusion.merge_scores(_collections(spark, sf_dir))


@query(f"""SELECT query_id, kb_id, uid, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t, CASE WHEN t = 0 THEN kb_id END, score DESC, uid) AS p FROM
(SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, kb_id ORDER BY score DESC, uid) = 1 THEN 0 ELSE 1 END AS t FROM {_COLLECTIONS_SQL})) WHERE p <= 8""")
def fair_merge(spark, sf_dir):
    return fusion.fair_merge(_collections(spark, sf_dir), 8)


# --- retrieval -----------------------------------------------------------------------------------------------------


def _chunks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    return chunks, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_KEYWORD_SQL = r"""WITH terms AS (SELECT query_id, term, CASE WHEN length(term) >= 6 THEN 4.0 ELSE 1.2 END AS weight FROM (SELECT DISTINCT item_id AS query_id, term FROM
(SELECT item_id, unnest(string_split_regex(trim(text), '\s+')) AS term FROM benchmark) WHERE length(term) >= 2 AND regexp_matches(term, '[A-Za-z0-9]'))),
hits AS (SELECT query_id, doc_id AS chunk_id, round(CAST(sum(weight) AS DOUBLE), 6) AS score FROM terms JOIN documents ON contains(text, term) GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM hits)"""


@query(_KEYWORD_SQL + " SELECT query_id, chunk_id, score, rank FROM best WHERE rank <= 5")
def keyword_top(spark, sf_dir):
    found = retrieval.keyword_search(*_chunks(spark, sf_dir), 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


@query(_KEYWORD_SQL + """ SELECT count(*) AS questions, count(*) FILTER (WHERE top >= 30) AS hits, round(avg(CASE WHEN top >= 30 THEN 1.0 ELSE 0.0 END), 4) AS hit_rate
FROM (SELECT item_id, coalesce((SELECT max(score) FROM best WHERE query_id = item_id), 0) AS top FROM benchmark)""")
def benchmark_hit_rate(spark, sf_dir):
    chunks, queries = _chunks(spark, sf_dir)
    return retrieval.hit_rate(retrieval.keyword_search(chunks, queries, 5), queries, 30.0)


@query("""SELECT query_id, vec_id, score, rank FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score,
row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) DESC, b.vec_id) AS rank
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE rank <= 5""")
def vector_top(spark, sf_dir):
    found = retrieval.vector_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 5)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


# --- graph ---------------------------------------------------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), F.col("p_type").alias("entity_type"), F.col("p_name").alias("description"))
    supplier = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.lit("SUPPLIER").alias("entity_type"), F.col("s_name").alias("description"))
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.when(F.col("l_returnflag") == "R", "RETURNED").otherwise("DIRECTED").alias("rel_type"))
    return part.union(supplier), edges


_GRAPH_SQL = """WITH nodes AS (SELECT 'p' || p_partkey AS entity_id, p_type AS entity_type, p_name AS description FROM part UNION ALL SELECT 's' || s_suppkey, 'SUPPLIER', s_name FROM supplier),
edges AS (SELECT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, CASE WHEN l_returnflag = 'R' THEN 'RETURNED' ELSE 'DIRECTED' END AS rel_type FROM lineitem),
deg AS (SELECT entity_id, entity_type, description, coalesce(d, 0) AS degree FROM nodes LEFT JOIN (SELECT e, count(*) AS d FROM (SELECT src AS e FROM edges UNION ALL SELECT dst FROM edges WHERE src <> dst) GROUP BY e) ON e = entity_id)"""


@query(_GRAPH_SQL + " SELECT (SELECT count(*) FROM nodes) AS node_total, (SELECT count(*) FROM edges WHERE src <> dst) AS edge_total")
def graph_totals(spark, sf_dir):
    return graph.totals(*_graph(spark, sf_dir))


@query(_GRAPH_SQL + " SELECT * FROM deg ORDER BY degree DESC, entity_id LIMIT 50")
def graph_top_degree(spark, sf_dir):
    return graph.top_degree(*_graph(spark, sf_dir), 50)


@query(_GRAPH_SQL + """, top AS (SELECT entity_id FROM deg ORDER BY degree DESC, entity_id LIMIT 300)
SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM edges WHERE rel_type = 'DIRECTED' AND src <> dst AND src IN (SELECT * FROM top) AND dst IN (SELECT * FROM top)""")
def graph_induced_edges(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    return graph.induced_edges(edges, graph.top_degree(nodes, edges, 300))


@query(_GRAPH_SQL + """, one AS (SELECT DISTINCT dst AS e FROM edges WHERE src = 'p1' UNION SELECT DISTINCT src FROM edges WHERE dst = 'p1'),
two AS (SELECT DISTINCT CASE WHEN src IN (SELECT e FROM one) THEN dst ELSE src END AS e FROM edges WHERE src IN (SELECT e FROM one) OR dst IN (SELECT e FROM one)),
hops AS (SELECT 'p1' AS e, 0 AS hop UNION ALL SELECT e, 1 FROM one WHERE e <> 'p1' UNION ALL SELECT e, 2 FROM two WHERE e <> 'p1' AND e NOT IN (SELECT e FROM one))
SELECT entity_id, hop, degree FROM deg JOIN hops ON e = entity_id ORDER BY hop > 0, degree DESC, entity_id LIMIT 100""")
def graph_ego(spark, sf_dir):
    return graph.ego(*_graph(spark, sf_dir), "p1", 2, 100)


@query(_GRAPH_SQL + " SELECT * FROM deg WHERE lower(entity_id) LIKE '%p12%' OR lower(description) LIKE '%p12%' ORDER BY entity_id <> 'P12', lower(entity_id) NOT LIKE '%p12%', degree DESC, entity_id LIMIT 1")
def graph_center(spark, sf_dir):
    return graph.find_center(*_graph(spark, sf_dir), "P12")


# --- analytics -----------------------------------------------------------------------------------------------------


@query(f"""SELECT strftime(day, '%m-%d') AS label, k AS event_type, coalesce(n, 0) AS n, round(coalesce(total, 0), 6) AS total FROM
(SELECT unnest(generate_series(DATE '2024-01-31' - INTERVAL 29 DAY, DATE '2024-01-31', INTERVAL 1 DAY)) AS day), (SELECT unnest(['click', 'view', 'purchase']) AS k)
LEFT JOIN (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS d, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2) ON d = CAST(day AS DATE) AND event_type = k""")
def usage_series(spark, sf_dir):
    rows = A.daily_series(table(spark, sf_dir, "events"), NOW, 30, ["click", "view", "purchase"], F.col("value"))
    return rows.withColumn("total", F.round("total", 6))


@query("""SELECT count(*) AS n, round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END), 0), 6) AS total FROM events WHERE ts >= TIMESTAMP '2024-01-24 00:00:00'""")
def usage_total(spark, sf_dir):
    rows = table(spark, sf_dir, "events").filter(F.col("ts") >= F.expr("TIMESTAMP_NTZ '2024-01-24 00:00:00'"))
    return rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("event_type") == "purchase", F.col("value"))), F.lit(0.0)), 6).alias("total"))


@query("""SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, least(count(*), 5) AS accepted, greatest(count(*) - 5, 0) AS rejected FROM events GROUP BY 1, 2""")
def daily_quota(spark, sf_dir):
    return A.daily_quota(table(spark, sf_dir, "events"), "user_id", 5).select("user_id", F.col("day").cast("string").alias("day"), big("accepted").alias("accepted"), big("rejected").alias("rejected"))


@query("""SELECT (SELECT count(*) FROM customer) AS customers, (SELECT count(DISTINCT c_nationkey) FROM customer) AS nations, (SELECT count(*) FROM orders) AS orders,
(SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS finished, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open, (SELECT round(sum(o_totalprice), 2) FROM orders) AS revenue, (SELECT count(*) FROM documents) AS documents, (SELECT CAST(sum(n_chars) AS BIGINT) FROM documents) AS chars""")
def dashboard_overview(spark, sf_dir):
    c = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers"), F.countDistinct("c_nationkey").alias("nations"))
    o = table(spark, sf_dir, "orders").agg(
        F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))
    return c.crossJoin(o).crossJoin(d)  # one row each


@query("""SELECT lower(ext) AS label, n FROM (SELECT p_type AS ext, count(*) AS n FROM part GROUP BY 1)""")
def type_distribution(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_type").agg(F.count("*").alias("n")).select(F.lower("p_type").alias("label"), "n")


@query("""SELECT l_orderkey, total, success, failed, running, CASE WHEN running > 0 THEN 'running' WHEN failed = 0 THEN 'success' WHEN success = 0 THEN 'failed' ELSE 'partial' END AS status, CASE WHEN running = 0 THEN e END AS finished_at FROM
(SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE s = 'success') AS success, count(*) FILTER (WHERE s = 'failed') AS failed, count(*) FILTER (WHERE s = 'running') AS running, max(l_shipdate) AS e FROM
(SELECT *, CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_linestatus = 'O' AND l_discount >= 0.09 THEN 'running' ELSE 'success' END AS s FROM lineitem) GROUP BY 1)""")
def batch_status(spark, sf_dir):
    s = F.when(F.col("l_returnflag") == "R", "failed").when((F.col("l_linestatus") == "O") & (F.col("l_discount") >= 0.09), "running").otherwise("success")
    return A.batch_status(table(spark, sf_dir, "lineitem").withColumn("s", s), "l_orderkey", F.col("s"), F.col("l_shipdate"))


@query("""SELECT conv_id, turn, tokens, running FROM (SELECT conv_id, turn, tokens, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS running FROM
(SELECT *, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) WHERE p <= 6) WHERE running <= 120""")
def message_budget(spark, sf_dir):
    rows = A.token_budget(table(spark, sf_dir, "conversations"), "conv_id", "turn", T.estimated_tokens(F.col("text")), 6, 120)
    return rows.select("conv_id", "turn", "tokens", "running")


@query("""SELECT source, count(*) AS titles, string_agg(t, '; ' ORDER BY p) AS body FROM (SELECT *, sum(length(t)) OVER (PARTITION BY source ORDER BY p) AS run FROM
(SELECT source, text[1:30] AS t, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS p FROM documents) WHERE p <= 8) WHERE run <= 200 GROUP BY source""")
def route_titles(spark, sf_dir):
    return A.top_titles(table(spark, sf_dir, "documents"), "source", F.substring("text", 1, 30), 8, 200, F.desc("n_chars"), F.col("doc_id"))


@query("""SELECT g, count(*) AS n FROM (SELECT CASE WHEN DATE '2024-01-31' = d THEN 'today' WHEN DATE '2024-01-31' - d = 1 THEN 'yesterday' WHEN DATE '2024-01-31' - d BETWEEN 2 AND 29 THEN 'day:' || strftime(d, '%Y-%m-%d') ELSE strftime(d, '%Y-%m') END AS g
FROM (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS d FROM events)) GROUP BY g""")
def time_groups(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(A.time_group(F.col("ts"), NOW).alias("g")).agg(F.count("*").alias("n"))


@query("""SELECT coalesce(c.conv_id, u.user_id) AS id, coalesce(messages, 0) AS messages, coalesce(calls, 0) AS calls FROM (SELECT conv_id, count(*) AS messages FROM conversations GROUP BY 1) c
FULL JOIN (SELECT user_id, count(*) AS calls FROM events GROUP BY 1) u ON c.conv_id = u.user_id""")
def joined_counts(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("messages"))
    u = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("calls"))
    return c.join(u, "id", "full").select("id", F.coalesce("messages", F.lit(0)).alias("messages"), F.coalesce("calls", F.lit(0)).alias("calls"))


@query("""SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""")
def audit_page(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "F") & (F.col("o_orderdate") >= F.expr("TIMESTAMP_NTZ '1997-01-01'")))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return lifecycle.page(rows, 2, 50, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "c_name", "n_name")


@query("""SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderpriority ILIKE '%urgent%' OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50) OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_name LIKE '%99')""")
def log_search(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    items = table(spark, sf_dir, "lineitem").filter("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    people = table(spark, sf_dir, "customer").filter(F.col("c_name").endswith("99")).select(F.col("c_custkey").alias("o_custkey"))
    found = orders.filter(F.col("o_orderpriority").ilike("%urgent%")).union(orders.join(items, "o_orderkey", "left_semi").select(*orders.columns)).union(orders.join(people, "o_custkey", "left_semi").select(*orders.columns))
    return found.select("o_orderkey", "o_orderdate").distinct()


# --- lifecycle -----------------------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) WHERE p = 1""")
def latest_states(spark, sf_dir):
    return lifecycle.latest(table(spark, sf_dir, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@query("""SELECT min(doc_id) AS doc_id, sha256(text) AS sha FROM documents GROUP BY sha256(text) HAVING sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src0')""")
def new_uploads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha"))
    return lifecycle.insert_absent(docs.filter("source = 'src0'"), docs, ["sha"], F.col("doc_id")).select("doc_id", "sha")


@query("""SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_tax = 0.08) UNION ALL
SELECT l_suppkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey) AS p FROM lineitem WHERE l_returnflag = 'R' AND l_quantity = 50 AND l_tax = 0.08) WHERE p = 1""")
def upserted_balances(spark, sf_dir):
    changes = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity = 50 AND l_tax = 0.08D")
    fresh = changes.select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_extendedprice").alias("s_acctbal"), "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    rows = lifecycle.latest(fresh, ["s_suppkey"], F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).select("s_suppkey", "s_acctbal")
    return lifecycle.upsert(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), rows, ["s_suppkey"], F.col("s_acctbal"))


@query("""SELECT vec_id, label FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def deleted_vectors(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id"))
    return lifecycle.delete(table(spark, sf_dir, "embeddings").select("vec_id", "label"), gone, ["vec_id"])


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-30 16:00:00' - INTERVAL 30 MINUTE""")
def stale_runs(spark, sf_dir):
    rows = lifecycle.stale(table(spark, sf_dir, "events"), F.col("event_type") == "error", F.col("ts"), F.expr(f"TIMESTAMP_NTZ '{NOW}'"))
    return rows.select("event_id", "user_id")


# --- segments ------------------------------------------------------------------------------------------------------


LINES_SQL = r"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS seq, start_offset, start_offset + length(segment) AS end_offset, segment FROM
(SELECT doc_id, i, CAST(CASE WHEN i = 1 THEN 0 ELSE list_sum(list_transform(x[1 : i - 1], lambda y: length(y) + 1)) END AS BIGINT) AS start_offset, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS segment FROM
(SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))) WHERE segment <> ''"""


@query(LINES_SQL)
def line_segments(spark, sf_dir):
    return chunking.split_segments(table(spark, sf_dir, "documents"), "\n")


@query(r"""WITH p AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS parent_index, s FROM (SELECT doc_id, i, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS s FROM
(SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))) WHERE s <> '')
SELECT doc_id, parent_index, row_number() OVER (PARTITION BY doc_id, parent_index ORDER BY i) - 1 AS child_index, s[1:400] AS parent_preview, segment FROM
(SELECT doc_id, parent_index, s, i, regexp_replace(x[i], '^\s+|\s+$', '', 'g') AS segment FROM (SELECT doc_id, parent_index, s, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT *, string_split(s, '. ') AS x FROM p))) WHERE segment <> ''""")
def parent_child_segments(spark, sf_dir):
    return chunking.parent_children(table(spark, sf_dir, "documents"), "\n", ". ")


@query()
def sliding_chunks(spark, sf_dir):
    return chunking.sliding_chunks(chunking.split_segments(table(spark, sf_dir, "documents"), "\n"), 512, 50)


@query(r"""SELECT doc_id, CAST(CASE WHEN t < 2048 AND greatest(160, t // 4) < 512 THEN greatest(160, t // 4) ELSE 512 END AS BIGINT) AS chunk_size,
CAST(CASE WHEN t < 2048 AND greatest(160, t // 4) < 512 THEN least(50 * greatest(160, t // 4) // 512, greatest(160, t // 4) - 1) ELSE 50 END AS BIGINT) AS chunk_overlap
FROM (SELECT doc_id, sum(length(regexp_replace(s, '^\s+|\s+$', '', 'g'))) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE regexp_replace(s, '^\s+|\s+$', '', 'g') <> '' GROUP BY doc_id)""")
def adapted_chunk_sizes(spark, sf_dir):
    return chunking.adapted_sizes(chunking.split_segments(table(spark, sf_dir, "documents"), "\n"), 512, 50)


@query("""SELECT l_suppkey, p // 10 AS batch, count(*) AS n, string_agg(line, chr(10) ORDER BY p) AS body FROM
(SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS p, l_orderkey || ' | ' || l_partkey AS line FROM lineitem) GROUP BY 1, 2""")
def table_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return chunking.batched(rows, ["l_suppkey"], "o", 10, F.concat_ws(" | ", "l_orderkey", "l_partkey"))


# --- sources and counters ------------------------------------------------------------------------------------------


@query()
def page_lines(spark, sf_dir):
    return files.page_segments(table(spark, sf_dir, "pages"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2""")
def hourly_usage(spark, sf_dir):
    rows = usage.windowed_usage(table(spark, sf_dir, "events"))
    return rows.select("start", "event_type", "n", F.round("total", 6).alias("total"))


@query("""WITH RECURSIVE call AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts) AS i FROM (SELECT CAST(user_id AS VARCHAR) AS key, floor(epoch(ts)) / 3600 AS ts FROM events)),
log AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS i, CAST(NULL AS DOUBLE) AS ts, false AS accepted, CAST([] AS DOUBLE[]) AS stamps FROM call
UNION ALL SELECT key, i, ts, len(held) < 3, CASE WHEN len(held) < 3 THEN list_append(held, ts) ELSE held END FROM (SELECT log.key, call.i, call.ts, list_filter(stamps, lambda x: x >= call.ts - 24) AS held FROM log JOIN call ON call.key = log.key AND call.i = log.i + 1))
SELECT key, ts, accepted FROM log WHERE i > 0""")
def sliding_log(spark, sf_dir):
    day = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double") / 3600
    return usage.rate_limited(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), day.alias("ts")), 3, 24.0)
