"""Queries of dashboard counts, lists and fields, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fields
from ..functions import text as T
from ..operators import dashboard as D
from ..operators import lifecycle
from ..sources import markdown
from .queries import big, query, table

_STATUS_SQL = "CASE WHEN l_returnflag = 'R' THEN 'failed' WHEN l_returnflag = 'A' THEN 'indexed' WHEN l_quantity > 40 THEN 'deleted' WHEN l_quantity > 30 THEN 'parsing' ELSE 'uploaded' END"


def _items(spark, sf_dir):
    """Order lines as documents with a status."""
    flag, q = F.col("l_returnflag"), F.col("l_quantity")
    status = F.when(flag == "R", "failed").when(flag == "A", "indexed").when(q > 40, "deleted").when(q > 30, "parsing").otherwise("uploaded")
    return table(spark, sf_dir, "lineitem").withColumn("status", status)


# --- counts ----------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT unnest([l_suppkey, l_partkey % 50]) AS k FROM lineitem), r AS (SELECT l_suppkey % 40 AS k FROM lineitem WHERE l_returnflag = 'R'),
u AS (SELECT coalesce(b1.k, r1.k) AS kb_id, coalesce(r1.n, 0) AS recalls, coalesce(b1.n, 0) AS binds FROM (SELECT k, count(*) AS n FROM b GROUP BY k) b1 FULL JOIN (SELECT k, count(*) AS n FROM r GROUP BY k) r1 ON b1.k = r1.k)
SELECT kb_id, s_name AS name, recalls, binds FROM u JOIN supplier ON s_suppkey = kb_id ORDER BY recalls DESC, binds DESC, kb_id LIMIT 5""")
def collection_usage(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    bound = items.select(F.to_json(F.array("l_suppkey", F.col("l_partkey") % 50)).alias("ids"))
    cited = items.filter("l_returnflag = 'R'").select(F.to_json(F.array(F.struct((F.col("l_suppkey") % 40).alias("knowledge_base_id"), F.lit("x").alias("title")))).alias("citations"))
    return D.collection_usage(bound, cited, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("kb_id"), F.col("s_name").alias("name")))


@query(f"SELECT count(*) FILTER (WHERE s IN ('parsing', 'uploaded')) AS parsing, count(*) FILTER (WHERE s = 'indexed') AS indexed, count(*) FILTER (WHERE s = 'failed') AS failed FROM (SELECT {_STATUS_SQL} AS s FROM lineitem)")
def pipeline_counts(spark, sf_dir):
    return D.pipeline_counts(_items(spark, sf_dir))


@query(f"""SELECT s_suppkey AS kb_id, coalesce(documents, 0) AS documents, coalesce(indexed, 0) AS indexed, coalesce(failed, 0) AS failed, coalesce(chunks, 0) AS chunks FROM supplier
LEFT JOIN (SELECT l_suppkey, count(*) AS documents, count(*) FILTER (WHERE s = 'indexed') AS indexed, count(*) FILTER (WHERE s = 'failed') AS failed FROM (SELECT *, {_STATUS_SQL} AS s FROM lineitem) WHERE s <> 'deleted' GROUP BY 1) ON l_suppkey = s_suppkey
LEFT JOIN (SELECT p_size AS k, count(*) AS chunks FROM part GROUP BY 1) ON k = s_suppkey""")
def collection_stats(spark, sf_dir):
    docs = _items(spark, sf_dir).select(F.col("l_suppkey").alias("kb_id"), "status")
    chunks = table(spark, sf_dir, "part").select(F.col("p_size").alias("kb_id"))
    return D.collection_stats(docs, chunks, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("kb_id")))


@query("""SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) >= 50 OR sum(n_chars) >= 130000 AS "full" FROM documents GROUP BY source""")
def space_usage(spark, sf_dir):
    return D.space_usage(table(spark, sf_dir, "documents"), "source", "n_chars", 50, 130_000)


@query("""WITH b AS (SELECT o_orderkey AS batch_id, CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'partial' END AS status, epoch(o_orderdate) AS started, CASE WHEN o_orderstatus = 'P' THEN epoch(o_orderdate) + 50 END AS finished FROM orders),
i AS (SELECT l_orderkey AS batch_id, min(epoch(l_shipdate)) AS a, max(CASE WHEN l_returnflag <> 'N' THEN epoch(l_shipdate) END) AS z, bool_and(l_returnflag <> 'N') AS ended FROM lineitem GROUP BY 1)
SELECT b.batch_id, greatest(coalesce(CASE WHEN coalesce(ended, false) AND status IN ('success', 'failed', 'partial') AND a IS NOT NULL THEN z - a END, CASE WHEN finished IS NOT NULL THEN finished - started WHEN status = 'running' THEN 2000000000 - started END), 0) AS seconds
FROM b LEFT JOIN i ON i.batch_id = b.batch_id WHERE coalesce(CASE WHEN coalesce(ended, false) AND status IN ('success', 'failed', 'partial') AND a IS NOT NULL THEN z - a END, CASE WHEN finished IS NOT NULL THEN finished - started WHEN status = 'running' THEN 2000000000 - started END) IS NOT NULL""")
def batch_durations(spark, sf_dir):
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp")).cast("double")
    o = F.col("o_orderstatus")
    status = F.when(o == "F", "success").when(o == "O", "running").otherwise("partial")
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), status.alias("status"), seconds("o_orderdate").alias("started"), F.when(o == "P", seconds("o_orderdate") + 50).alias("finished"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), seconds("l_shipdate").alias("started"), F.when(F.col("l_returnflag") != "N", seconds("l_shipdate")).alias("finished"))
    return D.batch_durations(batches, items, F.lit(2e9)).filter("seconds IS NOT NULL")


@query("""SELECT o_custkey AS kb_id, count(*) FILTER (WHERE l_returnflag = 'A') AS succeeded, count(*) FILTER (WHERE l_returnflag <> 'A') AS failed FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND o_orderstatus IN ('F', 'O') GROUP BY 1""")
def recent_outcomes(spark, sf_dir):
    batches = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("batch_id"), F.col("o_custkey").alias("kb_id"), F.col("o_orderstatus").alias("action"))
    status = F.when(F.col("l_returnflag") == "A", "success").when(F.col("l_returnflag") == "R", "failed").otherwise("cancelled")
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch_id"), status.alias("status"), F.col("l_shipdate").alias("finished"))
    return D.recent_outcomes(batches, items, F.expr("TIMESTAMP_NTZ '1996-01-01'"), ("F", "O"))


@query("""SELECT CASE WHEN trim(n) = '' THEN '未知知识库' ELSE trim(n) END AS name, count(*) AS n FROM (SELECT CASE WHEN p_size % 5 = 0 THEN '  ' WHEN p_size % 7 = 0 THEN NULL ELSE ' ' || p_brand END AS x, coalesce(x, '') AS n FROM part) GROUP BY 1""")
def name_breakdown(spark, sf_dir):
    name = F.when(F.col("p_size") % 5 == 0, "  ").when(F.col("p_size") % 7 != 0, F.concat(F.lit(" "), "p_brand"))
    return D.name_breakdown(table(spark, sf_dir, "part").select(name.alias("kb")), "kb")


@query(f"""SELECT item_id, document_id, outcome FROM (SELECT o_orderkey AS item_id, o_custkey AS document_id, CASE WHEN s IS NULL OR s IN ('failed', 'deleted') THEN 'failed' WHEN s = 'indexed' THEN 'success' WHEN s = 'uploaded' THEN 'cancelled' END AS outcome
FROM orders LEFT JOIN (SELECT l_orderkey, max({_STATUS_SQL}) AS s FROM lineitem WHERE l_linenumber = 1 GROUP BY 1) ON l_orderkey = o_custkey WHERE o_orderstatus = 'O') WHERE outcome IS NOT NULL""")
def reconciled_items(spark, sf_dir):
    docs = _items(spark, sf_dir).filter("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("document_id")).agg(F.max("status").alias("doc_status"))
    items = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("document_id"), F.when(F.col("o_orderstatus") == "O", "running").otherwise("success").alias("status"))
    return D.reconciled(items, docs)


@query("""SELECT c_custkey AS document_id, CAST(CASE WHEN c_nationkey > 5 THEN c_nationkey ELSE coalesce(n, 0) END AS BIGINT) AS chunk_count FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def filled_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_id"), F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")).otherwise(0).alias("chunk_count"))
    lists = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document_id")).agg(F.collect_list("o_orderkey").alias("keys"))
    return D.filled_counts(docs, lists).select("document_id", big("chunk_count").alias("chunk_count"))


_LOG = ("解析 a", "分块 b", "Chunk 3 of 9", "正在生成向量", "Milvus 写入完成", "其他", "队列", "其他")
_LOG_SQL = "[" + ", ".join(f"'{x}'" for x in _LOG) + "]"


@query(f"""WITH l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS p, {_LOG_SQL}[CAST(floor(value * 7) AS INTEGER) % 8 + 1] AS line, CASE WHEN user_id % 9 = 0 THEN 'stored' END AS s FROM events),
t AS (SELECT user_id, max(s) AS s, string_agg(line, ' ') AS x FROM l WHERE p <= 3 GROUP BY user_id),
q AS (SELECT user_id, coalesce(s, CASE WHEN regexp_matches(x, 'Milvus 写入完成') THEN 'indexing' WHEN regexp_matches(x, '生成向量') THEN 'embedding' WHEN regexp_matches(lower(x), '分块|chunk') THEN 'chunking' WHEN contains(x, '解析') THEN 'parsing' WHEN contains(x, '队列') THEN 'queued' END) AS phase FROM t)
SELECT user_id, phase, CASE phase WHEN 'indexing' THEN 90.0 WHEN 'embedding' THEN 70.0 WHEN 'chunking' THEN 50.0 WHEN 'parsing' THEN 20.0 WHEN 'queued' THEN 2.0 END AS percent FROM q""")
def log_progress(spark, sf_dir):
    line = F.get(F.array(*map(F.lit, _LOG)), (F.floor(F.col("value") * 7) % 8).cast("int"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", line.alias("line"), F.when(F.col("user_id") % 9 == 0, "stored").alias("stored"))
    return D.progress(rows, "user_id", "event_id", "line", {"indexing": 90.0, "embedding": 70.0, "chunking": 50.0, "parsing": 20.0, "queued": 2.0}, 3)


# --- results ---------------------------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT l_suppkey AS query_id, l_partkey AS uid, max(l_discount) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2), k AS (SELECT l_suppkey AS query_id, l_partkey AS uid, max(l_tax) AS s FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1, 2)
SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.uid, k.uid) AS uid, v.s AS vector_score, k.s AS keyword_score, coalesce(nullif(v.s, 0), nullif(k.s, 0), 0) AS score FROM v FULL JOIN k ON v.query_id = k.query_id AND v.uid = k.uid""")
def joined_channels(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_suppkey": "query_id", "l_partkey": "uid"})
    best = lambda rows, c: rows.groupBy("query_id", "uid").agg(F.max(c).alias("score"))
    return D.joined_channels(best(items.filter("l_linenumber <= 4"), "l_discount"), best(items.filter("l_linenumber >= 3"), "l_tax"))


@query(r"""SELECT source, "index", name, score, CASE WHEN length(c) <= 60 THEN c ELSE c[1:59] || '…' END AS preview FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS "index", coalesce(lang, '文献') AS name,
round(n_chars / 7, 4) AS score, regexp_replace(text, '^\s+|\s+$', '', 'g') AS c FROM documents) WHERE "index" <= 5""")
def result_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumns({"content": F.col("text"), "name": F.col("lang"), "score": F.col("n_chars") / 7})
    return D.summaries(rows, "source", 5, 60, F.desc("n_chars"), F.col("doc_id"))


@query("""SELECT o_custkey AS query_id, CAST(o_orderkey % 7 AS BIGINT) AS "index", o_totalprice AS score FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 < c_nationkey""")
def reranked_places(spark, sf_dir):
    one = F.struct((F.col("o_orderkey") % 7).alias("index"), F.col("o_totalprice").alias("relevance_score"))
    body = F.when(F.col("o_orderstatus") == "F", F.to_json(F.struct(F.array(one).alias("results")))).otherwise(F.to_json(F.struct(F.struct(F.array(one).alias("results")).alias("output"))))
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query_id"), body.alias("body"))
    return D.reranked(answers, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").alias("n")))


@query("""WITH t AS (SELECT l_suppkey AS k, count(*) AS rows, greatest(1, floor(avg(length(l_orderkey || ' ' || l_partkey)))) AS mean FROM lineitem GROUP BY 1),
b AS (SELECT k, CAST(least(greatest(1, ceil(rows / greatest(80, floor(200 / (SELECT count(*) FROM t))))), greatest(1, floor(60 / mean))) AS BIGINT) AS batch FROM t),
r AS (SELECT l_suppkey AS table_index, l_orderkey || ' ' || l_partkey AS text, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS place FROM lineitem)
SELECT table_index, min(place) * 10 AS start_offset, max(place) * 10 + 9 AS end_offset, count(*) AS n, string_agg(text, chr(10) ORDER BY place) AS text FROM r JOIN b ON k = table_index GROUP BY table_index, place // batch""")
def compacted_rows(spark, sf_dir):
    place = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("table_index"), place.cast("long").alias("row_index"), F.concat_ws(" ", "l_orderkey", "l_partkey").alias("text"))
    rows = rows.withColumns({"start_offset": F.col("row_index") * 10, "end_offset": F.col("row_index") * 10 + 9})
    return D.compacted_rows(rows, 200, 60)


# --- lists -----------------------------------------------------------------------------------------------------------


@query("""SELECT n_nationkey AS provider_id, n_name AS provider, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) - 1 AS place, c_custkey AS model_id, c_name AS model, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AS is_default
FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def models_by_provider(spark, sf_dir):
    models = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("model_id"), F.col("c_name").alias("model"), F.col("c_nationkey").alias("provider_id"))
    providers = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("provider_id"), F.col("n_name").alias("provider"))
    chosen = table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("model_id"))
    return D.models_by_provider(models, providers, chosen).select("provider_id", "provider", F.posexplode("models").alias("place", "m")).select("provider_id", "provider", big("place").alias("place"), "m.*")


@query("""SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') AND (c_name ILIKE '%9%' OR c_mktsegment ILIKE '%9%')""")
def space_members(spark, sf_dir):
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("email"))
    held = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("space_id"))
    return D.members(users, held, 1, "9").select("user_id", "name")


@query("""SELECT o_orderkey, o_orderdate, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus <> 'P' AND n_regionkey = 1 ORDER BY o_orderdate DESC, o_orderkey LIMIT 8""")
def latest_events(spark, sf_dir):
    """The eight latest of one tenant that aren't deleted."""
    owned = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").filter("n_regionkey = 1"), F.col("n_nationkey") == F.col("c_nationkey"))
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'").join(owned, F.col("c_custkey") == F.col("o_custkey"))
    return lifecycle.page(rows, 1, 8, F.desc("o_orderdate"), F.col("o_orderkey")).select("o_orderkey", "o_orderdate", "n_name")


# --- fields ----------------------------------------------------------------------------------------------------------


@query(r"""SELECT p_partkey, replace(replace(replace(x, '\r', chr(13)), '\n', chr(10)), '\t', chr(9)) AS delimiter, CASE WHEN trim(replace(f, '\', '/')) <> '' THEN trim(replace(f, '\', '/')) END AS name,
CASE WHEN lower(split_part(f, '.', -1)) IN ('txt', 'md', 'pdf') THEN lower(split_part(f, '.', -1)) END AS kind FROM
(SELECT p_partkey, ['\n\n', 'a\tb', '\r\n', ';'][p_size % 4 + 1] AS x, [' a\b.TXT', 'c.exe', '  ', 'd.Md', 'e.pdf '][p_size % 5 + 1] AS f0, trim(f0) AS f FROM part)""")
def upload_fields(spark, sf_dir):
    pick = lambda xs: F.get(F.array(*map(F.lit, xs)), (F.col("p_size") % len(xs)).cast("int"))
    x, f = pick(["\\n\\n", "a\\tb", "\\r\\n", ";"]), pick([" a\\b.TXT", "c.exe", "  ", "d.Md", "e.pdf "])
    rows = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), f.alias("f"))
    return rows.select("p_partkey", fields.real_delimiter(F.col("x")).alias("delimiter"), fields.upload_name(F.col("f")).alias("name"), fields.file_type(T.strip(F.col("f"))).alias("kind"))


@query("""SELECT event_id, ts AS at FROM events UNION ALL SELECT -event_id - 1, NULL FROM events""")
def parsed_times(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    written = events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("s"))
    broken = events.select((-F.col("event_id") - 1).alias("event_id"), F.lit("no time").alias("s"))
    return written.union(broken).select("event_id", fields.iso_time(F.col("s")).alias("at"))


@query("""SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS chunk, CAST(o_orderkey AS BIGINT) AS entities FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderstatus <> 'F'""")
def extraction_lines(spark, sf_dir):
    line = F.format_string("Chunk %d of 99 extracted %d Ent + 3 Rel%s", "o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") == "F", " ab12").otherwise(" and more"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", fields.extraction_counts(line).alias("c"))
    return rows.select("o_orderkey", "c.chunk", "c.entities")


@query("""SELECT p_partkey, ['*', p_brand, '*', p_brand, '*'][p_size % 5 + 1] AS label, CASE WHEN p_size % 3 = 0 THEN 'base' ELSE replace(p_brand || '`', '`', '``') END AS workspace FROM part""")
def graph_labels(spark, sf_dir):
    label = F.get(F.array(F.lit(" * "), F.concat(F.lit("*"), "p_brand"), F.lit(""), F.concat(F.lit("** "), "p_brand"), F.lit("***")), (F.col("p_size") % 5).cast("int"))
    space = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.concat("p_brand", F.lit("`")))
    return table(spark, sf_dir, "part").select("p_partkey", fields.graph_label(label).alias("label"), fields.workspace_label(space).alias("workspace"))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN [] ELSE [p_brand, p_type] END AS keywords, CASE WHEN p_size % 4 = 3 THEN [] ELSE [x || '?' for x in range(1, 6)] END AS questions FROM part""")
def enrichments(spark, sf_dir):
    words = F.array(F.concat(F.lit(" "), "p_brand"), F.lit(" "), F.col("p_type"))
    asked = F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.concat(i.cast("string"), F.lit("?")))
    body = F.to_json(F.struct(words.alias("keywords"), asked.alias("questions")))
    answer = F.get(F.array(body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("```\n"), body, F.lit("```")), F.lit("I can't")), (F.col("p_size") % 4).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", fields.enrichment(answer).alias("e")).select("p_partkey", "e.keywords", "e.questions")


@query(r"""SELECT doc_id, array_to_string(list_filter([coalesce(lang, ''), source, CASE WHEN length(c) > 120 THEN c[1:120] || '…' ELSE c END], lambda x: x <> ''), chr(10)) AS words, CASE WHEN source = 'src0' THEN 'lightrag' ELSE 'classic' END AS kind,
least(50, greatest(1, n_chars // 100)) AS top_k FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS c FROM documents)""")
def image_keyword_texts(spark, sf_dir):
    words = fields.image_keywords(F.col("lang"), F.col("source"), F.col("text"))
    kind = fields.collection_type(F.when(F.col("source") == "src0", "lightrag").otherwise(F.col("source")))
    return table(spark, sf_dir, "documents").select("doc_id", words.alias("words"), kind.alias("kind"), fields.clamped(F.floor(F.col("n_chars") / 100), 1, 50, 5).alias("top_k"))


@query("""SELECT l_suppkey, '| ' || 'a | b |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || l_orderkey || ' | ' || CASE WHEN l_linenumber = 1 THEN '' ELSE l_returnflag END || ' |', chr(10) ORDER BY l_orderkey, l_linenumber, l_partkey) AS body FROM lineitem GROUP BY 1""")
def markdown_tables(spark, sf_dir):
    cells = F.when(F.col("l_linenumber") == 1, F.array(F.col("l_orderkey").cast("string"))).otherwise(F.array(F.concat(F.lit(" "), F.col("l_orderkey")), "l_returnflag"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", cells.alias("cells")))).alias("rows"))
    head = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(" ")))
    return rows.select("l_suppkey", fields.markdown_table(F.concat(head, F.transform("rows", lambda r: r["cells"]))).alias("body"))


@query("""SELECT l_suppkey, CAST(CASE WHEN n <= 1 THEN 1 WHEN n > 320 THEN greatest(b, ceil(n / 320)) ELSE b END AS BIGINT) AS batch FROM (SELECT *, least(greatest(1, floor(650 / greatest(mean, 80))), 10) AS b FROM
(SELECT l_suppkey, count(*) AS n, avg(length(l_orderkey || l_comment)) AS mean FROM (SELECT l_suppkey, l_orderkey, repeat('x', CAST(l_quantity * 4 AS INTEGER)) AS l_comment FROM lineitem) GROUP BY 1))""")
def table_batch_sizes(spark, sf_dir):
    size = F.length(F.col("l_orderkey").cast("string")) + (F.col("l_quantity") * 4).cast("int")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.avg(size).alias("mean"))
    return rows.select("l_suppkey", fields.table_batch(F.col("n"), F.col("mean"), 650, 10, 320).alias("batch"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s IN ('failed', 'uploaded', 'parsing') THEN 'parse' WHEN s = 'indexed' THEN 'reindex' END AS mode, CASE WHEN s <> 'deleted' THEN l_tax > 0.05 OR s = 'parsing' END AS "force" FROM (SELECT *, {_STATUS_SQL} AS s FROM lineitem)""")
def process_modes(spark, sf_dir):
    rows = _items(spark, sf_dir).withColumn("m", fields.process_mode(F.col("status"), F.col("l_tax") > 0.05, F.lit(False)))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "m.mode", "m.force")


@query("""SELECT doc_id, n_chars >= 3000 AND lang <> 'fr' OR lang = 'de' AS parsed FROM documents""")
def parsed_chunk_use(spark, sf_dir):
    mode = F.when(F.col("lang") == "fr", "native").when(F.col("lang") == "de", "reuse_parse").otherwise("auto")
    return table(spark, sf_dir, "documents").select("doc_id", fields.uses_parsed_chunks(F.col("n_chars"), F.lit(3), mode, 3000).alias("parsed"))


_HEADED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: CASE WHEN length(trim(x)) BETWEEN 1 AND 40 THEN repeat('#', CAST(1 + length(x) % 4 AS INTEGER)) || ' ' || trim(x) ELSE x END), chr(10))"


@query(rf"""WITH l AS (SELECT doc_id, i, x[i] AS line, length(regexp_extract(x[i], '^\s*(#{{1,6}})\s+(.*)$', 1)) AS level FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, string_split({_HEADED}, chr(10)) AS x FROM documents))),
s AS (SELECT *, count(*) FILTER (WHERE level > 0) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM l),
t AS (SELECT *, CASE WHEN section > 0 THEN section + least(0, min(CASE WHEN level > 0 THEN level - section END) OVER (PARTITION BY doc_id ORDER BY i)) ELSE 0 END AS deep, CASE WHEN level > 0 THEN trim(regexp_extract(line, '^\s*(#{{1,6}})\s+(.*)$', 2)) END AS title FROM s),
p AS (SELECT *, {', '.join(f"CASE WHEN deep >= {k} THEN last_value(CASE WHEN deep = {k} THEN title END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) END AS t{k}" for k in range(1, 5))} FROM t),
g AS (SELECT doc_id, section, regexp_replace(string_agg(line, chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text, max(concat_ws(' / ', t1, t2, t3, t4)) AS path FROM p GROUP BY 1, 2)
SELECT doc_id, row_number() OVER w - 1 AS seq, text, CAST(coalesce(sum(length(text) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset, CASE WHEN path <> '' THEN path END AS heading_path FROM g WHERE text <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY section)""")
def markdown_sections(spark, sf_dir):
    """Documents with short lines made headings."""
    short = lambda x: F.length(F.trim(x)).between(1, 40)
    made = lambda x: F.when(short(x), F.concat(F.repeat(F.lit("#"), 1 + F.length(x) % 4), F.lit(" "), F.trim(x))).otherwise(x)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), made), "\n").alias("text"))
    return markdown.markdown_sections(docs).select("doc_id", "seq", "text", "start_offset", "heading_path")


@query(r"""SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS expanded, len(regexp_extract_all(text, '\[\d+\]')) AS refs, text || chr(10) || '关键词：' || source || '；' || lang AS body FROM documents""")
def text_fields(spark, sf_dir):
    c = F.col("text")
    body = T.keyword_text(c, F.array("source", "lang"), F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.expand_colloquial(c).alias("expanded"), big(F.size(T.cited_references(c))).alias("refs"), body.alias("body"))
