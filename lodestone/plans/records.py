"""Queries of record operators, merges and traces, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merging, records, retrieval
from .queries import _KEYWORD_SQL as KEYWORD_SQL
from .queries import big, query, table


@query("""SELECT event_id, user_id, event_type, previous FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events) WHERE event_type = 'purchase'""")
def preceding_views(spark, sf_dir):
    rows = records.last_before(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], F.col("event_id"), F.col("event_type") == "view")
    return rows.filter("event_type = 'purchase'").select("event_id", "user_id", "event_type", "previous")


@query("""SELECT conv_id, CASE WHEN length(b) > 300 THEN b[1:300] || '…' ELSE b END AS body FROM (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY p) AS b FROM
(SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p <= 4) WHERE run < 300 GROUP BY conv_id)""")
def leading_turns(spark, sf_dir):
    return records.leading_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), 4, 300)


@query("""SELECT d.doc_id FROM documents d JOIN (SELECT text, min(doc_id) AS m FROM documents GROUP BY text) USING (text) WHERE d.doc_id > m""")
def repeated_rows(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    return records.repeats(docs, ["sha"], "doc_id").select("doc_id")


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'disabled' ELSE 'updated' END AS state FROM (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity < 3) a FULL JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48) b ON a.k = b.k""")
def synced_keys(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), "l_quantity")
    return records.merged_by_key(items.filter("l_quantity < 3").select("k").distinct(), items.filter("l_quantity > 48").select("k").distinct(), "k")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CAST(least(greatest(CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'R' THEN 0 ELSE CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END END, 0), 2) AS INTEGER) AS grade,
(l_returnflag = 'R' AND l_tax > 0.05) OR least(greatest(CASE WHEN l_returnflag = 'A' THEN 3 WHEN l_returnflag = 'R' THEN 0 ELSE CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END END, 0), 2) >= 1 AS relevant FROM lineitem""")
def graded_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    keyed = rows.withColumn("query_id", F.col("l_orderkey")).withColumn("index", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"))
    candidates = keyed.select("query_id", "index", F.col("l_discount").alias("score"))
    given = keyed.filter("l_returnflag IN ('A', 'R')").select("query_id", "index", F.when(F.col("l_returnflag") == "A", 3).otherwise(0).alias("grade"), ((F.col("l_returnflag") == "R") & (F.col("l_tax") > 0.05)).alias("relevant"))
    found = records.graded(candidates, given, 0.05)
    return found.select(F.col("query_id").alias("l_orderkey"), "index.l_linenumber", "index.l_partkey", "grade", "relevant")


@query("""SELECT DISTINCT ON (k) k, source, v FROM (SELECT l_partkey AS k, 0 AS source, l_orderkey AS v FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_partkey, 1, l_orderkey FROM lineitem WHERE l_linenumber = 2) ORDER BY k, source, v""")
def ordered_union(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("v"), "l_linenumber")
    part = lambda n: items.filter(F.col("l_linenumber") == n).select("k", "v")
    return records.ordered_union(part(1), part(2), ["k"], "v").select("k", "source", "v")


@query("""SELECT c_custkey AS k, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def zero_filled_counts(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return records.counts_with_zeros(names, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("""SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem WHERE l_partkey <> l_suppkey AND l_partkey IN (SELECT s_suppkey FROM supplier) AND l_suppkey IN (SELECT s_suppkey FROM supplier)""")
def undirected_pairs(spark, sf_dir):
    nodes = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return records.undirected(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")), nodes)


@query("""SELECT o_orderkey, round(CASE o_orderstatus WHEN 'F' THEN 40.0 WHEN 'O' THEN 5.0 ELSE 95.0 END + CASE o_orderstatus WHEN 'F' THEN 55.0 WHEN 'O' THEN 35.0 ELSE 5.0 END * least(greatest(o_totalprice / 200000, 0), 1), 2) AS percent FROM orders""")
def phase_percents(spark, sf_dir):
    spans = {"F": (40.0, 95.0), "O": (5.0, 40.0), "P": (95.0, 100.0)}
    return table(spark, sf_dir, "orders").select("o_orderkey", records.phase_percent(F.col("o_orderstatus"), F.col("o_totalprice"), F.lit(200000.0), spans).alias("percent"))


@query("""SELECT doc_id, source, round(CAST(coalesce(CASE WHEN quality = 1 THEN 0.9 END, greatest(0.1, 1 - 0.05 * (p - 1))) AS DOUBLE), 6) AS score FROM (SELECT d.doc_id, source, quality, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS p FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""")
def falling_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.9).alias("known")), "doc_id", "left")
    return records.falling_scores(docs, "source", "doc_id", ["known"]).select("doc_id", "source", F.round(F.col("score").cast("double"), 6).alias("score"))


@query("""SELECT o_orderkey, o_custkey, (count(*) OVER (PARTITION BY o_custkey) - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + 1) / count(*) OVER (PARTITION BY o_custkey) AS score FROM orders""")
def pseudo_ranks(spark, sf_dir):
    return records.pseudo_ranks(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "o_custkey", "score")


@query("""SELECT CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1""")
def property_counts(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy(k.alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT doc_id, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND (text ILIKE '%the%' OR source ILIKE '%1%') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 20""")
def document_page(spark, sf_dir):
    from ..operators import lifecycle

    rows = table(spark, sf_dir, "documents").filter(F.col("lang").isin("en", "de") & (F.col("text").ilike("%the%") | F.col("source").ilike("%1%")))
    return lifecycle.page(rows, 2, 20, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "source", "n_chars")


@query("""SELECT o_orderkey, c_custkey, tier FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY tier, c_custkey) AS p FROM
(SELECT o_orderkey, c_custkey, 0 AS tier FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 UNION ALL
SELECT o_orderkey, c_custkey, 1 FROM orders JOIN customer ON o_custkey + 1 = c_custkey WHERE c_acctbal > 0)) WHERE p = 1""")
def first_matches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_custkey") + 1).alias("b"))
    names = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey")
    return records.first_match(orders, names, [("a", "c_custkey"), ("b", "c_custkey")], "o_orderkey", F.col("c_custkey")).select("o_orderkey", "c_custkey", "tier")


def _hits(spark, sf_dir):
    """The benchmark's hits among the documents of sources (collections), where long texts stand for those of images."""
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    about = docs.select(F.col("doc_id").alias("chunk_id"), "source", F.col("text").alias("content"), "n_chars")
    found = retrieval.keyword_search(chunks, items, 40).join(about, "chunk_id")
    return found.select(
        "query_id",
        F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("kb_id"),
        F.when(F.col("source") == "src0", "graph").otherwise("classic").alias("kb_type"),
        F.col("chunk_id").alias("uid"),
        "score",
        F.hash("source").cast("long").alias("document_id"),
        "content",
        (F.col("n_chars") > 5000).alias("is_image"),
        F.col("rank").alias("ord"),
    )


#: The hits of the benchmark among documents, and a fold over `hit` (query_id, uid, score, ord, source, image, bare) that
#: keeps LIMIT rows of each query at most.
_HITS_SQL = KEYWORD_SQL.replace("WITH", "WITH RECURSIVE", 1) + r""",
about AS (SELECT query_id, chunk_id AS uid, score, rank AS ord, source, n_chars > 5000 AS image, regexp_replace(text, '\s+', '', 'g') AS bare FROM best JOIN documents ON doc_id = chunk_id WHERE rank <= 40)"""
_KEPT_SQL = r"""fold AS (SELECT DISTINCT query_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(uid BIGINT, score DOUBLE, ord BIGINT, source VARCHAR, image BOOLEAN, bare VARCHAR)[]) AS kept FROM hit
UNION ALL SELECT query_id, i, CASE WHEN len(kept) >= LIMIT THEN kept WHEN twin IS NULL THEN list_append(kept, me) WHEN kept[twin].image AND NOT me.image THEN list_concat(list_append(kept[: twin - 1], me), kept[twin + 1 :]) ELSE kept END
FROM (SELECT f.query_id, h.ord AS i, f.kept, {'uid': h.uid, 'score': h.score, 'ord': h.ord, 'source': h.source, 'image': h.image, 'bare': h.bare} AS me,
list_min(list_filter(range(1, len(f.kept) + 1), lambda j: f.kept[j].source = h.source AND least(length(f.kept[j].bare), length(h.bare)) > 0 AND
CASE WHEN contains(f.kept[j].bare, h.bare) OR contains(h.bare, f.kept[j].bare) THEN least(length(f.kept[j].bare), length(h.bare))
WHEN least(length(f.kept[j].bare), length(h.bare), 120) >= 40 AND f.kept[j].bare[1 : least(length(f.kept[j].bare), length(h.bare), 120)] = h.bare[1 : least(length(f.kept[j].bare), length(h.bare), 120)] THEN least(length(f.kept[j].bare), length(h.bare), 120) ELSE 0 END
/ greatest(length(f.kept[j].bare), length(h.bare)) >= 0.72)) AS twin FROM fold f JOIN hit h ON h.query_id = f.query_id AND h.ord = f.i + 1)),
kept AS (SELECT query_id, k.uid AS uid, k.score AS score, k.ord AS ord FROM (SELECT query_id, unnest(kept) AS k FROM (SELECT query_id, arg_max(kept, i) AS kept FROM fold GROUP BY 1)))"""


@query(_HITS_SQL + ", hit AS (SELECT * FROM about), " + _KEPT_SQL.replace("LIMIT", "10") + " SELECT query_id, uid, score, ord FROM kept")
def deduped_hits(spark, sf_dir):
    return merging.dedupe(_hits(spark, sf_dir), 10).select("query_id", "uid", F.round("score", 6).alias("score"), big("ord").alias("ord"))


@query(_HITS_SQL + """, scored AS (SELECT *, CAST(regexp_extract(source, '[0-9]+') AS INT) AS kb_id, CASE WHEN source = 'src0' THEN 'graph' ELSE 'classic' END AS kb_type,
CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS m FROM about WINDOW w AS (PARTITION BY query_id, source)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY m DESC, uid) = 1 AS first FROM scored),
typed AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_type ORDER BY first, m DESC, kb_id, uid) AS within, count(*) FILTER (WHERE first) OVER (PARTITION BY query_id, kb_type) AS held,
min(kb_type) OVER (PARTITION BY query_id) < max(kb_type) OVER (PARTITION BY query_id) AS several FROM placed),
tiered AS (SELECT *, CASE WHEN first THEN 0 WHEN several AND within <= 2 - held THEN 1 ELSE 2 END AS tier FROM typed),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 0 THEN kb_id ELSE 0 END, m DESC, kb_id, uid) AS place FROM tiered),
hit AS (SELECT * EXCLUDE (ord), row_number() OVER (PARTITION BY query_id ORDER BY m DESC, place) AS ord FROM chosen WHERE place <= 8), """ + _KEPT_SQL.replace("LIMIT", "8") + """
SELECT query_id, kb_id, kb_type, uid, round(m, 6) AS merge_score FROM kept JOIN scored USING (query_id, uid)""")
def merged_collections(spark, sf_dir):
    merged = merging.merge_collections(_hits(spark, sf_dir), 8)
    return merged.select("query_id", "kb_id", "kb_type", "uid", F.round("merge_score", 6).alias("merge_score"))
