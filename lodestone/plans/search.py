"""Queries of search terms, gates and labels, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import search as S
from ..operators import chunking, lifecycle, retrieval, segments
from .queries import LINES_SQL, big, query, table


@query(r"""SELECT item_id, list_sort(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{2,}'))) AS terms, CAST(CASE WHEN n <= 2 THEN 1 ELSE least(3, greatest(2, n // 4)) END AS BIGINT) AS least_matches
FROM (SELECT *, len(list_distinct(regexp_extract_all(text, '[A-Za-z0-9]{2,}'))) AS n FROM benchmark)""")
def search_terms(spark, sf_dir):
    terms = S.expanded_terms(S.search_terms(F.col("text")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_sort(terms).alias("terms"), S.least_matches(terms).alias("least_matches"))


@query(r"""SELECT doc_id, CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) = 0 THEN 'empty' WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 5000 THEN 'too long' END AS refused, CAST(0 AS DOUBLE) AS cjk FROM documents""")
def indexing_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.indexable(F.col("text"), 5000).alias("refused"), S.cjk_share(F.col("text")).cast("double").alias("cjk"))


@query(r"""SELECT page_id, len(list_filter(x, lambda l: trim(l) <> '' AND regexp_full_match(trim(l), '!\[[^\]]*\]\([^)]*\)'))) / greatest(len(list_filter(x, lambda l: trim(l) <> '')), 1) AS share FROM (SELECT page_id, string_split(html, chr(10)) AS x FROM pages)""")
def placeholder_shares(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.placeholder_share(F.col("html")).alias("share"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_type = 'ECONOMY' THEN '表格' WHEN p_size > 1 THEN printf('第 %d 页', p_size) END AS label FROM part""")
def location_labels(spark, sf_dir):
    path = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_type"), F.lit(" / "), F.col("p_brand"), F.lit(" / ")))
    block = F.when(F.col("p_type") == "ECONOMY", "table").otherwise("text")
    return table(spark, sf_dir, "part").select("p_partkey", S.location_label(path, block, F.col("p_size")).alias("label"))


@query("""SELECT doc_id, CASE WHEN contains(text, source[1:24]) THEN text ELSE source || chr(10) || chr(10) || text END AS body FROM documents""")
def prefixed_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.with_prefix(F.col("text"), F.col("source")).alias("body"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN ' ' ELSE s END AS prepared FROM (SELECT page_id, regexp_replace(html, '^\s+|\s+$', '', 'g')[1:8192] AS s FROM pages)""")
def embedding_texts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.prepared_for_embedding(F.col("html")).alias("prepared"))


@query("""SELECT c_custkey, c_name[1:12] || '__deleted' AS name FROM customer""")
def deleted_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", S.suffixed_name(F.col("c_name"), "__deleted", 21).alias("name"))


@query("""SELECT d.doc_id, c.doc_id IS NOT NULL AS hit FROM documents d LEFT JOIN (SELECT DISTINCT text, min(doc_id) AS doc_id FROM documents WHERE lang = 'en' AND n_chars > 500 GROUP BY text) c USING (text)""")
def cache_hits(spark, sf_dir):
    from ..functions.text import cache_key

    docs = table(spark, sf_dir, "documents").withColumn("key", cache_key(F.lit(1), F.col("text")))
    cache = docs.filter("lang = 'en'").select("key", F.lit(10).alias("expires_at"), F.when(F.col("n_chars") > 500, 64).otherwise(32).alias("width"))
    return lifecycle.cache_lookup(docs.select("doc_id", "key"), cache, F.lit(5), F.lit(64)).select("doc_id", "hit")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END, CASE WHEN c_acctbal > 0 THEN c_nationkey END, r_regionkey) AS model FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def resolved_models(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    override = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey"))
    own = F.when(F.col("c_acctbal") > 0, F.col("c_nationkey"))
    return rows.select("o_orderkey", big(F.coalesce(override, own, "r_regionkey")).alias("model"))


@query("""WITH p AS (SELECT o_custkey % 100 AS q, avg(CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN o_totalprice > 80000 THEN 1.0 ELSE 0.0 END) AS a, count(*) AS n FROM orders GROUP BY 1)
SELECT q, round(b, 4) AS baseline, round(a, 4) AS agentic, round(a - b, 4) AS gain, n FROM p""")
def paired_rates(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 100).alias("q"), "o_totalprice")
    rate = lambda cut, name: rows.groupBy("q").agg(F.avg(F.when(F.col("o_totalprice") > cut, 1.0).otherwise(0.0)).alias(name), F.count("*").alias("n"))
    both = rate(100000, "b").join(rate(80000, "a").drop("n"), "q")
    return both.select("q", F.round("b", 4).alias("baseline"), F.round("a", 4).alias("agentic"), F.round(F.col("a") - F.col("b"), 4).alias("gain"), "n")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity = floor(l_quantity) AND length(l_returnflag) > 0 AS header FROM lineitem""")
def header_rows(spark, sf_dir):
    cells = F.array(F.col("l_returnflag"), F.col("l_linestatus"))
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", S.plausible_header(cells).alias("header"))


@query("""SELECT query_id, vec_id, source, round(s, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM
(SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0))
JOIN documents ON doc_id = vec_id WHERE rank <= 10 AND lang = 'en'""")
def vector_then_join(spark, sf_dir):
    """Filters come after the top k, so fewer than k rows may be left."""
    found = retrieval.vector_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
    docs = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source")
    return found.join(docs, "vec_id").select("query_id", "vec_id", "source", F.round("score", 6).alias("score"), big("rank").alias("rank"))


def _segments(spark, sf_dir):
    """The lines of each document. Whole texts are dealt by document, which serves all windows to come: lines aren't shuffled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    rows = chunking.split_segments(docs, "\n").withColumnRenamed("segment", "text")
    return rows.select("doc_id", "seq", "text", F.when(F.length("text") < 30, "heading").alias("block"), (F.col("seq") / 20).cast("int").alias("page_no"), F.lit(None).cast("string").alias("heading_path"), "start_offset", "end_offset")


@query(f"""WITH RECURSIVE line AS (SELECT doc_id, seq, segment AS t, length(segment) AS n, length(segment) < 30 AS head, CAST(floor(seq / 20) AS INT) AS page_no, start_offset, end_offset FROM ({LINES_SQL})),
pack AS (SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS seq, CAST(-1 AS BIGINT) AS g, CAST(0 AS BIGINT) AS used, CAST(NULL AS INT) AS page_no FROM line
UNION ALL SELECT doc_id, seq, CASE WHEN joins THEN g ELSE g + 1 END, CASE WHEN joins THEN used + 2 + n WHEN n >= 512 AND NOT head THEN 0 ELSE n END, page_no
FROM (SELECT l.*, p.g, p.used, p.used > 0 AND NOT l.head AND l.page_no IS NOT DISTINCT FROM p.page_no AND p.used + 2 + l.n <= 512 AS joins FROM pack p JOIN line l ON l.doc_id = p.doc_id AND l.seq = p.seq + 1))
SELECT doc_id, min(seq) AS seq, string_agg(t, chr(10) || chr(10) ORDER BY seq) AS text, min(start_offset) AS start_offset, max(end_offset) AS end_offset, count(*) AS merged, CASE WHEN arg_min(head, seq) THEN 'heading' END AS block, max(line.page_no) AS page_no, CAST(NULL AS VARCHAR) AS heading_path
FROM line JOIN pack USING (doc_id, seq) GROUP BY doc_id, g""")
def budget_merged_segments(spark, sf_dir):
    return segments.merge_by_budget(_segments(spark, sf_dir), 512)


@query()
def headed_segments(spark, sf_dir):
    return segments.merge_orphan_headings(segments.merge_preamble(_segments(spark, sf_dir)))
