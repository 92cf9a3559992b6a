"""Queries of stored versions, running totals, stitched texts and tailed logs, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import chunking, ordered
from ..operators.embedding import hashing_provider
from ..operators.store import ChunkStore, RuleError
from ..operators.written import folder
from ..streaming import logs
from .queries import big, query, table


@query("""WITH base AS (SELECT o_custkey AS document_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS chunk_index, 'u' || o_orderkey AS chunk_uid, o_orderstatus || ' ' || o_orderkey AS content, o_orderkey, o_totalprice FROM orders),
anew AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY o_orderkey) - 1 AS chunk_index, chunk_uid, 'anew ' || content AS content, o_orderkey FROM base WHERE document_id % 3 = 0 AND o_totalprice > 100000),
now AS (SELECT document_id, chunk_index, chunk_uid, content, o_orderkey, 2 AS v FROM anew UNION ALL SELECT document_id, chunk_index, chunk_uid, content, o_orderkey, 1 FROM base WHERE document_id NOT IN (SELECT document_id FROM anew)),
edited AS (SELECT *, o_orderkey % 7 = 0 AS e FROM now), touched AS (SELECT document_id FROM edited GROUP BY document_id HAVING bool_or(e))
SELECT document_id, chunk_index, chunk_uid, content || CASE WHEN e THEN chr(10) || '关键词：k' || o_orderkey % 5 || '；订单' ELSE '' END AS keyword_text, CAST(CASE WHEN document_id IN (SELECT document_id FROM touched) THEN 3 ELSE v END AS BIGINT) AS version FROM edited WHERE document_id % 10 <> 4""")
def stored_chunks(spark, sf_dir):
    """Orders as chunks of customers' documents: written, in part overwritten, edited, in part removed, and read back."""
    store = ChunkStore(spark, folder(spark, f"store-{uuid.uuid4().hex}"))
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("kb_id"), F.col("o_custkey").alias("document_id"), "o_orderkey", "o_totalprice", F.concat(F.lit("u"), "o_orderkey").alias("chunk_uid"), F.concat_ws(" ", "o_orderstatus", "o_orderkey").alias("content"), place.alias("chunk_index"))
    ready = lambda r: r.select("kb_id", "document_id", "chunk_index", "chunk_uid", "content", F.col("content").alias("keyword_text"), F.array(F.lit(1.0)).alias("embedding"))
    store.overwrite(ready(rows), "first")
    anew = rows.filter("document_id % 3 = 0 AND o_totalprice > 100000").withColumns({"content": F.concat(F.lit("anew "), "content"), "chunk_index": F.row_number().over(W.partitionBy("document_id").orderBy("o_orderkey")) - 1})
    store.overwrite(ready(anew), "second")
    store.overwrite(ready(anew), "second")  # a repeated batch changes nothing
    edits = rows.filter("o_orderkey % 7 = 0").select("chunk_uid", F.array(F.concat(F.lit("k"), F.col("o_orderkey") % 5), F.lit(" 订单 "), F.lit("")).alias("keywords"), F.array().cast("array<string>").alias("questions"))
    store.edit(edits, hashing_provider(8))
    store.remove(rows.filter("document_id % 10 = 4").select("document_id"))
    return store.read().select("document_id", big("chunk_index").alias("chunk_index"), "chunk_uid", "keyword_text", big("version").alias("version"))


@query("""SELECT 'chunk_uid' AS rule, '{"chunk_uid":"' || l_orderkey || '-' || l_linenumber || '"}' AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'document_id,chunk_index', '{"document_id":' || l_suppkey || ',"chunk_index":' || l_orderkey || '}', count(*) FROM lineitem GROUP BY l_suppkey, l_orderkey HAVING count(*) > 1""")
def broken_rules(spark, sf_dir):
    """Order lines under keys that some share: the write is refused, and the broken rules are its result."""
    store = ChunkStore(spark, folder(spark, f"store-{uuid.uuid4().hex}"))
    rows = table(spark, sf_dir, "lineitem").select(F.lit(1).alias("kb_id"), F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("chunk_index"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("chunk_uid"))
    try:
        store.overwrite(rows)
    except RuleError as e:
        return spark.read.parquet(e.table).select("rule", "key", "n")
    return spark.createDataFrame([], "rule string, key string, n long")


_MOST, _PIECE = 50_000, 88
_END = "coalesce(" + ", ".join(f"CASE WHEN strpos(reverse(w), reverse({m})) > 0 AND length(w) - strpos(reverse(w), reverse({m})) - length({m}) + 1 >= 29 THEN length(w) - strpos(reverse(w), reverse({m})) + 1 END" for m in ("chr(10) || chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'；'", "'，'", "'、'", "';'", "','", "' '")) + ", length(w))"


@query(rf"""WITH RECURSIVE line AS (SELECT doc_id, i - 1 AS seq, regexp_replace(t, '^\s+|\s+$', '', 'g') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
child AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS seq, t FROM line WHERE t <> ''),
cut AS (SELECT doc_id, seq, t AS rest, '' AS piece, 0 AS k FROM child UNION ALL SELECT doc_id, seq, rest[size + 1:], regexp_replace(rest[1 : size], '^\s+|\s+$', '', 'g'), k + 1
FROM (SELECT *, CASE WHEN length(rest) <= {_PIECE} THEN length(rest) ELSE {_END} END AS size FROM (SELECT *, rest[1 : {_PIECE}] AS w FROM cut WHERE rest <> ''))),
piece AS (SELECT doc_id, seq, seq // 5 AS parent_index, k, piece AS content FROM cut WHERE k > 0 AND piece <> '')
SELECT doc_id, parent_index, chunk_index, content, length(content) AS char_count FROM (SELECT *, row_number() OVER (ORDER BY doc_id, parent_index, seq, k) - 1 AS chunk_index FROM piece) WHERE chunk_index < {_MOST}""")
def preview_pieces(spark, sf_dir):
    """Lines of documents as children of parents of five: the first pieces of all, numbered through."""
    rows = chunking.split_segments(table(spark, sf_dir, "documents"), "\n").withColumnRenamed("segment", "text")
    return ordered.preview_groups(rows.withColumn("parent_index", F.floor(F.col("seq") / 5)), _MOST, _PIECE)


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text ELSE list_aggregate(list_transform(range(0, length(text), 40), lambda s: text[s + 1 : s + 30]), 'string_agg', chr(10)) END AS text,
CASE WHEN doc_id % 2 = 0 THEN 0 ELSE (length(text) - 1) // 40 END AS gaps, CASE WHEN doc_id % 2 = 0 THEN length(text) ELSE (length(text) - 1) // 40 * 30 + least(30, (length(text) - 1) % 40 + 1) END AS covered FROM documents WHERE text <> ''""")
def stitched_texts(spark, sf_dir):
    """Documents cut into chunks that overlap, or leave gaps, and put together again."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    parts = docs.select("doc_id", F.regexp_extract_all("text", F.lit("(?s).{1,40}"), F.lit(0)).alias("parts"))  # each text is read once, not once a chunk
    longer = F.zip_with("parts", F.slice("parts", 2, F.greatest(F.size("parts"), F.lit(1))), lambda a, b: F.concat(a, F.coalesce(F.substring(b, 1, 20), F.lit(""))))
    chunks = F.when(F.col("doc_id") % 2 == 0, longer).otherwise(F.transform("parts", lambda a: F.substring(a, 1, 30)))
    rows = parts.select("doc_id", F.posexplode(chunks).alias("at", "content"))
    return ordered.stitched(rows.select("doc_id", (F.col("at") * 40).alias("start_offset"), "content"))


@query(r"""WITH snap AS (SELECT CAST(o_custkey AS VARCHAR) AS log, o_orderkey AS "at", CAST(floor(o_totalprice) AS BIGINT) % 12 AS n FROM orders),
told AS (SELECT *, coalesce(lag(n) OVER (PARTITION BY log ORDER BY "at", n), 0) AS b FROM snap)
SELECT log, "at", i AS line, 'line ' || i AS text, n < b AS reset FROM (SELECT *, unnest(range(CASE WHEN n < b THEN 0 ELSE b END, n)) AS i FROM told)""")
def tailed_lines(spark, sf_dir):
    """Snapshots of customers' logs, one for each order."""
    n = (F.floor("o_totalprice") % 12).cast("int")
    lines = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat(F.lit("line "), i)))
    return logs.tailed(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("at"), lines.alias("lines")))
