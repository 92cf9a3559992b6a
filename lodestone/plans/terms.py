"""Queries of Chinese question terms, anchored scores, image roles and guards, with their DuckDB SQL.

The tables hold no Chinese text; questions and passages are made from keys, alike in both languages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import terms as Q
from ..functions.text import CJK, dominant_identifier
from ..operators import fusion, retrieval, roles
from .queries import big, query, table

QUESTIONS = (
    "新生儿医保如何办理",
    "落户怎么办",
    "杀了人判刑吗",
    "请问 正当防卫需要什么",
    "YZ0000000QR13010003",
    "医保",
    "居住证申请 A12",
    "abc 什么",
    "对方可以防御吗",
    "",
)
PASSAGES = (
    "城乡居民参保登记（新生儿）需在出生后办理医保参保手续。",
    "医保基金结算政策规定如下",
    "事项编号：YZ0000000QR13010003",
    "新生儿落户所需材料",
    "杀人者处有期徒刑，防卫过当除外",
    "居住证 A12 号窗口 abc",
)


def _sql_list(xs) -> str:
    return "[" + ", ".join(f"'{x}'" for x in xs) + "]"


def _picked(key: str, xs: tuple[str, ...], divisor: int = 1):
    return F.get(F.array(*map(F.lit, xs)), ((F.col(key) / divisor).cast("int") % len(xs)).cast("int"))


def _asked(spark, sf_dir) -> DataFrame:
    """A question and a passage for each part."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), _picked("p_partkey", QUESTIONS).alias("q"), _picked("p_size", PASSAGES).alias("t"))


_RUNS = f"regexp_extract_all(q, '{CJK}{{2,}}')"
_PEELED = reduce(lambda x, t: f"replace({x}, '{t}', '|')", sorted(Q.TEMPLATES, key=len, reverse=True), "r")
_TOKENS = r"list_filter(string_split_regex(trim(q), '\s+'), lambda x: length(x) >= 2 AND regexp_matches(x, '[A-Za-z0-9]'))"
_IDLE = _sql_list((*Q.TEMPLATES, *Q.NOISE, *Q.LOW_VALUE))
_LAYERS_SQL = f"""asked AS (SELECT CAST(p_partkey AS BIGINT) AS id, {_sql_list(QUESTIONS)}[p_partkey % {len(QUESTIONS)} + 1] AS q, {_sql_list(PASSAGES)}[p_size % {len(PASSAGES)} + 1] AS t FROM part),
one AS (SELECT *, list_distinct(list_filter(flatten(list_transform({_RUNS}, lambda r: string_split({_PEELED}, '|'))), lambda p: length(p) >= 2)) AS parts,
 flatten(list_transform({_RUNS}, lambda r: list_transform(range(1, length(r)), lambda i: r[i : i + 1]))) AS pairs FROM asked),
two AS (SELECT *, list_filter(list_distinct(list_concat(list_concat(parts, flatten(list_transform(parts, lambda p: CASE WHEN length(p) >= 4 THEN list_concat([p[1:3], p[-2:]], CASE WHEN length(p) = 4 THEN [p[1:2]] ELSE [] END) WHEN length(p) = 3 THEN [p[1:2], p[-2:]] ELSE [] END))), {_TOKENS})),
 lambda a: NOT list_contains({_sql_list(Q.TEMPLATES)}, a)) AS anchors FROM one),
layers AS (SELECT id, q, t, anchors, CASE WHEN len(parts) > 0 THEN parts ELSE anchors END AS required, list_distinct(list_filter(pairs, lambda p: NOT list_contains({_IDLE}, p) AND NOT list_contains(anchors, p))) AS auxiliaries FROM two)"""


def _hit_sql(term: str, text: str = "t") -> str:
    others = " OR ".join(f"({term} = '{k}' AND ({' OR '.join(f'''contains({text}, '{x}')''' for x in v)}))" for k, v in Q.ALIASES.items())
    return f"(contains({text}, {term}) OR {others})"


_WEIGHT_SQL = f"""CASE WHEN list_contains({_sql_list(Q.NOISE)}, a) THEN 0.0 WHEN regexp_full_match(a, '{CJK}+') THEN CASE WHEN length(a) >= 5 THEN 3.0 WHEN length(a) = 4 THEN 2.5 WHEN length(a) = 3 THEN 2.0 ELSE 1.5 END
 WHEN regexp_matches(a, '[A-Za-z0-9]') THEN CASE WHEN length(a) >= 6 THEN 4.0 ELSE 1.2 END ELSE 1.0 END"""
_MEETS_SQL = f"""(len(required) = 0 OR len(list_filter(required, lambda p: {_hit_sql('p')} AND length(p) < 5 AND length(p) <> 4 AND length(p) <> 3 OR (length(p) >= 5 AND {_hit_sql('p[1:3]')}) OR (length(p) >= 5 AND {_hit_sql('p')})
 OR (length(p) = 4 AND ({_hit_sql('p')} OR {_hit_sql('p[1:2]')} OR {_hit_sql('p[-2:]')})) OR (length(p) = 3 AND ({_hit_sql('p')} OR {_hit_sql('p[1:2]')})))) > 0)"""
_SCORE_SQL = f"""round(CASE WHEN len(anchors) = 0 OR NOT {_MEETS_SQL} THEN 0.0 ELSE CAST(coalesce(list_sum(list_transform(anchors, lambda a: CASE WHEN {_hit_sql('a')} THEN {_WEIGHT_SQL} ELSE 0.0 END)), 0)
 + coalesce(list_sum(list_transform(auxiliaries, lambda a: CASE WHEN {_hit_sql('a')} THEN 0.45 ELSE 0.0 END)), 0) AS DOUBLE) END, 6)"""


@query(f"WITH {_LAYERS_SQL} SELECT id, list_sort(anchors) AS anchors, list_sort(required) AS required, list_sort(auxiliaries) AS auxiliaries FROM layers")
def question_layers(spark, sf_dir):
    rows = _asked(spark, sf_dir).select("id", Q.term_layers(F.col("q")).alias("l"))
    return rows.select("id", *(F.array_sort(f"l.{c}").alias(c) for c in ("anchors", "required", "auxiliaries")))


@query(f"WITH {_LAYERS_SQL} SELECT id, {_MEETS_SQL} AS meets, {_SCORE_SQL} AS score FROM layers")
def layered_scores(spark, sf_dir):
    rows = _asked(spark, sf_dir).withColumn("l", Q.term_layers(F.col("q")))
    meets = (F.size("l.required") == 0) | F.exists(F.flatten(F.transform("l.required", Q.accepted_parts)), lambda s: F.contains(F.col("t"), s))
    return rows.select("id", meets.alias("meets"), F.round(Q.layered_score(F.col("t"), F.col("l")), 6).alias("score"))


_FLAT_SQL = f"""CASE WHEN list_contains({_sql_list(Q.NOISE)}, a) THEN 0.0 WHEN list_contains({_sql_list(Q.LOW_VALUE)}, a) THEN 0.35 WHEN regexp_full_match(a, '{CJK}+') THEN CASE WHEN length(a) >= 4 THEN 2.5 WHEN length(a) = 3 THEN 2.0 WHEN length(a) = 2 THEN 1.5 ELSE 1.0 END
 WHEN regexp_matches(a, '[A-Za-z0-9]') THEN 1.2 ELSE 1.0 END"""


@query(f"""WITH {_LAYERS_SQL} SELECT id, list_sort(f) AS terms, round(CAST(coalesce(list_sum(list_transform(f, lambda a: CASE WHEN {_hit_sql('a')} THEN {_FLAT_SQL} ELSE 0.0 END)), 0) AS DOUBLE), 6) AS score
FROM (SELECT *, list_distinct(list_concat(anchors, auxiliaries)) AS f FROM layers)""")
def fallback_scores(spark, sf_dir):
    rows = _asked(spark, sf_dir).withColumn("f", Q.fallback_terms(F.col("q")))
    return rows.select("id", F.array_sort("f").alias("terms"), F.round(Q.flat_score(F.col("t"), F.col("f")), 6).alias("score"))


@query(f"""WITH {_LAYERS_SQL}, p AS (SELECT id AS chunk_id, t || ' ' || id AS t FROM asked), asks AS (SELECT id AS query_id, q, anchors, required, auxiliaries FROM layers WHERE id <= {len(QUESTIONS)}),
s AS (SELECT query_id, chunk_id, {_SCORE_SQL} AS score FROM asks, p)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5""")
def anchored_top(spark, sf_dir):
    """The best passages of each question; ten questions, one of each kind."""
    rows = _asked(spark, sf_dir)
    chunks = rows.select(F.col("id").alias("chunk_id"), F.concat_ws(" ", "t", "id").alias("text"))
    asks = rows.filter(F.col("id") <= len(QUESTIONS)).select(F.col("id").alias("query_id"), F.col("q").alias("text"))
    found = retrieval.keyword_search(chunks, asks, 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), big("rank").alias("rank"))


# --- identifiers, image roles and guards -----------------------------------------------------------------------------

_IDENT_SQL = """rows0 AS (SELECT l_suppkey AS query_id, l_orderkey * 10 + l_linenumber AS uid, max(l_quantity / 50) AS v, bool_or(l_partkey % 10 = l_suppkey % 10) AS held FROM lineitem GROUP BY 1, 2),
vec AS (SELECT *, row_number() OVER w AS ord, max(v) OVER (PARTITION BY query_id) AS best, count(*) OVER (PARTITION BY query_id) AS many FROM rows0 WINDOW w AS (PARTITION BY query_id ORDER BY v DESC, uid))"""


@query(f"WITH {_IDENT_SQL} SELECT query_id, uid, v AS score, held FROM vec WHERE v > 0 AND (held OR (ord <= greatest(3, many // 4) AND v >= best * 0.55))")
def identifier_hits(spark, sf_dir):
    """Vector hits that pass the gate, or hold the identifier that the query asks for."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("uid"), (F.col("l_quantity") / 50).alias("v"), (F.col("l_partkey") % 10 == F.col("l_suppkey") % 10).alias("h"))
    rows = rows.groupBy("query_id", "uid").agg(F.max("v").alias("score"), F.bool_or("h").alias("ident_hit"))
    ranked = rows.withColumn("ord", F.row_number().over(fusion.W.partitionBy("query_id").orderBy(F.desc("score"), "uid")))
    return fusion.vector_gate(ranked).select("query_id", "uid", "score", F.col("ident_hit").alias("held"))


@query(f"""WITH asked AS (SELECT CAST(p_partkey AS BIGINT) AS id, {_sql_list(QUESTIONS)}[p_partkey % {len(QUESTIONS)} + 1] AS q, p_size / 10 AS k, p_retailprice / 2500 AS v, p_size % 4 = 0 AS boosted, p_size % 7 = 0 AS bare FROM part)
SELECT id, bare OR k = 0 OR k >= CASE WHEN len(list_filter(string_split_regex(trim(q), '\\s+'), lambda x: length(x) >= 6 AND regexp_full_match(x, '[A-Za-z0-9][A-Za-z0-9_-]*'))) > 0 THEN 1.0 ELSE 3.0 END
 OR boosted OR (v >= 0.45 AND k >= 1.5) AS stands FROM asked""")
def cross_domain_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"), _picked("p_partkey", QUESTIONS).alias("q"), (F.col("p_size") / 10).alias("k"), (F.col("p_retailprice") / 2500).alias("v"), (F.col("p_size") % 4 == 0).alias("boosted"), (F.col("p_size") % 7 == 0).alias("bare"))
    guard = roles.result_stands(F.when(F.col("k") > 0, F.col("k")), F.col("v"), F.col("boosted"), F.col("bare"), dominant_identifier(F.col("q")).isNotNull())
    return rows.select("id", guard.alias("stands"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN image AND wants THEN l_quantity * 0.6 ELSE l_quantity END, 6) AS score FROM
(SELECT *, l_returnflag = 'R' AND l_linestatus = 'F' AS image, l_suppkey % 3 = 0 AS wants FROM lineitem) WHERE wants OR NOT image""")
def image_roles(spark, sf_dir):
    """Rows of images alone go, or weigh less where the question asks for images."""
    rows = table(spark, sf_dir, "lineitem").withColumn("block", F.when(F.col("l_returnflag") == "R", "image").otherwise("text")).withColumn("attached", F.when(F.col("l_linestatus") != "F", 1))
    alone = roles.image_alone(F.col("block"), F.col("attached"))
    kept = roles.apply_image_role(rows.withColumnRenamed("l_quantity", "score"), alone, F.col("l_suppkey") % 3 == 0, 0.6)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"))
