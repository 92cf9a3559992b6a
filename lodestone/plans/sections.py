"""Queries of chunks by section, with their DuckDB SQL: orders stand for the segments of laid-out documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sections
from .queries import query, table

BUDGET = 200
_TEXTS = ["报", "10", "a@b.cn", "第 {n} 章 总则", "附件{n}", "一、范围", "| 段1 | 段2 | 段3 |", "图 {n}", "长句" * 60, "正文。" * 15, "  ", "段{n}", "（一）条目", "段{n}\n报", "1、项", "文" * 121]
_BLOCKS = ["paragraph", "paragraph", None, "heading", "heading", "paragraph", "table", "image", "paragraph", None, "paragraph", "paragraph", "paragraph", "list", "paragraph", "paragraph"]
_PATHS = [None, "指南 / 一、范围", "指南 / 二、对象", "指南 / 二、对象 / 1、短条目", "附件"]
_SQL_LIST = lambda xs: "[" + ", ".join("NULL" if x is None else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"

#: Segments (doc_id, seq, text, block, page_no, heading_path): eight customers' orders are a document.
_SEGMENTS_SQL = f"""seg AS (SELECT doc_id, seq, replace(texts[v + 1], '{{n}}', CAST(n AS VARCHAR)) AS text, blocks[v + 1] AS block, page_no, paths[h + 1] AS heading_path
FROM (SELECT o_custkey // 8 AS doc_id, o_orderkey AS seq, p % 1009 % 16 AS v, p // 16 % 4 + 1 AS n, p // 64 % 23 // 5 AS h,
CASE WHEN o_custkey // 8 % 3 > 0 OR p % 7 > 0 THEN CAST(o_orderkey // 900 AS INT) END AS page_no,
{_SQL_LIST(_TEXTS)} AS texts, {_SQL_LIST(_BLOCKS)} AS blocks, {_SQL_LIST(_PATHS)} AS paths FROM (SELECT *, CAST(floor(o_totalprice) AS BIGINT) AS p FROM orders)))"""


def _segments(spark, sf_dir):
    p = F.floor("o_totalprice")
    pick = lambda values, at: F.get(F.array(*(F.lit(x) for x in values)), at.cast("int"))
    rows = table(spark, sf_dir, "orders").select(
        F.floor(F.col("o_custkey") / 8).alias("doc_id"), F.col("o_orderkey").alias("seq"), (p % 1009 % 16).alias("v"),
        (F.floor(p / 16) % 4 + 1).cast("string").alias("n"), F.floor(F.floor(p / 64) % 23 / 5).alias("h"), (p % 7).alias("g"))
    page = F.when((F.col("doc_id") % 3 > 0) | (F.col("g") > 0), F.floor(F.col("seq") / 900).cast("int"))
    text = F.replace(pick(_TEXTS, F.col("v")), F.lit("{n}"), F.col("n"))
    return rows.select("doc_id", "seq", text.alias("text"), pick(_BLOCKS, F.col("v")).alias("block"), page.alias("page_no"), pick(_PATHS, F.col("h")).alias("heading_path"),
                       F.col("seq").alias("start_offset"), (F.col("seq") + 1).alias("end_offset"))


_FOLD_SQL = f"""r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS i FROM (SELECT *, length(t) AS n, coalesce(block, '') = 'heading' AS head, coalesce(block, '') = 'table' AS tab,
length(t) <= 1 OR (length(t) <= 3 AND regexp_full_match(t, '-?[0-9]+')) OR t = 'a@b.cn' AS noise, regexp_matches(t, '^(第 [0-9]+ 章|一、|（一）)') AS section,
len(list_filter(string_split(t, chr(10)), lambda x: length(x) > 1 AND x <> '10' AND x <> 'a@b.cn')) > 0 AS line,
(CASE WHEN pages THEN coalesce(CAST(page_no AS VARCHAR), '-') ELSE '' END) || '|' || coalesce(CASE WHEN heading_path IS NULL THEN NULL WHEN contains(heading_path, '二、') THEN '/二、对象' WHEN contains(heading_path, '一、') THEN '/一、范围' ELSE '/' || heading_path END, '') AS key
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, coalesce(block IN ('table', 'image'), false) AS whole FROM seg, mode) WHERE t <> '' OR whole)),
st AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(i BIGINT, t VARCHAR, p INT)[]) AS b, CAST(0 AS BIGINT) AS bs, '' AS bk, CAST(NULL AS INT) AS bp, false AS bh, false AS bc, false AS bl, false AS bo,
CAST([] AS STRUCT(m BIGINT[], w BIGINT)[]) AS o, CAST([] AS STRUCT(i BIGINT, t VARCHAR, p INT)[]) AS tl FROM r
UNION ALL SELECT doc_id, ri, CASE WHEN whole OR alone THEN [] WHEN opened THEN [me] ELSE list_append(b, me) END, CASE WHEN opened THEN n ELSE bs + 2 + n END, CASE WHEN opened THEN key ELSE bk END, CASE WHEN opened THEN page_no ELSE bp END,
CASE WHEN opened THEN head ELSE bh AND head END, CASE WHEN opened THEN ctx ELSE bc AND ctx END, CASE WHEN opened THEN line ELSE bl OR line END, opened AND pop,
CASE WHEN whole THEN list_append(CASE WHEN own OR k > 0 THEN o[:len(o) - k] ELSE fo END, {{'m': CASE WHEN length(t) > 0 AND len(list_filter(mem, lambda x: contains(t, x.t))) >= greatest(1, (len(mem) + 1) // 2) THEN [] ELSE list_transform(mem, lambda x: x.i) END, 'w': ri}})
WHEN alone THEN list_append(eo, {{'m': [ri], 'w': CAST(0 AS BIGINT)}}) ELSE eo END,
CASE WHEN whole THEN [] WHEN alone THEN CASE WHEN pop THEN list_append(et, me)[-6:] ELSE [] END ELSE et END
FROM (SELECT *, CASE WHEN ends THEN fo ELSE o END AS eo, CASE WHEN ends THEN ft ELSE tl END AS et, (ends OR len(b) = 0) AND n >= {BUDGET} AND NOT head AND NOT noise AS alone, ends OR len(b) = 0 AS opened,
CASE WHEN own THEN b WHEN k > 0 THEN tl[len(tl) - k + 1:] ELSE [] END AS mem FROM (SELECT *, CASE WHEN keeps THEN list_append(o, {{'m': list_transform(b, lambda x: x.i), 'w': CAST(0 AS BIGINT)}}) ELSE o END AS fo,
CASE WHEN NOT keeps THEN tl WHEN bo THEN list_append(tl, b[1])[-6:] ELSE [] END AS ft,
CASE WHEN tab AND NOT own THEN len(tl) - coalesce(list_max(list_transform(range(1, len(tl) + 1), lambda j: CASE WHEN page_no IS NOT NULL AND tl[j].p IS DISTINCT FROM page_no THEN j ELSE 0 END)), 0) ELSE 0 END AS k
FROM (SELECT s.*, r.i AS ri, r.* EXCLUDE (doc_id, i), len(b) > 0 AND bc AS own, len(b) > 0 AND (bs > 24 OR bl) AS keeps, {{'i': r.i, 't': r.t, 'p': r.page_no}} AS me,
coalesce(block, 'paragraph') IN ('heading', 'paragraph') AND n <= 120 OR head AS ctx, coalesce(block, 'paragraph') IN ('heading', 'paragraph') AND n <= 120 AND NOT section AS pop,
len(b) > 0 AND ((head AND section AND NOT noise) OR (key <> bk AND NOT (bh AND head AND page_no IS NOT DISTINCT FROM bp)) OR bs + 2 + n > {BUDGET}) AS ends
FROM st s JOIN r ON r.doc_id = s.doc_id AND r.i = s.i + 1)))),
last AS (SELECT doc_id, unnest(CASE WHEN len(b) > 0 AND (bs > 24 OR bl) THEN list_append(o, {{'m': list_transform(b, lambda x: x.i), 'w': CAST(0 AS BIGINT)}}) ELSE o END) AS c FROM st WHERE (doc_id, i) IN (SELECT doc_id, max(i) FROM r GROUP BY doc_id)),
chunk AS (SELECT doc_id, c, list_concat(c.m, CASE WHEN c.w > 0 THEN [c.w] ELSE [] END) AS every FROM last),
merged AS (SELECT chunk.doc_id, min(seq) AS seq, CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg(t, chr(10) || chr(10) ORDER BY i) END AS text, max(CASE WHEN i = CASE WHEN c.w > 0 THEN c.w ELSE every[1] END THEN block END) AS block,
coalesce(max(CASE WHEN i = c.w THEN page_no END), max(CASE WHEN i = every[1] THEN page_no END)) AS page_no, coalesce(max(CASE WHEN i = c.w THEN heading_path END), max(CASE WHEN i = every[1] THEN heading_path END)) AS heading_path,
min(seq) AS start_offset, max(seq) + 1 AS end_offset, CAST(CASE WHEN any_value(c.w) = 0 THEN count(*) ELSE 1 END AS INT) AS merged, CAST(CASE WHEN any_value(c.w) = 0 THEN 0 ELSE count(*) - 1 END AS INT) AS context
FROM chunk JOIN r ON r.doc_id = chunk.doc_id AND list_contains(every, r.i) GROUP BY chunk.doc_id, c, every)"""


def _merged_sql(pages: str) -> str:
    return f"WITH RECURSIVE mode AS (SELECT {pages} AS pages), {_SEGMENTS_SQL}, {_FOLD_SQL} SELECT doc_id, seq, text, block, page_no, heading_path, start_offset, end_offset, merged, context FROM merged"


@query(_merged_sql("true"))
def section_merged_segments(spark, sf_dir):
    return sections.merge_sections(_segments(spark, sf_dir), BUDGET)


@query(_merged_sql("false"))
def section_merged_across_pages(spark, sf_dir):
    return sections.merge_sections(_segments(spark, sf_dir), BUDGET, keep_pages=False)
