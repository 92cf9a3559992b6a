"""Queries of the chunk planner, with their DuckDB SQL: orders stand for segments, and a document's settings vary by its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import planning
from .queries import query
from .sections import _SEGMENTS_SQL, _SQL_LIST, _segments

#: Settings of a document, null where it has none; those of a collection; what parsed it.
_OWN = [
    None, '{"mode": "parent_child", "parent_child": {"parent_delimiter": "。", "child_delimiter": "文文", "child_max_length": 60, "child_overlap": 5}}', '{"mode": "general"}', "no settings",
    '{"general": {"delimiter": "段", "max_length": 200, "overlap": 20, "collapse_whitespace": false}}', '{"mode": "parent_child", "parent_child": {"parent_mode": "full_document"}}', None,
]
_SHARED = [
    None, '{"chunking": {"mode": "parent_child", "parent_child": {"child_delimiter": "", "child_max_length": 0}}}', '{"chunking": {"general": {"max_length": 90, "overlap": 0}}}', '{"other": 1}',
    '{"chunking": {"general": {"delimiter": "\\\\n", "max_length": 300}}}',
]
_KINDS, _BACKENDS = ["pdf", "docx", "txt", "xlsx", None, "pptx", "html", "csv"], [None, None, "mineru", None, "opendataloader", None, None, None, "plain"]
_ENGINES = [None, None, None, "tsv", None, None, None, None, None, None, "docling"]


def _documents(segments):
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))
    ids = segments.select("doc_id").distinct()
    return ids.select(
        "doc_id", pick(_OWN).alias("own"), pick(_SHARED).alias("shared"), pick(_KINDS).alias("parser_type"), pick(_BACKENDS).alias("parser_backend"), pick(_ENGINES).alias("excel_engine"),
        F.when(F.col("doc_id") % 13 == 6, "table_segments").alias("strategy"), (400 + F.col("doc_id") % 5 * 100).cast("int").alias("chunk_size"), (F.col("doc_id") % 4 * 15).cast("int").alias("chunk_overlap"),
    )


_AT = lambda values: f"({_SQL_LIST([v.replace(chr(39), chr(39) * 2) if v else v for v in values])})[doc_id % {len(values)} + 1]"
_SETTINGS_SQL = f"""{_SEGMENTS_SQL},
raw AS (SELECT doc_id, {_AT(_OWN)} AS own, {_AT(_SHARED)} AS shared, {_AT(_KINDS)} AS kind, {_AT(_BACKENDS)} AS backend, {_AT(_ENGINES)} AS engine,
doc_id % 13 = 6 AS cut, 400 + doc_id % 5 * 100 AS size, doc_id % 4 * 15 AS lap FROM (SELECT DISTINCT doc_id FROM seg)),
doc AS (SELECT *, CASE WHEN starts_with(own, '{{') THEN CAST(own AS JSON) ELSE json_extract(shared, '$.chunking') END AS j FROM raw),
part AS (SELECT *, CASE WHEN j->>'$.mode' = 'parent_child' THEN 'parent_child' ELSE 'general' END AS mode FROM doc),
setting AS (SELECT doc_id, kind, backend, engine, cut, mode,
replace(coalesce(nullif(CASE mode WHEN 'general' THEN j->>'$.general.delimiter' ELSE j->>'$.parent_child.child_delimiter' END, ''), CASE mode WHEN 'general' THEN '\\n\\n' ELSE '\\n' END), '\\n', chr(10)) AS delimiter,
CAST(coalesce(nullif(CAST(CASE mode WHEN 'general' THEN j->>'$.general.max_length' ELSE j->>'$.parent_child.child_max_length' END AS INT), 0), size) AS INT) AS size,
CAST(coalesce(nullif(CAST(CASE mode WHEN 'general' THEN j->>'$.general.overlap' ELSE j->>'$.parent_child.child_overlap' END AS INT), 0), lap) AS INT) AS overlap,
coalesce(CAST(CASE mode WHEN 'general' THEN j->>'$.general.collapse_whitespace' ELSE j->>'$.parent_child.collapse_whitespace' END AS BOOLEAN), true) AS collapse,
CASE WHEN j->>'$.parent_child.parent_mode' = 'full_document' THEN 'full_document' ELSE 'paragraph' END AS parent_mode,
coalesce(j->>'$.parent_child.parent_delimiter', chr(10) || chr(10)) AS parent_delimiter FROM part),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (block = 'table') AS tables FROM seg GROUP BY doc_id),
route AS (SELECT setting.* EXCLUDE (cut, engine, kind), kind AS parser_type,
CASE WHEN cut OR coalesce(engine = 'tsv', false) OR coalesce(kind = 'xlsx', false) OR coalesce(backend IN ('mineru', 'opendataloader'), false) OR tables >= greatest(3, n // 2) THEN 'prebuilt' ELSE mode END AS route FROM setting JOIN n USING (doc_id))"""


@query(f"WITH {_SETTINGS_SQL} SELECT * EXCLUDE (backend), backend AS parser_backend FROM route")
def chunk_routes(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    return planning.chunk_routes(segments, _documents(segments))


@query(f"""WITH {_SETTINGS_SQL},
piece AS (SELECT *, unnest(string_split(CASE WHEN collapse THEN trim(regexp_replace(text, '[\\s\\x{{A0}}]+', ' ', 'g')) ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END, delimiter)) AS p FROM seg JOIN route USING (doc_id) WHERE route = 'general'),
total AS (SELECT doc_id, any_value(size) AS size, any_value(overlap) AS overlap, count(*) AS n_pieces, bool_or(coalesce(block IN ('table', 'image', 'document_preamble'), false)) AS whole,
greatest(160, sum(length(regexp_replace(p, '^\\s+|\\s+$', '', 'g'))) // 4) AS target FROM piece WHERE trim(p, ' ' || chr(10)) <> '' GROUP BY doc_id)
SELECT doc_id, n_pieces, CAST(CASE WHEN less THEN target ELSE size END AS INT) AS size, CAST(CASE WHEN less THEN greatest(0, least(floor(overlap * (target / size)), target - 1)) ELSE overlap END AS INT) AS overlap
FROM (SELECT *, NOT whole AND size > 160 AND target < size AS less FROM total)""")
def general_piece_sizes(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    rows = segments.join(planning.chunk_routes(segments, _documents(segments)).filter("route = 'general'"), "doc_id")
    return planning.general_pieces(rows).groupBy("doc_id").agg(F.count("*").alias("n_pieces"), F.max("size").alias("size"), F.max("overlap").alias("overlap"))


@query()
def planned_chunks(spark, sf_dir):
    segments = _segments(spark, sf_dir)
    documents = _documents(segments)
    return planning.ready_chunks(planning.planned_chunks(segments, documents), documents)
