"""Queries of the rules on headings, texts, questions and boxes, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import search
from ..functions import text as T
from ..operators import graph, planning, roles, segments
from .queries import _GRAPH_SQL, _graph, query, table

#: Pieces that an order's lines are put together from: a mark, a number, what closes it, a subject.
_OPENS = ["第", "（", "", "(", "**", "__第", "**（", "　", "# ", "附"]
_NUMBERS = ["一", "十二", "3", "百", "12", "七", ""]
_CLOSES = ["章", "、", "）", ".", "条", ")", "** ", "__", " 节", "．", "：", "**：", " "]
_SUBJECTS = ["总则", "适用范围", "**甲**乙", "__办理__流程", "a" * 30, "说明：", "须知", "-12", "7", "x@y.cn", "当前位置 首页 公告", ""]
_LISTS = (_OPENS, _NUMBERS, _CLOSES, _SUBJECTS)
_SQL_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"

#: Lines (order_id, customer, seq, line) of orders.
_LINES_SQL = f"""line AS (SELECT o_orderkey AS order_id, o_custkey AS customer, ({_SQL_LIST(_OPENS)})[p % 10 + 1] || ({_SQL_LIST(_NUMBERS)})[p // 10 % 7 + 1] || ({_SQL_LIST(_CLOSES)})[p // 70 % 13 + 1] || ({_SQL_LIST(_SUBJECTS)})[p // 910 % 12 + 1]
|| CASE WHEN p % 3 = 0 THEN repeat('字', CAST(p % 45 AS INT)) ELSE '' END AS line FROM (SELECT *, CAST(floor(o_totalprice * 100) AS BIGINT) AS p FROM orders))"""
_PLAIN_SQL = "trim(" + "regexp_replace(regexp_replace(" * 3 + "replace({c}, '　', ' ')" + r", '\*\*(.+?)\*\*', '\1', 'g'), '__(.+?)__', '\1', 'g')" * 3 + ")"
_NUMERAL = "[一二三四五六七八九十百千]+"
_SECTION_SQL = f"^((第\\s*)?{_NUMERAL}\\s*[、.．]|[(（]\\s*{_NUMERAL}\\s*[)）]|第\\s*[0-9]+\\s*[章节篇部条款])"
_plain = lambda c: _PLAIN_SQL.format(c=c)


def _lines(spark, sf_dir):
    p = F.floor(F.col("o_totalprice") * 100)
    pick = lambda values, by: F.get(F.array(*map(F.lit, values)), (F.floor(p / by) % len(values)).cast("int"))
    pieces = [pick(values, by) for values, by in zip(_LISTS, (1, 10, 70, 910), strict=True)]
    line = F.concat(*pieces, F.when(p % 3 == 0, F.repeat(F.lit("字"), (p % 45).cast("int"))).otherwise(""))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), line.alias("line"))


@query(f"WITH {_LINES_SQL} SELECT order_id, {_plain('line')} AS plain FROM line")
def plain_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("order_id", T.strip_markdown(F.col("line")).alias("plain"))


@query(f"""WITH {_LINES_SQL}, p AS (SELECT *, {_plain('line')} AS t, trim(coalesce(lag(line) OVER (PARTITION BY customer ORDER BY order_id), ''), ' 　') AS before FROM line)
SELECT order_id, regexp_matches(t, '{_SECTION_SQL}') AS section, regexp_matches(t, '{_SECTION_SQL}') OR regexp_matches(t, '^[0-9]+\\s*[、.．)）]') AS body,
regexp_matches(t, '^[(（]\\s*{_NUMERAL}\\s*[)）]') AND (regexp_matches(before, '[：:]$') OR length(t) <= 40) AS item FROM p""")
def heading_lines(spark, sf_dir):
    rows = _lines(spark, sf_dir).withColumn("before", F.lag("line").over(W.partitionBy("customer").orderBy("order_id")))
    line = F.col("line")
    return rows.select("order_id", segments.starts_section(line).alias("section"), segments.starts_body(line).alias("body"), segments.inline_item(line, F.col("before")).alias("item"))


@query(f"""WITH {_LINES_SQL}, part AS (SELECT customer, order_id, {_plain('line')} AS t FROM line),
kept AS (SELECT customer, order_id, t, regexp_matches(t, '^[0-9]+\\s*[、.．)）]') AS item, regexp_matches(t, '{_SECTION_SQL}') AS section FROM part WHERE t <> '')
SELECT customer, coalesce(arg_max(t, order_id) FILTER (section AND NOT item), arg_max(t, order_id) FILTER (NOT item), arg_max(t, order_id)) AS key FROM kept GROUP BY customer""")
def section_keys(spark, sf_dir):
    parts = F.transform(F.array_sort(F.collect_list(F.struct("order_id", "line"))), lambda x: x["line"])
    paths = _lines(spark, sf_dir).groupBy("customer").agg(F.array_join(parts, " / ").alias("path"))
    return paths.select("customer", segments.section_key(F.col("path")).alias("key")).filter("key IS NOT NULL")


@query(f"""WITH {_LINES_SQL}, piece AS (SELECT order_id, line AS whole, unnest(string_split(line, '：')) AS raw FROM line),
flat AS (SELECT *, trim(regexp_replace(raw, '[\\s　]+', ' ', 'g')) AS s FROM piece),
marked AS (SELECT *, length(s) <= 1 OR (length(s) <= 3 AND regexp_full_match(s, '-?[0-9]+')) OR (length(s) <= 32 AND regexp_full_match(s, '[\\w\\p{{L}}\\p{{N}}.+-]+@[\\w\\p{{L}}\\p{{N}}.-]+\\.[\\w\\p{{L}}\\p{{N}}]+')) OR (length(s) <= 48 AND contains(s, '当前位置')) AS noise FROM flat)
SELECT order_id, length(trim(any_value(whole), ' 　')) > 24 OR bool_or(NOT noise) AS kept FROM marked GROUP BY order_id""")
def retrievable_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("order_id", T.retrievable(F.replace("line", F.lit("："), F.lit("\n"))).alias("kept"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, [CAST(l_quantity AS DOUBLE), l_extendedprice % 700, l_quantity + l_partkey, l_extendedprice % 700 + l_suppkey] AS box, 800 + l_linenumber AS height FROM lineitem)
SELECT l_orderkey, l_linenumber, box[1] AS x0, height - box[4] AS y0, box[3] AS x1, height - box[2] AS y1 FROM b""")
def flipped_boxes(spark, sf_dir):
    low = F.col("l_extendedprice") % 700
    box = F.array(F.col("l_quantity").cast("double"), low, F.col("l_quantity") + F.col("l_partkey"), low + F.col("l_suppkey"))
    rows = table(spark, sf_dir, "lineitem").withColumn("box", search.flipped_box(box, 800 + F.col("l_linenumber")))
    return rows.select("l_orderkey", "l_linenumber", *(F.get("box", F.lit(i)).alias(name) for i, name in enumerate(("x0", "y0", "x1", "y1"))))


#: Words that questions are put together from.
_ASKS = ["如何在APP里", "小 程 序", "请问", "哪个按钮", "你好", "HELLO", "Thanks", "who are you", "谢谢", "支付宝", "what can you do"]
_ENDS = ["！", "办理", " ?!", "", "截图在哪", "。。", "？ ", "点击", "～"]
_QUESTIONS_SQL = f"""q AS (SELECT event_id, ({_SQL_LIST(_ASKS)})[event_id % 11 + 1] || ({_SQL_LIST(_ENDS)})[user_id % 9 + 1] || CASE WHEN event_id % 4 = 3 THEN event_type ELSE '' END AS question FROM events)"""


def _questions(spark, sf_dir):
    pick = lambda values, c: F.get(F.array(*map(F.lit, values)), (F.col(c) % len(values)).cast("int"))
    question = F.concat(pick(_ASKS, "event_id"), pick(_ENDS, "user_id"), F.when(F.col("event_id") % 4 == 3, F.col("event_type")).otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", question.alias("question"))


@query(f"""WITH {_QUESTIONS_SQL} SELECT event_id, regexp_matches(question, '(?i)(界面|截图|页面|App|小程序|按钮|点击|屏幕|图片|豫事办|支付宝)') AS images,
regexp_full_match(s, '你好|您好|嗨|hi|hello|hey|在吗|早上好|下午好|晚上好|谢谢|thanks|thank you') OR contains(s, 'what can you do') OR contains(s, 'who are you') AS talk
FROM (SELECT *, lower(regexp_replace(trim(question), '[\\s!?.,。！？，～~]+$', '')) AS s FROM q)""")
def question_intents(spark, sf_dir):
    return _questions(spark, sf_dir).select("event_id", roles.wants_images(F.col("question")).alias("images"), search.skips_retrieval(F.col("question")).alias("talk"))


@query(_GRAPH_SQL + """, named AS (SELECT *, entity_type || '|||' || degree % 3 || '|||' || CASE WHEN degree % 2 = 0 THEN '' ELSE entity_type END || '|||' || degree % 5 AS source_id FROM deg)
SELECT entity_id, degree, array_to_string([entity_type] || list_filter([CAST(degree % 3 AS VARCHAR)] || CASE WHEN degree % 5 = degree % 3 THEN [] ELSE [CAST(degree % 5 AS VARCHAR)] END, lambda x: x <> entity_type), ',') AS tags FROM named""")
def node_tags(spark, sf_dir):
    nodes, edges = _graph(spark, sf_dir)
    degree = graph.degrees(nodes, edges).select("entity_id", "degree")
    source = F.concat_ws("|||", "entity_type", F.col("degree") % 3, F.when(F.col("degree") % 2 == 0, "").otherwise(F.col("entity_type")), F.col("degree") % 5)
    rows = graph.node_detail(nodes.join(degree, "entity_id").withColumn("source_id", source).drop("degree"), edges)
    return rows.select("entity_id", "degree", F.array_join("tags", ",").alias("tags"))


@query(r"""WITH piece AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
d AS (SELECT doc_id, n_chars, ['auto', 'reuse_parse', 'native', 'other', NULL][doc_id % 5 + 1] AS mode, string_agg(content, chr(10) || '##' || chr(10) ORDER BY i) AS text,
max(CASE WHEN trim(content) <> '' THEN floor(length(content) / 1.5) END) AS longest FROM documents LEFT JOIN piece USING (doc_id) GROUP BY ALL)
SELECT doc_id, coalesce(use, false) AS reuses, CAST(CASE WHEN use THEN least(900, greatest(512, coalesce(longest, 0) + 256)) ELSE 512 END AS BIGINT) AS token_size, CASE WHEN use THEN text END AS text
FROM (SELECT *, text IS NOT NULL AND CASE WHEN mode = 'native' THEN false WHEN mode = 'reuse_parse' THEN true ELSE n_chars >= 1500 END AS use FROM
(SELECT doc_id, any_value(n_chars) AS n_chars, any_value(mode) AS mode, any_value(text) AS text, max(longest) AS longest FROM d GROUP BY doc_id))""")
def graph_inserts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    chunks = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    mode = F.get(F.array(*map(F.lit, ["auto", "reuse_parse", "native", "other", None])), (F.col("doc_id") % 5).cast("int"))
    wanted = docs.select("doc_id", "n_chars", mode.alias("index_mode"), F.lit(1500).alias("least_chars"))
    return planning.graph_inserts(chunks, wanted, "\n##\n", 512, most=900)
