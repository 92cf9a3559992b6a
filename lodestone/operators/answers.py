"""What goes from searches into answers: hits with their rows, blocks of passages, turns of a conversation, prompts.

Null texts count as empty; equal ranks are in order of the row's id. Groups that are joined to one text are those of one
question or one conversation, cut to a number of rows before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import clamped, plain_fence
from ..functions.text import rstrip, strip
from . import graph

#: Labels that stand in prompts and answers.
NO_HITS, NO_TITLE, NOTHING_YET, HIT_MARK = "（无召回片段）", "文献", "（本轮尚未注入检索片段）", "—— 命中片段 ——"
DEFAULT_REASON = "默认进入知识库检索"
TERMINAL = ("success", "failed", "partial", "cancelled")


def _bare(c: str | Column) -> Column:
    return strip(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 1), F.lit("…")))


def _joined(order: str, line: str, joiner: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), joiner)


def searchable(kb: Column, status: Column, block: Column, attached: Column, wanted: int, with_images: bool) -> Column:
    """Whether a search of a collection reads a chunk: its document is indexed and it is no picture alone."""
    alone = F.coalesce((block == "image") & attached.isNull(), F.lit(False))
    return F.coalesce((kb == wanted) & (status == "indexed"), F.lit(False)) & (F.lit(with_images) | ~alone)


def found_rows(hits: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Hits (query_id, rank, chunk_uid, score) with their chunks and document_name, if the document is indexed still; place
    counts what is left of a query in the order of rank. The hits are the small side of both joins."""
    live = documents.filter("status = 'indexed'").select("document_id", "document_name")
    rows = hits.filter("chunk_uid <> ''").join(chunks, "chunk_uid").join(live, "document_id")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy("rank", "chunk_uid")).cast("long"))


def shown_content(mode: Column, parent: Column, content: Column) -> Column:
    """A child's text under what is shown of its parent; the text alone in other modes or without a parent."""
    above, own = F.coalesce(parent, F.lit("")), F.coalesce(content, F.lit(""))
    both = F.when(strip(own) == "", strip(above)).otherwise(F.concat(rstrip(above), F.lit(f"\n\n{HIT_MARK}\n"), strip(own)))
    return F.when((mode == "parent_child") & (strip(above) != ""), both).otherwise(own)


def citation(title: Column, page: Column, index: Column, path: Column, label: Column, block: Column) -> Column:
    """What an answer cites, as one struct."""
    return F.struct(title.alias("document_name"), page.alias("page_no"), index.alias("chunk_index"), path.alias("heading_path"), label.alias("location_label"), block.alias("block"))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "uid"))
    return rows.withColumn("ref", place).filter(F.col("ref") <= most).withColumn("title", F.coalesce("title", F.lit(NO_TITLE)))


def answer_blocks(rows: DataFrame, most: int) -> DataFrame:
    """query_id, knowledge, citations: the best passages (uid, title, page_no, content, score), numbered, with their pages."""
    page = F.when(F.col("page_no").isNull(), "").otherwise(F.format_string(" 第%d页", "page_no"))
    line = F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] 《"), "title", F.lit("》"), page, F.lit("\n"), _bare("content"))
    numbered = _ranked(rows, most).withColumn("line", line).withColumn("cite", F.concat_ws(":", "ref", "uid", F.format_string("%.4f", F.round("score", 4))))
    return numbered.groupBy("query_id").agg(_joined("ref", "line", "\n\n---\n\n").alias("knowledge"), _joined("ref", "cite", ",").alias("citations"))


def hit_summaries(questions: DataFrame, rows: DataFrame, most: int, size: int = 200) -> DataFrame:
    """query_id, summary: beginnings of each question's best passages; a note where nothing was found."""
    line = F.concat(F.lit("["), F.col("ref").cast("string"), F.lit("] 《"), "title", F.lit("》 score="), F.format_string("%.2f", "score"), F.lit("\n"), F.substring(_bare("content"), 1, size))
    found = _ranked(rows, most).withColumn("line", line).groupBy("query_id").agg(_joined("ref", "line", "\n\n").alias("summary"))
    return questions.select("query_id").join(found, "query_id", "left").withColumn("summary", F.coalesce("summary", F.lit(NO_HITS)))


def spoken(messages: DataFrame) -> DataFrame:
    """Messages of known roles that say something."""
    return messages.filter(F.col("role").isin("system", "user", "assistant") & (_bare("text") != ""))


def last_questions(messages: DataFrame) -> DataFrame:
    """conv_id, messages, question: how many messages count, and what the user said last; empty if nothing."""
    last = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    return spoken(messages).groupBy("conv_id").agg(F.count("*").alias("messages"), F.coalesce(last, F.lit("")).alias("question"))


def history(messages: DataFrame, turns: int = 2, size: int = 200) -> DataFrame:
    """conv_id, history: the last messages (two a turn), those of user and assistant as labelled lines."""
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))
    tail = messages.withColumn("__p", place).filter(F.col("__p") <= 2 * turns)
    label = F.when(F.col("role") == "user", "用户").when(F.col("role") == "assistant", "助手")
    lines = tail.select("conv_id", "turn", F.when(_bare("text") != "", F.concat(label, F.lit("："), _cut(_bare("text"), size))).alias("line"))
    return lines.filter("line IS NOT NULL").groupBy("conv_id").agg(_joined("turn", "line", "\n").alias("history"))


def asked_before(messages: DataFrame, most: int, size: int = 300) -> DataFrame:
    """conv_id, questions: the user's last messages as a list."""
    own = messages.filter((F.col("role") == "user") & (_bare("text") != ""))
    kept = own.withColumn("__p", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).filter(F.col("__p") <= most)
    return kept.withColumn("line", F.concat(F.lit("- "), _cut(_bare("text"), size))).groupBy("conv_id").agg(_joined("turn", "line", "\n").alias("questions"))


def route(c: Column) -> Column:
    """Decision, reason and confidence of a model's JSON answer; retrieval with high confidence where it can't be read."""
    read = F.from_json(plain_fence(c), "decision string, reason string, confidence string")
    word = lambda name: F.lower(strip(read[name]))
    reason = F.when(F.coalesce(read["reason"], F.lit("")) == "", DEFAULT_REASON).otherwise(strip(read["reason"]))
    return F.struct(F.when(word("decision") == "direct", "direct").otherwise("retrieve").alias("decision"), reason.alias("reason"), F.when(word("confidence") == "low", "low").otherwise("high").alias("confidence"))


def system_prompt(own: Column, knowledge: Column, with_knowledge: str, without: str) -> Column:
    """The conversation's own prompt with the passages in its place for them, else one of the two given ones."""
    mine, known = _bare(own), _bare(knowledge)
    filled = F.replace(mine, F.lit("{knowledge}"), F.when(known == "", NOTHING_YET).otherwise(known))
    return F.when(mine != "", filled).when(known == "", without).otherwise(F.replace(F.lit(with_knowledge), F.lit("{knowledge}"), known))


def default_top_k(requests: DataFrame, collections: DataFrame, default: int = 5, most: int = 50) -> DataFrame:
    """request_id, top_k: what the first of a request's kb_ids sets, if that collection is there, within 1 and `most`."""
    live = collections.filter("status <> 'deleted'").select("kb_id", "default_top_k")
    first = requests.select("request_id", F.get("kb_ids", F.lit(0)).alias("kb_id"))
    return first.join(live, "kb_id", "left").select("request_id", clamped(F.col("default_top_k"), 1, most, default).alias("top_k"))


def chunk_keys(documents: DataFrame, store: DataFrame) -> DataFrame:
    """document_id, place, key: the keys that a document lists, else those of the store that name it, in their order."""
    listed = documents.filter(F.size("keys") > 0).select("document_id", F.posexplode("keys").alias("place", "key"))
    bare = documents.filter(F.coalesce(F.size("keys"), F.lit(0)) <= 0).select("document_id")
    place = F.row_number().over(W.partitionBy("document_id").orderBy(F.col("chunk_order").asc_nulls_last(), "key")) - 1
    return listed.unionByName(store.join(bare, "document_id").select("document_id", place.alias("place"), "key")).withColumn("place", F.col("place").cast("long"))


def graph_chunks(keys: DataFrame, store: DataFrame, word: str, size: int = 240) -> DataFrame:
    """Chunks of documents in a graph's store: document_id, id (-1, -2, ...), key, chunk_index, preview, char_count; those that
    hold `word`, case and all."""
    rows = keys.join(store.select("key", "content", "chunk_order"), "key").filter(F.contains(F.coalesce("content", F.lit("")), F.lit(word)))
    rows = rows.withColumn("chunk_index", F.coalesce("chunk_order", "place")).withColumn("content", F.coalesce("content", F.lit("")))
    number = F.row_number().over(W.partitionBy("document_id").orderBy("chunk_index", "place"))
    shown = F.when(F.length("content") <= size, F.col("content")).otherwise(F.concat(F.substring("content", 1, size), F.lit("…")))
    return rows.select("document_id", (-number).cast("long").alias("id"), "key", "chunk_index", shown.alias("preview"), F.length("content").cast("long").alias("char_count"))


def without_keys(store: DataFrame, removed: DataFrame) -> DataFrame:
    """The rows of a key-value store whose key isn't removed."""
    return store.join(removed.select("key"), "key", "left_anti")


def first_endings(batches: DataFrame, recorded: DataFrame) -> DataFrame:
    """Batches that ended and of which no audit event was recorded; to append these makes each event once."""
    return batches.filter(F.col("status").isin(*TERMINAL)).join(recorded.select("batch_id"), "batch_id", "left_anti")


def shown_part(nodes: DataFrame, edges: DataFrame, label: str, limit: int, depth: int) -> DataFrame:
    """The nodes of a graph that are shown for a label, or those of most edges for '*', each with the number of all shown
    and of all there are."""
    limit, depth = max(1, min(limit, 500)), max(1, min(depth, 3))
    rows = graph.top_degree(nodes, edges, limit) if label == "*" else graph.ego(nodes, edges, label, depth, limit)
    rows = rows.select("entity_id", "degree")
    return rows.crossJoin(rows.agg(F.count("*").alias("node_shown"))).crossJoin(graph.totals(nodes, edges))  # one row each


def span_excerpts(documents: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """doc_id, excerpt, truncated: each text from where its chunks begin to where they end, cut to `most` characters."""
    spans = chunks.groupBy("doc_id").agg(F.min("start_offset").alias("a"), F.max("end_offset").alias("b"))
    raw = F.substr("text", (F.greatest(F.col("a"), F.lit(0)) + 1).cast("int"), (F.col("b") - F.greatest(F.col("a"), F.lit(0))).cast("int"))
    rows = documents.join(spans, "doc_id").withColumn("raw", F.coalesce(raw, F.lit("")))
    return rows.select("doc_id", F.substring("raw", 1, most).alias("excerpt"), (F.length("raw") > most).alias("truncated"))


def compacted_metadata(meta: Column, content: Column) -> Column:
    """Metadata (a map) without the table's HTML, where that is the overview's, the text itself or far longer than it."""
    html, text = F.coalesce(meta["table_body_html"], F.lit("")), F.coalesce(content, F.lit(""))
    needless = (meta["table_role"] == "overview") | (html == strip(text)) | (F.length(html) > F.greatest(F.length(text) * 8, F.lit(65_536)))
    return F.map_filter(meta, lambda k, _: ~((k == "table_body_html") & (html != "") & F.coalesce(needless, F.lit(False))))


def code_points(c: Column) -> Column:
    """The code point of each character."""
    return F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x))
