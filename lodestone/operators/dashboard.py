"""Counts and lists of the dashboard as grouped aggregations and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fields import FAILED, IN_PROGRESS, INDEXED, NO_NAME, inferred_outcome, progress_phase
from ..functions.text import strip


def collection_usage(bound: DataFrame, cited: DataFrame, names: DataFrame, limit: int = 5) -> DataFrame:
    """kb_id, name, recalls, binds of the most used collections. bound: ids, a JSON array of collection ids for each
    conversation; cited: citations, a JSON array of objects with knowledge_base_id for each answer; names: kb_id, name."""
    binds = bound.select(F.explode(F.from_json("ids", "array<bigint>")).alias("kb_id")).groupBy("kb_id").agg(F.count("*").alias("binds"))
    items = cited.select(F.explode(F.from_json("citations", "array<struct<knowledge_base_id: bigint>>")).alias("c"))
    recalls = items.select(F.col("c.knowledge_base_id").alias("kb_id")).groupBy("kb_id").agg(F.count("*").alias("recalls"))
    both = binds.join(recalls, "kb_id", "full").join(names.filter("name <> ''"), "kb_id")
    rows = both.select("kb_id", "name", F.coalesce("recalls", F.lit(0)).alias("recalls"), F.coalesce("binds", F.lit(0)).alias("binds"))
    return rows.orderBy(F.desc("recalls"), F.desc("binds"), "kb_id").limit(limit)


def pipeline_counts(docs: DataFrame) -> DataFrame:
    """One row: documents under way, indexed and failed, by their status; deleted ones don't count."""
    status = F.col("status")
    return docs.agg(
        F.count_if(status.isin("uploaded", *IN_PROGRESS)).alias("parsing"), F.count_if(status.isin(*INDEXED)).alias("indexed"), F.count_if(status.isin(*FAILED)).alias("failed")
    )


def collection_stats(docs: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """kb_id with its documents (all, indexed, failed) and chunks. docs: kb_id, status; chunks: kb_id; names: kb_id."""
    status = F.col("status")
    of_docs = docs.filter(status != "deleted").groupBy("kb_id")
    of_docs = of_docs.agg(F.count("*").alias("documents"), F.count_if(status.isin(*INDEXED)).alias("indexed"), F.count_if(status.isin(*FAILED)).alias("failed"))
    of_chunks = chunks.groupBy("kb_id").agg(F.count("*").alias("chunks"))
    return names.select("kb_id").distinct().join(of_docs, "kb_id", "left").join(of_chunks, "kb_id", "left").fillna(0, ["documents", "indexed", "failed", "chunks"])


def space_usage(files: DataFrame, by: str, size: str, most_files: int, most_bytes: int) -> DataFrame:
    """Files and bytes of each space, and whether another file would be one too many."""
    used = files.groupBy(by).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))
    return used.withColumn("full", (F.col("files") >= most_files) | (F.col("bytes") >= most_bytes))


def batch_durations(batches: DataFrame, items: DataFrame, now: Column, terminal: tuple[str, ...] = ("success", "failed", "partial")) -> DataFrame:
    """batch_id, seconds: from the first start to the last end of its items, if all have ended and it is done; else from
    its own times, until now while it runs. Times are in seconds; batches: batch_id, status, started, finished; items:
    batch_id, started, finished."""
    each = items.groupBy("batch_id").agg(F.min("started").alias("first"), F.max("finished").alias("last"), (F.count("finished") == F.count("*")).alias("ended"))
    rows = batches.join(each, "batch_id", "left")
    by_items = F.when(F.coalesce("ended", F.lit(False)) & F.col("status").isin(*terminal) & F.col("first").isNotNull(), F.col("last") - F.col("first"))
    own = F.when(F.col("finished").isNotNull(), F.col("finished") - F.col("started")).when(F.col("status") == "running", now - F.col("started"))
    seconds = F.coalesce(by_items, own)
    return rows.select("batch_id", F.when(seconds.isNotNull(), F.greatest(seconds, F.lit(0.0))).alias("seconds"))


def recent_outcomes(batches: DataFrame, items: DataFrame, since: Column, actions: tuple[str, ...] = ("parse", "reindex")) -> DataFrame:
    """kb_id, succeeded, failed: items that ended since then in batches of these actions."""
    ended = items.filter(F.col("finished") >= since).join(batches.filter(F.col("action").isin(*actions)).select("batch_id", "kb_id"), "batch_id")
    status = F.col("status")
    return ended.groupBy("kb_id").agg(F.count_if(status == "success").alias("succeeded"), F.count_if(status.isin("failed", "cancelled")).alias("failed"))


def name_breakdown(rows: DataFrame, name: str) -> DataFrame:
    """name, n, sorted by name; blank names are counted together."""
    bare = strip(F.coalesce(F.col(name), F.lit("")))
    return rows.groupBy(F.when(bare == "", NO_NAME).otherwise(bare).alias("name")).agg(F.count("*").alias("n")).orderBy("name")


def reconciled(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Items that count as running though their document has ended, or is gone, with the outcome that follows. items:
    item_id, document_id, status; docs: document_id, doc_status."""
    rows = items.filter((F.col("status") == "running") & F.col("document_id").isNotNull()).join(docs, "document_id", "left")
    return rows.select("item_id", "document_id", inferred_outcome(F.col("doc_status")).alias("outcome")).filter("outcome IS NOT NULL")


def filled_counts(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """document_id, chunk_count: a count of 0 gives way to the length of the document's key list. lists: document_id, keys."""
    known = F.when(F.col("chunk_count") > 0, F.col("chunk_count"))
    return docs.join(lists, "document_id", "left").select("document_id", F.coalesce(known, F.size("keys"), F.lit(0)).alias("chunk_count"))


def progress(logs: DataFrame, by: str, order: str, line: str, status: dict[str, float], last: int = 24) -> DataFrame:
    """by, phase, percent: what is stored for it, else the phase that the last lines of its log speak of. status maps
    phases to percents; logs have `stored`, null where nothing is stored."""
    place = F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))
    recent = logs.withColumn("__p", place).filter(F.col("__p") <= last)
    text = F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("__p", F.coalesce(line, F.lit("")).alias("t"))))), lambda x: x["t"]), " ")
    rows = recent.groupBy(by).agg(F.max("stored").alias("stored"), text.alias("text"))
    phase = F.coalesce("stored", progress_phase(F.col("text")))
    percent = F.create_map(*(F.lit(x) for kv in status.items() for x in kv))
    return rows.select(by, phase.alias("phase"), percent[phase].alias("percent"))


def joined_channels(vector: DataFrame, keyword: DataFrame) -> DataFrame:
    """query_id, uid, vector_score, keyword_score, score of hits of either channel: the vector's score, or the keyword's
    where that is 0 or missing. Both have query_id, uid, score."""
    both = vector.withColumnRenamed("score", "vector_score").join(keyword.withColumnRenamed("score", "keyword_score"), ["query_id", "uid"], "full")
    return both.withColumn("score", F.coalesce(F.when(F.col("vector_score") != 0, F.col("vector_score")), F.when(F.col("keyword_score") != 0, F.col("keyword_score")), F.lit(0.0)))


def summaries(rows: DataFrame, by: str, limit: int, size: int, *order: Column) -> DataFrame:
    """by, index, name, score, preview of the first rows of each key."""
    place = F.row_number().over(W.partitionBy(by).orderBy(*order))
    content = strip(F.coalesce("content", F.lit("")))
    preview = F.when(F.length(content) <= size, content).otherwise(F.concat(F.substring(content, 1, size - 1), F.lit("…")))
    ranked = rows.withColumn("index", place).filter(F.col("index") <= limit)
    return ranked.select(by, F.col("index").cast("long").alias("index"), F.coalesce("name", F.lit("文献")).alias("name"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("score"), preview.alias("preview"))


def reranked(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """query_id, index, score of a reranker's JSON answers; places beyond the query's documents are left out. answers:
    query_id, body; documents: query_id, n."""
    kind = "array<struct<index: bigint, relevance_score: double, score: double>>"
    read = F.from_json("body", f"results {kind}, output struct<results: {kind}>")
    items = answers.select("query_id", read.alias("r")).select("query_id", F.explode(F.coalesce("r.results", "r.output.results")).alias("x"))
    rows = items.select("query_id", "x.index", F.coalesce("x.relevance_score", "x.score").alias("score")).join(documents, "query_id")
    return rows.filter((F.col("index") >= 0) & (F.col("index") < F.col("n")) & F.col("score").isNotNull()).select("query_id", "index", "score")


def compacted_rows(segments: DataFrame, most: int, most_chars: int) -> DataFrame:
    """table_index, start_offset, end_offset, n, text: row segments of tables joined so that there are about `most` of them
    in all, but none over `most_chars`. segments: table_index, row_index, start_offset, end_offset, text."""
    of_table = segments.groupBy("table_index").agg(F.count("*").alias("rows"), F.greatest(F.lit(1), F.floor(F.avg(F.length("text")))).alias("mean"))
    share = F.greatest(F.lit(80), F.floor(F.lit(most) / F.greatest(F.count("*").over(W.partitionBy()), F.lit(1))))  # a row for each table
    batch = F.least(F.greatest(F.lit(1), F.ceil(F.col("rows") / share)), F.greatest(F.lit(1), F.floor(most_chars / F.col("mean"))))
    sizes = of_table.select("table_index", batch.alias("batch"))
    place = F.row_number().over(W.partitionBy("table_index").orderBy("row_index")) - 1
    rows = segments.withColumn("place", place).join(sizes, "table_index").withColumn("g", F.floor(F.col("place") / F.col("batch")))
    lines = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), lambda t: strip(t) != "")
    out = rows.groupBy("table_index", "g").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"), F.count("*").alias("n"), F.array_join(lines, "\n").alias("text"))
    return out.drop("g").filter(strip(F.col("text")) != "")


def models_by_provider(models: DataFrame, providers: DataFrame, chosen: DataFrame) -> DataFrame:
    """provider_id, provider, models: the models of each provider as sorted structs of id, name and is_default."""
    rows = models.join(chosen.select("model_id", F.lit(True).alias("d")).distinct(), "model_id", "left").join(providers, "provider_id")
    one = F.struct("model_id", "model", F.coalesce("d", F.lit(False)).alias("is_default"))
    return rows.groupBy("provider_id", "provider").agg(F.array_sort(F.collect_list(one)).alias("models"))


def members(users: DataFrame, memberships: DataFrame, space: int | None, pattern: str | None) -> DataFrame:
    """Users of a space (all, if none is given) whose name or address holds the pattern, by id."""
    rows = users if space is None else users.join(memberships.filter(F.col("space_id") == space).select("user_id"), "user_id", "left_semi")
    if pattern:
        rows = rows.filter(F.col("name").ilike(f"%{pattern}%") | F.col("email").ilike(f"%{pattern}%"))
    return rows.orderBy("user_id")
