"""Property-graph queries over nodes(entity_id, entity_type, ...) and edges(src, dst, rel_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import written


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes, and of edges between different nodes, parallel ones each."""
    n = nodes.agg(F.count("*").alias("node_total"))
    e = edges.filter("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").agg(F.count("*").alias("edge_total"))
    return n.crossJoin(e)  # one row each


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with the number of incident edges; a loop counts once."""
    ends = edges.select(F.col("src").alias("entity_id")).unionAll(edges.filter("src <> dst").select("dst"))
    counted = ends.groupBy("entity_id").agg(F.count("*").alias("degree"))
    return nodes.join(counted, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def top_degree(nodes: DataFrame, edges: DataFrame, limit: int) -> DataFrame:
    return degrees(nodes, edges).orderBy(F.desc("degree"), "entity_id").limit(limit)


def induced_edges(edges: DataFrame, chosen: DataFrame, rel_type: str = "DIRECTED") -> DataFrame:
    """Distinct undirected edges of the type between chosen nodes."""
    pairs = edges.filter((F.col("rel_type") == rel_type) & (F.col("src") != F.col("dst")))
    pairs = pairs.join(chosen.select(F.col("entity_id").alias("src")), "src", "left_semi").join(chosen.select(F.col("entity_id").alias("dst")), "dst", "left_semi")
    return pairs.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def ego(nodes: DataFrame, edges: DataFrame, center: str, depth: int, limit: int) -> DataFrame:
    """entity_id, hop, degree of the nodes within `depth` hops: the centre first, then by degree."""
    both = written(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "ego-edges")
    reached = nodes.filter(F.col("entity_id") == center).select("entity_id", F.lit(0).alias("hop"))
    front = reached
    for hop in range(1, depth + 1):
        front = front.join(both, front["entity_id"] == both["src"]).select(F.col("dst").alias("entity_id")).distinct().join(reached, "entity_id", "left_anti")
        front = written(front.withColumn("hop", F.lit(hop)), "ego-front")
        reached = reached.union(front)
    found = degrees(nodes, edges).join(reached, "entity_id")
    return found.select("entity_id", "hop", "degree").orderBy(F.col("hop") > 0, F.desc("degree"), "entity_id").limit(limit)


def find_center(nodes: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """The node that a label means: the exact id, else one whose id holds it, else one whose description does."""
    low = label.lower()
    exact, inside = F.col("entity_id") == label, F.lower("entity_id").contains(low)
    hits = degrees(nodes, edges).filter(exact | inside | F.lower("description").contains(low))
    return hits.orderBy(~exact, ~inside, F.desc("degree"), "entity_id").limit(1)


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the subgraph as GraphML text. Meant for subgraphs that `limit` bounds."""
    text = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<node id="'), text("entity_id"), F.lit('"/>')))), "").alias("n"))
    e = edges.agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('<edge source="'), text("src"), F.lit('" target="'), text("dst"), F.lit('"/>')))), "").alias("e"))
    head = '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="undirected">'
    return n.crossJoin(e).select(F.concat(F.lit(head), "n", "e", F.lit("</graph></graphml>")).alias("graphml"))


def node_detail(nodes: DataFrame, edges: DataFrame, separator: str = "|||") -> DataFrame:
    """Nodes with degree and `tags`: the type, then the distinct sources of source_id."""
    parts = F.filter(F.split("source_id", "\\Q" + separator + "\\E", -1), lambda x: x != "")
    return degrees(nodes, edges).withColumn("tags", F.array_distinct(F.concat(F.array("entity_type"), F.coalesce(parts, F.array().cast("array<string>")))))


def cooccurrences(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """src, dst, weight: entities (entity_id, a single word) that stand in one chunk, and in how many chunks they do.

    Pairs are made inside a chunk, among its distinct entities, so their number follows the text."""
    words = chunks.select("chunk_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"))).alias("word"))
    known = words.join(entities.select("entity_id", F.lower("entity_id").alias("word")), "word").select("chunk_id", "entity_id")
    held = known.groupBy("chunk_id").agg(F.sort_array(F.collect_set("entity_id")).alias("e")).filter(F.size("e") > 1)
    left = held.select("e", F.posexplode("e").alias("i", "src"))
    pairs = left.select("src", F.explode(F.slice(F.col("e"), F.col("i") + 2, F.size("e"))).alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("weight"))


def graph_search(hits: DataFrame, edges: DataFrame, sources: DataFrame, mode: str = "local") -> DataFrame:
    """query_id, chunk_id, score from scored entities (query_id, entity_id, score): 'local' goes from the entities to
    their own chunks, 'global' over their edges to the chunks of both ends, 'hybrid' takes the better of both.
    sources: entity_id, chunk_id."""
    local = hits.join(sources, "entity_id").select("query_id", "chunk_id", "score")
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    ends = hits.join(both, hits["entity_id"] == both["src"]).select("query_id", F.col("dst").alias("entity_id"), "score").union(hits.select("query_id", "entity_id", "score"))
    wide = ends.join(sources, "entity_id").select("query_id", "chunk_id", "score")
    rows = {"local": local, "global": wide}.get(mode)
    rows = local.union(wide) if rows is None else rows
    return rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
