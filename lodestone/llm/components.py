"""Connected components of an edge table, by contraction towards least neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored


def _mapped(frame: DataFrame, column: str, parents: DataFrame) -> DataFrame:
    """`column` replaced by its parent, where it has one."""
    to = parents.select(F.col("node").alias(column), F.col("parent").alias("to"))
    return frame.join(to, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")


def connected_components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """edges: a, b long. Returns node, label: every node that has an edge, with the same label throughout a component.

    In each round a node points to its least neighbour below it, and on to where that one points; edges and labels move
    along the pointers, loops and repeats go, until no edge is left. Node ids are hashes, so their order is random and
    the number of rounds is logarithmic. Edges and labels are written after each round."""
    spark = edges.sparkSession
    pairs = lambda rows: rows.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = stored(pairs(edges), folder, f"{name}-edges-0")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = stored(nodes.withColumn("label", F.col("node")), folder, f"{name}-labels-0")
    for step in range(200):
        if edges.isEmpty():
            return labels
        at, after = f"{step}", f"{step + 1}"
        parents = stored(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent")), folder, f"{name}-parents-{at}")
        parents = stored(_mapped(parents, "parent", parents), folder, f"{name}-jumped-{at}")
        labels = stored(_mapped(labels, "label", parents), folder, f"{name}-labels-{after}")
        edges = stored(pairs(_mapped(_mapped(edges, "a", parents), "b", parents)), folder, f"{name}-edges-{after}")
        discard(spark, folder, *(f"{name}-{x}-{at}" for x in ("parents", "jumped", "labels", "edges")))
    raise RuntimeError("components did not settle")
