"""Approximate nearest neighbours with a permutation index (operator 7).

Every vector is represented by its nearest pivots in order and posted, with its place in that order, in the inverted
files of these pivots alone. A query opens the files of its own nearest pivots. Each posting that it meets lessens the
vector's footrule distance, in which a pivot that one side lacks counts as if it came last; vectors that no opened file
holds are never looked at. The vectors of smallest footrule are reranked by their inner products with the query, on the
original vectors in double precision. Inner products are turned into nearness by one added component that gives all
vectors the largest norm.

The files are cut into blocks of vectors, dealt by hash. A block is sent to one task and stays there while the queries
stream past, so that no task holds all vectors or all queries. Equal vectors are one entry of the index.

Defined results: vectors that are null, empty, zero, of another length than most of the sample, or that hold a null or
non-finite component take no part; of rows that repeat a vec_id the one with the least vector counts, and it asks if any
of them does; a query's own vec_id is no candidate; a null vec_id takes no part; ties go to the smaller vec_id; a query
without candidates has no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, stored, work_dir

#: Rows that pivots are chosen from, and most pivots; the index itself holds every row.
PIVOT_SAMPLE, MOST_PIVOTS = 4096, 1024
#: Files that a vector is posted in, and that a query opens.
POSTED = 48
BLOCK, QUERY_BLOCK = 8192, 512
#: Vectors reranked for a query: this times the number of vectors to the power of 3/4, or LEAST_BREADTH times its square
#: root, whichever is more.
BREADTH, LEAST_BREADTH = 2.0, 20.0
NEIGHBOURS = 20
#: Most rows that are broadcast; beyond it a hot key is dealt in SALTS pieces.
BROADCAST_ROWS, SALTS = 100_000, 16


def _usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def pivots_for(n: int) -> int:
    """The number of pivots, so that files hold about 6 times the square root of n postings, until MOST_PIVOTS."""
    return min(MOST_PIVOTS, 1 << max(4, round(math.log2(8 * math.sqrt(max(n, 1))))))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, posted: int) -> np.ndarray:
    """The numbers of each vector's nearest pivots, in order."""
    near = -(vectors @ pivots.T)
    first = np.argpartition(near, posted - 1, 1)[:, :posted] if posted < len(pivots) else np.tile(np.arange(len(pivots)), (len(vectors), 1))
    own = np.take_along_axis(near, first, 1)
    return np.take_along_axis(first, np.argsort(own, 1, kind="stable"), 1).astype(np.uint16)


def lifted(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Vectors with the component that gives them the norm `norm`."""
    rest = np.sqrt(np.maximum(norm * norm - (vectors * vectors).sum(1), 0))
    return np.column_stack([vectors, rest])


class Files:
    """The inverted files of a block: for each pivot, the vectors that it is near to and its place in their orders."""

    def __init__(self, order: np.ndarray, pivots: int):
        n, self.posted = order.shape
        by_pivot = np.argsort(order.ravel(), kind="stable")
        self.cut = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
        self.vector, self.place = by_pivot // self.posted, (by_pivot % self.posted).astype(np.int32)
        self.n = n

    def saved(self, order: np.ndarray) -> np.ndarray:
        """By how much each vector's footrule distance from a query of this order is less than that of one without a
        common pivot; 0 for vectors that no opened file holds."""
        total = np.zeros(self.n, np.int64)
        for place, pivot in enumerate(order.tolist()):
            a, b = self.cut[pivot], self.cut[pivot + 1]
            total[self.vector[a:b]] += self.posted - np.abs(self.place[a:b] - place)  # a file holds a vector once
        return total


def nearest(ids: np.ndarray, vectors: np.ndarray, files: Files, queries: np.ndarray, orders: np.ndarray, breadth: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the block's k best of the `breadth` vectors of smallest footrule: place of the query, vector, score."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for q, (query, order) in enumerate(zip(queries, orders, strict=True)):
        saved = files.saved(order)
        pick = np.argpartition(-saved, breadth - 1)[:breadth] if breadth < len(ids) else np.arange(len(ids))
        pick = pick[saved[pick] > 0]
        score = (vectors[pick] * query).sum(1)
        best = np.lexsort((ids[pick], -score))[:k]
        found.append((np.full(len(best), q), ids[pick][best], score[best]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _entries(table: DataFrame, query: Column, k: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """Every vec_id that takes part (vec_id, v, asks), and the entries of the index: v, ids (its k + 1 least), entry (the
    least of them) and asks."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    rows = stored(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.bool_or("asks").alias("asks")), folder, "vectors")
    place = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    ids = rows.select("vec_id", "v").withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.filter("asks").select("v").distinct().withColumn("asked", F.lit(True))
    entries = ids.join(asked, "v", "left").select("v", "ids", F.col("ids")[0].alias("entry"), F.coalesce("asked", F.lit(False)).alias("asks"))
    return rows, stored(entries, folder, "entries")


def _met(rows: DataFrame, small: DataFrame, key: str, how: str) -> DataFrame:
    """Join by a key that many rows may share."""
    if small.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(small), key, how)
    wide = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.floor(F.rand(7) * SALTS).cast("int"))
    return salted.join(wide, [key, "salt"], how).drop("salt")


def nearest_neighbours(table: DataFrame, query: Column, k: int = NEIGHBOURS, pivots: int | None = None, breadth: float = BREADTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for every row for which `query` holds."""
    spark = table.sparkSession
    folder = work_dir(spark, "permutations")
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows, entries = _entries(table, query, k, folder)
    scale = 1 << 30
    share = min(scale, 2 * scale * PIVOT_SAMPLE // max(entries.count(), 1))  # twice the sample in expectation, whatever the size
    drawn = entries.filter(F.pmod(F.xxhash64("entry"), F.lit(scale)) < share)
    sample = [x.v for x in drawn.select("v").orderBy(F.xxhash64("entry"), "entry").limit(PIVOT_SAMPLE).collect()]
    if not sample:
        return empty
    width = Counter(map(len, sample)).most_common(1)[0][0]
    rows, entries = (x.filter(F.size("v") == width) for x in (rows, entries))
    n, norm, asked = entries.agg(F.count("*"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))), F.count_if("asks")).first()
    if not asked:
        return empty
    chosen = lifted(np.array([x for x in sample if len(x) == width][: pivots or pivots_for(n)]), norm)
    size = len(chosen)
    posted = min(POSTED, size)
    reranked = max(breadth * n**0.75, LEAST_BREADTH * n**0.5)
    blocks, asking = math.ceil(n / BLOCK), math.ceil(asked / QUERY_BLOCK)

    def pack(query_side: bool):
        def run(group: pa.Table) -> pa.Table:
            group = group.sort_by("entry")
            ids = group.column("entry").to_numpy()
            vectors = np.ascontiguousarray(pc.list_flatten(group.column("v")).to_numpy().reshape(-1, width))
            order = nearest_pivots(np.column_stack([vectors, np.zeros(len(ids))]) if query_side else lifted(vectors, norm), chosen, posted)
            cells = [pa.array([x.tobytes()], pa.binary()) for x in (ids, vectors, order)]
            return pa.table([group.column("part")[:1], *cells], names=["part", "ids", "vectors", "orders"])

        return run

    packed = "part int, ids binary, vectors binary, orders binary"
    part = lambda many: F.pmod(F.xxhash64("entry", F.lit(7)), F.lit(many)).cast("int").alias("part")
    data = stored(entries.select("entry", "v", part(blocks)).groupBy("part").applyInArrow(pack(False), packed), folder, "index")
    ask = stored(entries.filter("asks").select("entry", "v", part(asking)).groupBy("part").applyInArrow(pack(True), packed), folder, "queries")
    everywhere = ask.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = data.withColumn("asks", F.lit(0)).unionByName(everywhere.withColumn("asks", F.lit(1)))
    meet = meet.repartition("part").sortWithinPartitions("part", "asks")  # each block before the queries that it meets

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                cell = lambda c, t, r=r, batch=batch: np.frombuffer(batch.column(c)[r].as_buffer(), t)
                ids, vectors = cell("ids", np.int64), cell("vectors", np.float64).reshape(-1, width)
                order = cell("orders", np.uint16).reshape(-1, posted)
                if not batch.column("asks")[r].as_py():
                    at, block = batch.column("part")[r].as_py(), (ids.copy(), vectors.copy(), Files(order, size))
                elif block and batch.column("part")[r].as_py() == at:
                    many = max(k + 1, math.ceil(reranked * len(block[0]) / n))
                    q, v, s = nearest(*block, vectors, order, many, k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(v), pa.array(s)], ["query", "entry", "score"])

    found = meet.select("part", "asks", "ids", "vectors", "orders").mapInArrow(search, "query long, entry long, score double")
    first = lambda by: F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), by))
    found = stored(found.withColumn("place", first("entry")).filter(F.col("place") <= k + 1).drop("place"), folder, "found")
    discard(spark, folder, "index", "queries")
    several = entries.filter(F.size("ids") > 1)
    ids = _met(found, several.select("entry", "ids"), "entry", "left").select("query", "score", F.explode(F.coalesce("ids", F.array("entry"))).alias("vec_id"))
    best = ids.withColumn("place", first("vec_id")).filter(F.col("place") <= k + 1)
    best = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    best = stored(best, folder, "best").withColumnRenamed("query", "entry")
    # the ids that ask, with the entry that stands for their vector
    apart = several.select("v", "entry")
    askers = rows.filter("asks").select("vec_id", "v")
    askers = askers.join(F.broadcast(apart) if apart.count() <= BROADCAST_ROWS // 10 else apart, "v", "left").select(F.col("vec_id").alias("query_id"), F.coalesce("entry", "vec_id").alias("entry"))
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    full = _met(askers, best, "entry", "inner").select("query_id", F.posexplode(others).alias("at", "hit"))
    return full.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
