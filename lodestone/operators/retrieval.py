"""Batch retrieval: a table of queries against all chunks; tasks keep each query's best only.

Queries are dealt into blocks of bounded size by hash. Each block is one pass over the chunks, in which its terms or its
vectors go to the tasks; its hits are written before the next block begins, so that the driver and the tasks hold one
block at a time, however many there are. Queries without an id take no part."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.terms import accepted_parts, layer_weight, spellings, term_layers
from .written import written

#: Most queries, and characters of queries, of a block in expectation.
QUERY_BLOCK, QUERY_CHARS = 4096, 4_000_000
#: Cells of the score tables that a task holds at once, and the pairs of a chunk and a query's term that it scores at once.
CELLS, PAIRS = 1 << 20, 1 << 20
#: Texts that are made Python strings at once.
TEXTS = 64


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, weight, auxiliary: both layers of every query's terms."""
    return _terms(queries.select("query_id", term_layers(F.col("text")).alias("layers")))


def _terms(layers: DataFrame) -> DataFrame:
    named = F.array(*(F.struct(F.col(f"layers.{name}").alias("terms"), F.lit(auxiliary).alias("auxiliary")) for name, auxiliary in (("anchors", False), ("auxiliaries", True))))
    rows = layers.select("query_id", F.explode(named).alias("layer")).select("query_id", "layer.auxiliary", F.explode("layer.terms").alias("term"))
    return rows.select("query_id", "term", layer_weight(F.col("term"), F.col("auxiliary")).alias("weight"), "auxiliary")


def query_needles(queries: DataFrame) -> DataFrame:
    """query_id, needle, term, weight: what to look for in passages. A term counts once, whichever of its spellings is
    met; needles with a null term are the ones of which a passage must hold one. The layers are written once."""
    layers = written(_spread(queries.select("query_id", "text")).select("query_id", term_layers(F.col("text")).alias("layers")), "layers")
    terms = _terms(layers).select("query_id", F.explode(spellings(F.col("term"))).alias("needle"), "term", "weight")
    required = layers.select("query_id", F.explode("layers.required").alias("part"))
    required = required.select("query_id", F.explode(accepted_parts(F.col("part"))).alias("needle")).distinct()
    return terms.filter("weight > 0").unionByName(required.select("query_id", "needle", F.lit(None).cast("string").alias("term"), F.lit(0.0).alias("weight")))


def _blocks(queries: DataFrame, size: Column) -> list[DataFrame]:
    """The queries with an id in blocks of bounded size."""
    rows = queries.filter("query_id IS NOT NULL")
    many, chars = rows.agg(F.count("*"), F.sum(size)).first()
    blocks = max(math.ceil(many / QUERY_BLOCK), math.ceil((chars or 0) / QUERY_CHARS))
    return [rows.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b) for b in range(blocks)]


def _best(found: DataFrame, k: int, *ties: str) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), *ties))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def _spread(frame: DataFrame) -> DataFrame:
    """The frame in as many partitions as tasks can run, if it is read in fewer (a table of few files)."""
    tasks = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(tasks) if frame.rdd.getNumPartitions() < tasks else frame


def _passes(blocks: list[DataFrame], run: Callable[[DataFrame], tuple[DataFrame, Broadcast]]) -> list[DataFrame]:
    """The hits of each block in turn, written; what the tasks were told of a block is dropped then."""
    found = []
    for block in blocks:
        hits, told = run(block)
        found.append(written(hits, "hits"))
        told.destroy()
    return found


class _Best:
    """The best k hits of each query so far. Hits gather until they are twice as many as those that were left by the last
    cut, so that sorting takes little of the time."""

    def __init__(self, k: int):
        self.k, self.held, self.new, self.limit = k, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], CELLS // 4
        self.size = 0

    def add(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray) -> None:
        self.new.append((query, chunk, score))
        self.size += len(query)
        if self.size > self.limit:
            self._cut()

    def _cut(self) -> None:
        query, chunk, score = (np.concatenate(x) for x in zip(self.held, *self.new, strict=True))
        order = np.lexsort((chunk, -score, query))
        query, chunk, score = query[order], chunk[order], score[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < self.k
        self.held, self.new, self.size = (query[keep], chunk[keep], score[keep]), [], 0
        self.limit = max(CELLS // 4, len(self.held[0]))

    def rows(self, ids: np.ndarray, name: str) -> pa.RecordBatch:
        self._cut()
        return pa.RecordBatch.from_arrays([pa.array(ids[self.held[0]], pa.int64()), pa.array(self.held[1]), pa.array(self.held[2])], ["query_id", name, "score"])


def _listed(groups: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[g] ... first[g] + many[g] - 1 of every group in turn."""
    n = many[groups]
    return np.repeat(first[groups] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class _Needles:
    """All needles of a block of queries in one automaton, with the terms that each stands for and their queries."""

    def __init__(self, ids: np.ndarray, rows: pa.Table):
        self.ids = ids
        query = np.searchsorted(ids, rows.column("query_id").to_numpy())
        needle, self.names = self._numbered(rows.column("needle"))
        term = rows.column("term")
        must = term.is_null().to_numpy(zero_copy_only=False)
        self.must = self._lists(needle[must], query[must])
        # terms of one query are numbered together, so that a term counts once for it
        keys = pc.binary_join_element_wise(pc.cast(rows.column("query_id"), pa.string()), pc.fill_null(term, ""), "\0")
        number, names = self._numbered(keys)
        self.terms = self._lists(needle[~must], number[~must])
        self.several = np.bincount(number[~must], minlength=len(names)) > 1  # terms with several spellings
        self.query_of, self.weight_of = np.zeros(len(names), np.int64), np.zeros(len(names))
        self.query_of[number[~must]] = query[~must]
        self.weight_of[number[~must]] = rows.column("weight").to_numpy()[~must]

    @staticmethod
    def _numbered(column: pa.ChunkedArray) -> tuple[np.ndarray, list[str]]:
        coded = column.combine_chunks().dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()

    def _lists(self, needle: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(needle, kind="stable")
        many = np.bincount(needle, minlength=len(self.names))
        return np.cumsum(many) - many, many, value[order]

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for i, name in enumerate(self.names):
            machine.add_word(name, i)
        machine.make_automaton()
        return machine

    def groups(self, machine, texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Where a group of texts begins and the needles of each of them: as many texts as have CELLS cells and PAIRS pairs, of
        which long texts and frequent words make many, but one text at least."""
        cost = self.terms[1] + self.must[1]
        first, group, pairs = 0, [], 0
        for at in range(0, len(texts), TEXTS):
            for text in texts.slice(at, TEXTS).to_pylist():
                met = np.unique(np.fromiter((i for _, i in machine.iter(text or "")), np.int64))
                more = int(cost[met].sum())
                if group and (pairs + more > PAIRS or (len(group) + 1) * len(self.ids) > CELLS):
                    yield first, group
                    first, group, pairs = first + len(group), [], 0
                group.append(met)
                pairs += more
        if group:
            yield first, group

    def scores(self, chunk: np.ndarray, needle: np.ndarray, chunks: int) -> np.ndarray:
        """chunks x queries, from the pairs of a chunk and a needle that it holds; 0 without a required needle."""
        size = len(self.ids)

        def met(lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
            first, many, value = lists
            return np.repeat(chunk, many[needle]), value[_listed(needle, first, many)]

        of, term = met(self.terms)
        if (twice := self.several[term]).any():  # a term counts once, whichever of its spellings are met
            width = len(self.query_of)
            once = np.unique(of[twice] * width + term[twice])
            of, term = np.append(of[~twice], once // width), np.append(term[~twice], once % width)
        total = np.bincount(of * size + self.query_of[term], self.weight_of[term], chunks * size)
        allowed = np.zeros(chunks * size, bool)
        of, query = met(self.must)
        allowed[of * size + query] = True
        return np.round(np.where(allowed, total, 0.0), 9).reshape(chunks, size)  # equal sums stay equal in any order


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, score, rank: the weights of the query's terms that a chunk holds as substrings, for chunks that
    hold one of its required pieces; scores above 0, ties to the smaller chunk_id."""
    rows = _spread(chunks.filter("chunk_id IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), "text"))
    found = _passes(_blocks(queries, F.length("text")), lambda block: _keyword_pass(rows, block, k))
    if not found:
        return chunks.sparkSession.createDataFrame([], "query_id long, chunk_id long, score double, rank int")
    return _best(reduce(DataFrame.unionAll, found), k, "chunk_id")


def _keyword_pass(chunks: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    rows = query_needles(queries.select(F.col("query_id").cast("long").alias("query_id"), "text")).toArrow()  # of one block
    needles = _Needles(np.unique(rows.column("query_id").to_numpy()), rows)
    told = chunks.sparkSession.sparkContext.broadcast(needles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needles, best = told.value, _Best(k)
        machine = needles.automaton() if needles.names else None
        for batch in batches if machine else ():
            for at, hits in needles.groups(machine, batch.column(1)):
                ids = batch.column(0).slice(at, len(hits)).to_numpy()
                score = needles.scores(np.repeat(np.arange(len(hits)), [len(x) for x in hits]), np.concatenate(hits), len(hits))
                if k < len(hits):  # of each query the k best of the group, with all that tie with the last of them
                    least = np.partition(score, len(hits) - k, axis=0)[len(hits) - k]
                    chunk, query = np.nonzero((score > 0) & (score >= least))
                else:
                    chunk, query = np.nonzero(score)
                best.add(query, ids[chunk], score[chunk, query])
        yield best.rows(needles.ids, "chunk_id")

    return chunks.mapInArrow(run, "query_id long, chunk_id long, score double"), told


def _directions(vectors: DataFrame, column: str) -> DataFrame:
    """Vectors as doubles, without those that are null, empty or zero or hold a null or a value that isn't finite."""
    v = F.col(column).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.withColumn("v", v)
    return rows.filter(F.coalesce(~F.exists("v", bad) & F.exists("v", lambda x: x != 0), F.lit(False)))


def _unit(column: pa.Array) -> np.ndarray:
    v = pc.list_flatten(column).to_numpy().reshape(len(column), -1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def vector_search(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest others by cosine, exactly, for the rows for which `asked` holds, among
    vectors of the query's length. Rows without a usable vector or id take no part."""
    rows = _directions(vectors.filter("vec_id IS NOT NULL").withColumn("asked", F.coalesce(asked, F.lit(False))), "embedding")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v", "asked")
    queries = rows.filter("asked").select(F.col("vec_id").alias("query_id"), "v")
    rows = _spread(rows.select("vec_id", "v"))
    blocks = [block.filter(F.size("v") == width) for block in _blocks(queries, 8 * F.size("v")) for (width,) in block.select(F.size("v")).distinct().collect()]  # one length, but for tables of several models
    found = _passes(blocks, lambda block: _vector_pass(rows, block, k))
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    return _best(reduce(DataFrame.unionAll, found), k, "vec_id")


def _vector_pass(rows: DataFrame, queries: DataFrame, k: int) -> tuple[DataFrame, Broadcast]:
    block = queries.orderBy("query_id").toArrow().combine_chunks()
    told = rows.sparkSession.sparkContext.broadcast((block.column("query_id").to_numpy(), _unit(block.column("v").combine_chunks())))
    group, width = max(1, CELLS // max(block.num_rows, 1)), len(block.column("v")[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (q_ids, q), best = told.value, _Best(k)
        for batch in batches:
            for at in range(0, batch.num_rows, group):
                part = batch.slice(at, group)
                ids = part.column(0).to_numpy()
                score = q @ _unit(part.column(1)).T
                score[q_ids[:, None] == ids[None, :]] = -2
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None] if k < len(ids) else -2.0
                query, hit = np.nonzero((score > -1.5) & (score >= least))
                best.add(query, ids[hit], score[query, hit])
        yield best.rows(q_ids, "vec_id")

    return rows.filter(F.size("v") == width).mapInArrow(run, "query_id long, vec_id long, score double"), told


def hit_rate(results: DataFrame, queries: DataFrame, threshold: float | None) -> DataFrame:
    """One row: questions, those whose best score reaches the threshold (0 or null: 0.3), and the rate to four places."""
    top = results.groupBy("query_id").agg(F.max("score").alias("top"))
    rows = queries.select("query_id").join(top, "query_id", "left")
    hit = F.coalesce(F.col("top"), F.lit(0.0)) >= (threshold or 0.3)
    return rows.agg(F.count("*").alias("questions"), F.count_if(hit).alias("hits"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 4).alias("hit_rate"))
