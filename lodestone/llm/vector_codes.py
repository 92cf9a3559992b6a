"""Compression of vectors into codes of nearest codebook entries, by partial-distance search (operator 13).

Components become integers, so that every distance, sum and mean is exact and every run gives the same codebooks. A
vector is cut into equal parts; each part has a codebook, which a fixed number of rounds of assignment and averaging
fits to all vectors. A round is one pass: each task sends the sums and counts of its parts by entry, at most one row
for each entry, and Spark adds them up. Only the codebooks (entries x width integers) are on the driver and in each task.

The nearest entry is found by partial distances. Dimensions come in descending variance of the codebook. The entry that
is nearest in the first of them is completed, which gives the best complete distance so far; then the next dimensions
are added for all entries that are left, and a mask drops those whose sum strictly exceeds it. An entry whose sum equals
it stays, so that ties go to the lower index.

Defined results: a vector that is null, or holds a null or non-finite component, takes no part; nor does one of another
length than most (of lengths equally frequent, the longest counts) or of length 0. A length that can't be cut evenly is
filled up with zeros. Integers beyond the bound under which all distances fit 64 bits count as that bound. A null vec_id
comes after all others; rows that repeat a vec_id are vectors of their own, ordered by their components. With fewer
vectors than entries, there are as many entries as vectors. Rows without a label are a group of their own. label_error
is null if it doesn't fit 64 bits. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, work_dir

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Dimensions added between two masks, vectors handled at once, and the share of entries from which on only those that
#: are left are added to.
STEP, BLOCK, DENSE = 2, 512, 0.2
#: Most label sums that are broadcast; beyond it labels are dealt in SALTS pieces.
BROADCAST_LABELS, SALTS = 100_000, 16


def largest_component(width: int) -> int:
    """The largest size of a component under which the squared distances of whole vectors fit 62 bits."""
    return min(math.isqrt((1 << 62) // (4 * max(width, 1))), (1 << 31) - 1)


class Codebook:
    """Integer entries of one part, with the order in which their dimensions are added."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        wide = entries.astype(np.float64)
        self.order = np.argsort(-wide.var(0), kind="stable") if len(entries) else np.arange(entries.shape[1])
        self.sorted = np.ascontiguousarray(entries[:, self.order])

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each row's nearest entry, ties to the lower, and its squared distance."""
        index, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), BLOCK):
            index[at : at + BLOCK], best[at : at + BLOCK] = self._block(np.ascontiguousarray(x[at : at + BLOCK][:, self.order]))
        return index, best

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = x.shape
        e = self.sorted
        most = max(int(np.abs(x).max(initial=0)), int(np.abs(e).max(initial=0)))
        if 4 * most * most * width < 1 << 31:  # half the bytes, the same integers
            x, e = x.astype(np.int32), e.astype(np.int32)
        total = np.zeros((n, len(e)), x.dtype)
        self._add(total, x, e, 0, min(STEP, width))
        guess = total.argmin(1)
        gap = x - e[guess]
        bound = (gap * gap).sum(1, dtype=x.dtype)[:, None]  # the best complete distance so far
        at = min(STEP, width)
        left = total <= bound
        while at < width and np.count_nonzero(left) > DENSE * left.size:  # most are left: all are added, which is cheaper
            self._add(total, x, e, at, min(at + STEP, width))
            at = min(at + STEP, width)
            left = total <= bound
        row, entry = np.nonzero(left)
        part, bound = total[row, entry], bound[:, 0]
        for d in range(at, width):
            gap = x[row, d] - e[entry, d]
            part = part + gap * gap
            stay = np.flatnonzero(part <= bound[row])
            row, entry, part = row[stay], entry[stay], part[stay]
        begin = np.searchsorted(row, np.arange(n))  # every row keeps its guess at least, and entries are in order
        best = np.minimum.reduceat(part, begin)
        hit = np.flatnonzero(part == np.repeat(best, np.diff(np.append(begin, len(row)))))
        return entry[hit[np.searchsorted(row[hit], np.arange(n))]], best

    @staticmethod
    def _add(total: np.ndarray, x: np.ndarray, e: np.ndarray, first: int, last: int) -> None:
        for d in range(first, last):
            gap = x[:, d, None] - e[None, :, d]
            gap *= gap
            total += gap


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return pc.list_flatten(batch.column("v")).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def integer_vectors(table: DataFrame, vector: Column, keep: dict[str, Column], folder: str) -> tuple[DataFrame, int]:
    """The rows that take part, with the columns of `keep` and their integer components v, stored; and the width."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = table.select(*(c.alias(name) for name, c in keep.items()), vector.cast("array<double>").alias("v"))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0) & ~F.coalesce(F.exists("v", bad), F.lit(True)))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("many")).orderBy(F.desc("many"), F.desc("n")).first()
    if not lengths:
        return rows, 0
    width = -(-lengths.n // PARTS) * PARTS
    most = largest_component(width)
    whole = F.transform("v", lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x * SCALE, F.lit(-1e15)), F.lit(1e15))), F.lit(-most)), F.lit(most)).cast("int"))
    filled = F.concat(whole, F.array_repeat(F.lit(0), width - lengths.n)) if width > lengths.n else whole
    return stored(rows.filter(F.size("v") == lengths.n).withColumn("v", filled), folder, "integers"), width


def _partial_sums(rows: DataFrame, books: list[Codebook], width: int) -> DataFrame:
    """part, entry, n and sums: at most one row for each entry and task."""
    size = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((PARTS, len(books[0].entries)), np.int64)
        sums = np.zeros((*n.shape, size), np.int64)
        for batch in batches:
            x = _matrix(batch, width)
            for p, book in enumerate(books):
                mine = x[:, p * size : (p + 1) * size]
                index, _ = book.nearest(mine)
                order = np.argsort(index, kind="stable")
                used, begin = np.unique(index[order], return_index=True)
                if len(used):
                    sums[p, used] += np.add.reduceat(mine[order], begin)
                    n[p] += np.bincount(index, minlength=n.shape[1])
        part, entry = np.nonzero(n)
        flat = pa.array(sums[part, entry].ravel())
        sums_of = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * size), flat)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), sums_of], ["part", "entry", "n", "sums"])

    return rows.select("v").mapInArrow(run, "part int, entry int, n long, sums array<long>")


def fit(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """Codebooks of the integer vectors `rows` (vec_id, v), started with the vectors of the smallest ids."""
    size = width // PARTS
    seeds = np.array([r.v for r in rows.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()], np.int64)
    books = [Codebook(seeds[:, p * size : (p + 1) * size]) for p in range(PARTS)]
    for _ in range(rounds):
        sums = _partial_sums(rows, books, width).groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(size))).alias("sums"))
        after = [book.entries.copy() for book in books]
        for r in sums.collect():  # a row for each used entry
            after[r.part][r.entry] = np.array(r.sums, np.int64) // r.n
        books = [Codebook(x) for x in after]
    return books


def encode(rows: DataFrame, books: list[Codebook], width: int, keep: list[str]) -> DataFrame:
    """The columns of `keep` with code and error of every integer vector."""
    size = width // PARTS
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, width)
            code, error = np.full(len(x), "", "U8"), np.zeros(len(x), np.int64)
            for p, book in enumerate(books):
                index, best = book.nearest(x[:, p * size : (p + 1) * size])
                code, error = np.char.add(code, digits[index]), error + best
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(code.tolist(), pa.string()), pa.array(error)], [*keep, "code", "error"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "v").mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "code string", "error long"]))


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.entries.ravel().tolist()).encode()).hexdigest()


def vector_codes(table: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector of `table` (vec_id, embedding, label)."""
    spark = table.sparkSession
    folder = work_dir(spark, "codes")
    rows, width = integer_vectors(table, F.col("embedding"), {"vec_id": F.col("vec_id").cast("long"), "label": F.col("label")}, folder)
    if not width:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = fit(rows, width, entries, rounds)
    coded = stored(encode(rows, books, width, ["vec_id", "label"]), folder, "codes")
    sums = stored(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")), folder, "labels").withColumnRenamed("label", "of")
    if sums.count() <= BROADCAST_LABELS:
        full = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("of")))
    else:
        wide = sums.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
        full = salted.join(wide, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("piece")))
    return full.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
