"""Class-based n-gram language model after Brown et al. (operator 2).

Words are counted over the whole training part. Exchange clustering then assigns words to classes: in every round the
neighbours' classes of each unit are counted over all training text, and each unit of the round's half moves to the
class that raises the likelihood of the class bigrams most, until few move. A unit is a word that occurs LEAST times or
more, or all other words with one ending (their own neighbours are too few to place them singly); words that aren't
among the HOT most frequent are also placed by their endings. A text's probability is the
product of class transitions, given the two classes before and smoothed by Witten-Bell interpolation down to single
classes, and of word emissions with absolute discounting; the discount of all classes is the share of unknown words.

Word counts are exact at any size: the HOT most frequent words go to the tasks as arrays of bounded size, tokens of
other words meet their counts in a shuffle join. Words are told apart by 64-bit hashes.

Defined results: a null or empty text is the end token alone; a null doc_id is in the training part; rows that repeat
a doc_id are texts of their own; without training text all words are unknown; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, work_dir
from .vectext import ASCII_SPACE, SPACE_CUT, char_table, joined, lower_ascii, mix64, parts, slices, span_hashes, word_spans

CLASSES = 64
#: Half-rounds of exchange at most; they end when two in a row move less than the share SETTLED of the units.
ROUNDS, SETTLED = 6, 0.01
#: Occurrences that make a word a unit of its own, and units of all other words.
LEAST, ENDINGS = 100, 4096
#: Rows of a count table that a task keeps as a matrix; it keeps others as pairs.
DENSE = 1 << 14
#: Rows of a count table that travel as one.
RANGE = 64
#: Words whose counts go to every task; the counts of the others are joined.
HOT = 1_000_000
SLICE_CHARS = 1 << 20
FOLDS = 10
PSEUDO = 0.1
END = np.int64(0x5EED0F7E47)  # stands for the end token among the hashes
_BOS = CLASSES  # the context before a text
_WIDE = CLASSES + 1


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == 0, F.lit(False))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and ending of every token, the end tokens among them, one text after another, and each text's number of them."""
    space = char_table(tuple(ASCII_SPACE))
    counts, hashes, endings = np.ones(len(texts), np.int64), [], []
    for rows, group in parts(texts, SPACE_CUT):
        _, cp, bounds = joined(group)
        cp = lower_ascii(cp)
        starts, ends = word_spans(cp, space, bounds)
        hashes.append(span_hashes(cp, starts, ends).view(np.int64))
        before = np.where(ends - starts > 1, cp[np.maximum(ends - 2, 0)], 0) if len(ends) else cp[:0]
        last = cp[ends - 1] if len(ends) else cp[:0]
        endings.append((mix64(last.astype(np.uint64) << np.uint64(32) | before.astype(np.uint64)) % np.uint64(ENDINGS)).astype(np.int32))
        np.add.at(counts, rows, np.diff(np.searchsorted(starts, bounds)))
    at = np.cumsum(counts) - 1
    inner = np.ones(int(counts.sum()), bool)
    inner[at] = False
    word, ending = np.full(len(inner), END), np.zeros(len(inner), np.int32)
    if hashes:
        word[inner], ending[inner] = np.concatenate(hashes), np.concatenate(endings)
    return word, ending, counts


def word_counts(docs: DataFrame, folder: str) -> DataFrame:
    """w, c, ending of every word of the training part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                word, ending, _ = tokens(part.column("text").to_pylist())
                w, first, c = np.unique(word, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w), pa.array(c), pa.array(ending[first])], ["w", "c", "ending"])

    rows = docs.filter("NOT held_out").select("text").mapInArrow(run, "w long, c long, ending int")
    return stored(rows.groupBy("w").agg(F.sum("c").alias("c"), F.first("ending").alias("ending")), folder, "counts")


class Hot(NamedTuple):
    """The most frequent words in order of hash: their counts, the unit of each, and the endings of those that are units
    of their own, which come before the units of endings, the most frequent first."""

    w: np.ndarray
    c: np.ndarray
    unit: np.ndarray
    frequent: np.ndarray

    @property
    def own(self) -> int:
        return len(self.frequent)


def hot_words(counts: DataFrame) -> Hot:
    """Words of the highest counts, HOT at most: the least count is read off a histogram of counts, so that no task
    orders the words of others. Words of equal count are all in or all out."""
    step = F.floor(F.log2("c") * 16)
    histogram = {r.s: r.n for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()}  # under a thousand rows
    least, total = None, 0
    for s in sorted(histogram, reverse=True):
        if (total := total + histogram[s]) > HOT:
            break
        least = s
    rows = counts.filter(step >= least if least is not None else F.lit(False)).toArrow()
    w, c, ending = (rows.column(x).to_numpy() for x in ("w", "c", "ending"))
    order = np.lexsort((w, -c))
    w, c, ending = w[order], c[order], ending[order]
    own = int((c >= LEAST).sum())
    unit = np.where(np.arange(len(w)) < own, np.arange(len(w)), own + ending).astype(np.int32)
    order = np.argsort(w)
    return Hot(w[order], c[order], unit[order], ending[:own])


def index_tokens(docs: DataFrame, hot: Hot, folder: str) -> DataFrame:
    """Each text's tokens as places in the hot words (-1 - ending for others), with the hashes of the others."""
    shared = docs.sparkSession.sparkContext.broadcast(hot.w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                word, ending, counts = tokens(part.column("text").to_pylist())
                w, back = np.unique(word, return_inverse=True)
                at = np.minimum(np.searchsorted(known, w), max(len(known) - 1, 0))
                place = np.where(known[at] == w, at, -1) if len(known) else np.full(len(w), -1)
                ids = place[back.ravel()]
                cold = ids < 0
                ids = np.where(cold, -1 - ending, ids).astype(np.int32)
                cut = np.append(0, np.cumsum(counts))
                many = np.append(0, np.cumsum(cold))[cut]
                data, others = ids.tobytes(), word[cold].tobytes()
                pack = lambda data, cut, size: pa.array([data[size * a : size * b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("held_out"), pack(data, cut, 4), pack(others, many, 8)], ["row", "doc_id", "held_out", "ids", "cold"])

    return stored(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, ids binary, cold binary"), folder, "tokens")


def _sequences(column: pa.Array, unit: np.ndarray, own: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, units and first-token flags of groups of texts, about a million tokens at a time."""
    group: list[np.ndarray] = []
    size = 0
    for k in range(len(column)):
        group.append(np.frombuffer(column[k].as_buffer(), np.int32))
        size += len(group[-1])
        if size >= 1 << 20 or k == len(column) - 1:
            ids = np.concatenate(group)
            first = np.zeros(len(ids), bool)
            first[np.cumsum([0, *map(len, group[:-1])])] = True
            yield ids, np.where(ids >= 0, unit[np.maximum(ids, 0)] if len(unit) else 0, own - 1 - ids), first
            group, size = [], 0


def _contexts(of_class: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The classes one and two places before each token."""
    one = np.append(_BOS, of_class[:-1])
    one[first] = _BOS
    two = np.append(_BOS, one[:-1])
    two[first] = _BOS
    return one, two


def _summed(index: DataFrame, hot: Hot, classes: np.ndarray, events, rows: int, width: int, folder: str, name: str) -> DataFrame:
    """key, counts (int64): how often `events(units, classes, first)`, which gives rows and places in them, names each
    place of each row, over the training texts. A task keeps frequent rows as a matrix and others as pairs, and sends what
    it has of RANGE rows as one, so that the shuffle moves a row for each range and task at most."""
    shared = index.sparkSession.sparkContext.broadcast((hot.unit, hot.own, classes))
    dense = min(rows, DENSE)
    span = RANGE * width

    def packed(keys: list[int], data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], ["key", "counts"])

    def ranges(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sorted places in all rows, and their counts, as one row for each range: the places in it, then the counts."""
        at, first = np.unique(keys // span, return_index=True)
        place, many = (keys % span).astype(np.uint32), counts.astype(np.uint32)
        cut = np.append(first, len(keys)).tolist()
        for k in range(0, len(at), 512):
            yield packed(at[k : k + 512].tolist(), [place[a:b].tobytes() + many[a:b].tobytes() for a, b in zip(cut[k:], cut[k + 1 : k + 513], strict=False)])

    def pairs(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
        yield from ranges(keys, np.bincount(back.ravel(), np.concatenate([n for _, n in found])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, own, classes = shared.value
        total, rest, held = np.zeros(dense * width, np.int32), [], 0
        for batch in batches:
            for _, units, first in _sequences(batch.column(0), unit, own):
                row, place = events(units, classes[units].astype(np.int64), first)
                key = row.astype(np.int64) * width + place
                low = key < dense * width
                total += np.bincount(key[low], minlength=dense * width).astype(np.int32)
                if not low.all():
                    rest.append(np.unique(key[~low], return_counts=True))
                    held += len(rest[-1][0])
                if held > 1 << 21:
                    yield from pairs(rest)
                    rest, held = [], 0
        some = np.flatnonzero(total)
        rest.append((some, total[some]))
        yield from pairs(rest)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = total.get(key)
                if held is None:
                    held = total[key] = np.zeros(span, np.int64)
                place, many = np.frombuffer(data, np.uint32).reshape(2, -1)
                held[place] += many  # a place is named once
        for key, held in total.items():
            matrix = held.reshape(RANGE, width)
            some = np.flatnonzero(matrix.any(1))
            yield packed((key * RANGE + some).tolist(), [matrix[k].tobytes() for k in some])

    partial = index.filter("NOT held_out").select("ids").mapInArrow(run, "key long, counts binary")
    return stored(partial.repartition("key").mapInArrow(add, "key long, counts binary"), folder, name)


def _turn(units: np.ndarray, step: int) -> np.ndarray:
    """Which units may move in a half-round."""
    return mix64(units.astype(np.uint64)) % np.uint64(2) == step % 2


def _profiles(of_turn: np.ndarray):
    """Events of a half-round. Rows below _WIDE: of each context, the classes after it. Row _WIDE + u, of the units that may
    move: the class before (or the start), and after these the class after."""

    def events(units: np.ndarray, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        one, _ = _contexts(classes, first)
        follow = np.flatnonzero(~first)
        may = of_turn[units]
        here, after = np.flatnonzero(may), follow[may[follow - 1]]
        rows = np.concatenate([one, _WIDE + units[here], _WIDE + units[after - 1]])
        return rows, np.concatenate([classes, one[here], _WIDE + classes[after]])

    return events


def _trigrams(units: np.ndarray, classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = _contexts(classes, first)
    return two * _WIDE + one, classes


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def best_class(left: np.ndarray, right: np.ndarray, own: int, pair: np.ndarray) -> int:
    """The class in which a unit with these neighbours makes the class bigrams likeliest. pair: counts of (context, class)."""
    rest = pair.copy()
    rest[:, own] -= left
    rest[own] -= right
    rest = np.maximum(rest, 0)
    n = left.sum()
    i, j = np.flatnonzero(left), np.flatnonzero(right)
    gain = (_xlogx(rest[i] + left[i, None]) - _xlogx(rest[i])).sum(0)
    gain += (_xlogx(rest[:CLASSES, j] + right[j]) - _xlogx(rest[:CLASSES, j])).sum(1)
    size = rest.sum(0)
    gain -= 2 * (_xlogx(size + n) - _xlogx(size))
    best = int(gain.argmax())
    return best if gain[best] > gain[own] + 1e-9 else own


def exchange(index: DataFrame, hot: Hot, classes: np.ndarray, folder: str, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each unit after `rounds` rounds at most; each round half of the units may move."""
    context = index.sparkSession.sparkContext
    still = 0
    for step in range(rounds):
        of_turn = _turn(np.arange(len(classes)), step)
        rows = _summed(index, hot, classes, _profiles(of_turn), _WIDE + len(classes), _WIDE + CLASSES, folder, f"profile-{step}")
        pair = np.zeros((_WIDE, CLASSES), np.int64)
        for r in rows.filter(F.col("key") < _WIDE).collect():  # one for each context
            pair[r.key] = np.frombuffer(r.counts, np.int64)[:CLASSES]
        told = context.broadcast((classes, pair))

        def move(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            classes, pair = told.value
            for batch in batches:
                units, to = batch.column(0).to_numpy() - _WIDE, []
                for k, unit in enumerate(units.tolist()):
                    row = np.frombuffer(batch.column(1)[k].as_buffer(), np.int64)
                    to.append(best_class(row[:_WIDE], row[_WIDE:], int(classes[unit]), pair))
                yield pa.RecordBatch.from_arrays([pa.array(units, pa.int64()), pa.array(to, pa.int64())], ["key", "to"])

        moves = rows.filter(F.col("key") >= _WIDE).mapInArrow(move, "key long, to long").toArrow()  # at most a row for each unit
        before, classes = classes, classes.copy()
        classes[moves.column("key").to_numpy()] = moves.column("to").to_numpy()
        discard(index.sparkSession, folder, f"profile-{step}")
        still = still + 1 if (before != classes).sum() < SETTLED * max(moves.num_rows, 1) else 0
        if still == 2:
            break
    return classes


class Model(NamedTuple):
    """Logarithms to base 10."""

    transition: np.ndarray  # class given the two classes before
    unknown: np.ndarray  # an unknown word given the two classes before
    size: np.ndarray  # of each class, in tokens
    discount: float


def smoothed(trigrams: np.ndarray) -> np.ndarray:
    """P(class | two before), Witten-Bell from single classes upwards. trigrams: (two before, one before, class)."""
    bigrams, single = trigrams.sum(0), trigrams.sum((0, 1))
    p = (single + 1) / (single.sum() + CLASSES)
    for n in (bigrams, trigrams):
        types, total = (n > 0).sum(-1, keepdims=True), n.sum(-1, keepdims=True)
        p = np.where(total > 0, (n + types * p) / np.maximum(total + types, 1), np.broadcast_to(p, n.shape))
    return p


def train(index: DataFrame, counts: DataFrame, hot: Hot, folder: str, rounds: int = ROUNDS) -> tuple[np.ndarray, Model]:
    ending_of = mix64(np.arange(ENDINGS, dtype=np.uint64) + np.uint64(11)) % np.uint64(CLASSES)
    frequent, own = hot.frequent, hot.own
    classes = np.concatenate([ending_of[frequent], ending_of]).astype(np.int64)  # at first, words that end alike share a class
    classes = exchange(index, hot, classes, folder, rounds)
    table = np.zeros((_WIDE * _WIDE, CLASSES), np.int64)
    rows = _summed(index, hot, classes, _trigrams, _WIDE * _WIDE, CLASSES, folder, "trigrams").toArrow()  # at most a row for each two classes
    for key, data in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        table[key] = np.frombuffer(data, np.int64)
    n1, n2 = counts.agg(F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).first()
    discount = min(max(n1 / max(n1 + 2 * n2, 1), 0.05), 0.95)
    types = np.bincount(classes[hot.unit], minlength=CLASSES).astype(float)
    by_ending = np.zeros(ENDINGS)
    for r in counts.groupBy("ending").count().collect():  # ENDINGS rows
        by_ending[r.ending] = r["count"]
    by_ending -= np.bincount(frequent, minlength=ENDINGS) + np.bincount(hot.unit[hot.unit >= own] - own, minlength=ENDINGS)
    types += np.bincount(classes[own:], np.maximum(by_ending, 0), CLASSES)
    cube = table.reshape(_WIDE, _WIDE, CLASSES)
    size = cube.sum((0, 1)).astype(float)
    p = smoothed(cube)
    leak = np.where(size > 0, discount * types / np.maximum(size, 1), 1.0)
    return classes, Model(np.log10(p), np.log10(np.maximum(p @ leak, 1e-12)), size, discount)


def class_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark = docs.sparkSession
    folder = work_dir(spark, "class-lm")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    counts = word_counts(rows, folder)
    total, types = (x or 0 for x in counts.agg(F.sum("c"), F.count("*")).first())
    hot = hot_words(counts)
    index = index_tokens(rows, hot, folder)
    classes, model = train(index, counts, hot, folder, rounds)
    scale = total + PSEUDO * (types + 1)
    told = spark.sparkContext.broadcast((hot.c, hot.unit, hot.own, classes, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, unit, own, classes, model = told.value
        base_of = np.log10((c + PSEUDO) / scale)
        emit = np.log10((c - model.discount) / np.maximum(model.size[classes[unit]], 1)) if len(c) else np.zeros(0)
        size = np.log10(np.maximum(model.size, 1))
        for batch in batches:
            at = 0
            for ids, units, first in _sequences(batch.column("ids"), unit, own):
                begin = np.flatnonzero(first)
                part = batch.slice(at, len(begin))
                at += len(begin)
                of_class = classes[units]
                one, two = _contexts(of_class, first)
                known = ids >= 0
                place = np.maximum(ids, 0)
                move = model.transition[two, one, of_class]
                lengths = np.diff(np.append(begin, len(ids)))
                sums = lambda x, begin=begin: np.add.reduceat(x, begin)
                base = sums(np.where(known, base_of[place], 0.0)) if len(c) else np.zeros(len(begin))
                score = sums(np.where(known, move + emit[place], 0.0)) if len(c) else np.zeros(len(begin))
                cold = ~known
                cut = pa.array(np.append(0, np.cumsum(sums(cold.astype(np.int64)))).astype(np.int32))
                words = np.frombuffer(b"".join(part.column("cold").to_pylist()), np.int64)
                lists = [pa.ListArray.from_arrays(cut, pa.array(x)) for x in (words, (move - size[of_class])[cold], model.unknown[two, one][cold])]
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(lengths), pa.array(sums(known.astype(np.int64))), pa.array(base), pa.array(score), *lists],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "w", "seen", "unseen"],
                )

    scored = index.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, w array<long>, seen array<double>, unseen array<double>")
    scored = stored(scored, folder, "scored")
    cold = scored.filter(F.size("w") > 0).select("row", F.inline(F.arrays_zip("w", "seen", "unseen")))
    met = cold.join(counts.select("w", "c"), "w", "left").groupBy("row").agg(
        F.count("c").alias("cold_known"),
        F.sum(F.log10((F.coalesce("c", F.lit(0)) + PSEUDO) / scale)).alias("cold_base"),
        F.sum(F.when(F.col("c").isNull(), F.col("unseen")).otherwise(F.col("seen") + F.log10(F.col("c") - model.discount))).alias("cold_score"),
    )
    full = scored.drop("w", "seen", "unseen").join(met, "row", "left")
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return full.select("doc_id", "held_out", "n_tokens", add("known", "cold_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), add("base", "cold_base").alias("base_score"), add("score", "cold_score").alias("score"))
