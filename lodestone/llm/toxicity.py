"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams (operator 6).

A text's features are the presence of its words, pairs of neighbouring words and pairs with one word between, hashed
into 2^BITS coordinates. FTRL-proximal keeps a learning rate for each coordinate; its L1 term leaves most weights at
exactly zero, so that the few that remain are broadcast and scoring touches only them.

The model is fitted on at most TRAIN_ROWS labelled rows (in expectation), drawn by the hash of doc_id; features are
extracted in parallel, and one task runs the updates over that bounded sample. Every text is scored whole.

Defined results: null and empty texts get the score of the bias alone; rows that repeat a doc_id are scored each,
but only the greatest of their texts is learned from; a doc_id with several labels counts as toxic if one of them says
so; labels that are null are left out; without any label to learn from every score is 0.5 and predicted 1; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, work_dir
from .vectext import SPACE_CUT, char_table, joined, lower_ascii, mix64, parts, slices, span_hashes, word_spans

BITS = 20
TRAIN_ROWS = 16_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 8.0, 1.0
SLICE_CHARS = 1 << 20
FOLDS = 5
#: One of so many rows of the sample sets the threshold and is kept from the fit.
CALIBRATION = 5
_SEPARATORS = tuple(c for c in range(0x80) if not chr(c).isalnum())
_PAIR, _SKIP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % folds == 0


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of every word, pair and skip pair; coordinates repeat as the text does."""
    space = char_table(_SEPARATORS)
    found, counts = [], np.zeros(len(texts), np.int64)
    for rows, group in parts(texts, SPACE_CUT):
        _, cp, bounds = joined(group)
        starts, ends = word_spans(cp := lower_ascii(cp), space, bounds)
        found.append(span_hashes(cp, starts, ends))
        np.add.at(counts, rows, np.diff(np.searchsorted(starts, bounds)))
    word = np.concatenate(found) if found else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(texts)), counts)
    all_rows, all_values = [row], [word]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = row[gap:] == row[:-gap]
        all_rows.append(row[gap:][same])
        all_values.append(mix64(word[:-gap][same] * salt + word[gap:][same]))
    return np.concatenate(all_rows), (np.concatenate(all_values) >> np.uint64(64 - BITS)).astype(np.int64)


def feature_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct coordinates of all texts, one text after another, and each text's number of them."""
    row, at = features(texts)
    key = np.unique((row << BITS) | at)
    return key & ((1 << BITS) - 1), np.bincount(key >> BITS, minlength=len(texts))


def ftrl(sets: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Coordinates with a weight, their weights, and the bias."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    sets = [np.append(x, size) for x in sets]  # the last coordinate is the bias, free of L1

    def weights(at: np.ndarray) -> np.ndarray:
        l1 = np.where(at == size, 0.0, L1)
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, label in zip(sets, labels.tolist(), strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    at = np.flatnonzero(w[:-1])
    return at, w[at], float(w[-1])


def threshold(raw: np.ndarray, labels: np.ndarray) -> float:
    """The raw score that best parts the labels by F1: the middle of the widest gap among the best cuts."""
    order = np.argsort(-raw, kind="stable")
    raw, labels = raw[order], labels[order]
    if not 0 < labels.sum() < len(labels):
        return 0.0
    hits = np.cumsum(labels)[:-1]
    f1 = np.where(raw[:-1] > raw[1:], 2 * hits / (np.arange(1, len(raw)) + labels.sum()), -1)
    best = np.flatnonzero(f1 >= f1.max())
    at = best[np.argmax(raw[best] - raw[best + 1])]
    return float((raw[at] + raw[at + 1]) / 2) if f1.max() > 0 else 0.0


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id")))
    total = known.count()
    scale = 1 << 30
    share = min(scale, int(scale * TRAIN_ROWS / max(total, 1)))
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < share)  # TRAIN_ROWS rows at most, in expectation
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))  # one text of each id, however often it repeats

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                at, counts = feature_sets(part.column("text").to_pylist())
                data, cut = at.astype(np.int32).tobytes(), (4 * np.append(0, np.cumsum(counts))).tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic").cast(pa.int32()), pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["doc_id", "toxic", "features"])

    def train(group: pa.Table) -> pa.Table:
        doc_id = group.column("doc_id").to_numpy()
        sets = [np.frombuffer(x, np.int32).astype(np.int64) for x in group.column("features").to_pylist()]
        order = np.argsort(mix64(doc_id.astype(np.uint64)), kind="stable")
        labels = (group.column("toxic").to_numpy()[order] > 0).astype(float)
        check = np.arange(len(order)) % CALIBRATION == 0
        at, w, bias = ftrl([sets[i] for i in order[~check]], labels[~check])
        dense = np.zeros(1 << BITS)
        dense[at] = w
        cut = threshold(np.array([dense[sets[i]].sum() + bias for i in order[check]]), labels[check])
        return pa.table({"at": pa.array(np.append(at, -1)), "w": pa.array(np.append(w, bias - cut))})

    model = rows.mapInArrow(extract, "doc_id long, toxic int, features binary").groupBy().applyInArrow(train, "at long, w double").toArrow()
    at, w = model.column("at").to_numpy(), model.column("w").to_numpy()
    return at[at >= 0], w[at >= 0], float(w[at < 0].sum())


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every text."""
    at, w, bias = fit(docs, labels)
    model = docs.sparkSession.sparkContext.broadcast((at, w.astype(np.float64), bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, w, bias = model.value
        slot = np.full(1 << BITS, -1, np.int32)
        slot[at] = np.arange(len(at))
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                row, feature = features(part.column("text").to_pylist())
                mine = slot[feature]
                hit = mine >= 0
                key = np.unique(row[hit] * max(len(at), 1) + mine[hit])
                total = bias + np.bincount(key // max(len(at), 1), w[key % max(len(at), 1)] if len(key) else None, part.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(held_out(doc_id), F.lit(False)).alias("held_out"), "text")
    found = rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
    return stored(found, work_dir(docs.sparkSession, "toxicity"), "scores")
