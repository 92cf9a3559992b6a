"""Whole-batch text handling in numpy: code points, word spans and 64-bit word hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at once; a text is cut into such parts between two words, never dropped. It also bounds what a
#: worker's temporary arrays hold.
CHUNK_CHARS = 1 << 18
#: The Unicode White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The white space of the word pattern `[^\x20\x09-\x0D]+`.
ASCII_SPACE = [0x20, *range(0x09, 0x0E)]

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Where a text may be cut for every operator, and for those that read words between ASCII white space.
BLANK_CUT, SPACE_CUT = re.compile(r"\S(?= \S)"), re.compile(r"\S(?=[\x20\x09-\x0D])")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _char_values() -> np.ndarray:
    return mix64(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_STEP = 1 << 18  # places whose powers are kept


@lru_cache(2)
def _low_powers(base: int) -> np.ndarray:
    step = np.full(_STEP, base, np.uint64)
    step[0] = 1
    return np.multiply.accumulate(step)


def powers(places: np.ndarray, inverse: bool = False) -> np.ndarray:
    """The hash base, or its inverse, to the power of each place, modulo 2^64."""
    base = pow(int(_BASE), -1, 1 << 64) if inverse else int(_BASE)
    value = _low_powers(base)[places & (_STEP - 1)]
    if len(places) and (most := int(places.max()) // _STEP):
        step = np.full(most + 1, pow(base, _STEP, 1 << 64), np.uint64)
        step[0] = 1
        value *= np.multiply.accumulate(step)[places // _STEP]
    return value


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    low = cp.copy()
    np.add(low, np.uint32(32), out=low, where=(cp >= 65) & (cp <= 90))
    return low


@lru_cache(4)
def char_table(members: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[list(members)] = True
    return table


def span_hashes(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans cp[start:end], which are in order, apart and not empty."""
    total = np.zeros(len(starts), np.uint64)
    for at in range(0, len(cp) if len(starts) else 0, _STEP):
        piece = cp[at : at + _STEP]
        a, b = np.searchsorted(ends, at, "right"), np.searchsorted(starts, at + len(piece), "left")
        if a >= b:
            continue
        value = _char_values()[piece]
        value *= powers(np.arange(at, at + len(piece)))
        cut = np.empty(2 * (b - a), np.int64)
        cut[::2], cut[1::2] = np.maximum(starts[a:b] - at, 0), np.minimum(ends[a:b] - at, len(piece))
        total[a:b] += np.add.reduceat(value, cut[:-1] if cut[-1] == len(piece) else cut)[::2]
    return mix64(total * powers(starts, True) + (ends - starts).astype(np.uint64))


def word_spans(cp: np.ndarray, space: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs outside `space`; a position in `first` (a text's start) always begins a run."""
    if not len(cp):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~space[cp]
    begins, ends = inside.copy(), inside.copy()
    cut = np.zeros(len(cp) + 1, bool)
    cut[first] = True
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def parts(texts: list[str | None], cut_at: re.Pattern = BLANK_CUT, limit: int | None = None) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row numbers, texts) of about `limit` characters (CHUNK_CHARS). A longer text comes in several parts,
    cut after a match of `cut_at`; one without such a place stays whole. Nulls come as empty texts."""
    limit = limit or CHUNK_CHARS
    rows: list[int] = []
    group: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        text = text or ""
        at = 0
        while True:
            cut = cut_at.search(text, at + limit) if len(text) - at > limit else None
            piece = text[at : cut.end()] if cut else text[at:]
            if group and size + len(piece) > limit:
                yield rows, group
                rows, group, size = [], [], 0
            rows.append(row)
            group.append(piece)
            size += len(piece)
            if not cut:
                break
            at = cut.end()
    if group:
        yield rows, group


def slices(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about `limit` characters of `column` each."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def line_parts(texts: list[str | None], limit: int | None = None) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Groups of (row numbers, numbers of the first lines, texts) of about `limit` characters. A longer text comes in
    several parts of whole lines. Nulls come as empty texts."""
    limit = limit or CHUNK_CHARS
    rows: list[int] = []
    firsts: list[int] = []
    group: list[str] = []
    size = 0
    for row, text in enumerate(texts):
        text = text or ""
        at = number = 0
        while True:
            end = text.find("\n", at + limit) if len(text) - at > limit else -1
            piece = text[at:] if end < 0 else text[at:end]
            if group and size + len(piece) > limit:
                yield rows, firsts, group
                rows, firsts, group, size = [], [], [], 0
            rows.append(row)
            firsts.append(number)
            group.append(piece)
            size += len(piece)
            if end < 0:
                break
            at, number = end + 1, number + piece.count("\n") + 1
    if group:
        yield rows, firsts, group


def joined(group: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The group's texts as one string, its code points and the start of each text with the end of the last."""
    text = "".join(group)
    bounds = np.zeros(len(group) + 1, np.int64)
    np.cumsum([len(x) for x in group], out=bounds[1:])
    return text, code_points(text), bounds


def gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """pool[start : start + count] of every row, one after another."""
    total = int(counts.sum())
    if not total:
        return pool[:0]
    ends = np.cumsum(counts)
    return pool[np.repeat(starts - (ends - counts), counts) + np.arange(total)]
