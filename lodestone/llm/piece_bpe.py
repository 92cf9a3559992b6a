"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 9).

Words (a run of blanks with what follows it) never merge with each other, so the distinct words of a part of the
corpus are encoded together: one flat numpy array of symbols, the rank of every adjacent pair, the smallest rank
within each word by a segmented minimum, then all leftmost occurrences of that pair at once, and compaction, until
no pair remains. Where a merged piece could itself merge at a better rank than its own, only the leftmost occurrence
merges in that round, so that the result is that of the one-at-a-time agenda.

Defined results: a null or empty text has the end id alone and decodes to the empty text; texts are encoded whole,
long ones in parts cut between words; rows keep their own results, repeated or not; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, work_dir
from .vectext import gather, joined, parts, slices, span_hashes

BLANK = 0x2581
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Words whose pieces a task remembers; beyond it the memory starts anew, which changes no result.
CACHE_WORDS = 150_000
_NARROW = 1024
_NONE = np.iinfo(np.int64).max


class PieceModel:
    """The tables of a BPE model file with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.end = model.eos_id()
        normal = {pieces[i]: i for i in range(size) if not special[i]}
        rank_of = dict(zip(*(x.tolist() for x in self._ranks(np.array([model.get_score(i) for i in range(size)]))), strict=True))
        chars = sorted({c for p in normal for c in p})
        symbols = dict(normal)
        for c in chars:
            symbols.setdefault(c, size + len(symbols) - len(normal))
        self.first_char = np.full(0x110000, -1, np.int64)  # a character's symbol; -1: in no piece
        for c in chars:
            self.first_char[ord(c)] = symbols[c]
        self.size, self.stride = size, size + len(chars)
        pairs = {}
        near = np.zeros((_NARROW, _NARROW), bool)
        for piece, i in normal.items():
            for k in range(1, len(piece)):
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.stride + right] = i
                a, b = ord(piece[k - 1]), ord(piece[k])
                if a < _NARROW and b < _NARROW:
                    near[a, b] = True
        self.near = near.ravel()  # characters that stand side by side in some piece
        self.pairs = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.pairs.tolist()], np.int64)
        self.ranks = np.array([rank_of[i] for i in self.merged.tolist()], np.int64)
        self.alone = np.zeros(self.stride, bool)  # pieces that may merge at a better rank than their own
        own = np.full(self.stride, -1, np.int64)
        own[self.merged] = self.ranks
        for side in (self.pairs // self.stride, self.pairs % self.stride):
            self.alone[side[self.ranks < own[side]]] = True
        self.byte = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int64)
        self.text = [b"" if model.is_control(i) else bytes([int(p[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i, p in enumerate(pieces)]

    @staticmethod
    def _ranks(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Dense ranks, the highest score first."""
        _, back = np.unique(-scores, return_inverse=True)
        return np.arange(len(scores)), back

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair; a pair that doesn't merge has the largest rank."""
        key = left * self.stride + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        hit = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE), self.merged[at]

    def merge(self, cp: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words cp[start : start + count], one after another, and how many each has."""
        symbol = self.first_char[gather(cp, starts, counts)]
        raw = gather(cp, starts, counts).astype(np.int64)
        word = np.repeat(np.arange(len(starts)), counts)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbol):
            rank = np.full(len(symbol), _NONE)
            piece = np.zeros(len(symbol), np.int64)
            rank[:-1], piece[:-1] = self.look_up(symbol[:-1], symbol[1:])
            rank[:-1][word[1:] != word[:-1]] = _NONE
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(begin, len(word)))
            least = np.minimum.reduceat(rank, begin)
            over = np.repeat(least == _NONE, size)
            if over.any():
                done.append((word[over], symbol[over], raw[over]))
                stay = ~over
                symbol, raw, word, rank, piece = symbol[stay], raw[stay], word[stay], rank[stay], piece[stay]
                least, size = least[least != _NONE], size[least != _NONE]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            fresh = np.append(True, word[hit][1:] != word[hit][:-1])
            run = np.append(True, (hit[1:] != hit[:-1] + 1) | fresh[1:])  # runs of pairs that overlap
            at = np.arange(len(hit))
            odd = (at - np.maximum.accumulate(np.where(run, at, 0))) % 2 == 1
            hit = hit[fresh | ~(self.alone[piece[hit]] | odd)]
            symbol[hit] = piece[hit]
            keep = np.ones(len(symbol), bool)
            keep[hit + 1] = False
            symbol, raw, word = symbol[keep], raw[keep], word[keep]
        if not done:
            return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
        word, symbol, raw = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol, raw = word[order], symbol[order], raw[order]
        lost = np.flatnonzero((symbol < 0) | (symbol >= self.size))  # characters without a piece: their bytes
        if len(lost):
            spelled = [list(chr(c).encode("utf-8", "surrogatepass")) for c in raw[lost].tolist()]
            times = np.ones(len(symbol), np.int64)
            times[lost] = [len(x) for x in spelled]
            where = np.repeat(np.isin(np.arange(len(symbol)), lost), times)
            symbol, word = np.repeat(symbol, times), np.repeat(word, times)
            symbol[where] = self.byte[[b for x in spelled for b in x]]
        return symbol, np.bincount(word, minlength=len(starts))

    def word_starts(self, cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words begin: at texts' starts, and wherever no piece holds both neighbours."""
        begin = np.ones(len(cp), bool)
        if len(cp) > 1:
            a, b = cp[:-1], cp[1:]
            blank_a, blank_b = a == BLANK, b == BLANK
            low_a, low_b = np.where(blank_a, 0, a), np.where(blank_b, 0, b)
            narrow = (low_a < _NARROW) & (low_b < _NARROW) & ~blank_a & ~blank_b
            apart = narrow & ~self.near[np.where(narrow, low_a * _NARROW + low_b, 0)]
            begin[1:] = apart | (blank_b & ~blank_a)
        begin[bounds[:-1][bounds[:-1] < len(cp)]] = True
        return np.flatnonzero(begin)


class PieceCodec:
    """Encodes and decodes whole texts; distinct words go through the merge rounds once."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.pool = np.zeros(0, np.int32)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.decimal: list[bytes] = []
        self.spelled: list[bytes] = []

    def _words(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Rows of text parts, the slots of the group's words, and where each part's words begin."""
        seen = -1
        for rows, group in parts(texts):
            marked = []
            for row, text in zip(rows, group, strict=True):
                marked.append("▁" + text if row != seen and text else text)
                seen = row
            _, cp, bounds = joined(marked)
            cp = np.where(cp == 0x20, np.uint32(BLANK), cp)
            starts = self.model.word_starts(cp, bounds)
            ends = np.append(starts[1:], len(cp))
            if len(self.known) > CACHE_WORDS:
                self.forget()
            values, first, back = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
            slot = np.array(list(map(self.known.get, values.tolist(), repeat(-1))), np.int64)
            if len(new := np.flatnonzero(slot < 0)):
                slot[new] = self._learn(values[new].tolist(), *self.model.merge(cp, starts[first[new]], (ends - starts)[first[new]]))
            yield rows, slot[back.ravel()], np.searchsorted(starts, bounds)

    def _learn(self, hashes: list[int], ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        slots = np.arange(len(self.count), len(self.count) + len(counts))
        self.start = np.append(self.start, len(self.pool) + np.cumsum(counts) - counts)
        self.count = np.append(self.count, counts)
        self.pool = np.append(self.pool, ids.astype(np.int32))
        text, flat, at = self.model.text, ids.tolist(), 0
        for n in counts.tolist():
            mine = flat[at : at + n]
            self.decimal.append(b"%d " * n % tuple(mine))
            self.spelled.append(b"".join([text[i] for i in mine]))
            at += n
        self.known.update(zip(hashes, slots.tolist(), strict=True))
        return slots

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, with the end id."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for rows, slots, cut in self._words(texts):
            for k, row in enumerate(rows):
                mine = slots[cut[k] : cut[k + 1]]
                found[row].append(gather(self.pool, self.start[mine], self.count[mine]))
        return [np.concatenate([*x, [self.model.end]]).astype(np.int64) for x in found]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that `encode` made: pieces joined, the first blank dropped."""
        return b"".join([self.model.text[i] for i in ids.tolist()]).removeprefix(b" ").decode("utf-8", "replace")

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, SHA-256 of the ids in decimal, and SHA-256 of the decoded text, of each text."""
        counts = [1] * len(texts)
        ids = [hashlib.sha256() for _ in texts]
        decoded = [hashlib.sha256() for _ in texts]
        seen = -1
        for rows, slots, cut in self._words(texts):
            at = slots.tolist()
            total = np.append(0, np.cumsum(self.count[slots]))
            for k, row in enumerate(rows):
                mine = at[cut[k] : cut[k + 1]]
                counts[row] += int(total[cut[k + 1]] - total[cut[k]])
                ids[row].update(b"".join([self.decimal[s] for s in mine]))
                spelled = b"".join([self.spelled[s] for s in mine])
                decoded[row].update(spelled[1:] if row != seen else spelled)
                seen = row
        end = b"%d" % self.model.end
        for x in ids:
            x.update(end)
        return counts, [x.hexdigest() for x in ids], [x.hexdigest() for x in decoded]


@lru_cache(1)
def piece_codec(path: str) -> PieceCodec:
    """One codec for the tasks of a Python worker; each task forgets its words, as the worker may serve other stages next."""
    return PieceCodec(path)


def encode_decode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, as a stored table; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, ids, decoded = codec.digests(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return stored(found, work_dir(docs.sparkSession, "pieces"), "digests")


def encode_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and the ids of every text, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = piece_codec(model_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = codec.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])
        codec.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")
