"""Byte-level BPE by a lazily determinised finite-state transducer; streaming decoding (operator 12).

A sequence of tokens is what the merges make of its bytes if and only if they make each two neighbours of it of the
neighbours' bytes: no merge crosses a border in the whole exactly if none does in the pairs. So the merges compile into
a transducer over bytes: it guesses where the next token ends, follows the trie of the vocabulary, and accepts a token
after the one before it if the two are such neighbours. Every prefix of a text has one accepted sequence; the guesses
under way are those tokens that may still end later.

The transducer is made deterministic where texts need it. A state is the set of the guesses, each with its node of the
trie and the token before it; its output is the token that ends there, if one is accepted, and what follows decides which of these
stand. In a stream they are emitted as soon as all guesses under way agree on them, so the lookahead is as short as the
merges allow; a batch of spans moves through the machine together, and the tokens are read back from the ends. States
and their moves are made when a text first takes them and are remembered, up to a bound, beyond which they are made anew.

A span that is a token itself is that token, as the ranks' own library has it, whatever the merges would make of it: the guess that
started with the span stands for it to its end.

Decoding is a stream: a state machine over bytes passes on complete characters and keeps what may be the beginning of
one, so that ids can come in pieces of any size. A byte that can't go on gives U+FFFD, as in the usual decoders.

Defined results: a null or empty text has no ids and decodes to no bytes; texts are encoded whole, long ones in parts
that are cut between two spans; rows keep their own results, repeated or not; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored, work_dir
from .token_binary import span_starts
from .vectext import gather, joined, mix64, parts, slices, span_hashes

#: States and neighbours that a transducer remembers, and spans whose ids a task remembers; beyond them the memory starts
#: anew, which changes no result.
STATES, NEIGHBOURS, CACHE_SPANS = 200_000, 500_000, 500_000
#: Bytes beyond which a span goes through the machine alone.
LONG = 256
_NO_TOKEN = -1


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file that has a token in base 64 and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _grown(array: np.ndarray, size: int, more: np.ndarray) -> np.ndarray:
    """The array with `more` behind its first `size` cells; it doubles if it is too short, so that it is seldom copied."""
    if size + len(more) > len(array):
        array = np.append(array, np.zeros(max(size + len(more) - len(array), len(array)), array.dtype))
    array[size : size + len(more)] = more
    return array


def _members(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges start : start + count, and the number of the range of each."""
    of = np.repeat(np.arange(len(counts)), counts)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(of)), of


class Transducer:
    """Ids of spans of bytes, by moves of a deterministic machine that is built as it is used."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: t for t, i in ranks.items()}
        edge: dict[int, int] = {}
        ends = [_NO_TOKEN]  # the token that ends at a node of the vocabulary's trie
        for token, i in ranks.items():
            node = 0
            for b in token:
                to = edge.get(node << 8 | b)
                if to is None:
                    to = edge[node << 8 | b] = len(ends)
                    ends.append(_NO_TOKEN)
                node = to
            ends[node] = i
        self.ends = np.array(ends, np.int64)
        self.edges = np.array(sorted(edge), np.int64)  # node << 8 | byte
        self.below = np.array([edge[k] for k in self.edges.tolist()], np.int64)
        self.size = np.zeros(max(self.token, default=0) + 1, np.int64)
        for i, token in self.token.items():
            self.size[i] = len(token)
        depth = np.zeros(len(ends), np.int64)
        for key in sorted(edge, key=edge.__getitem__):  # a node's number is greater than its parent's
            depth[edge[key]] = depth[key >> 8] + 1
        self.depth = depth
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.forget()

    def forget(self) -> None:
        self.moves: dict[int, int] = {}  # state << 8 | byte: next state
        self.number: dict[int, int] = {}  # hash of a state's guesses: state
        #: Guesses of all states (node, token before it), in the order in which they began; where a state's begin, and how many.
        self.node, self.before, self.first, self.many = (np.zeros(1024, np.int64) for _ in range(4))
        self.out, self.whole = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.guesses = self.states = 0
        self._add(np.zeros(1, np.int64), np.full(1, _NO_TOKEN), np.ones(1, np.int64), np.full(1, _NO_TOKEN))

    def _add(self, node: np.ndarray, before: np.ndarray, many: np.ndarray, out: np.ndarray) -> None:
        """New states, with the token that ends at each, and the token that a span is which ends there (or none)."""
        first = np.cumsum(many) - many
        whole = np.where(before[first] == _NO_TOKEN, self.ends[node[first]], _NO_TOKEN)
        for name, value in (("first", first + self.guesses), ("many", many), ("out", out), ("whole", whole)):
            setattr(self, name, _grown(getattr(self, name), self.states, value))
        self.node, self.before = _grown(self.node, self.guesses, node), _grown(self.before, self.guesses, before)
        self.guesses, self.states = self.guesses + len(node), self.states + len(many)

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes the token; the token twice if it is a byte; None if merges don't make it."""
        if token not in self.parts:
            data = self.token[token]
            pieces = [data[k : k + 1] for k in range(len(data))]
            last = (token, token)
            while len(pieces) > 1:
                rank, at = min((self.ranks.get(a + b, 1 << 62), k) for k, (a, b) in enumerate(zip(pieces, pieces[1:], strict=False)))
                if rank == 1 << 62:
                    break
                last = (self.ranks[pieces[at]], self.ranks[pieces[at + 1]])
                pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
            self.parts[token] = last if len(pieces) == 1 else None
        return self.parts[token]

    def neighbours(self, before: int, token: int) -> bool:
        """Whether the merges leave the two tokens as they are, side by side; the first may be none.

        The merges of both are taken back, the latest first. While the tokens at the border are as they were before a
        merge, their own merge must not have come first: its rank must not be less than that of the one taken back, nor
        equal to it if that one is on the right, as the leftmost of several goes first."""
        if before == _NO_TOKEN:
            return self._last_merge(token) is not None
        left, right, ranks, text = before, token, self.ranks, self.token
        limit = 1 << 62
        known = self._last_merge(left) is not None and self._last_merge(right) is not None
        while known:
            if ranks.get(text[left] + text[right], limit) < limit:
                known = False
                break
            of_left, of_right = self._last_merge(left), self._last_merge(right)
            whole_left, whole_right = of_left[0] == left, of_right[0] == right  # bytes, which no merge made
            if whole_left and whole_right:
                break
            if whole_right or not whole_left and left > right:
                limit, left = left, of_left[1]
            else:
                limit, right = right + 1, of_right[0]
        return known

    def _neighbours(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        keys, back = np.unique((before + 1) << 32 | token, return_inverse=True)
        known = list(map(self.pairs.get, keys.tolist()))
        for k, x in enumerate(known):
            if x is None:
                key = int(keys[k])
                known[k] = self.pairs[key] = self.neighbours((key >> 32) - 1, key & 0xFFFFFFFF)
        return np.array(known, bool)[back.ravel()]

    def _expand(self, states: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """Where the states go with the bytes; states that are new are added."""
        guess, of = _members(self.first[states], self.many[states])
        edge = self.node[guess] << 8 | bytes_[of]
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        alive = self.edges[at] == edge
        of, node, before = of[alive], self.below[at[alive]], self.before[guess[alive]]
        ended = self.ends[node]
        may = np.flatnonzero(ended != _NO_TOKEN)
        done = may[self._neighbours(before[may], ended[may])]  # one for each state: every prefix has one accepted sequence
        out = np.full(len(states), _NO_TOKEN)
        out[of[done]] = ended[done]
        order = np.argsort(np.append(2 * of, 2 * of[done] + 1), kind="stable")
        of, node, before = np.append(of, of[done])[order], np.append(node, np.zeros(len(done), np.int64))[order], np.append(before, ended[done])[order]
        many = np.bincount(of, minlength=len(states))
        if not many.all():
            raise ValueError("a byte isn't in the vocabulary")
        first = np.cumsum(many) - many
        key = np.add.reduceat(mix64((node << 32 | before + 1).astype(np.uint64) + np.uint64(1)), first)
        keys, one, back = np.unique(key, return_index=True, return_inverse=True)
        number = np.array(list(map(self.number.get, keys.tolist(), repeat(-1))), np.int64)
        if len(new := np.flatnonzero(number < 0)):
            number[new] = np.arange(self.states, self.states + len(new))
            self.number.update(zip(keys[new].tolist(), number[new].tolist(), strict=True))
            mine, _ = _members(first[one[new]], many[one[new]])
            self._add(node[mine], before[mine], many[one[new]], out[one[new]])
        return number[back.ravel()]

    def _tidy(self) -> None:
        if self.states > STATES:
            self.forget()
        if len(self.pairs) > NEIGHBOURS:
            self.pairs = {}

    def stream(self, data: bytes) -> Iterator[int]:
        """The ids of a span, each as soon as all guesses under way agree on it."""
        self._tidy()
        state, sent = 0, 0
        last: list[int] = []  # the token that ends at each place, in the accepted sequence of what is before
        for k, byte in enumerate(data):
            to = self.moves.get(state << 8 | byte)
            if to is None:
                to = self.moves[state << 8 | byte] = int(self._expand(np.array([state]), np.array([byte]))[0])
            state = to
            last.append(int(self.out[state]))
            a = self.first[state]
            begun = {k + 1 - int(d) for d in self.depth[self.node[a : a + self.many[state]]]}
            while len(begun) > 1:  # back to where the guesses' sequences are one
                latest = max(begun)
                begun = begun - {latest} | {latest - int(self.size[last[latest - 1]])}
            yield from (agreed := self._back(last, sent, begun.pop()))
            sent += sum(int(self.size[i]) for i in agreed)
        if data:
            yield from [int(self.whole[state])] if self.whole[state] != _NO_TOKEN else self._back(last, sent, len(data))

    def _back(self, last: list[int], begin: int, end: int) -> list[int]:
        ids = []
        while end > begin:
            ids.append(last[end - 1])
            end -= int(self.size[ids[-1]])
        return ids[::-1]

    def encode(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the spans, one after another, and how many each has. All spans move together, byte by byte, but for
        the long ones."""
        self._tidy()
        size = np.array([len(x) for x in spans], np.int64)
        data = np.frombuffer(b"".join(spans), np.uint8).astype(np.int64)
        begin = np.cumsum(size) - size
        last = np.full(len(data), _NO_TOKEN)
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -LONG) :]  # from here on no span is too long
        begins, sizes = begin[order], size[order]
        state = np.zeros(len(order), np.int64)
        for k in range(int(sizes[0]) if len(sizes) else 0):
            n = int(np.searchsorted(-sizes, -k))  # as many spans have a byte here
            at = begins[:n] + k
            keys, back = np.unique(state[:n] << 8 | data[at], return_inverse=True)
            to = np.array(list(map(self.moves.get, keys.tolist(), repeat(-1))), np.int64)
            if len(new := np.flatnonzero(to < 0)):
                to[new] = self._expand(keys[new] >> 8, keys[new] & 255)
                self.moves.update(zip(keys[new].tolist(), to[new].tolist(), strict=True))
            state[:n] = to[back.ravel()]
            last[at] = self.out[state[:n]]
        # back from the end of each span, along the accepted sequence
        found: list[tuple[np.ndarray, np.ndarray]] = []
        whole = self.whole[state]
        single = np.flatnonzero((whole != _NO_TOKEN) & (sizes > 0))
        found.append((begins[single], whole[single]))
        span = np.flatnonzero((whole == _NO_TOKEN) & (sizes > 0))
        place = begins[span] + sizes[span]
        while len(span):
            ids = last[place - 1]
            place = place - self.size[ids]
            found.append((place, ids))
            span, place = span[place > begins[span]], place[place > begins[span]]
        for k in np.flatnonzero(size > LONG).tolist():
            ids = np.array(list(self.stream(spans[k])), np.int64)
            found.append((begin[k] + np.cumsum(self.size[ids]) - self.size[ids], ids))
        at, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(at, kind="stable")
        return ids[order], np.bincount(np.searchsorted(begin + size, at, "right"), minlength=len(spans))


@lru_cache(1)
def utf8_machine() -> tuple[tuple[int, ...], ...]:
    """For each state and byte the next state. 0: between characters, 1 to 7: within one, 8: the byte doesn't fit.

    States within a character: 1, 2 and 3 bytes of 0x80 to 0xBF are to come; 4 and 5: after 0xE0 and 0xED, 6 and 7: after
    0xF0 and 0xF4, where the next byte's range is narrower, so that no character has two forms or is a surrogate."""
    rest = {1: (0x80, 0xBF, 0), 2: (0x80, 0xBF, 1), 3: (0x80, 0xBF, 2), 4: (0xA0, 0xBF, 1), 5: (0x80, 0x9F, 1), 6: (0x90, 0xBF, 2), 7: (0x80, 0x8F, 2)}
    leads = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE1, 0xEC, 2), (0xEE, 0xEF, 2), (0xF1, 0xF3, 3), (0xE0, 0xE0, 4), (0xED, 0xED, 5), (0xF0, 0xF0, 6), (0xF4, 0xF4, 7))
    start = [8] * 256
    for a, b, to in leads:
        start[a : b + 1] = [to] * (b + 1 - a)
    rows = [tuple(start)]
    for state in range(1, 8):
        a, b, to = rest[state]
        rows.append(tuple(to if a <= x <= b else 8 for x in range(256)))
    return tuple(rows)


class Decoder:
    """Text of ids that come in pieces: complete characters are passed on, the beginning of one waits for the next piece."""

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens, self.state, self.held = tokens, 0, b""

    def feed(self, ids: list[int]) -> str:
        data = b"".join([self.tokens[i] for i in ids])
        if not self.state and data.isascii():
            return data.decode("ascii")
        machine, state = utf8_machine(), self.state
        data = self.held + data
        out: list[str] = []
        begin = done = 0  # of the text that is to be passed on, and of the character at hand
        at = len(self.held)
        while at < len(data):
            to = machine[state][data[at]]
            if to == 8:
                out.append(data[begin:done].decode("utf-8"))
                out.append("\ufffd")
                if not state:
                    at += 1  # a byte that begins nothing; else it may begin the next character
                begin = done = at
                state = 0
                continue
            at += 1
            if not to:
                done = at
            state = to
        out.append(data[begin:done].decode("utf-8"))
        self.state, self.held = state, data[done:]
        return "".join(out)

    def end(self) -> str:
        """What is left at the end of the stream."""
        left = "\ufffd" if self.state else ""
        self.state, self.held = 0, b""
        return left


class ByteCodec:
    """Encodes and decodes whole texts; distinct spans go through the transducer and the decoder once."""

    def __init__(self, path: str):
        self.transducer = Transducer(read_ranks(path))
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        #: Of ids, and of decoded bytes: all of them, where a span's begin, how many it has, and what is in use.
        self.pool = [np.zeros(1024, "<u4"), np.zeros(1024, np.uint8)]
        self.start, self.count = ([np.zeros(1024, np.int64), np.zeros(1024, np.int64)] for _ in range(2))
        self.size, self.spans = [0, 0], 0

    def _slots(self, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Rows of text parts, the slots of the group's spans, and where each part's spans begin."""
        for rows, group in parts(texts):
            text, cp, bounds = joined(group)
            starts = span_starts(cp, bounds)
            ends = np.append(starts[1:], len(cp))
            if len(self.known) > CACHE_SPANS:
                self.forget()
            values, first, back = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
            slot = np.array(list(map(self.known.get, values.tolist(), repeat(-1))), np.int64)
            if len(new := np.flatnonzero(slot < 0)):
                at = first[new]
                slot[new] = self._learn(values[new].tolist(), [text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            yield rows, slot[back.ravel()], np.searchsorted(starts, bounds)

    def _learn(self, hashes: list[int], spans: list[str]) -> np.ndarray:
        decoder, texts, at = Decoder(self.transducer.token), [], 0
        ids, many = self.transducer.encode([x.encode("utf-8", "surrogatepass") for x in spans])
        each = ids.tolist()
        for n in many.tolist():
            texts.append((decoder.feed(each[at : at + n]) + decoder.end()).encode())
            at += n
        slots = np.arange(self.spans, self.spans + len(spans))
        sizes = many, np.array([len(x) for x in texts], np.int64)
        flat = ids.astype("<u4"), np.frombuffer(b"".join(texts), np.uint8)
        for k, n in enumerate(sizes):
            self.start[k] = _grown(self.start[k], self.spans, self.size[k] + np.cumsum(n) - n)
            self.count[k] = _grown(self.count[k], self.spans, n)
            self.pool[k] = _grown(self.pool[k], self.size[k], flat[k])
            self.size[k] += len(flat[k])
        self.spans += len(spans)
        self.known.update(zip(hashes, slots.tolist(), strict=True))
        return slots

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        found: list[list[np.ndarray]] = [[np.zeros(0, "<u4")] for _ in texts]
        for rows, slots, cut in self._slots(texts):
            for k, row in enumerate(rows):
                mine = slots[cut[k] : cut[k + 1]]
                found[row].append(gather(self.pool[0], self.start[0][mine], self.count[0][mine]))
        return [np.concatenate(x) for x in found]

    def digests(self, texts: list[str | None]) -> tuple[list[int], list[str], list[str]]:
        """Number of ids, SHA-256 of the ids as 32-bit integers, and SHA-256 of the decoded bytes, of each text."""
        counts = [0] * len(texts)
        hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        for rows, slots, cut in self._slots(texts):
            for which, pool in enumerate(self.pool):
                size = self.count[which][slots]
                flat = gather(pool, self.start[which][slots], size)
                total = np.append(0, np.cumsum(size))[cut].tolist()
                for row, a, b in zip(rows, total, total[1:], strict=False):
                    hashes[row][which].update(flat[a:b])
                    if not which:
                        counts[row] += b - a
        return counts, [a.hexdigest() for a, _ in hashes], [b.hexdigest() for _, b in hashes]


@lru_cache(1)
def byte_codec(path: str) -> ByteCodec:
    """One codec for the tasks of a Python worker, so that its machine's states stay; each task forgets its spans."""
    return ByteCodec(path)


def encode_decode_digests(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text, as a stored table; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(ranks_path)
        for batch in batches:
            for part in slices(batch, "text"):
                counts, ids, decoded = codec.digests(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return stored(found, work_dir(docs.sparkSession, "bytes"), "digests")


def encode_bytes(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the ids of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = byte_codec(ranks_path)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = codec.encode(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])
        codec.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_bytes(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the text of every row's ids (doc_id, ids); a null list gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = byte_codec(ranks_path).transducer.token
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                decoder = Decoder(tokens)
                texts.append(decoder.feed(ids.as_py() or []) + decoder.end())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
