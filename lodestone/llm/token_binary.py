"""Token ids in a bit-packed binary format (operator 5).

Each id takes the fewest bits that the vocabulary needs. A shard file holds

    "TOKB"  u32 version, bits, ids per block
    blocks  each the packed ids of one block (the last may be short), little-endian bit order
    index   u64 block offsets, i64 doc_ids, u64 first id of each document and the end of the last
    tail    u64 offset of the index, blocks, documents, ids, then "BKOT"

so that any span of ids is read from its blocks alone and unpacked with numpy.

Defined results: a null or empty text gives the end id alone; a null doc_id sorts first; rows that repeat a
doc_id are documents of their own, in the order of their texts' hashes; an empty table gives no rows; other
columns are ignored. Long texts are encoded in parts that are cut where the tokenizer itself cuts.
"""

from __future__ import annotations

import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import stored, work_dir
from .vectext import WHITE_SPACE, gather, joined, parts, slices, span_hashes

BLOCK_IDS = 4096
END_ID = 0
#: Word spans whose ids a Python worker remembers; beyond it the memory starts anew, which changes no result.
CACHE_WORDS = 1_000_000
#: Ids after which a task begins another shard (at the next document), so that shards are bounded but for one document.
SHARD_IDS = 1 << 23
#: Ids that a writer packs at once.
WRITE_IDS = 1 << 20
_LETTER, _NUMBER, _SPACE = 1, 2, 3


@lru_cache(1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            table[c] = _LETTER
        elif major == "N":
            table[c] = _NUMBER
    table[WHITE_SPACE] = _SPACE
    return table


def span_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the spans of the byte-level pattern begin (contractions, words, numbers and signs with one leading
    space, white space); spans follow each other without gaps. bounds: starts of the texts and the end of the last."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[cp]
    new_text = np.zeros(n + 1, bool)
    new_text[bounds] = True
    change = np.ones(n, bool)
    change[1:] = (kind[1:] != kind[:-1]) | new_text[1:-1]
    start = np.flatnonzero(change)
    end = np.append(start[1:], n)
    kind, length = kind[start], end - start
    last_of_text = new_text[end] | (end == n)
    space = kind == _SPACE
    ends_in_blank = space & ~last_of_text & (cp[end - 1] == 0x20)
    joins = np.zeros(len(start), bool)  # takes the blank before it
    joins[1:] = ends_in_blank[:-1]
    begin = start - joins
    keep = ~space
    # a lone apostrophe that takes letters of the run after it
    mark = (kind == 0) & (length == 1) & (cp[start] == 0x27) & ~joins & ~last_of_text
    for k in np.flatnonzero(mark):
        if k + 1 < len(start) and kind[k + 1] == _LETTER:
            after = cp[start[k + 1] : start[k + 1] + 2].tobytes().decode("utf-32-le")
            take = 1 if after[:1] in ("s", "t", "m", "d") else 2 if after in ("re", "ve", "ll") and length[k + 1] >= 2 else 0
            begin[k + 1] += take
            keep[k + 1] = length[k + 1] > take
    blank_run = space & ((length >= 2) | ~ends_in_blank)
    last_alone = space & ~last_of_text & ~ends_in_blank & (length >= 2)
    return np.sort(np.concatenate([begin[keep], start[blank_run], end[last_alone] - 1]))


def _room(array: np.ndarray, size: int) -> np.ndarray:
    """The array, or twice as long a copy if it is too short, so that it is seldom copied as it grows."""
    return array if size <= len(array) else np.append(array, np.zeros(max(size, 2 * len(array)) - len(array), array.dtype))


class SpanEncoder:
    """Ids of whole texts: distinct spans go through the tokenizers library once, repeats come from memory."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.count, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self.words = self.size = 0  # of these arrays, what is in use

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of each text part, number of its ids) with the ids themselves, group by group."""
        for rows, group in parts(texts):
            text, cp, bounds = joined(group)
            starts = span_starts(cp, bounds)
            ends = np.append(starts[1:], len(cp))
            if len(self.known) > CACHE_WORDS:
                self.forget()
            values, first, back = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
            slot = np.array(list(map(self.known.get, values.tolist(), repeat(-1))), np.int64)
            if len(new := np.flatnonzero(slot < 0)):
                words = [text[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
                slot[new] = self._learn(values[new].tolist(), words)
            at = slot[back.ravel()]
            ids, counts = gather(self.pool, self.start[at], self.count[at]), self.count[at]
            total = np.append(0, np.cumsum(counts))
            inner = np.searchsorted(starts, bounds)
            yield np.asarray(rows), np.diff(total[inner]), ids

    def _learn(self, hashes: list[int], words: list[str]) -> np.ndarray:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        found: list[int] = []
        counts: list[int] = []
        for at in range(0, len(words), 4096):
            for x in encode(words[at : at + 4096], add_special_tokens=False):
                found += x.ids
                counts.append(len(x))
        count, ids = np.array(counts, np.int64), np.array(found, np.uint32)
        slots = np.arange(self.words, self.words + len(count))
        self.start, self.count = (_room(x, self.words + len(count)) for x in (self.start, self.count))
        self.pool = _room(self.pool, self.size + len(ids))
        self.start[slots] = self.size + np.cumsum(count) - count
        self.count[slots] = count
        self.pool[self.size : self.size + len(ids)] = ids
        self.words, self.size = self.words + len(count), self.size + len(ids)
        self.known.update(zip(hashes, slots.tolist(), strict=True))
        return slots


@lru_cache(1)
def span_encoder(path: str) -> SpanEncoder:
    """One encoder for the tasks of a Python worker, so that words met before stay known."""
    return SpanEncoder(path)


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The lowest `bits` bits of each id, one after another, little-endian."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    return np.packbits(((ids[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes | memoryview, bits: int, count: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=bits * count, bitorder="little").reshape(count, bits)
    return (flags.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class ShardWriter:
    """Writes one shard to an open binary file, block by block."""

    def __init__(self, out, vocabulary: int):
        self.out, self.bits = out, max(1, int(vocabulary - 1).bit_length())
        self.out.write(b"TOKB" + struct.pack("<III", 1, self.bits, BLOCK_IDS))
        self.at, self.rest, self.held, self.ids = 16, [], 0, 0
        self.offsets, self.docs, self.firsts = [], [], []

    def begin(self, doc_id: int) -> None:
        self.docs.append(doc_id)
        self.firsts.append(self.ids)

    def add(self, ids: np.ndarray) -> None:
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= WRITE_IDS:
            self._flush(False)

    def _flush(self, everything: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        whole = len(ids) if everything else len(ids) // BLOCK_IDS * BLOCK_IDS
        for at in range(0, whole, BLOCK_IDS):
            self.offsets.append(self.at)
            self.out.write(data := pack(ids[at : min(at + BLOCK_IDS, whole)], self.bits))
            self.at += len(data)
        self.rest, self.held = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        for values, kind in ((self.offsets, "<u8"), (self.docs, "<i8"), ([*self.firsts, self.ids], "<u8")):
            self.out.write(np.asarray(values, kind).tobytes())
        self.out.write(struct.pack("<QQQQ", self.at, len(self.offsets), len(self.docs), self.ids) + b"BKOT")


class Shard:
    """A shard in memory; ids(start, end) unpacks only the blocks that hold the span."""

    def __init__(self, data: bytes):
        self.data = memoryview(data)
        magic, _, self.bits, self.block = self.data[:4], *struct.unpack("<III", self.data[4:16])
        at, blocks, docs, self.n_ids = struct.unpack("<QQQQ", self.data[-36:-4])
        if bytes(magic) != b"TOKB" or bytes(self.data[-4:]) != b"BKOT":
            raise ValueError("not a token shard")
        self.offsets = np.frombuffer(self.data, "<u8", blocks, at)
        self.docs = np.frombuffer(self.data, "<i8", docs, at + 8 * blocks)
        self.firsts = np.frombuffer(self.data, "<u8", docs + 1, at + 8 * (blocks + docs)).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        if start >= end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        found = [unpack(self.data[int(self.offsets[b]) :][: -(-self.bits * n // 8)], self.bits, n) for b in range(first, last + 1) for n in [min(self.block, self.n_ids - b * self.block)]]
        return np.concatenate(found)[start - first * self.block : end - first * self.block]


_MANIFEST = "file string, first_doc long, first_hash long, n_docs long, n_tokens long"
_NO_DOC = -(1 << 63)


def write_tokens(docs: DataFrame, folder: str, tokenizer_path: str, vocabulary: int, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the texts' ids in ascending doc_id order as shard files of bounded size in `folder`; returns the manifest,
    which names the files of the attempts that counted. The texts are dealt by ranges of doc_id, encoded and written
    where they lie."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = span_encoder(tokenizer_path)
        end = np.array([end_id], np.uint32)
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        open_: list = []  # the shard at hand: its name, file, writer, first document and its text's hash

        def closed() -> pa.RecordBatch:
            name, out, writer, doc, text_hash = open_.pop()
            writer.close()
            out.close()
            row = {"file": name, "first_doc": doc, "first_hash": text_hash, "n_docs": len(writer.docs), "n_tokens": writer.ids}
            return pa.RecordBatch.from_pylist([row])

        def writer_for(doc: int, text_hash: int) -> ShardWriter:
            if not open_:
                name = f"{uuid.uuid4().hex}.tokb"
                out = system.open_output_stream(f"{base}/{name}")
                open_.append((name, out, ShardWriter(out, vocabulary), doc, text_hash))
            return open_[0][2]

        for batch in batches:
            for part in slices(batch, "text"):
                ids_of = [_NO_DOC if x is None else x for x in part.column("doc_id").to_pylist()]
                hashes = part.column("h").to_pylist()
                row = -1
                for rows, counts, ids in encoder(part.column("text").to_pylist()):
                    at = 0
                    for r, n in zip(rows.tolist(), counts.tolist(), strict=True):
                        if r != row:
                            if row >= 0:
                                open_[0][2].add(end)
                                if open_[0][2].ids >= shard_ids:
                                    yield closed()
                            writer_for(ids_of[r], hashes[r]).begin(ids_of[r])
                            row = r
                        open_[0][2].add(ids[at : at + n])
                        at += n
                if row >= 0:
                    open_[0][2].add(end)
                    if open_[0][2].ids >= shard_ids:
                        yield closed()
        if open_:
            yield closed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    parts_ = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts_, "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return stored(ordered.mapInArrow(write, _MANIFEST), folder, "manifest")


def read_tokens(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the shard files that the manifest names."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, base = Shard(batch.column("content")[k].as_buffer()), batch.column("base")[k].as_py()
                for at in range(0, len(shard.docs), 256):
                    firsts = shard.firsts[at : at + 257]
                    ids = shard.ids(int(firsts[0]), int(firsts[-1])).astype("<u4")
                    cut = (firsts - firsts[0]).tolist()
                    found = shard.docs[at : at + 256]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(found, mask=found == _NO_DOC),
                            pa.array(firsts[:-1] + base),
                            pa.array(np.diff(firsts)),
                            pa.array([zlib.crc32(ids[a:b]) for a, b in zip(cut, cut[1:], strict=False)], pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    before = W.orderBy("first_doc", "first_hash", "file").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))  # a row for each shard
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokb").load(folder)
    named = files.select("content", F.element_at(F.split("path", "/"), -1).alias("file"))
    return named.join(F.broadcast(bases), "file").select("content", "base").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_binary(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes, writes and reads back; see the module's text for the format and the defined results."""
    spark = docs.sparkSession
    folder = work_dir(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer_path, vocabulary, end_id, shard_ids)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_tokens(spark, folder, manifest)
