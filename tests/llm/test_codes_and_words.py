"""Spelling variants, byte-level BPE and vector codes against brute force."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from conftest import SF
from test_llm import LOW, SCHEMA, fixture_rows

from lodestone.llm import byte_fst, spelling_variants, vector_codes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fixture_rows()[0], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# --- spelling variants ---------------------------------------------------------------------------------------------


def brute_words(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOW)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_variants(n):
    """word, form, root, n, n_near, form_n; near words by the strings that one deletion leaves."""
    by = collections.defaultdict(set)
    for w in n:
        for k in range(len(w)):
            by[w[:k] + w[k + 1 :], k].add(w)  # replaced at k
    near = collections.defaultdict(set)
    for group in by.values():
        for w in group:
            near[w] |= group - {w}
    for w in n:
        for short in {w[:k] + w[k + 1 :] for k in range(len(w))} & n.keys():
            near[w].add(short)
            near[short].add(w)
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out)


def found_variants(table):
    return sorted(tuple(r) for r in spelling_variants.spelling_variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_crc_of_joined_strings():
    r = random.Random(1)
    a, b = ([r.randbytes(r.randrange(k, 40)) for _ in range(300)] for k in (0, 1))
    got = spelling_variants.crc_after(*(np.array([zlib.crc32(x) for x in y], np.uint64) for y in (a, b)), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]


def test_variants_of_documents(spark, docs, empty):
    for table in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), docs):
        rows = [(r.doc_id, r.text) for r in table.collect()]
        assert found_variants(table) == brute_variants(brute_words(rows))
    assert spelling_variants.spelling_variants(empty).count() == 0


@pytest.mark.parametrize(("part", "batch"), [(2048, 1 << 15), (8, 50), (1, 1)])
def test_variants_of_crowded_words(spark, monkeypatch, part, batch):
    """Words that differ little, in parts that are cut down to single places, and long ones; forms that have forms."""
    monkeypatch.setattr(spelling_variants, "PART_WORDS", part)
    monkeypatch.setattr(spelling_variants, "TRIE_WORDS", batch)
    r = random.Random(7)
    words = {"".join(r.choice("abÉ") for _ in range(r.randrange(6, 9))) for _ in range(400)} | {"x" * 300, "x" * 301, "x" * 150 + "y" + "x" * 149}
    text = [w for w in sorted(words) for _ in range(r.choice([5, 6, 30, 200, 1000]))]
    table = spark.createDataFrame([(k, " ".join(text[k::7])) for k in range(7)], "doc_id long, text string")
    rows = [(x.doc_id, x.text) for x in table.collect()]
    want = brute_variants(brute_words(rows))
    assert sum(x[1] is not None and x[2] != x[1] for x in want)  # forms of forms
    assert found_variants(table) == want


# --- byte-level BPE ------------------------------------------------------------------------------------------------

PIECES = ["a", "th", "ing", " ", " the", "é", "日本", "ー", "12", "'s", "'ll", "\n", "  ", "!!", "==", "да", "=====", "q", "́", "😀", "\x00", "\t", "aaaa"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts_to_encode():
    r = random.Random(5)
    return [None, "", *("".join(r.choice(PIECES) for _ in range(r.randrange(60))) for _ in range(800)), "a" * 3000, " " * 2000, "ab" * 900, "日" * 700]


@pytest.mark.parametrize(("states", "spans", "long"), [(200_000, 500_000, 256), (300, 100, 5)])
def test_byte_ids(library, monkeypatch, states, spans, long):
    for name, value in (("STATES", states), ("NEIGHBOURS", states), ("CACHE_SPANS", spans), ("LONG", long)):
        monkeypatch.setattr(byte_fst, name, value)
    codec, texts = byte_fst.ByteCodec(RANKS), texts_to_encode()
    want = [library.encode_ordinary(x or "") for x in texts]
    for _ in range(2):
        assert [x.tolist() for at in range(0, len(texts), 200) for x in codec.encode(texts[at : at + 200])] == want


def test_byte_stream_has_bounded_lookahead(library):
    """A span's ids come in order and, in prose, at most two tokens' bytes late."""
    machine = byte_fst.Transducer(byte_fst.read_ranks(RANKS))
    for span in regex.findall(public_tokenizers.PATTERN, " internationalisation of unquestionably straightforwardness " + "ab" * 200):
        data, sent = span.encode(), 0
        late = []

        def bytes_of(data=data, late=late):
            for k in range(len(data)):
                late.append(k - sent)
                yield data[k]

        class Feed(bytes):
            def __iter__(self):
                return bytes_of()

        ids = []
        for i in machine.stream(Feed(data)):
            ids.append(i)
            sent += len(machine.token[i])
        assert ids == library.encode_ordinary(span)
        assert max(late) <= 40


def test_token_that_merges_do_not_make():
    """A span that is a token itself is that token; elsewhere only merges make tokens."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bcd": 257, b"abc": 258}
    own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
    machine = byte_fst.Transducer(ranks)
    for text in ("bcd", "abcd", "abcbcd", "bcdabc", "abc", "aabcabcab"):
        assert machine.encode([text.encode()])[0].tolist() == list(machine.stream(text.encode())) == own.encode_ordinary(text)


def test_decoder_takes_pieces_of_any_size():
    r = random.Random(2)
    heads = [65, 0x80, 0xBF, 0xC2, 0xC1, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xE3]
    cases = [bytes(r.choice(heads) for _ in range(r.randrange(14))) for _ in range(2000)] + ["日本 é 😀x".encode()]
    for data in cases:
        decoder, text, at = byte_fst.Decoder({i: bytes([i]) for i in range(256)}), "", 0
        while at < len(data):
            n = r.randrange(1, 4)
            text += decoder.feed(list(data[at : at + n]))
            at += n
        assert text + decoder.end() == data.decode("utf-8", "replace")


def test_byte_digests(spark, docs, empty, library):
    for table in (docs, spark.read.parquet(f"{SF}/documents.parquet")):
        want = []
        for r in table.collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = byte_fst.encode_decode_digests(table, RANKS)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert byte_fst.encode_decode_digests(empty, RANKS).count() == 0
    back = byte_fst.decode_bytes(byte_fst.encode_bytes(docs, RANKS), RANKS)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)


def test_bytes_of_parts(monkeypatch):
    from lodestone.llm import vectext

    texts = texts_to_encode()[:300] + [" ".join(["alpha'll", "beta", "'s", "日本語"] * 200)]
    whole = byte_fst.ByteCodec(RANKS).digests(texts)
    monkeypatch.setattr(vectext, "CHUNK_CHARS", 60)
    assert byte_fst.ByteCodec(RANKS).digests(texts) == whole


# --- vector codes --------------------------------------------------------------------------------------------------


def brute_codes(rows, entries, rounds):
    """(vec_id, code, error, label_error), and the digest, in whole Python numbers."""
    width = max(len(v) for _, v, _ in rows)
    size = -(-width // 4)
    xs = [[math.floor(1024 * x) for x in v] + [0] * (4 * size - width) for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, xs[k]))
    cut = lambda x, p: x[p * size : (p + 1) * size]
    books = [[cut(xs[k], p) for k in order[:entries]] for p in range(4)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    find = lambda p, x: min(range(len(books[p])), key=lambda e: (far(cut(x, p), books[p][e]), e))
    for _ in range(rounds):
        for p in range(4):
            mine = collections.defaultdict(list)
            for x in xs:
                mine[find(p, x)].append(cut(x, p))
            for e, members in mine.items():
                books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    codes = [[find(p, x) for p in range(4)] for x in xs]
    errors = [sum(far(cut(x, p), books[p][c[p]]) for p in range(4)) for x, c in zip(xs, codes, strict=True)]
    total = collections.Counter()
    for (_, _, label), e in zip(rows, errors, strict=True):
        total[label] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{c:02x}" for c in code), e, total[label], digest) for (i, _, label), code, e in zip(rows, codes, errors, strict=True)), key=str)


def found_codes(table, **kw):
    return sorted((tuple(r) for r in vector_codes.vector_codes(table, **kw).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def test_nearest_entries():
    r = np.random.default_rng(0)
    for width, high in ((16, 300), (3, 4), (1, 3), (5, 2), (16, 1 << 26)):
        entries, x = (r.integers(-high, high, (n, width)) for n in (256, 1500))
        index, best = vector_codes.Codebook(entries).nearest(x)
        far = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (index == far.argmin(1)).all()
        assert (best == far.min(1)).all()


def test_codes(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in table.collect()]
    assert found_codes(table, entries=16, rounds=2) == brute_codes(rows, 16, 2)
    assert vector_codes.vector_codes(table).filter("length(code) <> 8 OR error < 0").isEmpty()


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_codes_of_odd_vectors(spark, monkeypatch, broadcast):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", broadcast)
    good = [(5, [0.5, -0.25, 0.001, 2.0, -0.001], 1), (5, [0.5, -0.25, 0.001, 2.0, -0.001], None), (None, [1.0, 1.0, 1.0, 1.0, 1.0], None), (-3, [0.0, 0.0, 0.0, 0.0, 0.0], 1), (7, [3.0, -7.5, 0.3, 0.2, 0.1], 2), (8, [3.0, -7.5, 0.3, 0.2, 0.1], 2)]
    bad = [(1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0, 0.0], 2), (4, [float("nan")] * 5, 2), (6, [float("inf")] * 5, None), (9, [1.0], 2)]
    columns = "vec_id long, embedding array<double>, label int, code string, error long, n int, part int, v int"
    table = spark.createDataFrame([(*x, "c", 1, 2, 3, 4) for x in good + bad], columns).repartition(3)
    for entries in (2, 256):
        assert found_codes(table, entries=entries, rounds=3) == brute_codes(good, entries, 3)
    assert vector_codes.vector_codes(table.limit(0)).count() == 0
    assert vector_codes.vector_codes(table.filter("embedding IS NULL")).count() == 0


def test_huge_components(spark):
    """Integers beyond the bound count as the bound; no distance overflows."""
    table = spark.createDataFrame([(k, [1e300 * (-1) ** k, 5.0, 0.0, 0.0], 0) for k in range(4)], "vec_id long, embedding array<double>, label int")
    got = vector_codes.vector_codes(table, entries=1).collect()
    most = vector_codes.largest_component(4)
    assert {r.error for r in got} == {most**2}  # the mean of both ends is 0
