"""Line deduplication with a deletion-neighbourhood join (operator 3).

Lines are compared as sequences of lower-cased words. A line of MIN_WORDS or more words goes if an earlier line (in
order of doc_id, then of the line's number) has the same words; one of NEAR_WORDS or more also if an earlier one lies
within one edited word. A line without blanks, of NEAR_CHARS or more characters and half of them or more of a script
that is written without blanks, is compared as a sequence of characters. Each line emits the hashes of all variants that
lack one word: lines that differ by a replaced word share a variant with the same place, lines that differ by an added word have one's variant equal to the other's
whole. Equal variants are joined, the earliest line of each is the partner of the others, and its edit distance is
verified. Before that, lines are let go that share neither a first nor a second half with any other line, as one edit
leaves one half whole; this drops no pair within the bound.

Defined results: null and empty texts have one empty line, which stays, as do all lines without words; a
null doc_id comes last; columns of the input named like the counts, whose names the caller may choose, give way to them;
rows that repeat doc_id and text are one document and keep the same lines; an empty table gives no rows. Texts are taken
whole, long ones in parts of whole lines; other columns stay as they are in `deduplicated`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, work_dir
from .vectext import ASCII_SPACE, char_table, joined, line_parts, lower_ascii, mix64, powers, slices, span_hashes, word_spans

MIN_WORDS, NEAR_WORDS, NEAR_CHARS = 1, 5, 10
#: First and last characters of scripts without blanks: Thai and Lao, Tibetan and Burmese, Khmer, kana and Han.
UNSPACED = ((0x0E00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
SLICE_CHARS = 1 << 20
#: Most rows, or bytes of lists, of a side that is broadcast; beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 1 << 26
LAST = (1 << 63) - 1
COUNTS = ("n_lines", "n_exact", "n_near")
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
_TAGS = np.arange(4, dtype=np.uint64) * _B


def _characters(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words, with those that are whole lines in a script without blanks cut into characters, and which these are."""
    first = np.searchsorted(starts, begin)
    alone = first[np.diff(np.append(first, len(starts))) == 1]
    alone = alone[ends[alone] - starts[alone] >= NEAR_CHARS]
    size = np.ones(len(starts), np.int64)
    if len(alone):
        among = np.zeros(len(cp), bool)
        for a, b in UNSPACED:
            among |= (cp >= a) & (cp <= b)
        held = np.append(0, np.cumsum(among))
        long = ends[alone] - starts[alone]
        some = alone[2 * (held[ends[alone]] - held[starts[alone]]) >= long]
        size[some] = (ends - starts)[some]
    single = np.repeat(size > 1, size)
    at = np.repeat(starts, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return at, np.where(single, at + 1, np.repeat(ends, size)), single


class Lines:
    """The words of all lines of some text parts, flat, with running sums that give the hash of any part of a line.
    `text` and `number` are the row of each line's text and the line's number in it."""

    def __init__(self, rows: list[int], firsts: list[int], texts: list[str]):
        _, cp, bounds = joined(texts)
        breaks = np.flatnonzero(cp == 10)
        cp = lower_ascii(cp)
        begin = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
        part = np.repeat(np.arange(len(texts)), np.array([x.count("\n") + 1 for x in texts]))
        self.text = np.asarray(rows)[part]
        self.number = np.arange(len(begin)) - np.searchsorted(part, part) + np.asarray(firsts)[part]
        starts, ends = word_spans(cp, char_table(tuple(ASCII_SPACE)), bounds)
        starts, ends, single = _characters(cp, starts, ends, begin)
        self.words = span_hashes(cp, starts, ends)
        self.words[single] = mix64(self.words[single] ^ _B)  # a character is no word of one letter
        self.first = np.searchsorted(starts, begin)
        # an empty text at the end of another shares its place; its line begins after all words before it
        self.n = np.diff(np.append(self.first, len(starts)))
        local = np.arange(len(starts)) - np.repeat(self.first, self.n)
        self.sums = np.append(np.uint64(0), np.cumsum(self.words * powers(local), dtype=np.uint64))

    def part(self, line: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sum of the words a to b of each line, as they stand in it."""
        at = self.first[line]
        return self.sums[at + b] - self.sums[at + a]

    def whole(self, line: np.ndarray) -> np.ndarray:
        n = self.n[line]
        return self._key(self.part(line, np.zeros_like(n), n), n, 0)

    def _key(self, value: np.ndarray, n: np.ndarray, tag: int) -> np.ndarray:
        return mix64(mix64(value) + n.astype(np.uint64) * _A + _TAGS[tag]).view(np.int64)

    def halves(self, line: np.ndarray) -> np.ndarray:
        """Four keys of each line: its first words, and its last, at the cuts that a line of as many words or one fewer has."""
        n, zero = self.n[line], np.zeros(len(line), np.int64)
        keys = []
        for m in (n, n - 1):
            cut = m // 2
            keys.append(self._key(self.part(line, zero, cut), cut, 1))
            tail = m - cut
            keys.append(self._key(self.part(line, n - tail, n) * powers(n - tail, True), tail, 2))
        return np.column_stack(keys)

    def variants(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word of each line in turn: the line's place in `line`, the hash of the line without the word as it is
        shared by lines that differ there, and the same as the hash of a whole line. A run of one word counts as its first."""
        n = self.n[line]
        own = np.repeat(np.arange(len(line)), n)
        i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        ln = line[own]
        zero = np.zeros_like(i)
        value = self.part(ln, zero, i) + self.part(ln, i + 1, n[own]) * powers(np.ones(1, np.int64), True)
        word = self.words[self.first[ln] + i]
        same = np.append(False, (word[1:] == word[:-1]) & (own[1:] == own[:-1]))
        place = np.maximum.accumulate(np.where(same, 0, np.arange(len(i)))) - (np.cumsum(n) - n)[own] if len(i) else i
        return own, self._key(value + place.astype(np.uint64) * _B, n[own], 3), self._key(value, n[own] - 1, 0)


def _order() -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("d"), F.xxhash64("text").alias("t")


def line_table(docs: DataFrame) -> DataFrame:
    """d, t (the document), line, n, h and the keys of the halves, of every line of MIN_WORDS or more words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d", "t", "line", "n", "h", "keys"]
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                for group in line_parts(part.column("text").to_pylist()):
                    lines = Lines(*group)
                    some = np.flatnonzero(lines.n >= MIN_WORDS)
                    near = lines.n[some] >= NEAR_WORDS
                    cut = np.append(0, np.cumsum(np.where(near, 4, 0))).astype(np.int32)
                    keys = pa.ListArray.from_arrays(pa.array(cut), pa.array(lines.halves(some[near]).ravel()))
                    row = pa.array(lines.text[some])
                    number, n = (pa.array(x[some].astype(np.int32)) for x in (lines.number, lines.n))
                    order = [part.column(c).take(row) for c in ("d", "t")]
                    yield pa.RecordBatch.from_arrays([*order, number, n, pa.array(lines.whole(some)), keys], names)

    return docs.select(*_order(), "text").mapInArrow(run, "d long, t long, line int, n int, h long, keys array<long>")


def _near_candidates(first: DataFrame) -> DataFrame:
    """The lines (h) that share a half with another."""
    rows = first.select(F.explode("keys").alias("key"), "h")
    shared = rows.groupBy("key").agg(F.min("h").alias("a"), F.max("h").alias("b")).filter("a <> b").select("key")
    return rows.join(shared, "key").select("h").distinct()


def _earliest_partners(rows: DataFrame, folder: str) -> DataFrame:
    """h, earlier: for each key, its earliest line is the partner of the others. Rows are dealt by ranges of key and
    order, so that a frequent key spreads over partitions; the first lines of the partitions' outer runs meet afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        out = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("earlier", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("line", pa.int32())])
        for batch in batches:
            key, h = batch.column("key").to_numpy(), batch.column("h").to_numpy()
            if not len(key):
                continue
            order = [batch.column(c) for c in ("d", "t", "line")]
            fresh = np.append(last is None or last[0] != key[0], key[1:] != key[:-1])
            begin = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), -1))
            hub = np.where(begin >= 0, h[np.maximum(begin, 0)], last[1] if last else 0)
            ends = np.array([0]) if last is None else np.zeros(0, np.int64)  # the partition's first line
            if len(hit := np.concatenate([ends, np.flatnonzero(hub != h)])):
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(h[hit]), pa.array(hub[hit]), *(c.take(pa.array(hit)) for c in order)], schema=out)
            last = (int(key[-1]), int(hub[-1]))
        if last is not None:  # the first line of the partition's last run, for lines of the key in later partitions
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((last[0], None, last[1], None, None, None), out.types, strict=True)], schema=out)

    many = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(many, "key", "d", "t", "line").sortWithinPartitions("key", "d", "t", "line")
    found = stored(dealt.mapInArrow(run, "key long, h long, earlier long, d long, t long, line int"), folder, "partners", batch_rows=None)
    # a partition's first line against the firsts of the key's runs in other partitions; the verification tells the order
    begins = found.filter("h = earlier").select("key", "h")
    runs = found.filter("h IS NULL").select("key", "earlier")
    return found.filter("h <> earlier").select("h", "earlier").union(begins.join(runs, "key").filter("h <> earlier").select("h", "earlier")).distinct()


def _within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one replaced, added or dropped word turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differ = np.flatnonzero(a != b[: len(a)])
    if not len(differ):
        return True
    i = differ[0]
    return bool((a[i + 1 :] == b[i + 1 :]).all() if len(a) == len(b) else (a[i:] == b[i + 1 :]).all())


def near_lines(docs: DataFrame, first: DataFrame, folder: str) -> DataFrame:
    """h of the lines that have an earlier line within one edited word. first: h with d, t, line of its first place."""
    wanted = stored(first.join(_near_candidates(first), "h").select("h", "d", "t", "line"), folder, "near-candidates")
    of_doc = wanted.groupBy("d", "t").agg(F.collect_list("h").alias("wanted"), F.collect_list("line").alias("at"))
    few = wanted.count() <= BROADCAST_ROWS
    known = np.sort(wanted.select("h").toArrow().column("h").to_numpy()) if few else None
    known_words = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words.value
        lists = lambda size, x: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(x))
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                at = part.column("at")
                row = np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy()))
                asked = np.sort(row << 32 | at.flatten().to_numpy())
                for group in line_parts(part.column("text").to_pylist()):
                    lines = Lines(*group)
                    place = lines.text << 32 | lines.number
                    mine = asked[np.searchsorted(asked, place[0]) : np.searchsorted(asked, place[-1], "right")]
                    if not len(mine):
                        continue
                    line = np.searchsorted(place, mine)
                    own, replaced, dropped = lines.variants(line)
                    if known is not None and len(known):
                        keep = known[np.minimum(np.searchsorted(known, dropped), len(known) - 1)] == dropped
                    else:
                        keep = np.ones(len(dropped), bool)
                    size = lines.n[line]
                    word = np.repeat(lines.first[line] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(lines.whole(line)),
                            *(part.column(c).take(pa.array(lines.text[line])) for c in ("d", "t")),
                            pa.array(lines.number[line].astype(np.int32)),
                            lists(size, lines.words[word].view(np.int64)),
                            lists(size, replaced),
                            lists(np.bincount(own[keep], minlength=len(line)), dropped[keep]),
                        ],
                        ["h", "d", "t", "line", "words", "replaced", "dropped"],
                    )

    texts = docs.select(*_order(), "text").join(F.broadcast(of_doc) if few else of_doc, ["d", "t"]).select("d", "t", "at", "text")
    lines = stored(texts.mapInArrow(run, "h long, d long, t long, line int, words array<long>, replaced array<long>, dropped array<long>"), folder, "variants")
    place = [F.col(c) for c in ("d", "t", "line")]
    by_place = _earliest_partners(lines.select(F.explode("replaced").alias("key"), "h", *place), folder)
    shorter = lines.select(F.col("h").alias("key"), F.col("h").alias("other")).join(lines.select(F.explode("dropped").alias("key"), "h"), "key")
    added = shorter.select("h", F.col("other").alias("earlier"))
    pairs = by_place.union(added).union(added.select("earlier", "h")).distinct()
    of_line = lines.select("h", "words", F.struct(*place).alias("o")).dropDuplicates(["h"])
    met = pairs.join(of_line, "h").join(of_line.select(F.col("h").alias("earlier"), F.col("words").alias("w2"), F.col("o").alias("o2")), "earlier").filter("o2 < o")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_within_one(a.values.to_numpy(), b.values.to_numpy()) for a, b in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], ["h"])

    return met.select("h", "words", "w2").mapInArrow(verify, "h long").distinct()


def dropped_lines(docs: DataFrame, folder: str) -> DataFrame:
    """d, t and the numbers of the document's lines that go: `exact` and `near`."""
    lines = stored(line_table(docs), folder, "lines")
    first = lines.groupBy("h").agg(F.min(F.struct("d", "t", "line")).alias("o"), F.first("keys").alias("keys"))
    first = stored(first.select("h", "o.d", "o.t", "o.line", "keys"), folder, "first")
    near = near_lines(docs, first, folder).withColumn("near", F.lit(True))
    decided = stored(first.select("h", F.struct("d", "t", "line").alias("o")).join(near, "h", "left"), folder, "decided")
    marked = lines.select("h", "d", "t", "line").join(decided, "h")
    marked = marked.withColumn("exact", F.struct("d", "t", "line") != F.col("o")).filter("exact OR near")
    return marked.groupBy("d", "t").agg(F.collect_set(F.when(F.col("exact"), F.col("line"))).alias("exact"), F.collect_set(F.when(~F.col("exact"), F.col("line"))).alias("near"))


def deduplicated(docs: DataFrame, counts: tuple[str, str, str] = COUNTS) -> DataFrame:
    """The documents with the lines that stay as `text`, and the numbers of lines, and of those that went, under the names
    `counts`."""
    folder = work_dir(docs.sparkSession, "lines")
    gone = stored(dropped_lines(docs, folder), folder, "gone").withColumnsRenamed({"d": "of_d", "t": "of_t"})
    discard(docs.sparkSession, folder, "lines", "first", "near-candidates", "variants", "partners", "decided")
    size = gone.agg(F.sum(64 + 4 * (F.size("exact") + F.size("near")))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    full = docs.select(F.struct("*").alias("doc"), *_order(), "text")  # in a struct, the names of the input can't clash
    full = full.join(gone, (F.col("d") == F.col("of_d")) & (F.col("t") == F.col("of_t")), "left")
    none = F.array().cast("array<int>")
    exact, near = F.coalesce("exact", none), F.coalesce("near", none)
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.array_contains(F.concat(exact, near), i))
    found = [F.size(x).cast("long").alias(c) for x, c in zip((lines, exact, near), counts, strict=True)]
    names = [c for c in docs.columns if c not in counts]
    return full.select(*(F.array_join(stay, "\n").alias("text") if c == "text" else F.col("doc").getField(c).alias(c) for c in names), *found)


_WORDS_SQL = r"regexp_extract_all(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
ORACLE_SQL = f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents),
l AS (SELECT doc_id, i - 1 AS line, xs[i] AS x, {_WORDS_SQL.replace('(x,', '(xs[i],')} AS w FROM (SELECT doc_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM s)),
e AS (SELECT *, doc_id * 1000000 + line AS o, array_to_string(w, ' ') AS k FROM l WHERE len(w) >= {MIN_WORDS}),
f AS (SELECT k, any_value(w) AS w, min(o) AS o FROM e GROUP BY k),
v AS (SELECT k, o, i, array_to_string(w[1:i - 1] || w[i + 1:], ' ') AS d FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM f WHERE len(w) >= {NEAR_WORDS})),
near AS (SELECT b.k FROM v a JOIN v b ON a.d = b.d AND a.i = b.i AND a.o < b.o
    UNION SELECT t.k FROM v t JOIN f s ON s.k = t.d AND len(s.w) >= {NEAR_WORDS} WHERE s.o < t.o
    UNION SELECT s.k FROM v t JOIN f s ON s.k = t.d AND len(s.w) >= {NEAR_WORDS} WHERE t.o < s.o),
g AS (SELECT e.doc_id, e.line, e.o <> f.o AS exact, near.k IS NOT NULL AS near FROM e JOIN f USING (k) LEFT JOIN near USING (k)),
m AS (SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.exact) AS n_exact, count(*) FILTER (WHERE NOT g.exact AND g.near) AS n_near,
    coalesce(string_agg(l.x, chr(10) ORDER BY l.line) FILTER (WHERE NOT coalesce(g.exact OR g.near, false)), '') AS text
    FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_exact, n_near, sha256(text) AS kept_sha256 FROM m
"""
