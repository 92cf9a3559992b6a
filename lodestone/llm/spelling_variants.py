"""Groups of spelling variants: a trie self-join of the vocabulary with active-node sets (operator 11).

Two words are near if one inserted, deleted or replaced code point makes one of them the other. The vocabulary is dealt
so that near words meet: words of m and m + 1 code points that differ at a place below m / 2 have the same last code
points, those that differ beyond have the same first ones. A part with too many words is cut in two again, at the middle
of the places where its words may differ, until at most the alphabet is left, so that no task holds an unbounded part.

In a task the parts are the children of one trie's root, which is a sorted array with the common prefix lengths of
neighbours. It is walked level by level. The active nodes of a node are itself and those within distance one: siblings
(a replaced code point) and children (an inserted one) become active at the level where they part, and from there a
pair of nodes lives on in the children that they have in common. Pairs of terminal nodes are near words. A pair becomes
active only where the two words first differ, so that each is met once, in one part: its counts can be added up.

Defined results: a null or empty text has no words; a null doc_id stands as an empty one in the hash of a run; rows that
repeat a doc_id are texts of their own, all of which count; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored, work_dir
from .vectext import joined, lower_ascii, parts, slices, span_hashes, word_spans

#: Least code points and occurrences of a word, and how many times as frequent a form must be.
LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: A run loses a code point if this divides its hash.
ALTERED = 199
#: Runs that a task counts before it passes the counts on.
HELD_WORDS = 150_000
#: Words of a part beyond which it is cut in two, and words that go into one trie.
PART_WORDS, TRIE_WORDS = 2048, 1 << 15
#: Most rows of a side that is broadcast.
BROADCAST_ROWS = 200_000
_WORDS = "word string, n long"
_CRC_POLY = 0xEDB88320


@lru_cache(1)
def _not_letters() -> np.ndarray:
    table = np.ones(0x110000, bool)
    for first, last in ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0xFF)):
        table[first : last + 1] = False
    return table


@lru_cache(1)
def _byte_steps() -> np.ndarray:
    """What one zero byte makes of each single bit of a CRC state."""
    steps = np.zeros(32, np.uint64)
    for k in range(32):
        x = 1 << k
        for _ in range(8):
            x = (x >> 1) ^ (_CRC_POLY if x & 1 else 0)
        steps[k] = x
    return steps


def _times(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The linear map whose images of single bits are `bits`, applied to the values."""
    out = np.zeros(len(values), np.uint64)
    for k in range(32):
        out ^= np.where((values >> np.uint64(k)) & np.uint64(1), bits[k], np.uint64(0))
    return out


@lru_cache(4096)
def _shift(size: int) -> np.ndarray:
    """4 x 256: what `size` zero bytes make of each byte of a CRC state."""
    power, result = _byte_steps(), np.left_shift(np.uint64(1), np.arange(32, dtype=np.uint64))
    while size:
        if size & 1:
            result = _times(power, result)
        power = _times(power, power)
        size >>= 1
    places = np.arange(256, dtype=np.uint64)
    return np.stack([_times(result, places << np.uint64(8 * b)) for b in range(4)])


def crc_after(before: np.ndarray, crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of two joined strings, from that of the first, and that and the bytes of the second."""
    out = crc.astype(np.uint64)
    before = before.astype(np.uint64)
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.append(True, np.diff(size[order]) != 0)) if len(size) else []
    for a, b in zip(cut, [*cut[1:], len(size)], strict=True):
        mine = order[a:b]
        table = _shift(int(size[mine[0]]))
        for k in range(4):
            out[mine] ^= table[k][(before[mine] >> np.uint64(8 * k) & np.uint64(255)).astype(np.intp)]
    return out


class Counter:
    """Counts of runs, altered as their hashes say, over the texts of a task."""

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.words: list[str] = []
        self.crc, self.size, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.altered: dict[str, int] = {}

    def add(self, doc_ids: list[int | None], texts: list[str | None]) -> None:
        heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in doc_ids], np.uint64)
        for rows, group in parts(texts):
            text, cp, bounds = joined(group)
            cp = lower_ascii(cp)
            starts, ends = word_spans(cp, _not_letters(), bounds[:-1][bounds[:-1] < len(cp)])
            long = ends - starts >= LEAST_LENGTH
            starts, ends = starts[long], ends[long]
            if not len(starts):
                continue
            values, first, back = np.unique(span_hashes(cp, starts, ends), return_index=True, return_inverse=True)
            slot = np.array(list(map(self.known.get, values.tolist(), repeat(-1))), np.int64)
            if len(new := np.flatnonzero(slot < 0)):
                at = first[new]
                slot[new] = self._learn(values[new].tolist(), [cp[a:b].tobytes().decode("utf-32-le") for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot = slot[back.ravel()]
            row = np.asarray(rows)[np.searchsorted(bounds, starts, "right") - 1]
            h = crc_after(heads[row], self.crc[slot], self.size[slot])
            hit = h % np.uint64(ALTERED) == 0
            self.n += np.bincount(slot[~hit], minlength=len(self.n))
            for s, x in zip(slot[hit].tolist(), h[hit].tolist(), strict=True):
                word = self.words[s]
                k = x % len(word)
                if len(word) > LEAST_LENGTH:
                    word = word[:k] + word[k + 1 :]
                    self.altered[word] = self.altered.get(word, 0) + 1

    def _learn(self, hashes: list[int], words: list[str]) -> np.ndarray:
        slots = np.arange(len(self.words), len(self.words) + len(words))
        coded = [w.encode() for w in words]
        self.words += words
        self.crc = np.append(self.crc, np.array([zlib.crc32(w) for w in coded], np.uint64))
        self.size = np.append(self.size, np.array([len(w) for w in coded], np.int64))
        self.n = np.append(self.n, np.zeros(len(words), np.int64))
        self.known.update(zip(hashes, slots.tolist(), strict=True))
        return slots

    def counts(self) -> pa.RecordBatch:
        seen = np.flatnonzero(self.n)
        words = [self.words[k] for k in seen.tolist()] + list(self.altered)
        n = self.n[seen].tolist() + list(self.altered.values())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n: the words that are long and frequent enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                counter.add(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
                if len(counter.words) + len(counter.altered) > HELD_WORDS:
                    yield counter.counts()
                    counter.forget()
        yield counter.counts()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _WORDS)
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def _spans(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of the ranges first:last, and the number of the range of each."""
    size = np.maximum(last - first, 0)
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum())), np.repeat(np.arange(len(size)), size)


class Level:
    """The edges from the nodes of one depth: for each child its strings (start:end), its code point, and a key of both."""

    def __init__(self, trie: Trie, depth: int, deep: np.ndarray, nodes: np.ndarray):
        self.nodes = nodes
        first = np.flatnonzero(trie.shared[deep] <= depth)
        self.start = deep[first]
        self.end = deep[np.append(first[1:], len(deep)) - 1] + 1 if len(first) else self.start
        self.char = trie.pool[trie.starts[self.start] + depth].astype(np.int64)
        self.key = (np.searchsorted(nodes, self.start, "right") - 1) << 21 | self.char

    def children(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.start, a), np.searchsorted(self.start, b)

    def find(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node with the code point; -1 if it has none."""
        key = np.searchsorted(self.nodes, node) << 21 | char
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        return np.where(self.key[at] == key, at, -1) if len(self.key) else np.full(len(key), -1)


class Trie:
    """Sorted strings of code points, dealt into groups, as a trie whose root has the groups as children. A node of depth
    d is a run of strings with a common prefix of d code points; `shared` is the length of the prefix that a string
    shares with the one before (-1 at the start of a group). A string that ends at a node is the first of its run."""

    def __init__(self, groups: np.ndarray, pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.pool, self.starts, self.sizes = pool, starts, sizes
        self.shared = np.full(len(groups), -1, np.int64)
        live = np.flatnonzero(groups[1:] == groups[:-1]) + 1
        depth = 0
        while len(live):
            self.shared[live] = depth
            live = live[(sizes[live] > depth) & (sizes[live - 1] > depth)]
            live = live[pool[starts[live] + depth] == pool[starts[live - 1] + depth]]
            depth += 1

    def levels(self) -> Iterator[Level]:
        """The edges of all depths, from the root's children on; the last of them have none."""
        deep, nodes, depth = np.arange(len(self.sizes)), np.flatnonzero(self.shared < 0), 0
        while True:
            deep = deep[self.sizes[deep] > depth]
            level = Level(self, depth, deep, nodes)
            yield level
            nodes, depth = level.start, depth + 1


def _common(ours: Level, theirs: Level, pairs: tuple[np.ndarray, ...], but: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """The children that the nodes of each pair (a, b, and a of the other) have in common, without those of code point `but`."""
    child, pair = _spans(*ours.children(pairs[0], pairs[1]))
    if but is not None:
        free = ours.char[child] != but[pair]
        child, pair = child[free], pair[free]
    other = theirs.find(pairs[2][pair], ours.char[child])
    child, other = child[other >= 0], other[other >= 0]
    return ours.start[child], ours.end[child], theirs.start[other]


def near_pairs(trie: Trie, short: np.ndarray, last_part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of strings of one group at distance one, the first of `short` code points and the second of as many or of one
    more. `short` and `last_part` hold the group's values for each string. Strings that differ by a code point at the end
    alone are a pair in a `last_part` only."""
    sizes = trie.sizes
    found: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.zeros(0, np.int64)
    a = np.flatnonzero(trie.shared < 0)
    b = np.append(a[1:], len(sizes))
    twins = longer = (none, none, none)  # active pairs (a, b, a of the other): of one depth, and with the other one deeper
    levels = trie.levels()
    level = next(levels)
    depth = 0

    def met(pairs: tuple[np.ndarray, ...], more: int, allowed: np.ndarray | bool = True) -> None:
        """Both nodes of a pair are terminal, and of the lengths asked for."""
        u, _, v = pairs
        full = (sizes[u] == depth) & (short[u] == depth) & (sizes[v] == depth + more) & allowed
        found.append((u[full], v[full]))

    while True:
        met(twins, 0)
        met(longer, 1)
        below = next(levels)
        # nodes whose strings may still part, and their children
        some = (b - a > 1) & (depth <= short[a])
        a, b = a[some], b[some]
        first, last = level.children(a, b)
        child, of = _spans(first, last)
        # a node and its child: one more code point, which the node's own strings don't have at that place
        seeds = (a[of], b[of], level.start[child])
        met(seeds, 1, last_part[seeds[0]])
        longer = [_common(level, below, longer), _common(level, below, seeds, level.char[child])]
        # siblings: one replaced code point
        parting = depth < short[a[of]]
        other, which = _spans(np.where(parting, child + 1, 0), np.where(parting, last[of], 0))
        mine = child[which]
        twins = [_common(level, level, twins), (level.start[mine], level.end[mine], level.start[other])]
        twins, longer = (tuple(np.concatenate(x) for x in zip(*y, strict=True)) for y in (twins, longer))
        a, b = level.start[child], level.end[child]
        level, depth = below, depth + 1
        if not (len(a) or len(twins[0]) or len(longer[0])):
            return tuple(np.concatenate(x) for x in zip(*found, strict=True))


_PART = ["m", "lo", "hi", "head", "tail"]
_NEAR = "word string, near long, best_n long, best string"


def _near_words(table: pa.Table) -> pa.RecordBatch:
    """For each word of whole parts: how many near words they show, and the best of these."""
    group = _groups(table)
    m, lo, hi = (table.column(c).to_numpy().astype(np.int64) for c in ("m", "lo", "hi"))
    middles, n = table.column("mid").to_pylist(), table.column("n").to_numpy()
    _, pool, bounds = joined(middles)
    u, v = near_pairs(Trie(group, pool, bounds[:-1], np.diff(bounds)), hi - lo, hi == m)
    word, near = np.append(u, v), np.append(v, u)
    heads, tails = table.column("head"), table.column("tail")
    used, place = np.unique(word, return_inverse=True)
    words = [f"{heads[k].as_py()}{middles[k]}{tails[k].as_py()}" for k in used.tolist()]
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    other = np.searchsorted(used, near)
    order = np.lexsort((rank[other], -n[near], place))
    begin = np.flatnonzero(np.append(True, np.diff(place[order]) != 0)) if len(order) else order
    best = other[order][begin]
    cells = [pa.array(words, pa.string()), pa.array(np.bincount(place, minlength=len(used))), pa.array(n[used[best]]), pa.array([words[k] for k in best.tolist()], pa.string())]
    return pa.RecordBatch.from_arrays(cells, ["word", "near", "best_n", "best"])


def _groups(table: pa.Table) -> np.ndarray:
    """The number of each row's part; rows are sorted by part."""
    change = np.zeros(max(table.num_rows - 1, 0), bool)
    for c in _PART:
        column = table.column(c).combine_chunks()
        change |= pc.not_equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
    return np.append(0, np.cumsum(change)) if table.num_rows else np.zeros(0, np.int64)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TRIE_WORDS:
            table = pa.Table.from_batches(held)
            group = _groups(table)
            whole = int(np.searchsorted(group, group[-1]))  # the last part may go on
            if whole:
                yield _near_words(table.slice(0, whole))
            held = table.slice(whole).to_batches()
            rows -= whole
    if rows:
        yield _near_words(pa.Table.from_batches(held))


def _halves(m: Column, lo: Column, hi: Column) -> Column:
    """The two halves of the places lo:hi, as structs."""
    middle = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(m.alias("m"), lo.alias("lo"), middle.alias("hi")), F.struct(m.alias("m"), middle.alias("lo"), hi.alias("hi")))


def _placed(rows: DataFrame) -> DataFrame:
    """word, n and a struct `p` (m, lo, hi) to the part's key, and the code points between its ends."""
    rows = rows.select("word", "n", "p.m", "p.lo", "p.hi")
    size, tail = F.length("word"), F.col("m") - F.col("hi")
    return rows.withColumns({"head": F.col("word").substr(F.lit(1), F.col("lo")), "tail": F.col("word").substr(size - tail + 1, tail), "mid": F.col("word").substr(F.col("lo") + 1, size - tail - F.col("lo"))})


def _small(frame: DataFrame) -> DataFrame:
    """A stored frame, to be broadcast if its rows are few."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def near_words(words: DataFrame, folder: str) -> DataFrame:
    """word, near (number of near words) and best (struct of the greatest n, negated, and its first word), for the words
    that have near ones. words: word, n."""
    size = F.length("word")
    lengths = F.filter(F.array(size, size - 1), lambda m: m >= LEAST_LENGTH)
    rows = words.select("word", "n", F.explode(lengths).alias("m")).select("word", "n", F.explode(_halves(F.col("m"), F.lit(0), F.col("m"))).alias("p"))
    rows, ready, step = _placed(rows), [], 0
    while True:
        full = rows.groupBy(*_PART).count().filter((F.col("count") > PART_WORDS) & (F.col("hi") - F.col("lo") > 1)).drop("count")
        full = stored(full, folder, f"full-{step}", None)
        if full.isEmpty():
            break
        ready.append(rows.join(_small(full), _PART, "left_anti"))
        cut = rows.join(_small(full), _PART, "left_semi").select("word", "n", F.explode(_halves(F.col("m"), F.col("lo"), F.col("hi"))).alias("p"))
        rows = stored(_placed(cut), folder, f"parts-{step}", None)
        step += 1
    for part in ready:
        rows = rows.unionByName(part)
    dealt = rows.select(*_PART, "mid", "n").repartition(*_PART).sortWithinPartitions(*_PART, "mid")
    found = dealt.mapInArrow(_join_parts, _NEAR)
    return found.groupBy("word").agg(F.sum("near").alias("near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("best"))


def roots(forms: DataFrame, folder: str) -> DataFrame:
    """word, root: where the forms lead to, for the words (word, form) that have one. Every step takes the pointers of the
    step before, so the number of steps is the logarithm of the longest way."""
    now = stored(forms.select("word", F.col("form").alias("root")), folder, "roots-0", None)
    step = 0
    while True:
        onward = _small(now).select(F.col("word").alias("root"), F.col("root").alias("to"))
        after = stored(now.join(onward, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved")), folder, f"roots-{step + 1}", None)
        moved = not after.filter("moved").isEmpty()
        discard(now.sparkSession, folder, f"roots-{step}")
        now, step = after.select("word", "root"), step + 1
        if not moved:
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of the texts."""
    folder = work_dir(docs.sparkSession, "variants")
    words = stored(vocabulary(docs), folder, "words")
    near = words.join(near_words(words, folder), "word", "left")
    most = -F.col("best.n")
    likely = most >= TIMES * F.col("n")
    forms = near.select("word", F.when(likely, F.col("best.word")).alias("form"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), F.when(likely, most).alias("form_n"))
    forms = stored(forms, folder, "forms", None)
    return forms.join(roots(forms.filter("form IS NOT NULL"), folder), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
