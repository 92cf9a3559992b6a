"""N-gram Jaccard join with PartEnum signatures (operator 10).

A document's set holds the 64-bit hashes of its distinct word shingles. Sets are dealt into size bands so that sets
that link lie in the same or in neighbouring bands; for bands j-1 and j, sets that link differ in at most
k = (u[j-1] + u[j]) * (q - p) / (q + p) features (threshold p/q, u the upper ends). The feature domain is cut into
partitions of two cells, SPARE * (k + 1) cells in all, and the subsets of one cell are enumerated (n1 = 1 partition at
a time, n2 = 1 of its cells; larger subsets would be rarer but far more than the k + 1 signatures that one cell each
needs): with its number, a cell's content is a signature. k differences spoil k cells at most, so all but k of the two
sets' signatures are equal;
then the first k + 1 of them in one common order (cells with the most features first, ties by hash) hold an equal one,
and only these are kept. Cells of few features, which unlike sets share by chance, are thereby left out.

Of the sets that share a signature any two may link. In HUB_ROUNDS rounds each set is verified against one hub, the
first set (in an order of the round's own) of those signatures that it shares with it most often; links contract. Only
signatures whose sets are then still in different components remain. Their sets form clusters, in which the stragglers,
the sets outside the cluster's largest component, are compared with all of the cluster, so that near copies of one text
cost a comparison or two each, not one for each pair. Comparisons are dealt into cells of bounded size in features,
which give back only a spanning forest of their links. No link between different sets is lost, no bucket is capped, and
no pairs are emitted. Where many sets are alike but link with none, as pages of one template, the stragglers are many,
and the work is quadratic in such a cluster.

Defined results: null and empty texts have no shingles and link with nothing; a text of fewer words than the width has
one shingle, the whole sequence; rows that repeat a doc_id are one document for the purpose of links; a null doc_id
keeps its count and has no component; an empty table gives no rows; other columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, stored, work_dir
from .vectext import ASCII_SPACE, SPACE_CUT, char_table, joined, lower_ascii, mix64, parts, slices, span_hashes, word_spans

SLICE_CHARS = 1 << 20
#: Cells for each signature that is kept.
SPARE = 1.3
#: Rounds of comparisons with hubs, and features of each side of a cell in expectation.
HUB_ROUNDS = 2
CELL = 1 << 18
#: Columns that a set's signatures are stored in; signatures and features that are shuffled at once, about. What a wave
#: shuffled is gone before the next begins, so that disk is held for the stored signatures and one wave.
COLUMNS, WAVE_ROWS, WAVE_FEATURES = 8, 1 << 24, 1 << 27
#: Largest number of ids that is broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
_A, _B = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, one text after another, and each text's number of words."""
    space = char_table(tuple(ASCII_SPACE))
    counts, found = np.zeros(len(texts), np.int64), []
    for rows, group in parts(texts, SPACE_CUT):
        _, cp, bounds = joined(group)
        cp = lower_ascii(cp)
        starts, ends = word_spans(cp, space, bounds)
        found.append(span_hashes(cp, starts, ends))
        np.add.at(counts, rows, np.diff(np.searchsorted(starts, bounds)))
    return np.concatenate(found) if found else np.zeros(0, np.uint64), counts


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one text after another, and each text's number of them."""
    words, counts = word_hashes(texts)
    n = len(texts)
    first = np.cumsum(counts) - counts
    own = np.repeat(np.arange(n), counts)
    whole = np.maximum(counts - width + 1, 0)
    at = np.flatnonzero(np.arange(len(words)) - first[own] < whole[own])
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        value = mix64(value * _A + words[at + k])
    row = own[at]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        extra = np.array([_sequence(words[a : a + c]) for a, c in zip(first[short].tolist(), counts[short].tolist(), strict=True)], np.uint64)
        value, row = np.concatenate([value, extra]), np.concatenate([row, short])
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.bincount(row, minlength=n)


def _sequence(words: np.ndarray) -> np.uint64:
    value = np.array([len(words)], np.uint64)
    for w in words:
        value = mix64(value * _B + w)
    return value[0]


class Bands:
    """Size bands of a threshold p/q and, for the instance that joins bands j-1 and j, its numbers of partitions and cells."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.upper = [0]

    def grow(self, size: int) -> None:
        while self.upper[-1] < size * self.q // self.p + 2:
            self.upper.append((self.upper[-1] + 1) * self.q // self.p)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        self.grow(int(sizes.max(initial=1)))
        return np.searchsorted(np.array(self.upper), sizes)

    def differences(self, instance: np.ndarray) -> np.ndarray:
        """k of each instance: in how many features sets that link differ at most."""
        upper = np.array(self.upper)
        return (upper[instance - 1] + upper[instance]) * (self.q - self.p) // (self.q + self.p)


def signatures(values: np.ndarray, counts: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """The PartEnum signatures of all sets, one set after another, and each set's number of them."""
    band = bands.of(counts)
    row = np.repeat(np.arange(len(counts)), counts)
    found, owner = [], []
    for instance in (band, band + 1):
        k = bands.differences(np.maximum(instance, 1))
        need = np.where((k > 0) & (counts > 0), k + 1, 0)  # with k = 0 only equal sets link
        cells = 2 * np.ceil(need * SPARE / 2).astype(np.int64)
        offset = np.cumsum(cells) - cells
        use = cells[row] > 0
        r, v = row[use], mix64(values[use] ^ (instance[row[use]].astype(np.uint64) * _B))
        cell = offset[r] + (v >> np.uint64(33)).astype(np.int64) % cells[r]
        total, m = int(cells.sum()), mix64(v ^ _A)
        held = np.bincount(cell, minlength=total)
        sums = np.zeros(total, np.uint64)
        for shift in (0, 21, 42):
            piece = ((m >> np.uint64(shift)) & np.uint64(0x1FFFFF)).astype(np.float64)
            sums += np.bincount(cell, piece, total).astype(np.uint64) << np.uint64(shift)
        own = np.repeat(np.arange(len(counts)), cells)
        inside = np.arange(total) - offset[own]
        sig = mix64(sums + mix64(instance[own].astype(np.uint64) * _A + inside.astype(np.uint64) * _B))
        order = np.lexsort((sig, -held, own))
        keep = order[inside < need[own]]
        found.append(sig[keep])
        owner.append(own[keep])
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return np.concatenate(found)[order], np.bincount(own, minlength=len(counts))


def set_ids(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set, the same for equal sets."""
    total = np.zeros(len(counts) + 1, np.uint64)
    ends = np.cumsum(counts)
    np.cumsum(mix64(values ^ _B), out=(sums := np.zeros(len(values), np.uint64)), dtype=np.uint64)
    total[1:] = np.where(ends > 0, sums[np.maximum(ends - 1, 0)], 0) if len(values) else 0
    return mix64(np.diff(total) + counts.astype(np.uint64) * _A)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def set_table(docs: DataFrame, width: int, p: int, q: int) -> DataFrame:
    """doc_id, n, the set's fingerprint, its number of signatures and these, dealt into COLUMNS columns, for every document."""
    shift, names = np.uint64(64 - (COLUMNS - 1).bit_length()), [f"sigs{i}" for i in range(COLUMNS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(p, q)
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                values, counts = shingle_sets(part.column("text").to_pylist(), width)
                sigs, many = signatures(values, counts, bands)
                own, column, lists = np.repeat(np.arange(len(many)), many), sigs >> shift, []
                for i in range(COLUMNS):
                    at = np.flatnonzero(column == i)
                    ends = np.append(0, np.cumsum(np.bincount(own[at], minlength=len(many)))).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), _signed(sigs[at])))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), _signed(set_ids(values, counts)), pa.array(many, pa.int64()), *lists], ["doc_id", "n", "set_id", "many", *names])

    kinds = ", ".join(f"{name} array<long>" for name in names)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n long, set_id long, many long, {kinds}")


def signature_rows(sets: DataFrame) -> list[DataFrame]:
    """sig, node: the signatures of all sets, in waves that share none."""
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    waves = min(COLUMNS, 1 + (known.agg(F.sum("many")).first()[0] or 0) // WAVE_ROWS)
    columns = [[F.col(f"sigs{i}") for i in range(wave, COLUMNS, waves)] for wave in range(waves)]
    return [known.select(F.explode(F.concat(*some)).alias("sig"), F.col("set_id").alias("node")) for some in columns]


def _waves(rows: DataFrame) -> list[DataFrame]:
    """The stored rows (sig, node) in waves that share no signature."""
    waves = 1 + rows.count() // WAVE_ROWS
    return [rows.filter(F.pmod(F.xxhash64("sig"), F.lit(waves)) == wave) for wave in range(waves)] if waves > 1 else [rows]


def signature_stars(waves: list[DataFrame], step: int, folder: str) -> DataFrame:
    """sig, a, b: from a hub of each signature to its other sets. Signatures are dealt by ranges of (signature, order of
    sets), so that a frequent one spreads over partitions; the hubs of the partitions' outer runs are joined afterwards.
    The waves (sig, node) share no signature."""

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None  # signature and hub of the run at hand
        out = pa.schema([("sig", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            sig, node = (batch.column(c).to_numpy() for c in ("sig", "node"))
            if not len(sig):
                continue
            if last is None:
                yield pa.RecordBatch.from_arrays([sig[:1], node[:1], node[:1]], schema=out)
            else:
                sig, node = np.append(last[0], sig), np.append(last[1], node)
            fresh = np.append(True, sig[1:] != sig[:-1])
            hub = node[np.maximum.accumulate(np.where(fresh, np.arange(len(sig)), 0))]
            hit = np.flatnonzero(hub != node)
            if len(hit):
                yield pa.RecordBatch.from_arrays([sig[hit], hub[hit], node[hit]], schema=out)
            last = (int(sig[-1]), int(hub[-1]))
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (last[0], last[1], last[1])], schema=out)

    many = int(waves[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("node") if step == 0 else F.xxhash64("node", F.lit(step))
    dealt = [rows.repartitionByRange(many, F.col("sig"), order).sortWithinPartitions(F.col("sig"), order) for rows in waves]
    found = reduce(DataFrame.union, [stored(rows.mapInArrow(stars, "sig long, a long, b long"), folder, f"runs-{step}/{wave}", batch_rows=None) for wave, rows in enumerate(dealt)])
    ends = found.filter("a = b").select("sig", "a")  # two for each partition
    joins = ends.groupBy("sig").agg(F.min("a").alias("first")).join(ends, "sig").select("sig", F.col("first").alias("a"), F.col("a").alias("b"))
    return found.union(joins).filter("a <> b")


def forest(ids: np.ndarray, link: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span the components of a symmetric matrix of links."""
    label = np.arange(len(ids))
    np.fill_diagonal(link, True)
    while True:
        low = np.where(link, label[None, :], len(ids)).min(1)
        low = low[low]
        if (low == label).all():
            break
        label = low
    tied = np.flatnonzero(label != np.arange(len(ids)))
    return ids[tied], ids[label[tied]]


def links_between(left: list[np.ndarray], right: list[np.ndarray], p: int, q: int) -> np.ndarray:
    """Which sets of one side link with which of the other; blocks of the right side keep the tables small."""
    domain = np.unique(np.concatenate(left))
    sizes = [np.array([len(x) for x in side]) for side in (left, right)]
    place = np.searchsorted(domain, np.concatenate(left))
    row = np.repeat(np.arange(len(left)), sizes[0])
    common = np.zeros((len(left), len(right)), np.int32)
    values = np.concatenate(right)
    at = np.minimum(np.searchsorted(domain, values), len(domain) - 1)
    hit = domain[at] == values
    column, at = np.repeat(np.arange(len(right)), sizes[1])[hit], at[hit]
    if len(left) == 1:
        common[0] = np.bincount(column, minlength=len(right))
    else:
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        order = np.argsort(at, kind="stable")
        column, at = column[order], at[order]
        for low in range(0, len(domain), 2048):
            a, b = np.searchsorted(place, [low, low + 2048])
            c, d = np.searchsorted(at, [low, low + 2048])
            if a < b and c < d:
                x, y = np.zeros((len(left), 2048), np.float32), np.zeros((len(right), 2048), np.float32)
                x[row[a:b], place[a:b] - low] = 1
                y[column[c:d], at[c:d] - low] = 1
                common += (x @ y.T).astype(np.int32)
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return q * common.astype(np.int64) >= p * union


class _Cell:
    """One cell at work: the sets of its first side are held, those of the second come by and are compared in portions."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q
        self.first: list[tuple[int, int, np.ndarray]] = []  # node, label, features
        self.second: list[tuple[int, int, np.ndarray]] = []
        self.held = 0

    def add(self, side: int, node: int, label: int, features: bytes) -> bool:
        """True if a portion is full."""
        (self.second if side else self.first).append((node, label, np.frombuffer(features, np.uint64)))
        self.held += len(features) // 8 if side else 0
        return self.held >= CELL or len(self.second) >= 4096

    def flush(self) -> pa.RecordBatch:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        for at in range(0, len(self.first) if self.second else 0, 512):
            first = self.first[at : at + 512]
            link = links_between([x[2] for x in first], [x[2] for x in self.second], self.p, self.q)
            link &= np.array([x[1] for x in first])[:, None] != np.array([x[1] for x in self.second])[None, :]
            some = np.flatnonzero(link.any(0))
            ids, others = (np.array([x[0] for x in side], np.int64) for side in (first, self.second))
            for low in range(0, len(some), 2048):
                portion = some[low : low + 2048]
                if len(first) == 1:
                    pairs = others[portion], np.repeat(ids, len(portion))
                else:
                    both = np.zeros((len(first) + len(portion),) * 2, bool)
                    both[: len(first), len(first) :] = link[:, portion]
                    pairs = forest(np.append(ids, others[portion]), both | both.T)
                found = [np.append(x, y) for x, y in zip(found, pairs, strict=True)]
        self.second, self.held = [], 0
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], ["a", "b"])


def set_features(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """set_id, features of the documents `ids` (doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                values, counts = shingle_sets(part.column("text").to_pylist(), width)
                data, cut = values.tobytes(), (8 * np.append(0, np.cumsum(counts))).tolist()
                cells = pa.array([data[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())
                yield pa.RecordBatch.from_arrays([_signed(set_ids(values, counts)), cells], ["set_id", "features"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi")
    return texts.select("text").mapInArrow(run, "set_id long, features binary").dropDuplicates(["set_id"])


def verified_links(docs: DataFrame, groups: DataFrame, classes: DataFrame, width: int, p: int, q: int, folder: str, name: str) -> DataFrame:
    """a, b: links that span, within each group, those between sets for which `first` holds and all others of another
    label. groups: grp, node, label, first; classes: set_id, doc_id (its least), n."""
    rows = groups.join(classes.withColumnRenamed("set_id", "node"), "node")
    rows = stored(rows, folder, f"members-{name}")
    size = rows.groupBy("grp").agg(F.coalesce(F.sum(F.when(F.col("first"), F.col("n"))), F.lit(0)).alias("nj"), F.sum("n").alias("ng"))
    size = size.select("grp", "nj", "ng", F.ceil(F.col("nj") / CELL).cast("int").alias("j"), F.ceil(F.col("ng") / CELL).cast("int").alias("g"))
    size = stored(size.filter("j > 0"), folder, f"cells-{name}")
    waves = 1 + (size.agg(F.sum(F.col("nj") * F.col("g") + F.col("ng") * F.col("j"))).first()[0] or 0) // WAVE_FEATURES
    few, size = rows.count() <= BROADCAST_IDS, size.select("grp", "j", "g")
    if size.count() <= BROADCAST_IDS:
        size = F.broadcast(size)
    placed = rows.join(size, "grp").withColumn("own", F.xxhash64("node"))
    cell = lambda many, salt: F.pmod(F.xxhash64("own", F.lit(salt)), F.col(many)).cast("int")
    every = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    first = placed.filter("first").select("grp", cell("j", 1).alias("cj"), every("g").alias("cg"), F.lit(0).alias("side"), "node", "label", "doc_id")
    second = placed.select("grp", every("j").alias("cj"), cell("g", 2).alias("cg"), F.lit(1).alias("side"), "node", "label", "doc_id")
    both = first.union(second)

    def dealt(wave: int) -> DataFrame:
        """The sets with their features in the order of the wave's cells."""
        here = both if waves == 1 else both.filter(F.pmod(F.xxhash64("grp", "cj", "cg"), F.lit(waves)) == wave)
        ids = here.select("doc_id").distinct()
        features = set_features(docs, F.broadcast(ids) if few else ids, width)
        found = here.drop("doc_id").join(features.withColumnRenamed("set_id", "node"), "node")
        return found.repartition("grp", "cj", "cg").sortWithinPartitions("grp", "cj", "cg", "side").select("grp", "cj", "cg", "side", "node", "label", "features")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, work = None, _Cell(p, q)
        for batch in batches:
            for grp, cj, cg, side, node, label, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (grp, cj, cg):
                    yield work.flush()
                    key, work = (grp, cj, cg), _Cell(p, q)
                if work.add(side, node, label, data):
                    yield work.flush()
        yield work.flush()

    return reduce(DataFrame.union, [stored(dealt(wave).mapInArrow(run, "a long, b long"), folder, f"links-{name}/{wave}") for wave in range(waves)])


def _labelled(rows: DataFrame, node: str, labels: DataFrame | None, name: str) -> DataFrame:
    """rows with the label of `node` as `name`; a node without links is its own label."""
    if labels is None:
        return rows.withColumn(name, F.col(node))
    return rows.join(labels.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def all_links(docs: DataFrame, sets: DataFrame, classes: DataFrame, width: int, p: int, q: int, folder: str) -> DataFrame:
    """a, b: links that span all components of the different sets."""
    spark = docs.sparkSession
    waves, links, labels, stars = signature_rows(sets), None, None, None
    for step in range(HUB_ROUNDS):
        stars = signature_stars(waves, step, folder)
        discard(spark, folder, "signatures")
        pairs = stars.groupBy("a", "b").agg(F.count("*").alias("shared"))
        if labels is not None:
            pairs = _labelled(_labelled(pairs, "a", labels, "la"), "b", labels, "lb").filter("la <> lb")
        hubs = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
        hubs = stored(hubs, folder, f"hubs-{step}")
        node = hubs.select(F.col("a").alias("grp"), F.col("b").alias("node"), F.lit(False).alias("first"))
        hub = hubs.select(F.col("a").alias("grp")).distinct().select("grp", F.col("grp").alias("node"), F.lit(True).alias("first"))
        groups = _labelled(node.union(hub), "node", labels, "label")
        found = verified_links(docs, groups, classes, width, p, q, folder, f"hubs-{step}")
        links = found if links is None else links.union(found)
        labels = connected_components(links, folder, f"joined-{step}")
        open_ = _labelled(_labelled(stars, "a", labels, "la"), "b", labels, "lb").filter("la <> lb").select("sig").distinct()
        # a signature's stars reach all of its sets, and most signatures are of one set, so all rows aren't joined again
        nodes = stars.select("sig", F.explode(F.array("a", "b")).alias("node")).distinct()
        rows = stored(nodes.join(open_, "sig", "left_semi"), folder, f"open-{step}")
        discard(spark, folder, f"runs-{step}", f"members-hubs-{step}", f"cells-hubs-{step}", f"hubs-{step}")
        if rows.isEmpty():
            return links
        waves = _waves(rows)
    clusters = connected_components(signature_stars(waves, HUB_ROUNDS, folder).select("a", "b"), folder, "clusters")
    members = _labelled(clusters.select(F.col("label").alias("grp"), "node"), "node", labels, "label")
    parts_ = members.groupBy("grp", "label").agg(F.count("*").alias("m"))
    largest = parts_.groupBy("grp").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.count("*").alias("parts")).filter("parts > 1")
    if largest.count() <= BROADCAST_IDS:
        largest = F.broadcast(largest)
    groups = members.join(largest, "grp").select("grp", "node", "label", (F.col("label") != F.col("largest")).alias("first"))
    found = verified_links(docs, groups, classes, width, p, q, folder, "stragglers")
    discard(spark, folder, f"runs-{HUB_ROUNDS}", *(f"open-{step}" for step in range(HUB_ROUNDS)), "members-stragglers", "cells-stragglers")
    return links.union(found)


def jaccard_components(docs: DataFrame, width: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, where q * intersection >= p * union links two documents."""
    folder = work_dir(docs.sparkSession, "jaccard")
    signed = stored(set_table(docs, width, p, q), folder, "signatures")
    sets = stored(signed.select("doc_id", "n", "set_id"), folder, "sets")
    known = sets.filter("n > 0 AND doc_id IS NOT NULL")
    classes = stored(known.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n")), folder, "classes")
    found = all_links(docs, signed, classes, width, p, q, folder)
    same = known.groupBy("doc_id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).filter("a <> b")
    extra = same.select("a", "doc_id").join(known.select("doc_id", F.col("set_id").alias("b")), "doc_id").select("a", "b")
    labels = connected_components(found.union(extra), folder, "links")
    named = classes.join(labels, classes["set_id"] == labels["node"], "left").select("set_id", "doc_id", F.coalesce("label", "set_id").alias("label"))
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_set = stored(named.join(least, "label").select("set_id", "component_id"), folder, "components")
    rows = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("set_id")).alias("set_id"))
    return rows.join(of_set, "set_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
