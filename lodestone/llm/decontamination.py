"""Benchmark decontamination with a positional inverted index (operator 1), in DataFrame operations alone.

The index is a stored table of postings (row, term, position) of the training texts for every term that a test item
uses, with one closing posting per text, which holds its length. Each test window is looked up from its rarest terms:
the posting lists of the two rarest, shifted by the terms' offsets, are intersected, and what remains is intersected
with the lists of all other terms of the window, read for the rows still in question only.

Defined results: a null or empty text has no words and no hits, an item without words no windows; an item of fewer
words than the window is one window; rows that repeat a doc_id are texts of their own, repeated items count once by
item_id; a null item_id marks hits but is in no list of items; an empty table on either side gives no hits; other
columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import discard, stored, work_dir

#: The pattern of a word, and the letters that are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Posting lists that find the candidates; the others confirm them.
RAREST = 2
#: Most rows of a test-side table, or row ids, that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS, SALTS = 1_000_000, 16
#: How far from its place a term may stand in a loose match.
SLOP = 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _met(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join of rows, of which a frequent key may hold many, with a test-side table: broadcast, or else dealt in SALTS
    pieces of each key."""
    if few.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key, how)
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "salt"], how).drop("salt")


def window_terms(items: DataFrame, size: int, folder: str) -> tuple[DataFrame, DataFrame]:
    """The test terms (term, term_id) and the windows' terms (window, item_id, length, offset, term_id)."""
    split = items.select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0).distinct()
    terms = split.select(F.explode("w").alias("term")).union(split.sparkSession.createDataFrame([("",)], "term string")).distinct()
    terms = stored(terms.select("term", F.when(F.col("term") == "", -1).otherwise(F.monotonically_increasing_id()).alias("term_id")), folder, "terms")
    starts = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0)))).alias("at")
    windows = split.select("item_id", "w", starts).select("item_id", F.slice("w", F.col("at") + 1, size).alias("w"))
    windows = stored(windows.distinct().withColumn("window", F.monotonically_increasing_id()), folder, "windows")
    spread = windows.select("window", "item_id", F.size("w").alias("length"), F.posexplode("w").alias("offset", "term"))
    return terms, stored(_met(spread, terms, "term").drop("term"), folder, "window-terms")


def build_index(docs: DataFrame, terms: DataFrame, folder: str) -> DataFrame:
    """Stores the postings row, doc_id, position, term_id; the closing posting of a text has term_id -1."""
    split = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    postings = split.select("row", "doc_id", F.posexplode(F.array_append("w", F.lit(""))).alias("position", "term"))
    return stored(_met(postings, terms, "term").select("row", "doc_id", "position", "term_id"), folder, "postings")


def ranked_terms(index: DataFrame, spread: DataFrame, folder: str) -> DataFrame:
    """The windows' terms with their rank in the window, the rarest in training first; windows with a term that
    training lacks are left out, as they can't occur."""
    often = index.groupBy("term_id").count()
    window = W.partitionBy("window")
    often = stored(often, folder, "term-counts")
    ranked = _met(spread, often, "term_id", "left").withColumn("lacks", F.max(F.col("count").isNull()).over(window)).filter("NOT lacks")
    ranked = ranked.withColumn("rank", F.row_number().over(window.orderBy("count", "offset")))
    return stored(ranked.select("window", "item_id", "length", "offset", "term_id", "rank"), folder, "ranked-terms")


def _list(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Posting lists shifted by the terms' offsets: window, row, start."""
    shifted = _met(index, terms.select("window", "length", "offset", "rank", "term_id"), "term_id")
    return shifted.select("window", "length", "rank", "row", (F.col("position") - F.col("offset")).alias("start"))


def _candidate_postings(index: DataFrame, candidates: DataFrame) -> DataFrame:
    return index.join(_small(candidates.select("row").distinct()), "row", "left_semi").select("row", "position", "term_id")


def phrase_matches(index: DataFrame, ranked: DataFrame, lists: DataFrame, folder: str) -> DataFrame:
    """window, row, start, length of every exact occurrence. lists: the posting lists of the rarest terms."""
    first = lists.filter("start >= 0")
    met = first.groupBy("window", "row", "start").agg(F.first("length").alias("length"), F.count("*").alias("met"))
    met = stored(met.filter(F.col("met") == F.least("length", F.lit(RAREST))).drop("met"), folder, "candidates")
    rest = ranked.filter(F.col("rank") > RAREST).select("window", "offset", "term_id")
    asked = met.join(_small(rest), "window").select("window", "row", "start", (F.col("start") + F.col("offset")).alias("position"), "term_id")
    found = asked.join(_candidate_postings(index, met), ["row", "position", "term_id"]).groupBy("window", "row", "start").agg(F.count("*").alias("met"))
    full = met.join(found, ["window", "row", "start"], "left")
    return full.filter(F.coalesce("met", F.lit(0)) == F.greatest(F.col("length") - RAREST, F.lit(0))).drop("met")


def proximity_matches(index: DataFrame, ranked: DataFrame, lists: DataFrame, slop: int, folder: str) -> DataFrame:
    """window, row of the texts in which every term of the window stands at most `slop` places away from where the
    rarest one puts it. The two rarest terms' lists give the candidates; the postings of the other terms are read in
    their rows alone. Places meet in buckets, so that a term that fills a text costs no more than its neighbours."""
    wide = slop + 1
    near = lambda c: F.explode(F.sequence(F.floor(F.col(c) / wide) - 1, F.floor(F.col(c) / wide) + 1))
    place = lambda c: F.floor(F.col(c) / wide)
    anchor = lists.filter("rank = 1").select("window", "row", "length", F.col("start").alias("anchor"))
    second = lists.filter("rank = 2").select("window", "row", "start", place("start").alias("bucket"))
    pairs = anchor.filter("length > 1").withColumn("bucket", near("anchor")).join(second, ["window", "row", "bucket"])
    pairs = pairs.filter(F.abs(F.col("start") - F.col("anchor")) <= slop).select("window", "row", "length", "anchor").distinct()
    pairs = stored(pairs, folder, "near-candidates")
    rest = ranked.filter(F.col("rank") > RAREST).select("window", "offset", "term_id")
    asked = pairs.join(_small(rest), "window").withColumn("wanted", F.col("anchor") + F.col("offset")).withColumn("bucket", near("wanted"))
    postings = _candidate_postings(index, pairs).withColumn("bucket", place("position"))
    found = asked.join(postings, ["row", "term_id", "bucket"]).filter(F.abs(F.col("position") - F.col("wanted")) <= slop)
    found = found.groupBy("window", "row", "anchor").agg(F.countDistinct("offset").alias("met"))
    full = pairs.join(found, ["window", "row", "anchor"], "left").filter(F.coalesce("met", F.lit(0)) == F.greatest(F.col("length") - RAREST, F.lit(0)))
    return full.select("window", "row").union(anchor.filter("length = 1").select("window", "row")).distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near_items (items with a window that stands in the
    text loosely, exact occurrences among them) of every text."""
    folder = work_dir(docs.sparkSession, "decontamination")
    terms, spread = window_terms(items, size, folder)
    index = build_index(docs, terms, folder)
    ranked = ranked_terms(index, spread, folder)
    lists = stored(_list(index, ranked.filter(F.col("rank") <= RAREST)), folder, "lists")
    matches = stored(phrase_matches(index, ranked, lists, folder), folder, "matches")
    loose = stored(proximity_matches(index, ranked, lists, SLOP, folder), folder, "loose")
    before = W.partitionBy("row").orderBy("start", "length").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    spans = matches.select("row", "start", "length").distinct().withColumn("past", F.coalesce(F.max(end).over(before), F.lit(0)))
    hits = spans.groupBy("row").agg(F.sum(F.greatest(end - F.greatest("start", "past"), F.lit(0))).alias("n_hit"))
    owner = ranked.select("window", F.col("item_id").cast("string").alias("item")).distinct()
    found = matches.join(_small(owner), "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    texts = stored(index.filter("term_id = -1").select("row", "doc_id", F.col("position").cast("long").alias("n_words")), folder, "texts")
    discard(docs.sparkSession, folder, "postings", "candidates", "near-candidates", "lists")
    near = loose.join(_small(owner), "window").groupBy("row").agg(F.countDistinct("item").alias("n_near"))
    full = texts.join(hits, "row", "left").join(found, "row", "left").join(near, "row", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return full.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items_of), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).alias("n_near_items"),
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, w[s + 1 : s + least(10, len(w))] AS g FROM (SELECT item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS l FROM iw),
dw AS (SELECT doc_id, s, l, w[s + 1 : s + l] AS g FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS s FROM d, sizes WHERE len(w) >= l)),
m AS (SELECT dw.doc_id, dw.s, dw.l, iw.item_id FROM dw JOIN iw ON dw.g = iw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + l)) AS p FROM m) GROUP BY doc_id),
o AS (SELECT term, count(*) AS c FROM (SELECT unnest(w) AS term FROM d) GROUP BY term),
wt AS (SELECT item_id, g, i - 1 AS off, g[i] AS term, len(g) AS l FROM (SELECT item_id, g, unnest(range(1, len(g) + 1)) AS i FROM (SELECT min(item_id) AS item_id, g FROM iw GROUP BY g))),
wr AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c, off) AS rank FROM wt JOIN o USING (term) WHERE g NOT IN (SELECT g FROM wt WHERE term NOT IN (SELECT term FROM o))),
ps AS (SELECT doc_id, i - 1 AS p, w[i] AS term FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
an AS (SELECT doc_id, g, l, p - off AS a FROM ps JOIN wr USING (term) WHERE rank = 1),
a2 AS (SELECT DISTINCT an.* FROM an JOIN wr ON wr.g = an.g AND (rank = 2 OR an.l = 1) LEFT JOIN ps ON ps.doc_id = an.doc_id AND ps.term = wr.term WHERE an.l = 1 OR abs(p - off - a) <= 2),
nr AS (SELECT a2.doc_id, a2.g FROM a2 JOIN wr ON wr.g = a2.g JOIN ps ON ps.doc_id = a2.doc_id AND ps.term = wr.term AND abs(p - off - a) <= CASE WHEN rank = 1 THEN 0 ELSE 2 END GROUP BY a2.doc_id, a2.g, a2.a, a2.l HAVING count(DISTINCT off) = a2.l),
nn AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM nr JOIN iw USING (g) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN nn USING (doc_id)
"""
