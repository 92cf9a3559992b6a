"""Language identification by Bayesian fusion of evidence (operator 4).

For every record the posterior of each language combines
  - the likelihood of the text's letter trigrams (naive Bayes, fitted on a bounded sample by declared language);
  - the declared language (of markup or metadata), by how often texts of each language declare it;
  - the address suffix, in the same way;
  - the host's prior: counts of the languages of its other texts, smoothed towards its domain's, that towards its
    suffix's, and that towards the whole.
All counts but the sample's are grouped aggregations over all records, and each leaves out the record that it judges.
A further class stands for languages that nobody declares: trigrams at random, with the prior BACKGROUND. A record is
rejected if no letter is in its text, if that class is likeliest, or if no language reaches MIN_CONFIDENCE.

Defined results: null and empty texts are rejected and have no language; missing evidence says nothing; a declared
language that isn't two or three letters is no evidence; a code that LEAST_TEXTS texts or more declare is a language,
however many there are, and a rarer one is none, as its model would be fitted on the very texts that it judges; without
any language every record is rejected; rows that repeat an id are judged each; other columns are
ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, work_dir
from .vectext import SPACE_CUT, gather, joined, mix64, parts, slices

#: Texts that must declare a code before it is a language.
LEAST_TEXTS = 5
#: Expected number of texts that the trigram model is fitted on, in equal shares for all languages.
TRAIN_DOCS = 8000
BUCKETS = 1 << 16
SLICE_CHARS = 1 << 20
#: A text's trigrams weigh as so many independent ones at most.
EFFECTIVE = 60.0
#: Records that a parent's shares weigh as, in the host hierarchy; pseudo-counts of the conditional shares and of buckets.
KAPPA, PSEUDO = 5.0, 0.5
BACKGROUND = 1e-4
MIN_CONFIDENCE = 0.5
#: Most counts that are broadcast; beyond it records meet them in a shuffle, hot hosts in SALTS pieces.
BROADCAST_COUNTS, SALTS = 1 << 20, 32
EVIDENCE = ("declared", "suffix", "domain", "host")


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, page_id, text and evidence of a table of documents: `lang` as declared, `source` as the address."""
    ids = [F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id")]
    return docs.select(*ids, "text", _code(F.col("lang")).alias("declared"), *_address(F.lower("source")))


def page_evidence(pages: DataFrame) -> DataFrame:
    """The same of web pages: text without tags, the language that the markup declares, and the url's host."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.regexp_extract("html", r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1)
    ids = [F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long").alias("page_id")]
    return pages.select(*ids, text.alias("text"), _code(declared).alias("declared"), *_address(host))


def _code(c: Column) -> Column:
    """Two or three letters, so that no more than 26^2 + 26^3 languages can be declared."""
    code = F.lower(F.substring_index(F.substring_index(F.trim(c), "-", 1), "_", 1))
    return F.when(code.rlike("^[a-z]{2,3}$"), code)


def _address(host: Column) -> list[Column]:
    labels = F.split(host, r"\.")
    some = F.length(host) > 0
    dotted = some & (F.size(labels) > 1)
    return [
        F.when(dotted, F.element_at(labels, -1)).alias("suffix"),
        F.when(dotted, F.concat_ws(".", F.slice(labels, -2, 2))).alias("domain"),
        F.when(some, host).alias("host"),
    ]


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code points, with everything but letters as a blank."""
    table = np.full(0x110000, 32, np.uint64)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and buckets of the trigrams of lower-cased texts that have a letter in the middle, group by group."""
    for rows, group in parts(texts, SPACE_CUT):
        _, cp, bounds = joined([x.lower() for x in group])
        if len(cp) < 1:
            continue
        own = np.repeat(np.asarray(rows), np.diff(bounds))
        mid = _letters()[cp]
        left, right = np.append(np.uint64(32), mid[:-1]), np.append(mid[1:], np.uint64(32))
        first = bounds[:-1][np.diff(bounds) > 0]
        left[first] = 32
        right[np.append(first[1:], len(cp)) - 1] = 32
        some = mid != 32
        key = mix64((left[some] << np.uint64(42)) | (mid[some] << np.uint64(21)) | right[some])
        yield own[some], (key % np.uint64(BUCKETS)).astype(np.int64)


class Trigrams(NamedTuple):
    """For each bucket, the languages whose sample has it and by how much their log share exceeds `floor`, the log share
    of a bucket that the sample lacks."""

    first: np.ndarray  # of each bucket in the two arrays below, with their end
    language: np.ndarray
    excess: np.ndarray
    floor: np.ndarray


def fit(records: DataFrame) -> tuple[list[str], Trigrams | None]:
    """Languages, and their trigram model."""
    declared = records.filter("declared IS NOT NULL AND length(text) > 0")
    counts = {r.declared: r["count"] for r in declared.groupBy("declared").count().filter(F.col("count") >= LEAST_TEXTS).collect()}
    languages = sorted(counts)
    if not languages:
        return [], None
    scale = 1 << 30
    shares = [(k, i, min(scale, int(scale * TRAIN_DOCS / len(counts) / counts[k]))) for i, k in enumerate(languages)]
    wanted = F.broadcast(records.sparkSession.createDataFrame(shares, "declared string, k int, share long"))
    drawn = F.pmod(F.xxhash64("doc_id", "page_id"), F.lit(scale)) < F.col("share")
    sample = declared.join(wanted, "declared").filter(drawn).select("k", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE_CHARS):
                language = part.column("k").to_numpy().astype(np.int64)
                for row, bucket in trigrams(part.column("text").to_pylist()):
                    at, n = np.unique(bucket * len(languages) + language[row], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    rows = sample.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    found = rows.orderBy("at").toArrow()  # what the bounded sample holds
    at, n = found.column("at").to_numpy(), found.column("n").to_numpy()
    bucket, language = at // len(languages), at % len(languages)
    whole = np.bincount(language, n, len(languages)) + PSEUDO * BUCKETS
    first = np.searchsorted(bucket, np.arange(BUCKETS + 1))
    return languages, Trigrams(first, language.astype(np.int32), np.log((n + PSEUDO) / PSEUDO).astype(np.float32), np.log(PSEUDO / whole))


def log_likelihoods(texts: list[str | None], model: Trigrams) -> tuple[np.ndarray, np.ndarray]:
    """Tempered log-likelihood of each text under each language and, last, at random; and the texts' letters."""
    n, size = len(texts), len(model.floor)
    total, letters = np.zeros(n * size), np.zeros(n, np.int64)
    for row, bucket in trigrams(texts):
        letters += np.bincount(row, minlength=n)
        key, times = np.unique(row * BUCKETS + bucket, return_counts=True)
        bucket = key % BUCKETS
        many = model.first[bucket + 1] - model.first[bucket]
        at = gather(np.arange(len(model.language)), model.first[bucket], many)
        place = np.repeat(key // BUCKETS * size, many) + model.language[at]
        total += np.bincount(place, model.excess[at] * np.repeat(times, many), n * size)
    ll = np.column_stack([total.reshape(n, size) + letters[:, None] * model.floor, -letters * np.log(BUCKETS)])
    return ll * (np.minimum(letters, EFFECTIVE) / np.maximum(letters, 1))[:, None], letters


def text_scores(records: DataFrame, model: Trigrams) -> DataFrame:
    """The evidence with `ll` (see log_likelihoods), `letters`, and `best`, the language that the text alone speaks for."""
    told = records.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "page_id", *EVIDENCE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = told.value
        size = len(model.floor) + 1
        step = max(1, (1 << 20) // size)  # texts at once
        for batch in batches:
            for whole in slices(batch, "text", SLICE_CHARS):
                for at in range(0, whole.num_rows, step):
                    part = whole.slice(at, step)
                    ll, letters = log_likelihoods(part.column("text").to_pylist(), model)
                    lists = pa.ListArray.from_arrays(pa.array((np.arange(len(ll) + 1) * size).astype(np.int32)), pa.array(ll.ravel()))
                    unknown = (letters == 0) | (ll[:, -1] + np.log(BACKGROUND) > ll[:, :-1].max(1))
                    best = pa.array(ll[:, :-1].argmax(1).astype(np.int32), mask=unknown)
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), lists, pa.array(letters), best], [*names, "ll", "letters", "best"])

    schema = "doc_id long, page_id long, declared string, suffix string, domain string, host string, ll array<double>, letters long, best int"
    return records.select(*names, "text").mapInArrow(run, schema)


def _counts(rows: DataFrame, by: str, size: int, folder: str) -> DataFrame:
    """For each value of `by`, the number of its texts of each language."""
    each = rows.filter(F.col(by).isNotNull() & F.col("best").isNotNull()).groupBy(by, "best").count()
    tally = F.map_from_entries(F.collect_list(F.struct("best", F.col("count").cast("double"))))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.coalesce(F.col("tally")[k], F.lit(0.0)))
    return stored(each.groupBy(by).agg(tally.alias("tally")).select(by, dense.alias(f"of_{by}")), folder, f"by-{by}")


def _with_counts(rows: DataFrame, counts: DataFrame, by: str, many: int, size: int) -> DataFrame:
    if many * size <= BROADCAST_COUNTS:
        return rows.join(F.broadcast(counts), by, "left")
    wide = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(wide, [by, "salt"], "left").drop("salt")


def identify(records: DataFrame) -> DataFrame:
    """doc_id, page_id, declared, text_lang, lang, confidence and accepted of every record of `document_evidence`,
    `page_evidence` or the union of both."""
    folder = work_dir(records.sparkSession, "languages")
    languages, model = fit(records)
    size = len(languages)
    if not size:
        none = F.lit(None).cast("string")
        return records.select("doc_id", "page_id", "declared", none.alias("text_lang"), none.alias("lang"), F.lit(0.0).alias("confidence"), F.lit(False).alias("accepted"))
    rows = stored(text_scores(records, model), folder, "scores")
    total = [0.0] * size
    for r in rows.filter("best IS NOT NULL").groupBy("best").count().collect():
        total[r.best] = float(r["count"])
    full, values = rows, {}
    for by in EVIDENCE:
        counts = _counts(rows, by, size, folder)
        values[by] = counts.count()
        full = _with_counts(full, counts, by, values[by], size)
    array = lambda xs: F.array(*(F.lit(x) for x in xs))
    lang = F.sequence(F.lit(0), F.lit(size - 1))
    own = lambda k: F.when(F.col("best") == k, 1.0).otherwise(0.0)

    def smoothed(tally: Column, many: Column, parent: Column):
        return lambda k: (F.get(tally, k) - own(k) + KAPPA * F.get(parent, k)) / (many + KAPPA)

    prior = array([(x + PSEUDO) / (sum(total) + PSEUDO * size) for x in total])
    for by in ("suffix", "domain", "host"):  # each level without the record itself
        tally = F.col(f"of_{by}")
        many = F.aggregate(tally, F.lit(0.0), lambda a, x: a + x) - F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)
        prior = F.when(tally.isNotNull(), F.transform(lang, smoothed(tally, many, prior))).otherwise(prior)
        full = full.withColumn(f"prior_{by}", prior)
        prior = F.col(f"prior_{by}")

    def conditional(by: str, k: Column) -> Column:
        """log P(value of `by` | language k), without the record itself."""
        of_language = F.get(array(total), k)
        return F.coalesce(F.log((F.get(F.col(f"of_{by}"), k) - own(k) + PSEUDO) / (of_language - own(k) + PSEUDO * (values[by] + 1))), F.lit(0.0))

    known = F.transform(lang, lambda k: F.get("ll", k) + F.log(F.get("prior_host", k)) + conditional("declared", k) + conditional("suffix", k))
    unknown = F.get("ll", F.lit(size)) + float(np.log(BACKGROUND))
    for by in ("declared", "suffix"):
        unknown = unknown - F.when(F.col(f"of_{by}").isNotNull(), float(np.log(values[by] + 1))).otherwise(0.0)
    full = full.withColumn("log", F.array_append(known, unknown))
    top = F.array_max("log")
    share = 1 / F.aggregate("log", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    name = lambda k: F.get(array(languages), k)  # noqa: E731  beyond the languages: null
    some = F.col("letters") > 0
    full = full.withColumn("confidence", F.when(some, share).otherwise(0.0)).withColumn("lang", F.when(some, name((F.array_position("log", top) - 1).cast("int"))))
    accepted = F.col("lang").isNotNull() & (F.col("confidence") >= MIN_CONFIDENCE)
    return full.select("doc_id", "page_id", "declared", name(F.col("best")).alias("text_lang"), "lang", "confidence", accepted.alias("accepted"))
