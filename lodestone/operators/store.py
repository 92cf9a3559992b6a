"""A table of chunks that is overwritten a document at a time, with versions, uniqueness rules and edits.

    store = ChunkStore(spark, folder)
    store.overwrite(chunks, batch="upload-7")   # the documents of `chunks` have these chunks from now on
    store.edit(edits, provider)                 # keywords and questions of single chunks; only what changed is embedded
    store.read()

Each write is a version: its rows are staged in a folder of their own, partitioned by kb_id, then the rules are checked,
and only then the manifest tells which documents the version holds. A reader takes each document's rows from its newest
version in the manifest, so a write that failed, or was repeated by a lost driver, is never seen in part. A batch that the
manifest knows isn't written again. Rows are matched by keys that spread; nothing is collected but counts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import cleaned_terms, keyword_text
from .embedding import Provider, with_embeddings
from .written import written

#: Columns that no two rows may share, each set a rule of its own; a null in one of them breaks the rule as well.
RULES = (("chunk_uid",), ("document_id", "chunk_index"))
#: Most documents of the manifest that are broadcast; fixed values: terms kept of an edit, and sources that aren't edited.
BROADCAST_DOCUMENTS, KEYWORDS, QUESTIONS, FIXED_SOURCES = 500_000, 12, 5, ("lightrag", "graph")


class RuleError(ValueError):
    """A write was refused; `table` holds the broken rules: rule, key (JSON) and n, how many rows share it."""

    def __init__(self, message: str, table: str):
        super().__init__(message)
        self.table = table


class ChunkStore:
    """Chunks in `folder` (kb_id, document_id, chunk_index, chunk_uid, content, keyword_text, embedding and what else)."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[tuple[str, ...], ...] = RULES):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def manifest(self) -> DataFrame:
        """document_id, chunks, batch, version of every write that counted."""
        if not self._exists("manifest"):
            return self.spark.createDataFrame([], "document_id long, chunks long, batch string, version int")
        return self.spark.read.schema("document_id long, chunks long, batch string, version int").parquet(f"{self.folder}/manifest")

    def _newest(self) -> DataFrame:
        newest = W.partitionBy("document_id").orderBy(F.desc("version"))
        rows = self.manifest().withColumn("__place", F.row_number().over(newest)).filter("__place = 1").select("document_id", "version", "chunks")
        return rows

    def read(self) -> DataFrame:
        """The chunks of all documents, each of its newest version, with `version`."""
        newest = self._newest().filter("chunks > 0").drop("chunks")
        known = [r.version for r in newest.select("version").distinct().collect()]  # a row for each write
        if not known:
            raise ValueError("nothing is stored yet")
        rows = self.spark.read.option("basePath", f"{self.folder}/data").parquet(*(f"{self.folder}/data/version={v}" for v in known))
        rows = rows.withColumns({"kb_id": F.col("kb_id").cast("long"), "version": F.col("version").cast("int")})
        if newest.count() <= BROADCAST_DOCUMENTS:
            newest = F.broadcast(newest)
        return rows.join(newest, ["document_id", "version"])

    def overwrite(self, chunks: DataFrame, batch: str | None = None) -> int:
        """Replaces the chunks of the documents that `chunks` names; returns the version. Raises RuleError, and changes
        nothing, if the documents would break a rule, among themselves or with the others."""
        done = self.manifest().agg(F.max("version").alias("last"), F.max(F.when(F.col("batch") == batch, F.col("version"))).alias("same")).first()
        if batch is not None and done.same is not None:
            return done.same
        version = (done.last or 0) + 1
        data = f"{self.folder}/data/version={version}"
        keys = sorted({c for rule in self.rules for c in rule})
        seen = Observation(f"version-{version}")
        broken = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in keys]
        told = chunks.drop("version").withColumn("kb_id", F.col("kb_id").cast("long")).observe(seen, F.count("*").alias("rows"), *broken)
        told.write.mode("overwrite").partitionBy("kb_id").parquet(data)
        staged = self.spark.read.parquet(data)
        missing = sum(v for name, v in seen.get.items() if name.startswith("null_"))
        found = self._violations(staged) if missing or self.rules else None
        if found is not None:
            table = f"{self.folder}/violations/version={version}"
            found.write.mode("overwrite").parquet(table)
            many = self.spark.read.schema(found.schema).parquet(table).count()
            if many:
                raise RuleError(f"{many} keys break a rule, in {seen.get['rows']} rows", table)
        held = staged.groupBy(F.col("document_id").cast("long").alias("document_id")).agg(F.count("*").alias("chunks"))
        held.withColumn("batch", F.lit(batch).cast("string")).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        return version

    def _violations(self, staged: DataFrame) -> DataFrame:
        """rule, key, n: keys that several rows of the new version share, that a row of another document has, or null ones."""
        others = None
        if not self._newest().filter("chunks > 0").isEmpty():
            others = self.read().join(staged.select("document_id").distinct(), "document_id", "left_anti")
        found = []
        for rule in self.rules:
            mine = staged.groupBy(*rule).agg(F.count("*").alias("n"))
            if others is not None:
                mine = mine.join(others.select(*rule).distinct().withColumn("__held", F.lit(1)), list(rule), "left").withColumn("n", F.col("n") + F.coalesce("__held", F.lit(0)))
            nulls = F.greatest(*(F.col(c).isNull() for c in rule), F.lit(False))
            found.append(mine.filter((F.col("n") > 1) | nulls).select(F.lit(",".join(rule)).alias("rule"), F.to_json(F.struct(*rule), {"ignoreNullFields": "false"}).alias("key"), "n"))
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        return every

    def remove(self, documents: DataFrame) -> int:
        """From now on the documents (document_id) have no chunks; their versions stay in the folder."""
        last = self.manifest().agg(F.max("version")).first()[0] or 0
        gone = documents.select(F.col("document_id").cast("long").alias("document_id")).distinct()
        gone.select("document_id", F.lit(0).cast("long").alias("chunks"), F.lit(None).cast("string").alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/manifest/version={last + 1}")
        return last + 1

    def append_vectors(self, vectors: DataFrame, batch: str | None = None) -> int:
        """Writes vectors (chunk_uid, embedding) beside the chunks that they belong to, as a version of their documents."""
        now = self.read().drop("version", "embedding")
        touched = now.join(now.join(vectors.select("chunk_uid"), "chunk_uid", "left_semi").select("document_id").distinct(), "document_id", "left_semi")
        kept = self.read()
        old = kept.select("chunk_uid", F.col("embedding").alias("__old")) if "embedding" in kept.columns else kept.select("chunk_uid", F.lit(None).cast("array<double>").alias("__old"))
        fresh = vectors.select("chunk_uid", F.col("embedding").cast("array<double>").alias("__new"))
        rows = touched.join(old, "chunk_uid", "left").join(fresh, "chunk_uid", "left")
        return self.overwrite(rows.withColumn("embedding", F.coalesce("__new", "__old")).drop("__new", "__old"), batch)

    def edit(self, edits: DataFrame, provider: Provider, batch: str | None = None) -> int:
        """Sets keywords and questions (chunk_uid, keywords, questions) of chunks, whose keyword text and, where that
        changed, vector follow. Edits of chunks that aren't stored, or whose source isn't edited, have no effect. Of
        several edits of a chunk the one with the greatest keywords counts."""
        now = self.read().drop("version")
        place = W.partitionBy("chunk_uid").orderBy(F.desc("keywords"), F.desc("questions"))
        one = edits.withColumn("__place", F.row_number().over(place)).filter("__place = 1")
        one = one.select("chunk_uid", cleaned_terms(F.col("keywords"), KEYWORDS).alias("__k"), cleaned_terms(F.col("questions"), QUESTIONS).alias("__q"))
        if "source" in now.columns:
            one = one.join(now.filter(F.col("source").isin(*FIXED_SOURCES)).select("chunk_uid"), "chunk_uid", "left_anti")
        one = written(one, "edits")
        documents = now.join(one, "chunk_uid", "left_semi").select("document_id").distinct()
        rows = now.join(documents, "document_id", "left_semi").join(one, "chunk_uid", "left")
        told = F.when(F.col("__k").isNotNull(), keyword_text(F.coalesce("content", F.lit("")), F.col("__k"), F.coalesce("__q", F.array().cast("array<string>")))).otherwise(F.col("keyword_text"))
        rows = rows.withColumn("__text", told).withColumn("__changed", ~F.col("__text").eqNullSafe(F.col("keyword_text")))
        rows = written(rows.withColumn("keyword_text", F.col("__text")).drop("__text", "__k", "__q"), "edited")  # read for both halves
        same = rows.filter("NOT __changed").drop("__changed")
        fresh = with_embeddings(rows.filter("__changed").drop("__changed", "embedding"), "keyword_text", provider)
        return self.overwrite(same.unionByName(fresh.withColumn("embedding", F.col("embedding").cast(dict(same.dtypes)["embedding"]))), batch)


def broken_rules(spark: SparkSession, error: RuleError) -> list[tuple[str, dict, int]]:
    """The first hundred broken rules of an error, for a message."""
    return [(r.rule, json.loads(r.key), r.n) for r in spark.read.parquet(error.table).orderBy("rule", "key").limit(100).collect()]
