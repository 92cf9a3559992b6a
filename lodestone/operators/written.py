"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A folder under spark.checkpoint.dir, or under the checkpoint folder that the context was given. Where neither is set,
    a session whose tasks run in the driver gets a folder of its own; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not re.match(r"local(\[|$)", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lodestone-"))
        current = context._jsc.sc().getCheckpointDir()
        base = current.get()
    return f"{base.rstrip('/')}/{name}"


#: Whether Spark removes the shuffle files of a query as soon as it ends, and not when the driver collects garbage.
_DROPPED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is run meanwhile leaves no shuffle files: for tables that are written once and read from then on."""
    before = spark.conf.get(_DROPPED, None)
    spark.conf.set(_DROPPED, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROPPED) if before is None else spark.conf.set(_DROPPED, before)


def written(frame: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The frame as a table written to the shared folder, which cuts its lineage. by: the column whose values have files of
    their own, so that a filter by it reads no others."""
    path = folder(frame.sparkSession, f"{name}-{uuid.uuid4().hex}")
    with shuffles_dropped(frame.sparkSession):
        (frame.write.partitionBy(by) if by else frame.write).parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def removed(spark: SparkSession, name: str) -> None:
    """Deletes a folder of written tables that no later step reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder(spark, name))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """The frame with new columns that are made once a row. Spark puts a plain column's expression in each place that reads it,
    filters too, so that a costly one is made many times; what a generator passes on is only read."""
    made = frame.withColumns({f"__{name}": c for name, c in columns.items()})
    return made.select(*frame.columns, F.inline(F.array(F.struct(*(F.col(f"__{name}").alias(name) for name in columns)))))
