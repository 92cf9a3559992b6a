"""Folders that the driver and every executor can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.written import shuffles_dropped


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or under the checkpoint folder that the context was given."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = current.get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows of texts that go to a Python worker at once while a table is written; the setting of the session would let
#: batches take tens of megabytes on both sides.
TEXT_ROWS = 1000
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def stored(frame: DataFrame, folder: str, name: str, batch_rows: int | None = TEXT_ROWS) -> DataFrame:
    """Writes the frame once and returns the table that was written, which cuts its lineage. batch_rows: most rows of an
    Arrow batch meanwhile; None leaves the session's setting (for narrow rows)."""
    path = f"{folder}/{name}"
    conf = frame.sparkSession.conf
    before = conf.get(_ROWS)
    if batch_rows and not 0 < int(before) <= batch_rows:
        conf.set(_ROWS, str(batch_rows))
    try:
        with shuffles_dropped(frame.sparkSession):
            frame.write.parquet(path)
    finally:
        conf.set(_ROWS, before)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def unused(columns: list[str], name: str) -> str:
    """The name, or one made longer until no column has it (Spark compares names without regard to case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def discard(spark: SparkSession, folder: str, *names: str) -> None:
    """Deletes stored tables that no later step reads, so that disk is held for the tables at hand alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        path.getFileSystem(conf).delete(path, True)
