"""The folder that driver and executors share, and cutting lineage there."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def work_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset a folder in the warehouse, or in one process (tests) a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext._jsc.sc().isLocal():
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/geoquilt-work"
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="geoquilt-"))
    return _OWN[0]


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed in the work folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint()


def dropped(spark: SparkSession, folder: str) -> None:
    """Deletes a folder that this package made in the work folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for jobs that run within."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of `rows` rows at most for jobs that run within: for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
