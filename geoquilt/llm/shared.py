"""Working tables in the shared folder, Arrow helpers and connected components."""

from __future__ import annotations

import ctypes
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.work import work_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut and a lost executor costs only a reread."""
    path = f"{work_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of written() that nothing unwritten reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._written_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Tables:
    """Working tables of one computation, deleted together when its result is written."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.held.append(written(df, name))
        return self.held[-1]

    def kept(self, df: DataFrame) -> DataFrame:
        """A table that is small against the input, in few files."""
        return self.written(few_files(df), "kept")

    def discard(self) -> None:
        for table in self.held:
            discard(table)
        self.held = []


_PART_BYTES = 128 << 20


def bytes_read(df: DataFrame) -> int | None:
    """Bytes of the stored tables that df reads, as Spark's statistics have them; None where one is of unknown size."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return None if any(x >= 1 << 62 for x in sizes) else sum(sizes)


def most_partitions(df: DataFrame, per_core: int = 2) -> int | None:
    """Partitions that df needs at most: one for each 128 MB that it reads, and so many a core at least; None if unknown."""
    size = bytes_read(df)
    return None if size is None else max(per_core * df.sparkSession.sparkContext.defaultParallelism, -(-size // _PART_BYTES))


def few_files(df: DataFrame, per_core: int = 2) -> DataFrame:
    """df in most_partitions() partitions, as on some file systems each file costs a process. A task's share of the input
    stays about 128 MB however much there is. Parts that meet in one task follow each other there, so none needs more memory."""
    most = most_partitions(df, per_core)
    return df if most is None else df.coalesce(min(most, (1 << 31) - 1))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of `rows` rows at most for what runs within, unless the session names another number than the default."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    if before == "10000":
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of whole texts hold `rows` rows at most, unless the session names another number than the default:
    with 10,000 long texts a batch takes several times its bytes in the JVM and again in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def give_back() -> None:
    """What Arrow and the C library hold free goes back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
        if trim:
            trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f for mapInArrow, after which its worker gives memory back: workers serve many tasks, and else keep the most that any took."""

    @wraps(f)
    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    offsets = offsets.astype(np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs(offsets: np.ndarray, most: int):
    """Cut documents into runs of about `most` bytes (one document at least): pairs of document numbers."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, last
        first = last


def splittable(sums: DataFrame) -> DataFrame:
    """A grouped result dealt out anew, so that a join with it has an exchange of its own on both sides. Then adaptive
    execution can split a hot key's rows on the other side, which it can't where the group's own exchange is used again."""
    return sums.repartition(sums.sparkSession.sparkContext.defaultParallelism)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of links (a, b) of longs: rows (node, component), component being its smallest node.

    Alternates large-star and small-star steps (Kiveris et al.), each a grouped minimum and an equi-join,
    until nothing changes; every step is written, so no lineage grows. Nodes without a link are not returned.
    """
    e = written(few_files(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()), "edges")

    def tally(frame: DataFrame) -> tuple:
        return tuple(frame.agg(F.count("*"), F.sum(F.col("u") % 1000003), F.sum(F.col("v") % 1000003), F.sum(F.xxhash64("u", "v") % 1000003)).first())

    before = tally(e)
    while before[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = splittable(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        held, large = e, written(few_files(large.distinct()), "large")
        low = splittable(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v")))
        e = written(few_files(small.distinct()), "small")
        discard(held)
        discard(large)
        after = tally(e)
        if after == before:
            break
        before = after
    nodes = e.groupBy("u").agg(F.min("v").alias("v"))
    return nodes.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
