"""Total orders of point sets, and ranks in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dequantised, morton_encode, quantised
from ..sources.work import cut

_ROWS = 250_000  # of a partition


def ranked(points: DataFrame, *keys: Column | str, n: int | None = None) -> DataFrame:
    """points with a 0-based rank by keys, which must be distinct; null and NaN keys have the places Spark's sort gives them.

    Rows are dealt by ranges of the keys, numbered in their partition, checkpointed (so both readings see the same
    partitions), and raised by the counts of the partitions before.
    """
    n = points.count() if n is None else n
    spark = points.sparkSession
    placed = points.repartitionByRange(max(2, -(-n // _ROWS)), *keys).sortWithinPartitions(*keys).withColumn("mid", F.monotonically_increasing_id())
    placed = cut(placed)
    counts = placed.groupBy(F.shiftright("mid", 33).alias("part")).count().orderBy("part").collect()  # a row for each partition
    table, before = [], 0
    for x in counts:
        table.append((x["part"], before))
        before += x["count"]
    offsets = spark.createDataFrame(table, "part long, before long")
    placed = placed.withColumn("part", F.shiftright("mid", 33)).join(F.broadcast(offsets), "part")
    return placed.withColumn("rank", F.col("before") + F.col("mid").bitwiseAND((1 << 33) - 1)).drop("part", "before", "mid")


def morton_code(points: DataFrame, rescale: bool) -> DataFrame:
    """points with their Morton code; rescale maps the bounding box to the unit square first (for other domains)."""
    if not rescale:
        return points.withColumn("code", morton_encode(quantised(F.col("x")), quantised(F.col("y"))))
    box = points.agg(*[f(c).alias(f"{k}_{c}") for c in "xy" for k, f in (("low", F.min), ("high", F.max))]).first()
    unit = lambda c: (F.col(c) - (box[f"low_{c}"] or 0.0)) / (((box[f"high_{c}"] or 0.0) - (box[f"low_{c}"] or 0.0)) or 1.0)
    return points.withColumn("code", morton_encode(quantised(unit("x")), quantised(unit("y"))))


def ordered(points: DataFrame, order: str = "morton", quantise: bool = False, rescale: bool = False, seed: int = 42) -> DataFrame:
    """(rank, id, x, y, z) in Morton order, shuffled by a hash of id and seed, or by id ("none").

    Ties go by id. quantise replaces coordinates by those of the Morton code (not with rescale, where they mean other things).
    """
    columns = ["rank", "id", "x", "y", "z"]
    if order == "morton":
        coded = morton_code(points, rescale)
        if quantise and not rescale:
            coded = coded.withColumn("x", dequantised(quantised(F.col("x")))).withColumn("y", dequantised(quantised(F.col("y"))))
        return ranked(coded, "code", "id").select(*columns)
    if order == "random":
        mixed = points.withColumn("h", F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")))
        return ranked(mixed, "h", "id").select(*columns)
    if order == "none":
        return ranked(points, "id").select(*columns)
    raise ValueError("order must be morton, random or none")
