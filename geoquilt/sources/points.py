"""Point sets: synthetic grids, text files, and views of event and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import hash_uniform, uniform
from ..operators.ordering import ordered


def grid_locations(spark: SparkSession, n: int, seed: int = 0, jitter: float = 0.4) -> DataFrame:
    """n points of a jittered square grid in (0, 1), with z = 0, as (id, x, y, z); the jitter is a hash of seed, id and axis."""
    side = int(n**0.5)
    side += side * side < n
    grid = spark.range(n).withColumn("i", F.floor(F.col("id") / side)).withColumn("j", F.col("id") % side)
    at = lambda k, axis: (F.col(k) + 0.5 + uniform(-jitter, jitter, hash_uniform(seed, F.col("id"), F.lit(axis)))) / side
    return grid.select("id", at("i", "x").alias("x"), at("j", "y").alias("y"), F.lit(0.0).alias("z"))


def synthetic(spark: SparkSession, n: int, seed: int = 0, order: str = "morton") -> DataFrame:
    """The input of a performance run: the grid in Morton order on 16-bit coordinates, or then shuffled."""
    points = ordered(grid_locations(spark, n, seed), "morton", quantise=True)
    return points if order == "morton" else ordered(points.select("id", "x", "y", "z"), order)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): the lines of all files of path, files in the order of their paths, numbered from 0.

    A line's number is the count of lines in the splits before its own (by path and place in the file) plus its place in
    it. The driver gets a row for each split. Spark packs splits into partitions by size, but each one's lines stay together.
    """
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    placed = text.withColumn("mid", F.monotonically_increasing_id())
    counts = placed.groupBy("file", "start").agg(F.count("*").alias("n"), F.min("mid").alias("first")).collect()
    offset, table = 0, []
    for x in sorted(counts, key=lambda x: (x["file"], x["start"])):
        table.append((x["file"], x["start"], offset - x["first"]))
        offset += x["n"]
    shifts = spark.createDataFrame(table, "file string, start long, shift long")
    return placed.join(F.broadcast(shifts), ["file", "start"]).select((F.col("mid") + F.col("shift")).alias("id"), "value")


def load_xy(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(id, x, y) of header-less text files of `x,y` lines; further columns are ignored, a bad line raises when read.

    A line's number is its id, files counting in the order of their paths; n limits what is taken.
    """
    text = _lines(spark, path)
    parts = F.split("value", ",")
    rows = text.select("id", F.trim(parts[0]).cast("double").alias("x"), F.trim(parts[1]).cast("double").alias("y"))
    return rows if n is None else rows.where(F.col("id") < n)


def load_observations(spark: SparkSession, path: str, n: int | None = None) -> DataFrame:
    """(id, z): the first number of each line; a line without one raises when read, as skipping it would shift the rest."""
    text = _lines(spark, path)
    rows = text.select("id", F.split(F.trim("value"), r"\s+")[0].cast("double").alias("z"))
    return rows if n is None else rows.where(F.col("id") < n)


def load_points(spark: SparkSession, xy_path: str, obs_path: str, n: int | None = None) -> DataFrame:
    """(id, x, y, z) of a locations and an observations file, joined by line; different counts raise ValueError."""
    xy, z = load_xy(spark, xy_path, n), load_observations(spark, obs_path, n)
    sizes = (xy.count(), z.count())
    if sizes[0] != sizes[1] or (n is not None and sizes[0] < n):
        raise ValueError(f"{sizes[0]} locations, {sizes[1]} observations" + (f", {n} asked for" if n is not None else ""))
    return xy.join(z, "id")


def vector_sites(vectors: DataFrame, earth: bool = False) -> DataFrame:
    """(id, x, y, z) from the first three components of vectors: [0, 1] coordinates, or latitude and longitude."""
    e = [F.col("embedding")[i].cast("double") for i in range(3)]
    x, y = (90 * e[0], 180 * e[1]) if earth else ((e[0] + 1) / 2, (e[1] + 1) / 2)
    return vectors.select(F.col("vec_id").alias("id"), x.alias("x"), y.alias("y"), (10 * e[2]).alias("z"))


def event_sites(events: DataFrame) -> DataFrame:
    """(id, x, y, z) from events: x the share of the time span, y the value over 600, z its log."""
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    span = events.agg(F.min(t).alias("low"), F.max(t).alias("high"))
    rows = events.select(F.col("event_id").alias("id"), t.alias("t"), F.col("value").cast("double").alias("v")).crossJoin(F.broadcast(span))  # one row
    return rows.select("id", ((F.col("t") - F.col("low")) / (F.col("high") - F.col("low"))).alias("x"), (F.col("v") / 600).alias("y"), F.log(1 + F.col("v")).alias("z"))
