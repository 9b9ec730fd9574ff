"""Conditioning sets: the m nearest predecessors of each point, or the m ranks before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import EARTH_RADIUS_KM, deg2rad, distance
from ..sources.work import cut
from .cells import nearest


def first_block(points: DataFrame, m: int) -> DataFrame:
    """The m points of the lowest ranks."""
    return points.where(F.col("rank") < m)


def _nearest(pairs: DataFrame, m: int) -> DataFrame:
    best = Window.partitionBy("rank").orderBy("dist", "nrank")
    return pairs.withColumn("k", F.row_number().over(best)).where(F.col("k") <= m)


def knn_exact(points: DataFrame, m: int, metric: str = "euclidean") -> DataFrame:
    """edges (rank, k, nrank, dist) by comparing every point with all its predecessors; to test the grid by."""
    t = points.where(F.col("rank") >= m).select("rank", "x", "y")
    c = points.select(F.col("rank").alias("nrank"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    pairs = t.join(c, F.col("nrank") < F.col("rank"))
    pairs = pairs.select("rank", "nrank", distance(metric, F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).alias("dist"))
    return _nearest(pairs, m)


def knn_grid(points: DataFrame, m: int, metric: str = "euclidean", n: int | None = None, rounds: int = 40) -> DataFrame:
    """edges (rank, k, nrank, dist), exact, by equi-joins on grid cells.

    Targets of ranks [B, 2B) look among ranks below 2B, on a grid whose cells then hold about m points each, in their
    own and all adjacent cells. What lies outside is at least one cell side away, so a target whose m-th neighbour is
    nearer is done. The others come again on cells twice as wide, until all are done; at the widest the neighbourhood is
    everything. Great-circle distances grow with chords, so those use a grid in space on the unit sphere. Coordinates must
    be finite: a target that has none, or too few neighbours with some, ends in ValueError.
    """
    spark = points.sparkSession
    n = points.count() if n is None else n
    if metric == "earth":
        lat, lon = deg2rad(F.col("x")), deg2rad(F.col("y"))
        axes = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
        extent, low = 2.0, [-1.0, -1.0, -1.0]
    else:
        box = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        extent = max((box[1] or 0.0) - (box[0] or 0.0), (box[3] or 0.0) - (box[2] or 0.0)) or 1.0
        axes, low = [F.col("x"), F.col("y")], [box[0] or 0.0, box[2] or 0.0]
    named = points.select("rank", "x", "y", *[(a - b).alias(f"a{i}") for i, (a, b) in enumerate(zip(axes, low))])
    block = F.floor(F.log2(F.greatest(F.col("rank"), F.lit(1)) + 0.5)).cast("int")
    last = max(0, (max(n, 2) - 1).bit_length() - 1)
    first = max(0, m.bit_length() - 1)
    targets = named.where(F.col("rank") >= m).withColumn("block", block)
    # a candidate serves its own block and all later ones: four times the points in all
    candidates = named.withColumn("block", F.explode(F.sequence(F.greatest(block, F.lit(first)), F.greatest(block, F.lit(last)))))
    candidates = candidates.where(F.col("block") <= last).withColumnsRenamed({"rank": "nrank", "x": "cx", "y": "cy"})
    done = None
    for level in range(rounds):
        side = F.least(F.lit(extent), F.lit(extent * 2.0**level * m**0.5) / F.sqrt(F.pow(F.lit(2.0), F.col("block"))))
        cell = lambda i: F.floor(F.col(f"a{i}") / F.col("side")).cast("long")
        t = targets.withColumn("side", side)
        for i in range(len(axes)):
            t = t.withColumn(f"c{i}", F.explode(F.array(*[cell(i) + F.lit(d) for d in (-1, 0, 1)])))
        c = candidates.withColumn("side", side)
        c = c.select("block", "nrank", "cx", "cy", *[cell(i).alias(f"c{i}") for i in range(len(axes))])
        pairs = t.join(c, ["block", *[f"c{i}" for i in range(len(axes))]]).where(F.col("nrank") < F.col("rank"))
        pairs = pairs.select("rank", "nrank", "side", distance(metric, F.col("x"), F.col("y"), F.col("cx"), F.col("cy")).alias("dist"))
        near = _nearest(pairs, m)
        reach = F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.col("side") / 2)) if metric == "earth" else F.col("side")
        sure = near.where(F.col("k") == m).where((F.col("dist") < reach) | (F.col("side") >= extent)).select("rank")
        near = cut(near.join(sure, "rank", "left_semi").select("rank", "k", "nrank", "dist"))
        done = near if done is None else done.union(near)
        targets = targets.join(near.where(F.col("k") == m).select("rank"), "rank", "left_anti")
        if targets.limit(1).count() == 0:
            break
    else:
        raise ValueError(f"some points have no {m} neighbours at any distance: coordinates must be finite")
    return done if done is not None else spark.createDataFrame([], "rank long, k int, nrank long, dist double")


def sequential(points: DataFrame, m: int) -> DataFrame:
    """edges (rank, k, nrank) to the m ranks before, ascending; an equi-join of ranks, so no task orders the whole set."""
    t = points.where(F.col("rank") >= m).select("rank")
    return t.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(m)))).withColumn("nrank", F.col("rank") - m + F.col("k") - 1)


def gathered(points: DataFrame, edges: DataFrame) -> DataFrame:
    """neighbors (rank, x, y, z, nrank, nx, ny, nz): a row for each target, arrays in the order of k."""
    c = points.select(F.col("rank").alias("nrank"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("z").alias("cz"))
    rows = edges.select("rank", "k", "nrank").join(c, "nrank")
    lists = rows.groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("k", "nrank", "cx", "cy", "cz"))).alias("s"))  # m entries each
    arrays = lists.select("rank", F.col("s.nrank").alias("nrank"), F.col("s.cx").alias("nx"), F.col("s.cy").alias("ny"), F.col("s.cz").alias("nz"))
    return points.select("rank", "x", "y", "z").join(arrays, "rank")


def conditioning(points: DataFrame, m: int, how: str = "knn", metric: str = "euclidean", n: int | None = None) -> DataFrame:
    """gathered() for the m neighbours of each target, cut from its lineage."""
    if how == "sequential":
        return cut(gathered(points, sequential(points, m)))
    if how not in ("knn", "knn_grid"):
        raise ValueError("conditioning must be knn, knn_grid or sequential")
    if how == "knn_grid":
        return cut(gathered(points, knn_grid(points, m, metric, n)))
    found = nearest(points.select("rank", "x", "y", "z"), m, metric, ("z",), ("n_x", "n_y", "n_z"))  # a tile holds what is gathered
    return found.select("rank", "x", "y", "z", "nrank", *[F.col(f"n_{c}").alias(f"n{c}") for c in "xyz"])
