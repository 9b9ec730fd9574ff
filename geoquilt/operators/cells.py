"""The m nearest predecessors by tiles that follow the density of the points.

Space is halved along every axis until a cell holds a bounded number of points; neighbouring cells of one parent make a
tile. Every tile is one group of a shuffle, in which each target finds its nearest predecessors within the tile. That is
an upper bound of its reach: a target whose reach touches the boxes of other tiles visits those, and only those, in a
second shuffle, and its lists are merged. Points of the first ranks, which reach far, are settled among themselves.

Within a tile, targets with B to 2B points before them look among the 2B first, which are halved along their widest sides
into small leaves; leaves are met in the order of their distance until none that is left can hold anything nearer.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from ..functions.kernels import pair_distances
from ..sources.work import cut

_LEAF = 32  # points of a leaf
_SLACK = 1e-9  # of a reach, for rounding; bounds are widened by it


def _axes(metric: str, x: np.ndarray, y: np.ndarray, t: np.ndarray | None) -> np.ndarray:
    """(n, dims) coordinates in which nearness is Euclidean: great-circle distances grow with chords on the unit sphere."""
    if metric == "earth":
        lat, lon = x * np.pi / 180, y * np.pi / 180
        return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])
    return np.column_stack([x, y] if metric != "spacetime" else [x, y, t])


def _columns(batch, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Ranks and axes of a batch or table whose first columns are rank, x, y and, in space and time, t."""
    at = [np.asarray(batch.column(i), np.float64) for i in range(1, 4 if metric == "spacetime" else 3)]
    return np.asarray(batch.column(0), np.int64), _axes(metric, at[0], at[1], at[2] if len(at) > 2 else None)


def _gap(low_a, high_a, low_b, high_b) -> np.ndarray:
    """Distances of boxes, over their last axis."""
    return np.sqrt((np.maximum(0.0, np.maximum(low_a - high_b, low_b - high_a)) ** 2).sum(-1))


# --- within a tile ----------------------------------------------------------------------------------------------------


def _leaves(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points, and where each leaf of it starts: halves along the widest side, of `size` points at most."""
    order, starts = np.arange(len(at)), np.array([0])
    while True:
        ends = np.append(starts[1:], len(at))
        if (ends - starts).max() <= size:
            return order, starts
        here = at[order]
        wide = (np.maximum.reduceat(here, starts) - np.minimum.reduceat(here, starts)).argmax(1)
        part = np.repeat(np.arange(len(starts)), ends - starts)
        order = order[np.lexsort((here[np.arange(len(at)), wide[part]], part))]
        middle = (starts + ends + 1) // 2
        starts = np.unique(np.concatenate([starts, middle[(ends - starts > size) & (middle < ends)]]))


def _first_of_spots(at: np.ndarray, m: int) -> np.ndarray:
    """Of points in the order of rank, those that are among the first m on their spot: no other can be a neighbour."""
    order = np.lexsort((np.arange(len(at)), *at.T))
    new = np.append(True, (at[order][1:] != at[order][:-1]).any(1))
    starts = np.flatnonzero(new)
    place = np.arange(len(at)) - starts[np.cumsum(new) - 1]
    return np.sort(order[place < m])


def _search(rank: np.ndarray, at: np.ndarray, t_rank: np.ndarray, t_at: np.ndarray, reach: np.ndarray, m: int, exact: Callable) -> tuple[np.ndarray, ...]:
    """Flat (target, candidate, dist, reached): each target's m nearest of smaller rank within its reach, in order; and for
    each target the m-th one's distance along the axes, infinite without m. rank is ascending; exact(targets, candidates)
    gives the distances that count."""
    found, reached = [], np.full(len(t_rank), np.inf)
    before = np.searchsorted(rank, t_rank)
    block = np.where(before > 0, np.floor(np.log2(np.maximum(before, 1) + 0.5)), -1).astype(int)
    for b in np.unique(block[block >= 0]):
        pool = _first_of_spots(at[: 2 << b], m)
        order, starts = _leaves(at[pool], _LEAF)
        pool = pool[order]
        here, sizes = at[pool], np.diff(np.append(starts, len(pool)))
        low, high = np.minimum.reduceat(here, starts), np.maximum.reduceat(here, starts)
        mine = np.flatnonzero(block == b)
        turn, t_starts = _leaves(t_at[mine], _LEAF)
        mine = mine[turn]
        for group in np.split(mine, t_starts[1:]):
            near = _gap(t_at[group].min(0), t_at[group].max(0), low, high)
            leaves = np.argsort(near, kind="stable")
            near, take = near[leaves], 3 ** at.shape[1]
            while len(group):
                take = min(take, len(leaves))
                chosen = leaves[:take]
                width = sizes[chosen]
                who = pool[np.repeat(starts[chosen] - np.append(0, np.cumsum(width)[:-1]), width) + np.arange(width.sum())]
                who.sort()
                far = sum((t_at[group, None, a] - at[None, who, a]) ** 2 for a in range(at.shape[1])) ** 0.5
                limit = reach[group] * (1 + _SLACK)
                far[(rank[who][None] >= t_rank[group, None]) | (far > limit[:, None])] = np.inf
                last = np.partition(far, m - 1, 1)[:, m - 1] if far.shape[1] >= m else np.full(len(group), np.inf)
                rest = near[take] if take < len(leaves) else np.inf
                done = (np.minimum(last, limit) * (1 + _SLACK) < rest) | (take == len(leaves))
                if done.any():
                    far, ended = far[done], group[done]
                    t, c = np.nonzero((far <= (last[done] * (1 + _SLACK))[:, None]) & (far < np.inf))
                    dist = exact(ended[t], who[c])
                    order = np.lexsort((dist, t))  # stable: ties stay in the order of rank
                    t, c, dist = t[order], c[order], dist[order]
                    first = np.arange(len(t)) - np.searchsorted(t, np.arange(len(ended)))[t] < m
                    found.append((ended[t[first]], who[c[first]], dist[first]))
                    reached[ended] = last[done]
                group, take = group[~done], take * 4
    t, c, d = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    order = np.argsort(t, kind="stable")
    return t[order], c[order], d[order], reached


def _exact(metric: str, t_xy: np.ndarray, t_at: np.ndarray, xy: np.ndarray, at: np.ndarray) -> Callable:
    if metric == "earth":
        return lambda t, c: pair_distances("earth", t_xy[t, 0], t_xy[t, 1], xy[c, 0], xy[c, 1])
    return lambda t, c: np.sqrt(sum((t_at[t, a] - at[c, a]) ** 2 for a in range(at.shape[1])))


# --- tiles ------------------------------------------------------------------------------------------------------------


@dataclass
class _Tiles:
    """Names of the tiles, which are intervals of a Morton code of `bits` bits an axis, and what is known of each."""

    metric: str
    low: np.ndarray
    extent: float
    bits: int
    starts: np.ndarray | None = None
    counts: np.ndarray | None = None
    stats: tuple | None = None  # low, high, first, last, n, head

    def code(self, at: np.ndarray) -> np.ndarray:
        q = np.minimum(np.floor((at - self.low) / self.extent * (1 << self.bits)), (1 << self.bits) - 1).astype(np.int64)
        out = np.zeros(len(at), np.int64)
        for bit in range(self.bits - 1, -1, -1):
            for a in range(at.shape[1]):
                out = (out << 1) | (q[:, a] >> bit & 1)
        return out

    def tile(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, self.code(at), "right") - 1


def _split(places: DataFrame, tiles: _Tiles, n: int, cap: int) -> None:
    """Sets starts and counts. A pass over the points counts the children of the cells that still hold too many."""
    dims = len(tiles.low)
    step = 6 // dims  # 64 children
    open_, level, found = np.zeros(1, np.int64), 0, []
    if n <= cap:
        tiles.starts, tiles.counts = open_, np.array([n])
        return
    while len(open_):
        up, down = dims * (tiles.bits - level), dims * (tiles.bits - min(level + step, tiles.bits))

        def count(batches, cells=open_, up=up, down=down):
            for b in batches:
                code = tiles.code(_columns(b, tiles.metric)[1])
                k = np.searchsorted(cells, code >> up, "right") - 1
                child, number = np.unique((code >> down)[(k >= 0) & (cells[np.maximum(k, 0)] == code >> up)], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(child), pa.array(number)], ["cell", "n"])

        rows = sorted(map(tuple, places.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect()))  # 64 for a cell with too many
        level = min(level + step, tiles.bits)
        more, parent, room = [], None, 0
        for cell, number in rows:
            if number > cap and level < tiles.bits:
                more.append(cell)
                parent = None
                continue
            if parent == cell >> dims * step and number <= room:  # joins the one before
                found[-1] = (found[-1][0], found[-1][1] + number)
            else:
                found.append((cell << down, number))
                parent, room = cell >> dims * step, cap
            room -= number
        open_ = np.array(more, np.int64)
    starts, counts = zip(*sorted(found))
    tiles.starts, tiles.counts = np.array(starts), np.array(counts)


def _measure(places: DataFrame, tiles: _Tiles, head: int) -> None:
    """Sets stats: a tile's box of the points it holds, its first and last rank, its points, and those of them in the head."""
    dims = len(tiles.low)
    names = ["tile", *[f"lo{i}" for i in range(dims)], *[f"hi{i}" for i in range(dims)], "first", "last", "n", "head"]

    def measure(batches):
        for b in batches:
            rank, at = _columns(b, tiles.metric)
            if not len(rank):
                continue
            tile = tiles.tile(at)
            order = np.argsort(tile, kind="stable")
            rank, at, tile = rank[order], at[order], tile[order]
            s = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
            low, high = np.minimum.reduceat(at, s), np.maximum.reduceat(at, s)
            ranks = [np.minimum.reduceat(rank, s), np.maximum.reduceat(rank, s), np.diff(np.append(s, len(rank))), np.add.reduceat((rank < head).astype(np.int64), s)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (tile[s], *low.T, *high.T, *ranks)], names)

    schema = ", ".join(f"{x} {'double' if x[:2] in ('lo', 'hi') else 'long'}" for x in names)
    merge = {"f": F.min, "l": F.max, "n": F.sum, "h": F.sum}
    each = [(F.min if x[:2] == "lo" else F.max if x[:2] == "hi" else merge[x[0]])(x).alias(x) for x in names[1:]]
    rows = places.mapInArrow(measure, schema).groupBy("tile").agg(*each).orderBy("tile").collect()  # a row for each tile
    table = np.array([tuple(r) for r in rows], float)[:, 1:]
    tiles.stats = (table[:, :dims], table[:, dims : 2 * dims], *table[:, 2 * dims :].T)


def _visits(tiles: _Tiles, own: int, rank: np.ndarray, at: np.ndarray, reach: np.ndarray, m: int) -> tuple[np.ndarray, list]:
    """Reaches, bounded where the own tile gave none, and for each target the other tiles that it touches."""
    low, high, first, last, n, head = tiles.stats
    reach = reach.copy()
    for k in np.array_split(np.flatnonzero(np.isinf(reach)), max(1, np.isinf(reach).sum() * len(n) >> 20)):
        corner = np.sqrt((np.maximum(np.abs(at[k, None] - low), np.abs(at[k, None] - high)) ** 2).sum(-1))
        whole = (head >= m) | (last < rank[k, None]) & (n >= m)  # at least m of its points come before
        reach[k] = np.where(whole, corner, np.inf).min(1) if len(k) else reach[k]
    out = np.empty(len(rank), object)
    order = np.argsort(reach)
    others = _gap(low[own], high[own], low, high)
    others[own] = np.nan
    slack = tiles.extent * 1e-12
    for part in np.array_split(order, max(1, len(order) // 2048)):
        if not len(part):
            continue
        bound = reach[part] * (1 + _SLACK) + slack
        near = np.flatnonzero(others <= bound[-1])
        for k, wide in zip(np.array_split(part, max(1, len(part) * len(near) >> 20)), np.array_split(bound, max(1, len(part) * len(near) >> 20))):
            met = (_gap(at[k, None], at[k, None], low[near], high[near]) <= wide[:, None]) & (first[near] < rank[k, None])
            for i, row in zip(k, met):
                out[i] = near[row]
    return reach, list(out)


def _lists(offsets: np.ndarray, values) -> pa.ListArray:
    values = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _plain(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def nearest(points: DataFrame, m: int, metric: str = "euclidean", payload: tuple[str, ...] = (), keep: tuple[str, ...] = ("dist",), cap: int | None = None) -> DataFrame:
    """(rank, x, y[, t], *payload, nrank, dist, n_x, n_y[, n_t], n_*): of each target, of rank m or above, its m nearest
    predecessors as arrays in the order of (dist, nrank), checkpointed; ranks are 0 to n - 1.

    dist and the n_* columns are there if named in `keep`. metric: euclidean, earth, or spacetime, which is Euclidean over
    x, y and a third column t, in units that the caller chose. A tile holds `cap` points at most, or more that lie on one
    spot or within 2**-26 (2**-20 in three axes) of the extent of each other: of those, the m of lowest rank on a spot are
    the candidates, and targets are dealt over several tasks. Null, NaN or infinite coordinates raise ValueError.
    """
    spark = points.sparkSession
    flat = ("x", "y", "t") if metric == "spacetime" else ("x", "y")
    dims = 2 if metric == "euclidean" else 3
    finite = F.coalesce(sum(F.abs(c) for c in flat) < float("inf"), F.lit(False))
    span = [f(c).alias(k + c) for c in flat for k, f in (("lo", F.min), ("hi", F.max))]
    about = points.agg(F.count("*").alias("n"), F.count_if(~finite).alias("odd"), *span).first()
    if about["odd"]:
        raise ValueError(f"{about['odd']} points have no finite coordinates")
    n = about["n"]
    carried = [c for c in ("x", "y", *(("t",) if metric == "spacetime" else ()), *payload)]
    shown = [c for c in carried if f"n_{c}" in keep]
    of = {f.name: f.dataType for f in points.schema.fields}
    lists = [("nrank", LongType()), ("dist", DoubleType()), *[(f"n_{c}", of[c]) for c in shown]]
    fields = [StructField("rank", LongType()), *[StructField(c, of[c]) for c in carried], *[StructField(c, ArrayType(t)) for c, t in lists]]
    final = ["rank", *carried, "nrank", *(["dist"] if "dist" in keep else []), *[f"n_{c}" for c in shown]]
    if n <= m:
        return spark.createDataFrame([], StructType(fields)).select(*final)
    low = np.full(3, -1.0) if metric == "earth" else np.array([about[f"lo{c}"] for c in flat])
    extent = 2.0 if metric == "earth" else max(about[f"hi{c}"] - about[f"lo{c}"] for c in flat) or 1.0
    tiles = _Tiles(metric, low, extent, 26 if dims == 2 else 20)
    cap = cap or max(1 << 14 if dims == 2 else 1 << 16, math.isqrt(8 * m * n))
    named = points.select("rank", *carried)
    places = points.select("rank", *flat)
    _split(places, tiles, n, cap)
    head = min(n, max(cap, 4 * m * len(tiles.starts)))
    alone = len(tiles.starts) == 1 and tiles.counts[0] <= cap
    if alone:
        head = n
    else:
        _measure(places, tiles, head)
    width = len(carried) + 1

    # rows (rank, carried, tile, part, seek, give): who seeks neighbours and who may be one
    def placed(batches):
        for b in batches:
            rank, at = _columns(b, metric)
            tile = tiles.tile(at)
            part = np.where(tiles.counts[tile] > cap, rank % np.maximum(1, tiles.counts[tile] // cap), 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tile.astype(np.int32)), pa.array(part.astype(np.int32)), pa.array((rank >= max(m, head)))], [*b.schema.names, "tile", "part", "seek"])

    put_schema = StructType([*fields[:width], StructField("tile", IntegerType()), StructField("part", IntegerType()), StructField("seek", named.selectExpr("true AS s").schema[0].dataType)])
    first_ones = named.where(F.col("rank") < head).withColumns({"tile": F.lit(-1), "part": F.lit(0), "seek": F.col("rank") >= m, "give": F.lit(True)})
    give = None
    if alone:
        sent = first_ones
    else:
        put = named.mapInArrow(placed, put_schema)
        crowded = [i for i, k in enumerate(tiles.counts) if k > cap]
        if crowded:  # many points on next to one spot
            at_spot = Window.partitionBy(*flat, "part").orderBy("rank")
            over = Window.partitionBy(*flat).orderBy("rank")
            few = put.where(F.col("tile").isin(crowded)).withColumn("r", F.row_number().over(at_spot)).where(F.col("r") <= m).withColumn("r", F.row_number().over(over)).where(F.col("r") <= m).drop("r")
            parts = {int(i): int(tiles.counts[i] // cap) for i in crowded}
            number = F.element_at(F.create_map(*[F.lit(x) for p in parts.items() for x in p]), F.col("tile"))
            spread = few.withColumn("part", F.explode(F.sequence(F.lit(0), number - 1))).withColumn("seek", F.lit(False)).withColumn("give", F.lit(True))
            give = put.where(~F.col("tile").isin(crowded)).union(few)
            sent = put.withColumn("give", ~F.col("tile").isin(crowded)).union(spread)
        else:
            give, sent = put, put.withColumn("give", F.lit(True))
        sent = sent.union(first_ones.select(*sent.columns))

    def answers(table, rows: np.ndarray, candidates: np.ndarray, t, c, dist) -> list:
        """nrank, dist and n_* of the targets, from flat (target, candidate, dist)."""
        offsets = np.append(0, np.cumsum(np.bincount(t, minlength=len(rows))))
        took = pa.array(candidates[c])
        values = [_plain(table.column(0)).take(took), pa.array(dist), *[_plain(table.column(c)).take(took) for c in shown]]
        return [_lists(offsets, v) for v in values]

    out_schema = StructType([*fields, StructField("reach", DoubleType()), StructField("visits", ArrayType(IntegerType()))])

    def within(table):
        rank, at = _columns(table, metric)
        order = np.argsort(rank, kind="stable")
        table, rank, at = table.take(pa.array(order)), rank[order], at[order]
        own = table.column("tile")[0].as_py()
        rows, candidates = (np.flatnonzero(np.asarray(table.column(c), bool)) for c in ("seek", "give"))
        xy = np.column_stack([np.asarray(table.column(i), np.float64) for i in (1, 2)])
        exact = _exact(metric, xy[rows], at[rows], xy[candidates], at[candidates])
        t, c, dist, reach = _search(rank[candidates], at[candidates], rank[rows], at[rows], np.full(len(rows), np.inf), m, exact)
        visits = [()] * len(rows)
        if own >= 0:
            reach, visits = _visits(tiles, own, rank[rows], at[rows], reach, m)
        met = np.array([len(v) for v in visits], np.int64)
        flat_visits = np.concatenate(visits) if met.sum() else np.empty(0)
        mine = [_plain(table.column(i)).take(pa.array(rows)) for i in range(width)]
        found = answers(table, rows, candidates, t, c, dist)
        if "dist" not in keep:  # only lists to be merged need them
            kept = met[t] > 0
            found[1] = _lists(np.append(0, np.cumsum(np.bincount(t[kept], minlength=len(rows)))), dist[kept])
        columns = [*mine, *found, pa.array(reach), _lists(np.append(0, np.cumsum(met)), flat_visits.astype(np.int32))]
        return pa.Table.from_arrays(columns, names=[f.name for f in out_schema.fields])

    local = cut(sent.groupBy("tile", "part").applyInArrow(within, out_schema))
    if alone:
        return local.select(*final)
    asked = local.where(F.size("visits") > 0)
    guests = asked.select("rank", *carried, F.explode("visits").alias("tile"), F.lit(0).alias("part"), F.lit(True).alias("seek"), "reach")
    both = guests.union(give.select("rank", *carried, "tile", "part", F.lit(False), F.lit(0.0)))
    met_schema = StructType([fields[0], *fields[width:]])

    def visited(table):
        rank, at = _columns(table, metric)
        order = np.argsort(rank, kind="stable")
        table, rank, at = table.take(pa.array(order)), rank[order], at[order]
        seek = np.asarray(table.column("seek"), bool)
        rows, candidates = np.flatnonzero(seek), np.flatnonzero(~seek)
        xy = np.column_stack([np.asarray(table.column(i), np.float64) for i in (1, 2)])
        reach = np.asarray(table.column("reach"), np.float64)[rows] + extent * 1e-12
        t, c, dist, _ = _search(rank[candidates], at[candidates], rank[rows], at[rows], reach, m, _exact(metric, xy[rows], at[rows], xy[candidates], at[candidates]))
        some = np.unique(t)
        return pa.Table.from_arrays([pa.array(rank[rows[some]]), *answers(table, some, candidates, np.searchsorted(some, t), c, dist)], names=[f.name for f in met_schema.fields])

    names = [c for c, _ in lists]
    there = both.groupBy("tile").applyInArrow(visited, met_schema)
    lead = [c for c in ("dist", "nrank", *names[2:])]
    each = asked.select("rank", F.struct(*carried).alias("own"), F.arrays_zip(*lead).alias("s")).union(there.select("rank", F.lit(None).cast(asked.select(F.struct(*carried)).schema[0].dataType).alias("own"), F.arrays_zip(*lead).alias("s")))
    best = F.slice(F.sort_array(F.flatten(F.collect_list("s"))), 1, m)
    merged = each.groupBy("rank").agg(F.max("own").alias("own"), best.alias("s")).select("rank", *[F.col(f"own.{c}").alias(c) for c in carried], *[F.col(f"s.{c}").alias(c) for c in names])
    return local.where(F.size("visits") == 0).select(*final).union(cut(merged.select(*final)))


def knn_cells(points: DataFrame, m: int, metric: str = "euclidean", n: int | None = None, cap: int | None = None) -> DataFrame:
    """edges (rank, k, nrank, dist), exact, ties to the smaller rank, by nearest()."""
    lists: Column = F.posexplode(F.arrays_zip("nrank", "dist")).alias("p", "v")
    return nearest(points, m, metric, cap=cap).select("rank", lists).select("rank", (F.col("p") + 1).alias("k"), F.col("v.nrank").alias("nrank"), F.col("v.dist").alias("dist"))
