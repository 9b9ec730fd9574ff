"""Approximate nearest neighbours: hierarchical navigable small-world graphs, one a shard, as flat neighbour arrays.

A shard's slots are ordered by level, highest first, so the nodes of any level are its first slots and a level's links
are one array of slot numbers (-1: none). Nodes join in batches: a batch searches the graph that is there, level by
level, compares its members with one another, links each to a spread-out choice of what was found, and links back.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_vectors import matrix, usable
from .shared import give_back, written

_CELLS = 1 << 21  # numbers of a candidates' distance table formed together
_WIDE = 8  # nodes that a search opens at once


class Graph:
    """Links of the nodes of each level: links[l] is (nodes of level l, width), slots without one hold -1."""

    def __init__(self, x: np.ndarray, links: list[np.ndarray]):
        # a power of two scales exactly, so that no square overflows or vanishes
        self.scale = -int(np.frexp(np.abs(x).max(initial=0.0))[1])
        self.x = np.ldexp(x, self.scale)
        self.square = np.einsum("ij,ij->i", self.x, self.x)
        self.links = links

    def _to(self, q: np.ndarray, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Squared distances of q[rows] to slots, less q's own square, which changes no order."""
        return self.square[slots] - 2 * np.einsum("ij,ij->i", self.x[slots], q[rows])

    def beam(self, level: int, q: np.ndarray, slots: np.ndarray, dist: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of q the `keep` nearest slots that a best-first search from `slots` meets, nearest first."""
        links, n = self.links[level], len(q)
        pad = max(0, keep - slots.shape[1])
        slots = np.pad(slots, ((0, 0), (0, pad)), constant_values=-1)
        dist = np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
        new = slots >= 0
        seen = np.zeros((n, len(links)), bool)
        at = np.nonzero(new)
        seen[at[0], slots[at]] = True
        while True:
            wide = min(_WIDE, slots.shape[1])
            near = np.where(new, dist, np.inf)
            pick = np.argpartition(near, wide - 1, axis=1)[:, :wide]
            live = np.take_along_axis(new, pick, 1)
            rows = np.flatnonzero(live.any(axis=1))
            if not len(rows):
                break
            np.put_along_axis(new, pick, False, 1)
            from_ = np.where(live[rows], slots[rows[:, None], pick[rows]], -1)
            met = np.where(from_[:, :, None] >= 0, links[from_], -1).reshape(len(rows), -1)
            met[seen[rows[:, None], met]] = -1
            met.sort(axis=1)
            met[:, 1:][met[:, 1:] == met[:, :-1]] = -1
            r, c = np.nonzero(met >= 0)
            seen[rows[r], met[r, c]] = True
            far = np.full(met.shape, np.inf)
            far[r, c] = self._to(q, rows[r], met[r, c])
            all_slots, all_dist, all_new = np.hstack([slots[rows], met]), np.hstack([dist[rows], far]), np.hstack([new[rows], met >= 0])
            best = np.argpartition(all_dist, keep - 1, axis=1)[:, :keep]
            if keep < slots.shape[1]:  # the entries were more than are kept
                slots, dist, new = slots[:, :keep].copy(), dist[:, :keep].copy(), new[:, :keep].copy()
            slots[rows], dist[rows], new[rows] = (np.take_along_axis(y, best, 1) for y in (all_slots, all_dist, all_new))
        order = np.argsort(dist, axis=1, kind="stable")[:, :keep]
        return np.take_along_axis(slots, order, 1), np.take_along_axis(dist, order, 1)

    def spread(self, slots: np.ndarray, dist: np.ndarray, most: int, fill: bool) -> np.ndarray:
        """Of each row's candidates (nearest first, -1 for none; dist as squared distances) at most `most` that are nearer to
        the row's own point than to any chosen before; fill takes the nearest of the others while there is room."""
        out = np.full((len(slots), most), -1, np.int32)
        step = max(1, _CELLS // max(1, slots.shape[1] ** 2))
        for low in range(0, len(slots), step):
            s, d = slots[low : low + step], dist[low : low + step]
            x = self.x[s]
            square = self.square[s]
            between = square[:, :, None] + square[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
            nearest, chosen, count = np.full(s.shape, np.inf), np.zeros(s.shape, bool), np.zeros(len(s), np.int64)
            for i in range(s.shape[1]):
                good = (s[:, i] >= 0) & (count < most) & (d[:, i] < nearest[:, i])
                chosen[:, i] = good
                count += good
                nearest = np.where(good[:, None], np.minimum(nearest, between[:, i]), nearest)
            rank = np.where(chosen, 0, np.where((s >= 0) & fill, 1, 2))
            order = np.argsort(rank, axis=1, kind="stable")[:, :most]
            picked = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(s, order, 1), -1)
            out[low : low + step, : picked.shape[1]] = picked
        return out

    def _link_back(self, level: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Each chosen slot gets a link to the node that chose it; a full list is thinned to a spread-out choice."""
        links = self.links[level]
        i, j = np.nonzero(chosen >= 0)
        to, node = chosen[i, j].astype(np.int64), new[i]
        fresh = ~(links[to] == node[:, None]).any(axis=1)
        to, node = to[fresh], node[fresh]
        order = np.argsort(to, kind="stable")
        to, node = to[order], node[order]
        start = np.r_[True, to[1:] != to[:-1]] if len(to) else np.zeros(0, bool)
        group = np.cumsum(start) - 1
        place = np.arange(len(to)) - np.flatnonzero(start)[group] + (links[to] >= 0).sum(axis=1)
        width = links.shape[1]
        heads = to[start]
        crowded = np.zeros(len(heads), bool)
        crowded[group[place >= width]] = True
        fits = ~crowded[group]
        links[to[fits], place[fits]] = node[fits]
        full = np.flatnonzero(crowded)
        if len(full):
            number = np.full(len(heads), -1)
            number[full] = np.arange(len(full))
            mine = crowded[group]
            table = np.full((len(full), int(place.max()) + 1), -1, np.int64)
            table[:, :width] = links[heads[full]]
            table[number[group[mine]], place[mine]] = node[mine]
            at = np.nonzero(table >= 0)
            dist = np.full(table.shape, np.inf)
            owner = heads[full][at[0]]
            dist[at] = self.square[owner] + self._to(self.x, owner, table[at])
            order = np.argsort(dist, axis=1, kind="stable")
            links[heads[full]] = self.spread(np.take_along_axis(table, order, 1), np.take_along_axis(dist, order, 1), width, False)

    def enter(self, q: np.ndarray, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest slot met on the levels above down_to, by greedy descent from the first slot."""
        slots = np.zeros((len(q), 1), np.int64)
        dist = self._to(q, np.arange(len(q)), slots[:, 0])[:, None]
        for level in range(len(self.links) - 1, down_to, -1):
            slots, dist = self.beam(level, q, slots, dist, 1)
        return slots, dist

    def search(self, q: np.ndarray, keep: int, block: int = 256) -> np.ndarray:
        """For each row of q (unscaled) `keep` slots near it, -1 where there are fewer; all slots if there are no more than that."""
        n = len(self.x)
        if n <= keep:
            return np.broadcast_to(np.arange(n), (len(q), n))
        out = np.empty((len(q), keep), np.int64)
        for low in range(0, len(q), block):
            part = np.ldexp(q[low : low + block], self.scale)
            out[low : low + block] = self.beam(0, part, *self.enter(part, 0), keep)[0]
        return out


def built(x: np.ndarray, links: int = 16, keep: int = 40, seed: int = 0, block: int = 256) -> tuple[np.ndarray, Graph]:
    """The order of x's rows in the graph, and the graph; rows should be distinct."""
    n = len(x)
    draw = np.random.Generator(np.random.PCG64(seed)).random(n)
    level = np.floor(-np.log(1 - draw) / math.log(links)).astype(np.int64)
    order = np.argsort(-level, kind="stable")
    level = level[order]
    top = int(level[0]) if n else 0
    graph = Graph(x[order], [np.full((int((level >= k).sum()), links * (1 + (k == 0))), -1, np.int32) for k in range(top + 1)])
    done = 1
    while done < n:
        end = min(n, done + min(block, done))
        mine = int(level[done])
        end = done + int((level[done:end] == mine).sum())
        new, q = np.arange(done, end), graph.x[done:end]
        slots, dist = graph.enter(q, mine)
        peers = graph.square[new] - 2 * q @ q.T
        np.fill_diagonal(peers, np.inf)
        close = np.argsort(peers, axis=1, kind="stable")[:, :links]
        for k in range(mine, -1, -1):
            slots, dist = graph.beam(k, q, slots, dist, keep)
            own = graph.square[new][:, None]
            both = np.hstack([slots, new[close]])
            far = np.hstack([dist, np.take_along_axis(peers, close, 1)])
            both = np.where(np.isfinite(far), both, -1)
            rank = np.argsort(far, axis=1, kind="stable")[:, :keep]
            chosen = graph.spread(np.take_along_axis(both, rank, 1), np.take_along_axis(far, rank, 1) + own, links, True)
            graph.links[k][new, :links] = chosen
            graph._link_back(k, new, chosen)
        done = end
    return order, graph


def _vectors(embeddings: DataFrame, id_: str, vector: str) -> DataFrame:
    rows = embeddings.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("vec_id"), F.col("v"))).where(F.exists("v", lambda x: x != 0))
    return rows.dropDuplicates(["vec_id", "v"]).withColumn("n", F.size("v"))


INDEX = "n int, shard int, slot int, ids array<long>, v array<double>, links array<int>"


def index(vectors: DataFrame, copies: int = 11, shard: int = 8192, links: int = 16, keep: int = 40) -> DataFrame:
    """Graphs of all vectors (vec_id, v, n), one row a distinct vector: (n, shard, slot, ids, v, links).

    links holds a slot's lists of all its levels one behind the other, 2 * `links` places for level 0 and `links` for each
    other. Vectors of each length are dealt by hash to shards of about `shard`. Of the ids that share a vector the
    `copies` smallest are kept, as no search for fewer results can return another.
    """
    same = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= copies)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("n").alias("n"))  # `copies` entries at most
    many = {x["n"]: x["count"] for x in vectors.groupBy("n").count().collect()}  # a row for each length
    shards = F.element_at(F.create_map(*[F.lit(v) for n, c in (many or {0: 1}).items() for v in (n, -(-c // shard))]), F.col("n"))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("v"), shards).cast("int"))
    names = [c.split()[0] for c in INDEX.split(", ")]

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("ids").combine_chunks()
        group = group.take(pa.array(np.argsort(np.asarray(ids.flatten())[np.asarray(ids.offsets)[:-1] - ids.offsets[0].as_py()], kind="stable")))
        order, graph = built(matrix(group.column("v")), links, keep)
        size = len(order)
        level = np.sum([np.arange(size) < len(x) for x in graph.links], axis=0)
        flat = [np.concatenate([graph.links[k][i] for k in range(level[i])]) for i in range(size)]
        group = group.take(pa.array(order))
        out = [group.column("n"), group.column("shard"), pa.array(np.arange(size, dtype=np.int32)), group.column("ids").cast(pa.list_(pa.int64())), group.column("v").cast(pa.list_(pa.float64())), pa.array(flat, pa.list_(pa.int32()))]
        give_back()
        return pa.table(out, names)

    return dealt.groupBy("n", "shard").applyInArrow(build, INDEX)


def loaded(rows: pa.Table, links: int) -> tuple[Graph, list[list[int]]]:
    """A shard's graph and ids from its rows of the index."""
    rows = rows.sort_by("slot")
    lists = rows.column("links").combine_chunks()
    flat, ends = np.asarray(lists.flatten(), np.int32), np.asarray(lists.offsets, np.int64)
    ends = ends - ends[0]
    levels = np.diff(ends) // links - 1
    held = [flat[ends[:-1][:, None] + np.arange(2 * links)]]
    for k in range(1, int(levels.max(initial=1))):
        some = int((levels > k).sum())
        held.append(flat[ends[:some, None] + (k + 1) * links + np.arange(links)])
    return Graph(matrix(rows.column("v")), held), rows.column("ids").to_pylist()


def search(index: DataFrame, queries: DataFrame, k: int = 10, keep: int = 128, links: int = 16, query_block: int = 16384) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query (vec_id, v, n) the k nearest ids that the graphs of its length show.

    Every shard meets every block of queries, each pair a task of bounded size, and sends k rows a query at most.
    `links` is the index's.
    """
    shards = {x["n"]: x["top"] + 1 for x in index.groupBy("n").agg(F.max("shard").alias("top")).collect()}  # a row for each length, here and below
    blocks = {x["n"]: -(-x["count"] // query_block) for x in queries.groupBy("n").count().collect() if x["n"] in shards}
    of = lambda table: F.element_at(F.create_map(*[F.lit(v) for pair in (table or {0: 1}).items() for v in pair]), F.col("n"))
    each = lambda table: F.explode(F.sequence(F.lit(0), (of(table) - 1).cast("int")))
    some = F.col("n").isin(list(blocks))
    left = index.where(some).withColumn("block", each(blocks))
    right = queries.where(some).withColumn("block", F.pmod(F.xxhash64("vec_id"), of(blocks)).cast("int")).withColumn("shard", each(shards))

    def find(part: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if part.num_rows and asked.num_rows:
            graph, ids = loaded(part, links)
            x = matrix(part.sort_by("slot").column("v"))
            q = matrix(asked.column("v"))
            for own, v, slots in zip(np.asarray(asked.column("vec_id")).tolist(), q, graph.search(q, keep)):
                slots = slots[slots >= 0]
                with np.errstate(over="ignore"):
                    dist = np.sqrt(((x[slots] - v) ** 2).sum(axis=1))
                far = np.partition(dist, k)[k] if len(dist) > k else np.inf
                best: dict[int, float] = {}
                for d, s in zip(dist.tolist(), slots.tolist()):
                    if d <= far:
                        for i in ids[s]:
                            if i != own:
                                best[i] = min(d, best.get(i, np.inf))
                out += [(own, i, d) for i, d in sorted(best.items(), key=lambda y: (y[1], y[0]))[:k]]
        cut = list(zip(*out)) or [(), (), ()]
        give_back()
        return pa.table([pa.array(c, t) for c, t in zip(cut, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    keys = ["n", "shard", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(find, "query_id long, vec_id long, score double")
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100, shard: int = 8192, links: int = 16, build_keep: int = 40, keep: int = 128, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found for each row whose id `every` divides, by Euclidean distance.

    Candidates are all rows of another id, each indexed; scores are exact, nearest first, ties to the smaller id. Vectors
    of each length are searched among themselves. Null ids and vectors that are null, zero or hold null or non-finite
    numbers take no part; rows that repeat id and vector count once, and of an id with several vectors the nearest
    counts, on either side. An empty table gives no rows. Other columns are not read.
    """
    rows = written(_vectors(embeddings, id_, vector), "vectors")
    graphs = written(index(rows, k + 1, shard, links, build_keep), "graphs")
    return search(graphs, rows.where(F.col("vec_id") % every == 0), k, keep, links)
