"""Exact top-k by inner product of integer vectors, with the threshold algorithm over sorted lists (Fagin et al.)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .near_vectors import matrix, usable


class Lists:
    """A shard's vectors with one sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.lists = np.argsort(self.x, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.x, self.lists.T, 0).T.copy()

    def top(self, q: np.ndarray, own: int, k: int, start: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best but `own`, ties to smaller ids.

        Lists are read from the end that the query's sign asks for, in ever longer runs; each new vector is scored
        wholly. No unseen vector can beat the sum of what the lists show next, so the search stops when that bound
        falls below the kth score (at equality a smaller id could still come).
        """
        n = len(self.ids)
        use = np.flatnonzero(q)
        seen, done = np.zeros(n, bool), np.zeros(n, bool)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        low, run = 0, start
        if not len(use):  # all scores are 0
            seen[:], low = True, n
        up = q[use] > 0
        while True:
            high = min(n, low + run)
            if low < high:
                seen[self.lists[use[up], n - high : n - low]] = True
                seen[self.lists[use[~up], low:high]] = True
            fresh = np.flatnonzero(seen & ~done)
            done[fresh] = True
            got = self.x[fresh] @ q
            mine = self.ids[fresh] != own
            ids, scores = np.concatenate([ids, self.ids[fresh][mine]]), np.concatenate([scores, got[mine]])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            low, run = high, run * 2
            if low >= n or seen.all():
                return ids, scores
            bound = int(self.values[use[up], n - low - 1] @ q[use[up]]) + int(self.values[use[~up], low] @ q[use[~up]])
            if len(ids) == k and bound < scores[-1]:
                return ids, scores


def top_k(embeddings: DataFrame, k: int = 10, every: int = 100, scale: int = 1024, shard: int = 8192, query_block: int = 2048, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its k best candidates by integer inner product.

    Components become floor(scale * x). Queries are the rows whose id `every` divides, candidates all rows of another
    id; with fewer than k all are returned. Shards of candidates meet blocks of queries, each pair a task of bounded
    size; a shard sends k rows for each query. Vectors of each length are searched among themselves. Null ids and vectors
    that are null or hold null or non-finite numbers take no part; rows that repeat id and vector count once. Scores that
    might not fit in 64 bits raise ValueError. Other columns are not read.
    """
    rows = embeddings.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(usable(F.col("vec_id"), F.col("v"))).select("vec_id", F.transform("v", lambda x: F.floor(x * scale)).alias("v")).distinct()
    rows = rows.withColumn("n", F.size("v"))
    many = rows.groupBy("n").agg(F.count("*").alias("all"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("asked"), F.max(F.array_max(F.transform("v", F.abs))).alias("top")).collect()  # a row for each length
    if any(x["n"] * float(x["top"] or 0) ** 2 >= 2.0**63 for x in many):
        raise ValueError("scores don't fit in 64 bits")
    parts = lambda what, least: F.element_at(F.create_map(*[F.lit(v) for x in many for v in (x["n"], max(1, -(-x[what] // least)))]), F.col("n"))
    h = F.xxhash64("vec_id")
    if not many:
        many = [{"n": 0, "all": 0, "asked": 0}]
    rows = rows.withColumn("shards", parts("all", shard)).withColumn("blocks", parts("asked", query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0), (F.col(n) - 1).cast("int")))
    data = rows.select("n", F.pmod(h, F.col("shards")).cast("int").alias("shard"), each("blocks").alias("block"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).select("n", each("shards").alias("shard"), F.pmod(h, F.col("blocks")).cast("int").alias("block"), "vec_id", "v")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            lists = Lists(np.asarray(left.column("vec_id"), dtype=np.int64), matrix(left.column("v"), np.int64))
            for own, q in zip(np.asarray(right.column("vec_id")).tolist(), matrix(right.column("v"), np.int64)):
                ids, scores = lists.top(q, own, k)
                out.append((np.full(len(ids), own), ids, scores))
        join = [np.concatenate([x[i] for x in out]) if out else np.zeros(0, np.int64) for i in range(3)]
        return pa.table(join, ["query_id", "vec_id", "score"])

    found = data.groupBy("n", "shard", "block").cogroup(queries.groupBy("n", "shard", "block")).applyInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
