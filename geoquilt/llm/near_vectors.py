"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine >= t are at most s = 2 - 2t apart in squared distance, and a rotation keeps that. The rotated
axes are dealt to blocks; each block gets its share of s by its number of axes, so a linked pair keeps within budget in
one block at least. Each block is range-joined on its own: strips of its leading axis, at least as wide as the budget's
root, meet themselves and the next strip, in tiles of bounded size. Pairs within a tile's budget are verified in double
precision; the first block that admits a pair counts it, so none counts twice. Tiles send sums of links and a spanning
forest, never pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import components, written

_SLACK = 1e-5


def usable(id_: Column, vector: Column) -> Column:
    """True where the id is there and the vector holds finite numbers only, none null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(id_.isNotNull() & vector.isNotNull() & finite, F.lit(False))


def matrix(column, kind=np.float64) -> np.ndarray:
    """A list column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit_of(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first scaled by a power of two, which is exact, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _rotation(vectors: DataFrame, dims: int, blocks: int) -> list[np.ndarray]:
    """Principal axes of all unit vectors, dealt to blocks in turn and back again, widest first: per block a (dims, d) matrix."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = unit_of(matrix(batch.column(0)))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims * dims)), pa.array(total.ravel())], ["at", "value"])

    sums = vectors.select("vector").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toPandas()
    moment = np.zeros(dims * dims)
    moment[sums["at"].to_numpy()] = sums["value"].to_numpy()
    _, axes = np.linalg.eigh(moment.reshape(dims, dims))
    axes = axes[:, ::-1]
    turn = np.arange(dims) // blocks
    dealt = np.where(turn % 2 == 0, np.arange(dims) % blocks, blocks - 1 - np.arange(dims) % blocks)
    return [axes[:, dealt == b] for b in range(blocks) if (dealt == b).any()]


def near_duplicates(embeddings: DataFrame, cosine: float = 0.9, blocks: int = 4, tile: int = 16384, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of embeddings.

    Links join vectors of one length and cosine >= `cosine` in double precision. Equal vectors are one class from the
    start and link with each other. Vectors that are null, all zero or hold null or non-finite numbers link with nothing,
    as do null ids, whose component is null and which are not kept. Each length there is gets a join of its own. Rows that
    repeat both id and vector count once as another's link. Other columns are not read. Memory of a task is bounded by
    two chunks of `tile` vectors.
    """
    kind = "float" if embeddings.schema[vector].dataType.simpleString() == "array<float>" else "double"  # what travels
    rows = embeddings.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).cast(f"array<{kind}>").alias("vector"))
    good = usable(F.col("vec_id"), F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    ids = rows.where("good").select("vec_id", "vector").distinct()
    classes = written(ids.groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    lengths = sorted(x["dims"] for x in classes.select(F.size("vector").alias("dims")).distinct().collect())
    out = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    for dims in lengths:
        found = _of_length(classes.where(F.size("vector") == dims), dims, kind, cosine, max(1, min(blocks, dims)), tile)
        sums = found.groupBy("rep").agg(F.sum("links").alias("links"))
        labels = components(found.where("rep <> root"), "rep", "root").withColumnRenamed("node", "rep")
        whole = classes.where(F.size("vector") == dims).join(sums, "rep", "left").join(labels, "rep", "left")
        whole = whole.select("vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
        linked = rows.where("good").where(F.size("vector") == dims).join(whole, "vector")
        out = out.union(linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")))
    return out


def _of_length(classes: DataFrame, dims: int, kind: str, cosine: float, blocks: int, tile: int) -> DataFrame:
    """(rep, links, root) of distinct vectors (vector, rep, n) of one length, summed by tile: links to other vectors, and a forest."""
    axes = _rotation(classes, dims, blocks)
    far = 2 - 2 * cosine
    budgets = [far * a.shape[1] / dims for a in axes]
    widths = [max(b**0.5 * (1 + 1e-6) + 1e-9, 0.02) for b in budgets]

    def strips_of(unit: np.ndarray) -> list[np.ndarray]:
        return [np.floor((unit @ a[:, :1])[:, 0] / w).astype(np.int64) for a, w in zip(axes, widths)]

    def count_strips(batches):
        for batch in batches:
            for b, s in enumerate(strips_of(unit_of(matrix(batch.column(0))))):
                found, n = np.unique(s, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), b)), pa.array(found), pa.array(n)], ["block", "strip", "n"])

    # at most blocks * 2 / 0.02 rows, as the coordinates of unit vectors lie in [-1, 1]
    counted = classes.select("vector").mapInArrow(count_strips, "block long, strip long, n long").groupBy("block", "strip").agg(F.sum("n").alias("n")).collect()
    chunks = {(x["block"], x["strip"]): -(-x["n"] // tile) for x in counted}

    def deal(batches):
        for batch in batches:
            x = matrix(batch.column(0))
            rep = np.asarray(batch.column(1), np.int64)
            out: dict[tuple, list[int]] = {}
            for b, strips in enumerate(strips_of(unit_of(x))):
                for i, s in enumerate(strips.tolist()):
                    c = int(rep[i] * 0x9E3779B1 % 2**31) % chunks[b, s]
                    for other in range(chunks[b, s]):
                        low, high = min(c, other), max(c, other)
                        out.setdefault((b, s, low, s, high, 0 if c == low else 1), []).append(i)
                    for other in range(chunks.get((b, s + 1), 0)):
                        out.setdefault((b, s, c, s + 1, other, 0), []).append(i)
                    for other in range(chunks.get((b, s - 1), 0)):
                        out.setdefault((b, s - 1, other, s, c, 1), []).append(i)
            keys = list(out)
            at = np.concatenate([np.array(out[k], np.int64) for k in keys]) if keys else np.zeros(0, np.int64)
            size = [len(out[k]) for k in keys]
            for low in range(0, len(at), 20000):
                some = at[low : low + 20000]
                key = np.repeat(np.arange(len(keys)), size)[low : low + 20000]
                names = pa.array([":".join(map(str, k[:5])) for k in keys], pa.string()).take(pa.array(key))
                side = np.array([k[5] for k in keys], np.int32)[key]
                take = pa.array(some)
                yield pa.RecordBatch.from_arrays([names, pa.array(side), batch.column(1).take(take), batch.column(2).take(take), batch.column(0).take(take)], ["tile", "side", "rep", "n", "vector"])

    def join(table: pa.Table) -> pa.Table:
        block = int(table.column("tile")[0].as_py().split(":")[0])
        _, s1, c1, s2, c2 = table.column("tile")[0].as_py().split(":")
        side, rep, n = (np.asarray(table.column(k)) for k in ("side", "rep", "n"))
        order = np.lexsort((rep, side))
        x = matrix(table.column("vector"))[order]
        side, rep, n = side[order], rep[order], n[order]
        alone = (s1, c1) == (s2, c2)
        cut = len(side) if alone else int(np.searchsorted(side, 1))
        x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
        parts = [unit_of(x) @ a for a in axes]
        mine = parts[block].astype(np.float32)
        square = (mine.astype(np.float64) ** 2).sum(1)
        left = np.concatenate([-2 * mine, square[:, None].astype(np.float32), np.ones((len(mine), 1), np.float32)], 1)
        right = np.concatenate([mine, np.ones((len(mine), 1), np.float32), square[:, None].astype(np.float32)], 1)
        norm = np.linalg.norm(x, axis=1)
        links, label = np.zeros(len(x), np.int64), np.arange(len(x))
        step = 1024
        for i in range(0, cut, step):
            for j in range(i if alone else cut, len(x), step):
                close = left[i : min(i + step, cut)] @ right[j : j + step].T <= budgets[block] + _SLACK
                a, b = np.nonzero(close)
                a, b = a + i, b + j
                if alone and i == j:
                    a, b = a[a < b], b[a < b]
                for low in range(0, len(a), 50000):
                    p, q = _verified(a[low : low + 50000], b[low : low + 50000], x, norm, parts, block)
                    if len(p):
                        links += np.bincount(p, n[q], len(x)).astype(np.int64) + np.bincount(q, n[p], len(x)).astype(np.int64)
                        _unite(label, p, q)
        some = np.flatnonzero((links > 0) | (label != np.arange(len(x))))
        return pa.table({"rep": rep[some], "links": links[some], "root": rep[label[some]]})

    def _verified(a, b, x, norm, parts, block):
        linked = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
        a, b = a[linked], b[linked]
        within = [((parts[k][a] - parts[k][b]) ** 2).sum(1) <= budgets[k] * (1 + 1e-9) + 1e-12 for k in range(block + 1)]
        first = within[block].copy()
        for k in range(block):
            first &= ~within[k]
        return a[first], b[first]

    def _unite(label, p, q):
        while True:
            low = np.minimum(label[p], label[q])
            before = label.copy()
            np.minimum.at(label, p, low)
            np.minimum.at(label, q, low)
            np.minimum.at(label, before, label)
            label[:] = label[label]
            if (label[p] == label[q]).all() and (label == before).all():
                return

    tiles = classes.select("vector", "rep", "n").mapInArrow(deal, f"tile string, side int, rep long, n long, vector array<{kind}>")
    return written(tiles.groupBy("tile").applyInArrow(join, "rep long, links long, root long"), "links")


ORACLE = """
WITH RECURSIVE e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), u AS (
  SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
), l AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.n * y.n) >= 0.9
), r(vec_id, c) AS (
  SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id
), m AS (
  SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id
), k AS (
  SELECT a AS vec_id, count(*) AS k FROM l GROUP BY a
)
SELECT vec_id, coalesce(k.k, 0) AS n_links, coalesce(m.c, vec_id) AS component_id, coalesce(m.c, vec_id) = vec_id AS kept FROM e LEFT JOIN k USING (vec_id) LEFT JOIN m USING (vec_id)
"""
