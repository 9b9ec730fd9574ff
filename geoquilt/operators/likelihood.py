"""Conditional terms of the Vecchia approximation and their sum.

A task turns an Arrow batch of neighbour rows into stacked covariance tiles, factors them together and keeps nothing.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paired
from ..functions.kernels import Kernel, Theta, pair_distances

_TILE_BYTES = 8 << 20  # a stack's; about ten of its size are alive at once
PAIR_STACKS = 8  # a chunk of pairs is as much smaller, as pairs have more alive at once and then stay in the cache
TERMS = "rank long, mu double, var double, quad double, logdet double, ll double, status string"


def _stack(column: pa.Array, m: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, m)


def _factor(tiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower factors of stacked tiles, and which of them exist; one bad tile must not spoil its stack."""
    try:
        return np.linalg.cholesky(tiles), np.ones(len(tiles), bool)
    except np.linalg.LinAlgError:
        out, good = np.zeros_like(tiles), np.ones(len(tiles), bool)
        for i, tile in enumerate(tiles):
            try:
                out[i] = np.linalg.cholesky(tile)
            except np.linalg.LinAlgError:
                out[i], good[i] = np.eye(tiles.shape[1]), False
        return out, good


def _forward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve L u = right for stacked L (B, m, m) and right (B, m, r), by rows over the whole stack."""
    u = np.empty_like(right)
    for i in range(factor.shape[1]):
        u[:, i] = (right[:, i] - np.einsum("bj,bjr->br", factor[:, i, :i], u[:, :i])) / factor[:, i, i, None]
    return u


def _tiles(kernel: Kernel, theta: Theta, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """Covariances (B, m, m) of points (B, m); each pair's is formed once."""
    i, j = np.triu_indices(nx.shape[1], 1)
    tiles = np.empty((*nx.shape, nx.shape[1]))
    tiles[:, i, j] = tiles[:, j, i] = kernel.array(pair_distances(kernel.metric, nx[:, i], ny[:, i], nx[:, j], ny[:, j]), theta)
    own = np.arange(nx.shape[1])
    tiles[:, own, own] = kernel.array(np.zeros(1), theta)[0]
    return tiles


STAGES = ("covariance", "cholesky", "triangular solve", "quadratic", "independent")


def conditional(kernel: Kernel, theta: Theta, x, y, z, nx, ny, nz, clock: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """mu, var, quad, logdet, ll and status of targets given their neighbours, (B,) and (B, m); clock gathers seconds by stage."""
    began = [time.perf_counter()]
    tiles = _tiles(kernel, theta, nx, ny)
    cross = kernel.array(pair_distances(kernel.metric, nx, ny, x[:, None], y[:, None]), theta)
    began.append(time.perf_counter())
    factor, good = _factor(tiles)
    began.append(time.perf_counter())
    u = _forward(factor, np.stack([cross, nz], 2))
    began.append(time.perf_counter())
    mu = np.einsum("bi,bi->b", u[:, :, 0], u[:, :, 1])
    var = kernel.marginal(theta) - np.einsum("bi,bi->b", u[:, :, 0], u[:, :, 0])
    began.append(time.perf_counter())
    fine = good & (var > 0)
    with np.errstate(all="ignore"):
        quad, logdet = np.where(fine, (z - mu) ** 2 / var, np.nan), np.where(fine, np.log(np.where(var > 0, var, 1.0)), np.nan)
    status = np.where(good, np.where(var > 0, "ok", "variance"), "singular")
    if clock is not None:
        clock += np.diff([*began, time.perf_counter()])
    return {"mu": mu, "var": var, "quad": quad, "logdet": logdet, "ll": -0.5 * (quad + logdet + math.log(2 * math.pi)), "status": status}


def _pair_tiles(kernel: Kernel, theta: Theta, x, y, nx: np.ndarray, ny: np.ndarray) -> tuple[paired.Pair, paired.Pair]:
    """_tiles and the covariances (B, m) with targets, in pairs of doubles."""
    i, j = np.triu_indices(nx.shape[1], 1)
    upper = kernel.pairs(paired.distances(nx[:, i], ny[:, i], nx[:, j], ny[:, j]), theta)
    tiles = paired.Pair(*np.zeros((2, *nx.shape, nx.shape[1])))
    for out, part in zip(tiles, upper):
        out[:, i, j] = out[:, j, i] = part
    own = np.arange(nx.shape[1])
    tiles.high[:, own, own] = kernel.marginal(theta)
    return tiles, kernel.pairs(paired.distances(nx, ny, x[:, None], y[:, None]), theta)


def _scored(z: np.ndarray, var: np.ndarray, rest: paired.Pair, good: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of a term from its variance and z - mu."""
    fine = good & (var > 0)
    with np.errstate(all="ignore"):
        quad, logdet = np.where(fine, rest.high**2 / var, np.nan), np.where(fine, np.log(np.where(var > 0, var, 1.0)), np.nan)
    return {"mu": (z - rest.high) - rest.low, "var": var, "quad": quad, "logdet": logdet, "ll": -0.5 * (quad + logdet + math.log(2 * math.pi)), "status": np.where(good, np.where(var > 0, "ok", "variance"), "singular")}


def conditional_pairs(kernel: Kernel, theta: Theta, x, y, z, nx, ny, nz) -> dict[str, np.ndarray]:
    """conditional for kernels that have `pairs`: covariances and elimination in pairs of doubles, so that tiles of near
    copies, or of many neighbours of a smooth field, keep all digits of a double."""
    tiles, cross = _pair_tiles(kernel, theta, x, y, nx, ny)
    var, rest, good = paired.eliminate(tiles, cross, nz, kernel.marginal(theta), z)
    return _scored(z, var.high, rest, good)


def block_term(kernel: Kernel, theta: Theta, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> dict[str, float | str]:
    """The joint term of the first block: m points, so m x m numbers on the driver."""
    tile = kernel.array(pair_distances(kernel.metric, x[:, None], y[:, None], x[None], y[None]), theta)
    if kernel.nugget:
        np.fill_diagonal(tile, kernel.marginal(theta))
    factor, good = _factor(tile[None])
    u = _forward(factor, z[None, :, None])[0, :, 0]
    quad, logdet = float(u @ u), float(2 * np.log(np.diag(factor[0])).sum())
    ll = -0.5 * (quad + logdet + len(z) * math.log(2 * math.pi)) if good[0] else math.nan
    return {"quad": quad, "logdet": logdet, "ll": ll, "status": "ok" if good[0] else "singular"}


def _chunks(batch: pa.RecordBatch, m: int, stacks: int = 1):
    """A batch's points in parts whose tiles, so many stacks of them, take _TILE_BYTES at most (one point at least)."""
    step = max(1, _TILE_BYTES // (8 * m * m * stacks))
    for low in range(0, batch.num_rows, step):
        part = batch.slice(low, step)
        yield np.asarray(part.column(0)), *(np.asarray(part.column(i), np.float64) for i in (1, 2, 3)), *(_stack(part.column(i), m) for i in (4, 5, 6))


def terms(neighbors: DataFrame, m: int, kernel: Kernel, theta: Theta) -> DataFrame:
    """(rank, mu, var, quad, logdet, ll, status) of every conditioned point; singular tiles give a status and NaN. In pairs
    of doubles where the kernel has them."""
    one, stacks = (conditional_pairs, PAIR_STACKS) if kernel.pairs else (conditional, 1)

    def run(batches):
        for batch in batches:
            for rank, *arrays in _chunks(batch, m, stacks):
                got = one(kernel, theta, *arrays)
                yield pa.RecordBatch.from_arrays([pa.array(rank), *(pa.array(got[k]) for k in ("mu", "var", "quad", "logdet", "ll")), pa.array(got["status"].tolist(), pa.string())], [x.split()[0] for x in TERMS.split(", ")])

    return neighbors.select("rank", "x", "y", "z", "nx", "ny", "nz").mapInArrow(run, TERMS)


def partial_sums(neighbors: DataFrame, m: int, kernel: Kernel, thetas: list[Theta]) -> DataFrame:
    """(theta_id, ll, n, bad), a row for each theta: one narrow pass and a sum, however many thetas."""

    def run(batches):
        for batch in batches:
            sums, bad, n = np.zeros(len(thetas)), np.zeros(len(thetas), np.int64), 0
            for rank, *arrays in _chunks(batch, m):
                n += len(rank)
                for i, theta in enumerate(thetas):
                    got = conditional(kernel, theta, *arrays)
                    sums[i] += math.fsum(got["ll"])
                    bad[i] += int((got["status"] != "ok").sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(thetas), dtype=np.int32)), pa.array(sums), pa.array(np.full(len(thetas), n)), pa.array(bad)], ["theta_id", "ll", "n", "bad"])

    parts = neighbors.select("rank", "x", "y", "z", "nx", "ny", "nz").mapInArrow(run, "theta_id int, ll double, n long, bad long")
    return parts.groupBy("theta_id").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def stage_seconds(neighbors: DataFrame, m: int, kernel: Kernel, theta: Theta) -> DataFrame:
    """(stage, seconds) of one evaluation, summed over tasks."""

    def run(batches):
        clock = np.zeros(len(STAGES))
        for batch in batches:
            for _, *arrays in _chunks(batch, m):
                conditional(kernel, theta, *arrays, clock=clock)
        yield pa.RecordBatch.from_arrays([pa.array(STAGES), pa.array(clock)], ["stage", "seconds"])

    return neighbors.select("rank", "x", "y", "z", "nx", "ny", "nz").mapInArrow(run, "stage string, seconds double").groupBy("stage").agg(F.sum("seconds").alias("seconds"))
