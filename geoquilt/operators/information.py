"""Gradient, observed and expected information of the Vecchia likelihood, summed in one narrow pass.

A term depends on the parameters through its conditional mean mu = c' K^-1 z and variance v = s - c' K^-1 c alone. With
a = K^-1 z, b = K^-1 c, e_p = dc_p - dK_p b and f_p = dK_p a, all their derivatives are products of these vectors and of
K^-1 e_p, so a tile is factored once and no derivative of its inverse is formed (compare J. Guinness, Statistics and
Computing 31, 2021).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.derivatives import Derivatives, free_parameters
from ..functions.kernels import Kernel, Theta, pair_distances
from .likelihood import _chunks, _factor, _forward


def _backward(factor: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solve L' u = right for stacked L (B, m, m) and right (B, m, r)."""
    u = np.empty_like(right)
    for i in reversed(range(factor.shape[1])):
        u[:, i] = (right[:, i] - np.einsum("bj,bjr->br", factor[:, i + 1 :, i], u[:, i + 1 :])) / factor[:, i, i, None]
    return u


def scores(kernel: Kernel, theta: Theta, x, y, z, nx, ny, nz) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each target given its neighbours: log-likelihood (B,), gradient (B, P), observed and expected information
    (B, P, P) in the order of free_parameters, and whether its tile has a factor and a positive variance (B,). Where it
    has none, all are 0."""
    names = free_parameters(kernel)
    count, size = len(x), len(names)
    tile_d = pair_distances(kernel.metric, nx[:, :, None], ny[:, :, None], nx[:, None, :], ny[:, None, :])
    cross_d = pair_distances(kernel.metric, nx, ny, x[:, None], y[:, None])
    factor, good = _factor(kernel.array(tile_d, theta))
    cross = kernel.array(cross_d, theta)
    solve = lambda right: _backward(factor, _forward(factor, right))
    b, a = np.moveaxis(solve(np.stack([cross, nz], 2)), 2, 0)
    dot = lambda u, w: np.einsum("bi,bi->b", u, w)
    v = kernel.marginal(theta) - dot(b, cross)
    good &= v > 0
    v = np.where(good, v, 1.0)
    r = z - dot(b, nz)
    tile, side = Derivatives(kernel, tile_d, theta), Derivatives(kernel, cross_d, theta)
    times = lambda k, w: np.einsum("bij,bj->bi", k, w)
    e, f, dmu, dv = [], [], [], []
    for p in names:
        k, c = tile.first(p), side.first(p)
        e.append(c - times(k, b))
        f.append(times(k, a))
        dmu.append(dot(e[-1], a))
        dv.append(tile.marginal(p) - dot(b, c + e[-1]))
    g = np.moveaxis(solve(np.stack(e, 2)), 2, 0)  # K^-1 e_p
    gradient = np.stack([-0.5 * dv[p] / v + r * dmu[p] / v + 0.5 * r * r * dv[p] / v**2 for p in range(size)], 1)
    observed, expected = np.zeros((count, size, size)), np.zeros((count, size, size))
    for p in range(size):
        for q in range(p, size):
            k, c = tile.second(names[p], names[q]), side.second(names[p], names[q])
            kb = times(k, b)
            ddmu = dot(c - kb, a) - dot(f[p], g[q]) - dot(f[q], g[p])
            ddv = dot(b, kb - 2 * c) - 2 * dot(e[p], g[q])
            second = -0.5 * (ddv / v - dv[p] * dv[q] / v**2) + (r * ddmu - dmu[p] * dmu[q]) / v - r * (dmu[p] * dv[q] + dmu[q] * dv[p]) / v**2 + 0.5 * r * r * (ddv / v**2 - 2 * dv[p] * dv[q] / v**3)
            observed[:, p, q] = observed[:, q, p] = -second
            expected[:, p, q] = expected[:, q, p] = 0.5 * dv[p] * dv[q] / v**2 + dot(e[p], g[q]) / v
    ll = -0.5 * (r * r / v + np.log(v) + math.log(2 * math.pi))
    keep = good * 1.0
    return ll * keep, gradient * keep[:, None], observed * keep[:, None, None], expected * keep[:, None, None], good


def block_scores(kernel: Kernel, theta: Theta, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray, bool]:
    """The same of the first block's joint term: m points, so a few m x m arrays on the driver."""
    names = free_parameters(kernel)
    d = pair_distances(kernel.metric, x[:, None], y[:, None], x[None], y[None])
    tile = kernel.array(d, theta)
    factor, good = _factor(tile[None])
    size = len(names)
    if not good[0]:
        return math.nan, np.zeros(size), np.zeros((size, size)), np.zeros((size, size)), False
    inverse = _backward(factor, _forward(factor, np.eye(len(x))[None]))[0]
    alpha = inverse @ z
    by = Derivatives(kernel, d, theta)
    firsts = [by.first(p) for p in names]
    solved = [inverse @ k for k in firsts]
    gradient = np.array([0.5 * alpha @ k @ alpha - 0.5 * np.trace(s) for k, s in zip(firsts, solved)])
    observed, expected = np.zeros((size, size)), np.zeros((size, size))
    for p in range(size):
        for q in range(p, size):
            k = by.second(names[p], names[q])
            half = 0.5 * np.einsum("ij,ji->", solved[p], solved[q])
            second = -0.5 * np.einsum("ij,ji->", inverse, k) + half + 0.5 * alpha @ k @ alpha - alpha @ firsts[p] @ solved[q] @ alpha
            observed[p, q] = observed[q, p] = -second
            expected[p, q] = expected[q, p] = half
    ll = -0.5 * (z @ alpha + 2 * np.log(np.diag(factor[0])).sum() + len(z) * math.log(2 * math.pi))
    return float(ll), gradient, observed, expected, True


def partial_information(neighbors: DataFrame, m: int, kernel: Kernel, theta: Theta) -> DataFrame:
    """One row (ll, n, bad, gradient, observed, expected) of arrays: sums over all conditioned points. A batch sends one
    row of 2 P**2 + P + 3 numbers, whatever its size."""
    size = len(free_parameters(kernel))
    flat = ["gradient", "observed", "expected"]

    def run(batches):
        for batch in batches:
            ll, n, bad, sums = 0.0, 0, 0, [np.zeros(size), np.zeros((size, size)), np.zeros((size, size))]
            for rank, *arrays in _chunks(batch, m, 6):
                one, *parts, good = scores(kernel, theta, *arrays)
                ll += math.fsum(one)
                n += len(rank)
                bad += int((~good).sum())
                for held, part in zip(sums, parts):
                    held += part.sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([ll]), pa.array([n]), pa.array([bad]), *(pa.array([x.ravel()], pa.list_(pa.float64())) for x in sums)], ["ll", "n", "bad", *flat])

    parts = neighbors.select("rank", "x", "y", "z", "nx", "ny", "nz").mapInArrow(run, "ll double, n long, bad long, gradient array<double>, observed array<double>, expected array<double>")
    width = {"gradient": size, "observed": size * size, "expected": size * size}
    sums = [F.array(*[F.sum(F.col(c)[i]) for i in range(width[c])]).alias(c) for c in flat]
    return parts.agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), *sums)
