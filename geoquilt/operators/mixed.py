"""Conditional terms whose tiles are factored in single precision and whose solutions are refined in double.

A factor takes half the bytes and its work runs at twice the width. Residuals are formed with the double tile, and each
step of refinement gains as many digits as the tile's condition leaves to single precision. Tiles that don't gain, or that
have no single-precision factor, are factored in double, so a result never depends on which tiles these were.

Where the kernel has pairs of doubles, solutions are then sharpened by residuals formed with the tile in pairs, and means
and variances taken in forms whose error is of second order in what is left; tiles that don't gain so are eliminated in
pairs. A term then has all digits of a double.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import paired
from ..functions.kernels import Kernel, Theta, pair_distances
from .information import _backward
from .likelihood import PAIR_STACKS, TERMS, _chunks, _factor, _forward, _pair_tiles, _scored, _tiles

MIXED_TERMS = TERMS + ", steps int, factor_bytes long"


def refined(tiles: np.ndarray, right: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """K x = right for stacked K (B, m, m) and right (B, m, r): x, steps taken by each tile (-1: factored in double), and
    which tiles have a factor at all.

    A column is done when its residual is within sqrt(m) units of double precision of |K| |x| + |right|, rows of largest
    sums standing for the norms: then it is as near as a double factor would bring it.
    """
    return _refined(tiles, right, most)[:3]


def _refined(tiles: np.ndarray, right: np.ndarray, most: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """refined, and the factors that gave x (single-precision ones as doubles)."""
    tol = np.finfo(np.float64).eps * tiles.shape[1] ** 0.5
    factor, single = _factor(tiles.astype(np.float32))
    solve = lambda f, b: _backward(f, _forward(f, b.astype(f.dtype))).astype(np.float64)
    size = np.abs(tiles).sum(2).max(1)
    with np.errstate(all="ignore"):
        x = solve(factor, right)
        steps, open_ = np.zeros(len(tiles), np.int32), single.copy()
        last = np.full(len(tiles), math.inf)
        for _ in range(most):
            k = np.flatnonzero(open_)
            if not len(k):
                break
            rest = right[k] - np.einsum("bij,bjr->bir", tiles[k], x[k])
            scale = size[k, None] * np.abs(x[k]).max(1) + np.abs(right[k]).max(1)
            error = (np.abs(rest).max(1) / np.where(scale > 0, scale, 1.0)).max(1)
            done = error <= tol
            gains = error < last[k] / 2
            go = k[~done & gains]
            open_[k[done | ~gains]] = False
            single[k[~done & ~gains]] = False  # no nearer than before, or not a number
            last[go] = error[~done & gains]
            x[go] += solve(factor[go], rest[~done & gains])
            steps[go] += 1
        single &= ~open_  # what is open after the last step is not done
    good = np.ones(len(tiles), bool)
    hard = np.flatnonzero(~single)
    if len(hard):
        double, good[hard] = _factor(tiles[hard])
        x[hard], steps[hard] = _backward(double, _forward(double, right[hard])), -1
    factor = factor.astype(np.float64)
    if len(hard):
        factor[hard] = double
    return x, steps, good, factor


def _sharpened(kernel: Kernel, theta: Theta, x, y, z, nx, ny, nz, most: int = 12) -> dict[str, np.ndarray]:
    """conditional where the kernel has pairs. Steps count those of both kinds; -1 stands for a factor in double or pairs.

    With b near K^-1 c, a near K^-1 z and the residual r = c - K b, the mean is z' b + a' r and the variance s - b' (c + r),
    but for (K^-1 z - a)' r and r' K^-1 r. A step is the last when these, by the factor, are no part of a double's digits.
    """
    tiles, cross = _pair_tiles(kernel, theta, x, y, nx, ny)
    own, eps = kernel.marginal(theta), np.finfo(np.float64).eps
    solved, steps, good, factor = _refined(tiles.high, np.stack([cross.high, nz], 2))
    count, m = nx.shape
    var, rest = paired.pair(np.ones(count)), paired.pair(np.zeros(count))
    open_, last = good.copy(), np.full(count, math.inf)
    b, a = (paired.pair(solved[:, :, i]) for i in (0, 1))
    for _ in range(most):
        k = np.flatnonzero(open_)
        if not len(k):
            break
        tile, c, values, bk, ak = tiles.at(k), cross.at(k), paired.pair(nz[k]), b.at(k), a.at(k)
        with np.errstate(all="ignore"):
            left = [paired.add(w, paired.minus(paired.dot(tile, paired.Pair(v.high[:, None], v.low[:, None])))) for w, v in ((c, bk), (values, ak))]
            more = _backward(factor[k], _forward(factor[k], np.stack([left[0].high, left[1].high], 2)))
            mean = paired.add(paired.dot(values, bk), paired.dot(ak, left[0]))
            var_k = paired.add(paired.pair(own), paired.minus(paired.dot(bk, paired.add(c, left[0]))))
            rest_k = paired.add(paired.pair(z[k]), paired.minus(mean))
            open_var, open_mean = (np.abs(np.einsum("bi,bi->b", left[0].high, more[:, :, i])) for i in (0, 1))
            error = np.maximum(open_var / np.abs(var_k.high), open_mean / np.abs(rest_k.high))
        done, gains = error <= eps / 16, error < last[k] / 4
        for whole, part in ((var, var_k), (rest, rest_k)):
            whole.high[k], whole.low[k] = part
        open_[k[done | ~gains]] = False
        good[k[~done & ~gains]] = False  # no nearer than before, or not a number
        last[k] = error
        go = ~done & gains
        for i, whole in enumerate((b, a)):
            whole.high[k[go]], whole.low[k[go]] = paired.add(whole.at(k[go]), paired.pair(more[go, :, i]))
        steps[k[go]] += steps[k[go]] >= 0
    hard = np.flatnonzero(~good | open_ | ~(var.high > 0))
    size = np.where(steps < 0, 8, 4)
    if len(hard):
        var_k, rest_k, good[hard] = paired.eliminate(tiles.at(hard), cross.at(hard), nz[hard], own, z[hard])
        for whole, part in ((var, var_k), (rest, rest_k)):
            whole.high[hard], whole.low[hard] = part
        steps[hard], size[hard] = -1, 16
    return _scored(z, var.high, rest, good) | {"steps": steps, "factor_bytes": size.astype(np.int64) * m * m}


def conditional(kernel: Kernel, theta: Theta, x, y, z, nx, ny, nz) -> dict[str, np.ndarray]:
    """likelihood.conditional by refined(), with `steps` and the bytes of each target's factor."""
    if kernel.pairs:
        return _sharpened(kernel, theta, x, y, z, nx, ny, nz)
    tiles = _tiles(kernel, theta, nx, ny)
    cross = kernel.array(pair_distances(kernel.metric, nx, ny, x[:, None], y[:, None]), theta)
    solved, steps, good = refined(tiles, np.stack([cross, nz], 2))
    mu, var = np.einsum("bi,bi->b", cross, solved[:, :, 1]), kernel.marginal(theta) - np.einsum("bi,bi->b", cross, solved[:, :, 0])
    fine = good & (var > 0)
    with np.errstate(all="ignore"):
        quad, logdet = np.where(fine, (z - mu) ** 2 / var, np.nan), np.where(fine, np.log(np.where(var > 0, var, 1.0)), np.nan)
    m = nx.shape[1]
    return {"mu": mu, "var": var, "quad": quad, "logdet": logdet, "ll": -0.5 * (quad + logdet + math.log(2 * math.pi)), "status": np.where(good, np.where(var > 0, "ok", "variance"), "singular"),
            "steps": steps, "factor_bytes": np.where(steps < 0, 8, 4).astype(np.int64) * m * m}


def terms(neighbors: DataFrame, m: int, kernel: Kernel, theta: Theta) -> DataFrame:
    """likelihood.terms with two more columns: steps of refinement (-1 where a double factor was needed), and factor_bytes."""
    names = [x.split()[0] for x in MIXED_TERMS.split(", ")]

    def run(batches):
        for batch in batches:
            for rank, *arrays in _chunks(batch, m, PAIR_STACKS if kernel.pairs else 2):
                got = conditional(kernel, theta, *arrays)
                columns = [pa.array(got[k].tolist(), pa.string()) if k == "status" else pa.array(got[k]) for k in names[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(rank), *columns], names)

    return neighbors.select("rank", "x", "y", "z", "nx", "ny", "nz").mapInArrow(run, MIXED_TERMS)
