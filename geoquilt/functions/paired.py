"""Numbers as unevaluated sums of two doubles, a high part and a low one: about 31 digits, for arrays.

Sums and products by Knuth's and Dekker's exact transformations (T. J. Dekker, Numerische Mathematik 18, 1971).
"""

from __future__ import annotations

import math
from fractions import Fraction
from typing import NamedTuple

import numpy as np

SPLIT = 134217729.0  # 2**27 + 1: halves a double's digits
HALVINGS = 12  # of exp's argument; squared as often
PLAIN = 9  # terms of exp's series from this one on need no low part


class Pair(NamedTuple):
    high: np.ndarray
    low: np.ndarray

    def at(self, *where) -> Pair:
        return Pair(self.high[where], self.low[where])


def series(last: int = 16) -> list[tuple[float, float]]:
    """1 / k! as pairs, from k = 0."""
    out = []
    for k in range(last + 1):
        exact = Fraction(1, math.factorial(k))
        high = float(exact)
        out.append((high, float(exact - Fraction(high))))
    return out


_SERIES = series()


def pair(high, low=0.0) -> Pair:
    high = np.asarray(high, np.float64)
    return Pair(high, np.zeros_like(high) + low)


def _whole(high, low) -> Pair:
    """The same sum with the low part below the high one's last digit."""
    total = high + low
    return Pair(total, low - (total - high))


def _split(a):
    scaled = SPLIT * a
    return scaled - (scaled - a)


def product_error(a, b, p):
    """a b - p, exactly, of doubles with p = a b rounded."""
    a1, b1 = _split(a), _split(b)
    a2, b2 = a - a1, b - b1
    return ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def add(a: Pair, b: Pair) -> Pair:
    s = a.high + b.high
    back = s - a.high
    return _whole(s, (a.high - (s - back)) + (b.high - back) + (a.low + b.low))


def minus(a: Pair) -> Pair:
    return Pair(-a.high, -a.low)


def multiply(a: Pair, b: Pair) -> Pair:
    p = a.high * b.high
    return _whole(p, product_error(a.high, b.high, p) + (a.high * b.low + a.low * b.high))


def divide(a: Pair, b: Pair) -> Pair:
    q = a.high / b.high
    p = q * b.high
    return _whole(q, ((a.high - p) - product_error(q, b.high, p) + a.low - q * b.low) / b.high)


def root(a: Pair) -> Pair:
    q = np.sqrt(a.high)
    p = q * q
    return _whole(q, ((a.high - p) - product_error(q, q, p) + a.low) / np.where(q == 0, 1.0, 2 * q))


def exp_minus(s: Pair) -> Pair:
    """exp(-s) for s >= 0, and 0 beyond 700: a series of s / 2**HALVINGS, squared."""
    far = s.high > 700
    r = Pair(np.where(far, 0.0, -s.high) * 2.0**-HALVINGS, np.where(far, 0.0, -s.low) * 2.0**-HALVINGS)
    plain = np.zeros_like(r.high)
    for high, _ in reversed(_SERIES[PLAIN:]):
        plain = plain * r.high + high
    value = pair(plain)
    for high, low in reversed(_SERIES[:PLAIN]):
        value = add(multiply(value, r), pair(high, low))
    for _ in range(HALVINGS):
        value = multiply(value, value)
    return Pair(np.where(far, 0.0, value.high), np.where(far, 0.0, value.low))


def dot(a: Pair, b: Pair) -> Pair:
    """Sums of products along the last axis."""
    terms = multiply(a, b)
    total = pair(np.zeros(terms.high.shape[:-1]))
    for i in range(terms.high.shape[-1]):
        total = add(total, terms.at(..., i))
    return total


def distances(x1, y1, x2, y2) -> Pair:
    """Euclidean ones, of coordinates that are doubles."""
    dx, dy = add(pair(x1), pair(-np.asarray(x2))), add(pair(y1), pair(-np.asarray(y2)))
    return root(add(multiply(dx, dx), multiply(dy, dy)))


def eliminate(tiles: Pair, cross: Pair, z, own: float, tz) -> tuple[Pair, Pair, np.ndarray]:
    """Of targets with variance `own` and value tz (B,), given neighbours with covariances tiles (B, m, m) and cross (B, m)
    and values z (B, m): conditional variance, value less conditional mean, and whether all pivots are positive.

    A pivot is taken for 0 if it is below what rounding may leave of one that is.
    """
    b, m = cross.high.shape
    high, low = np.empty((2, b, m + 1, m + 2))
    for out, tile, side in ((high, tiles.high, cross.high), (low, tiles.low, cross.low)):
        out[:, :m, :m], out[:, :m, m], out[:, m, :m] = tile, side, side
    high[:, m, m], low[:, m, m] = own, 0.0
    high[:, :m, m + 1], high[:, m, m + 1], low[:, :, m + 1] = z, tz, 0.0
    rows, good = Pair(high, low), np.ones(b, bool)
    floor = m * 2.0**-98 * own
    for _ in range(m):
        pivot = rows.at(slice(None), slice(0, 1), slice(0, 1))
        fine = pivot.high[:, 0, 0] > floor
        good &= fine
        pivot = Pair(np.where(fine[:, None, None], pivot.high, 1.0), np.where(fine[:, None, None], pivot.low, 0.0))
        factor = divide(rows.at(slice(None), slice(1, None), slice(0, 1)), pivot)
        top, rest = rows.at(slice(None), slice(0, 1), slice(1, None)), rows.at(slice(None), slice(1, None), slice(1, None))
        rows = add(rest, minus(multiply(factor, top)))
    return rows.at(slice(None), 0, 0), rows.at(slice(None), 0, 1), good
