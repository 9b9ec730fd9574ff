"""The modified Bessel function of the second kind of any order, for arrays: Temme's series near 0, and Steed's continued
fraction beyond 2 (N. M. Temme, J. Comput. Phys. 19, 1975); orders above 1/2 follow by recurrence."""

from __future__ import annotations

import math

import numpy as np

# Coefficients of z**2, z**4, z**6 and z**8 of 1 / Gamma(z).
_RECIPROCAL = (0.5772156649015329, -0.0420026350340952, -0.0421977345555443, 0.0072189432466630)


def _gammas(mu: float) -> tuple[float, float]:
    """Half the difference of 1 / Gamma(1 - mu) and 1 / Gamma(1 + mu) over mu, and half their sum."""
    low, high = 1 / math.gamma(1 - mu), 1 / math.gamma(1 + mu)
    if abs(mu) > 0.01:
        return (low - high) / (2 * mu), (low + high) / 2
    return -sum(c * mu ** (2 * i) for i, c in enumerate(_RECIPROCAL)), (low + high) / 2


def _series(x: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) K of orders mu and mu + 1, |mu| <= 1/2, 0 < x <= 2."""
    odd, even = _gammas(mu)
    log = np.log(2 / x)
    s = mu * log
    f = (mu * math.pi / math.sin(mu * math.pi) if mu else 1.0) * (np.cosh(s) * odd + np.where(np.abs(s) < 1e-8, 1.0, np.sinh(s) / np.where(s == 0, 1.0, s)) * log * even)
    p, q = 0.5 * np.exp(s) * math.gamma(1 + mu), 0.5 * np.exp(-s) * math.gamma(1 - mu)
    c, quarter = np.ones_like(x), x * x / 4
    one, two = f.copy(), p.copy()
    for k in range(1, 26):  # the terms fall faster than 1 / k!**2
        f = (k * f + p + q) / (k * k - mu * mu)
        p, q, c = p / (k - mu), q / (k + mu), c * quarter / k
        one += c * f
        two += c * (p - k * f)
    return one * np.exp(x), two * 2 / x * np.exp(x)


def _fraction(x: np.ndarray, mu: float) -> tuple[np.ndarray, np.ndarray]:
    """exp(x) K of orders mu and mu + 1, |mu| <= 1/2, x >= 2."""
    first = 0.25 - mu * mu
    if first == 0:  # order 1/2, where the sum is its first term
        k = np.sqrt(math.pi / (2 * x))
        return k, k * (mu + x + 0.5) / x
    b = 2 * (1 + x)
    d = 1 / b
    h = step = d
    before, now = np.zeros_like(x), np.ones_like(x)
    a, c = -first, first
    q = np.full_like(x, first)
    total = 1 + q * step
    for i in range(2, 400):
        a -= 2 * (i - 1)
        c = -a * c / i
        before, now = now, (before - b * now) / a
        q = q + c * now
        b = b + 2
        d = 1 / (b + a * d)
        step = (b * d - 1) * step
        h = h + step
        more = q * step
        total = total + more
        if np.all(np.abs(more) < 1e-17 * np.abs(total)):
            break
    k = np.sqrt(math.pi / (2 * x)) / total
    return k, k * (mu + x + 0.5 - first * h) / x


def scaled_k(x: np.ndarray, nu: float) -> np.ndarray:
    """exp(x) K_nu(x) for x > 0 and nu >= 0."""
    x = np.asarray(x, np.float64)
    up = math.floor(nu + 0.5)
    mu = nu - up
    flat = x.ravel()
    low, high = np.empty_like(flat), np.empty_like(flat)
    small = flat <= 2
    for part, f in ((small, _series), (~small, _fraction)):
        if part.any():
            low[part], high[part] = f(flat[part], mu)
    for i in range(1, up):
        low, high = high, 2 * (mu + i) / flat * high + low
    return (high if up else low).reshape(x.shape)


def matern(s: np.ndarray, nu: float) -> np.ndarray:
    """The Matern correlation 2**(1 - nu) / Gamma(nu) s**nu K_nu(s), which is 1 at s = 0."""
    s = np.asarray(s, np.float64)
    x = np.clip(s, 10.0 ** (-280 / (nu + 1)), 700.0)  # beyond, the value is that of 0, or nothing
    value = np.exp((1 - nu) * math.log(2) - math.lgamma(nu) + nu * np.log(x) - x) * scaled_k(x, nu)
    return np.where(s == 0, 1.0, np.where(s > 700, 0.0, value))
