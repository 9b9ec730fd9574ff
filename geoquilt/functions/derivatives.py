"""First and second derivatives of the covariances by their parameters, as numpy over stacked distances."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np

from .bessel import matern, scaled_k
from .kernels import Kernel, Theta

#: Steps of the five-point differences in the smoothness, for which no closed form exists: of first and of second derivatives.
NU_STEPS = (1e-3, 4e-3)


def free_parameters(kernel: Kernel) -> tuple[str, ...]:
    """What the covariance can be differentiated by: Matern of a fixed smoothness (0.5, 1.5, 2.5) leaves its smoothness out."""
    return kernel.parameters[:2] if kernel.name in _CLOSED else kernel.parameters


#: M(s), s M'(s) and s**2 M''(s) over exp(-s), by name.
_CLOSED: dict[str, Callable] = {
    "matern12": lambda s: (1.0, -s, s * s),
    "matern32": lambda s: (1 + s, -s * s, s * s * (s - 1)),
    "matern52": lambda s: (1 + s + s * s / 3, -(s * s) * (1 + s) / 3, s * s * (s * s - s - 1) / 3),
}


def _slope(s: np.ndarray, nu: float) -> np.ndarray:
    """s M'(s) of the Matern correlation: -2**(1 - nu) / Gamma(nu) s**(nu + 1) K of order nu - 1, which is even in its order."""
    x = np.clip(s, 10.0 ** (-280 / (nu + 1)), 700.0)
    value = -np.exp((1 - nu) * math.log(2) - math.lgamma(nu) + (nu + 1) * np.log(x) - x) * scaled_k(x, abs(nu - 1))
    return np.where((s == 0) | (s > 700), 0.0, value)


def _difference(f: Callable[[float], np.ndarray], at: float, order: int) -> np.ndarray:
    """The first or second derivative by five points, in error by the fourth power of the step."""
    h = min(NU_STEPS[order - 1], at / 4)
    a, b, c, d = f(at - 2 * h), f(at - h), f(at + h), f(at + 2 * h)
    return (a - 8 * b + 8 * c - d) / (12 * h) if order == 1 else (-a + 16 * b - 30 * f(at) + 16 * c - d) / (12 * h * h)


class Derivatives:
    """The derivatives over distances d at theta; each asked for by the names of one or two parameters and formed then, so
    that only one more stack is held at a time."""

    def __init__(self, kernel: Kernel, d: np.ndarray, theta: Theta):
        self.kernel, self.d, self.t = kernel, d, theta
        self.matern = kernel.name.startswith("matern")
        if self.matern:
            s = d / theta.range
            if kernel.name in _CLOSED:
                self.value, self.slope, self.curve = (x * np.exp(-s) for x in _CLOSED[kernel.name](s))
            else:
                self.value, self.slope = matern(s, theta.nu), _slope(s, theta.nu)
                self.curve = s * s * self.value + (2 * theta.nu - 1) * self.slope  # Bessel's equation
        else:
            unit = d / kernel.unit
            self.power = unit**theta.nu / theta.range
            self.log = np.log(np.where(unit > 0, unit, 1.0))  # d = 0: the power is 0 whatever the smoothness
            self.value = np.exp(-self.power)

    def first(self, p: str) -> np.ndarray:
        t = self.t
        if p == "sigma2":
            return self.value
        if p == "nugget":
            return (self.d == 0) * 1.0
        if self.matern:
            return t.sigma2 * (-self.slope / t.range if p == "range" else _difference(lambda nu: matern(self.d / t.range, nu), t.nu, 1))
        return t.sigma2 * self.value * self.power * (1 / t.range if p == "range" else -self.log)

    def second(self, p: str, q: str) -> np.ndarray:
        t, both = self.t, {p, q}
        if "nugget" in both or both == {"sigma2"}:
            return np.zeros_like(self.d)
        if "sigma2" in both:
            return self.first((both - {"sigma2"}).pop()) / t.sigma2
        if self.matern:
            if both == {"range"}:
                return t.sigma2 * (self.curve + 2 * self.slope) / t.range**2
            if both == {"nu"}:
                return t.sigma2 * _difference(lambda nu: matern(self.d / t.range, nu), t.nu, 2)
            return -t.sigma2 / t.range * _difference(lambda nu: _slope(self.d / t.range, nu), t.nu, 1)
        base, w = t.sigma2 * self.value, self.power
        if both == {"range"}:
            return base * w * (w - 2) / t.range**2
        if both == {"nu"}:
            return base * w * (w - 1) * self.log**2
        return base * w * (1 - w) * self.log / t.range

    def marginal(self, p: str) -> float:
        """The first derivative of the variance at distance 0; all second ones are 0."""
        return 1.0 if p in ("sigma2", "nugget") else 0.0
