"""Covariances that read more than a distance: several variables, space and time, parameters that change from site to site.

A model names the site columns it reads and how many variables each site has, and gives the covariance of variable i at
sites a with variable j at sites b, both as numpy (lists of arrays that broadcast, in the order of `columns`) and, where
all its smoothnesses are 1/2, 3/2 or 5/2, as SQL over two aliases. Nuggets are added where a site meets itself only.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .bessel import matern

#: The Matern correlations of closed form, over exp(-s), as SQL.
_SQL = {0.5: "1.0::DOUBLE", 1.5: "(1 + {s})", 2.5: "(1 + {s} + {s} * {s} / 3)"}
#: And as numpy.
_CLOSED = {0.5: lambda s: 1.0, 1.5: lambda s: 1 + s, 2.5: lambda s: 1 + s + s * s / 3}


def correlation(s: np.ndarray, nu: float) -> np.ndarray:
    return _CLOSED[nu](s) * np.exp(-s) if nu in _CLOSED else matern(s, nu)


def correlation_sql(s: str, nu: float) -> str:
    if nu not in _SQL:
        raise ValueError("only smoothness 0.5, 1.5 and 2.5 have SQL")
    return f"({_SQL[nu].format(s=f'({s})')} * exp(-({s})))"


def _plane(a, b) -> np.ndarray:
    return np.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2)


def _plane_sql(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


@dataclass(frozen=True)
class Multivariate:
    """Parsimonious Matern for any number of variables (Gneiting, Kleiber and Schlather, JASA 105, 2010): one range, a
    variance and a smoothness for each, cross smoothnesses their means, and correlations at distance 0.

    In the plane it is a covariance exactly if the correlations, each over sqrt(nu_i nu_j) / ((nu_i + nu_j) / 2), make a
    matrix without negative eigenvalues; otherwise ValueError.
    """

    sigma2: tuple[float, ...]
    range: float
    nu: tuple[float, ...]
    rho: tuple[tuple[float, ...], ...]
    nugget: float = 0.0
    columns = ("x", "y")

    def __post_init__(self):
        rho, nu = np.array(self.rho, float), np.array(self.nu, float)
        size = len(self.sigma2)
        if rho.shape != (size, size) or len(nu) != size or not np.allclose(rho, rho.T) or not np.allclose(np.diag(rho), 1):
            raise ValueError("rho must be a symmetric matrix with ones on its diagonal, a row for each variable")
        if min(*self.sigma2, *self.nu, self.range) <= 0 or self.nugget < 0:
            raise ValueError("variances, smoothnesses and the range must be positive")
        if np.linalg.eigvalsh(rho / (np.sqrt(np.outer(nu, nu)) / ((nu[:, None] + nu) / 2))).min() < -1e-12:
            raise ValueError("no covariance has these correlations and smoothnesses")

    @property
    def variables(self) -> int:
        return len(self.sigma2)

    def _scale(self, i: int, j: int) -> tuple[float, float]:
        return self.rho[i][j] * (self.sigma2[i] * self.sigma2[j]) ** 0.5, (self.nu[i] + self.nu[j]) / 2

    def array(self, a, b, i: int = 0, j: int = 0) -> np.ndarray:
        scale, nu = self._scale(i, j)
        return scale * correlation(_plane(a, b) / self.range, nu)

    def sql(self, a: str, b: str, i: int = 0, j: int = 0) -> str:
        scale, nu = self._scale(i, j)
        return f"({scale!r}::DOUBLE * {correlation_sql(f'{_plane_sql(a, b)} / {self.range!r}::DOUBLE', nu)})"


@dataclass(frozen=True)
class SpaceTime:
    """Non-separable Matern in space and time (T. Gneiting, JASA 97, 2002): with p = (|u| / time_range)**(2 time_nu) + 1,
    sigma2 / p times the Matern correlation of h / (range p**(beta / 2)). time_nu is above 0 and at most 1; beta, from 0
    (separable) to 1, is how much space and time interact."""

    sigma2: float
    range: float
    nu: float
    time_range: float
    time_nu: float
    beta: float
    nugget: float = 0.0
    columns = ("x", "y", "t")
    variables = 1

    def __post_init__(self):
        if min(self.sigma2, self.range, self.nu, self.time_range) <= 0 or not 0 < self.time_nu <= 1 or not 0 <= self.beta <= 1 or self.nugget < 0:
            raise ValueError("parameters must be positive, time_nu at most 1 and beta from 0 to 1")

    def array(self, a, b, i: int = 0, j: int = 0) -> np.ndarray:
        p = (np.abs(a[2] - b[2]) / self.time_range) ** (2 * self.time_nu) + 1
        return self.sigma2 / p * correlation(_plane(a, b) / self.range / p ** (self.beta / 2), self.nu)

    def sql(self, a: str, b: str, i: int = 0, j: int = 0) -> str:
        p = f"(pow(abs({a}.t - {b}.t) / {self.time_range!r}::DOUBLE, {2 * self.time_nu!r}::DOUBLE) + 1)"
        return f"({self.sigma2!r}::DOUBLE / {p} * {correlation_sql(f'{_plane_sql(a, b)} / {self.range!r}::DOUBLE / pow({p}, {self.beta / 2!r}::DOUBLE)', self.nu)})"


@dataclass(frozen=True)
class NonStationary:
    """Matern whose standard deviation and range are the sites' columns `sd` and `reach` (C. Paciorek and M. Schervish,
    Environmetrics 17, 2006): with q = (reach_a**2 + reach_b**2) / 2, sd_a sd_b reach_a reach_b / q times the correlation
    of d / sqrt(q). A covariance in the plane whatever the columns hold, as long as it is positive."""

    nu: float
    nugget: float = 0.0
    columns = ("x", "y", "sd", "reach")
    variables = 1

    def __post_init__(self):
        if self.nu <= 0 or self.nugget < 0:
            raise ValueError("the smoothness must be positive and the nugget not negative")

    def array(self, a, b, i: int = 0, j: int = 0) -> np.ndarray:
        q = (a[3] ** 2 + b[3] ** 2) / 2
        return a[2] * b[2] * a[3] * b[3] / q * correlation(_plane(a, b) / np.sqrt(q), self.nu)

    def sql(self, a: str, b: str, i: int = 0, j: int = 0) -> str:
        q = f"(({a}.reach * {a}.reach + {b}.reach * {b}.reach) / 2)"
        return f"({a}.sd * {b}.sd * {a}.reach * {b}.reach / {q} * {correlation_sql(f'{_plane_sql(a, b)} / sqrt({q})', self.nu)})"
