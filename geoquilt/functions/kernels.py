"""Covariance functions, each as a Column, as numpy and as SQL, under one name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paired
from .bessel import matern

EARTH_SCALE_KM = 2523.64  # fixed value: what great-circle distances are divided by, by default


@dataclass(frozen=True)
class Theta:
    """Variance, range, smoothness and nugget."""

    sigma2: float
    range: float
    nu: float = 0.5
    nugget: float = 0.0

    def values(self, names: tuple[str, ...]) -> list[float]:
        return [getattr(self, x) for x in names]


@dataclass(frozen=True)
class Kernel:
    """metric: what distance it takes. The Matern family measures Euclidean distance even where neighbours don't. pairs:
    the twin of array in pairs of doubles, for tiles so nearly singular that doubles lose the digits shown."""

    name: str
    metric: str
    column: Callable[[Column, Theta], Column]
    array: Callable[[np.ndarray, Theta], np.ndarray]
    sql: Callable[[str, Theta], str]
    parameters: tuple[str, ...]
    nugget: bool = False
    unit: float = 1.0  # what distances are divided by
    pairs: Callable[[paired.Pair, Theta], paired.Pair] | None = None

    def marginal(self, t: Theta) -> float:
        return t.sigma2 + (t.nugget if self.nugget and t.nugget > 0 else 0.0)


def _matern_pairs(order: int):
    """Correlations times exp(s): 1, 1 + s, 1 + s + s * s / 3."""

    def pairs(d: paired.Pair, t: Theta) -> paired.Pair:
        s = paired.divide(d, paired.pair(t.range))
        value = paired.exp_minus(s)
        if order:
            rise = paired.add(paired.pair(1.0), s)
            if order == 2:
                rise = paired.add(rise, paired.divide(paired.multiply(s, s), paired.pair(3.0)))
            value = paired.multiply(rise, value)
        return paired.multiply(paired.pair(t.sigma2), value)

    return pairs


def _matern(name: str, order: int, column, array, sql) -> Kernel:
    return Kernel(name, "euclidean", lambda d, t: t.sigma2 * column(d / t.range) * F.exp(-(d / t.range)), lambda d, t: t.sigma2 * array(d / t.range) * np.exp(-d / t.range),
                  lambda d, t: f"({t.sigma2!r} * {sql(f'(({d}) / {t.range!r}::DOUBLE)')} * exp(-(({d}) / {t.range!r}::DOUBLE)))", ("sigma2", "range", "nu"), pairs=_matern_pairs(order))


def _power(name: str, earth: bool, nugget: bool, scale: float = EARTH_SCALE_KM) -> Kernel:
    unit = scale if earth else 1.0

    def column(d, t):
        value = t.sigma2 * F.exp(-F.pow(d / unit, F.lit(t.nu)) / t.range)
        return F.when(d == 0, F.lit(t.sigma2 + t.nugget)).otherwise(value) if nugget else value

    def array(d, t):
        value = t.sigma2 * np.exp(-((d / unit) ** t.nu) / t.range)
        return np.where(d == 0, t.sigma2 + t.nugget, value) if nugget else value

    def sql(d, t):
        value = f"{t.sigma2!r} * exp(-pow(({d}) / {unit!r}::DOUBLE, {t.nu!r}::DOUBLE) / {t.range!r}::DOUBLE)"
        return f"(CASE WHEN ({d}) = 0 THEN {t.sigma2 + t.nugget!r} ELSE {value} END)" if nugget else f"({value})"

    return Kernel(name, "earth" if earth else "euclidean", column, array, sql, ("sigma2", "range", "nu", "nugget")[: 3 + nugget], nugget, unit)


KERNELS = {
    k.name: k
    for k in (
        _matern("matern12", 0, lambda s: F.lit(1.0), lambda s: 1.0, lambda s: "1.0::DOUBLE"),
        _matern("matern32", 1, lambda s: 1 + s, lambda s: 1 + s, lambda s: f"(1 + {s})"),
        _matern("matern52", 2, lambda s: 1 + s + s * s / 3, lambda s: 1 + s + s * s / 3, lambda s: f"(1 + {s} + {s} * {s} / 3)"),
        _power("powexp", False, False),
        _power("powexp_earth", True, False),
        _power("powexp_nugget", False, True),
        _power("powexp_nugget_earth", True, True),
    )
}

def _no_expression(*_):
    raise ValueError("the Matern covariance of any smoothness is no Spark or SQL expression")


#: Any smoothness above 0; the named ones above are its values at 0.5, 1.5 and 2.5.
MATERN_ANY = Kernel("matern", "euclidean", _no_expression, lambda d, t: t.sigma2 * matern(d / t.range, t.nu), _no_expression, ("sigma2", "range", "nu"))

#: The names users give, and how many parameters each has.
FAMILIES = {"univariate_matern_stationary_no_nugget": 3, "univariate_powexp_stationary_no_nugget": 3, "univariate_powexp_nugget_stationary": 4, "univariate_matern_any_smoothness": 3}


def kernel_for(family: str, nu: float, metric: str = "euclidean", earth_scale: float = EARTH_SCALE_KM) -> Kernel:
    """The covariance function of a family; Matern needs nu in 0.5, 1.5, 2.5 exactly, unless any smoothness is asked for."""
    if family not in FAMILIES:
        raise ValueError(f"kernel must be one of {', '.join(FAMILIES)}")
    if family == "univariate_matern_any_smoothness":
        if not nu > 0:
            raise ValueError("the smoothness must be positive")
        return MATERN_ANY
    if family.startswith("univariate_matern"):
        try:
            return KERNELS[{0.5: "matern12", 1.5: "matern32", 2.5: "matern52"}[nu]]
        except KeyError:
            raise ValueError(f"Matern smoothness must be 0.5, 1.5 or 2.5, not {nu}") from None
    nugget = "nugget_stationary" in family
    return _power("powexp" + "_nugget" * nugget + "_earth" * (metric == "earth"), metric == "earth", nugget, earth_scale)


def pair_distances(metric: str, x1, y1, x2, y2) -> np.ndarray:
    """The numpy twin of columns.distance; arguments broadcast."""
    if metric != "earth":
        return np.sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2)
    a, b = x1 * np.pi / 180, x2 * np.pi / 180
    u, v = np.sin((b - a) / 2), np.sin((y2 * np.pi / 180 - y1 * np.pi / 180) / 2)
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1.0, u * u + np.cos(a) * np.cos(b) * v * v)))
