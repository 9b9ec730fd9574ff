"""Maximum likelihood by Fisher scoring, and standard errors: what gradients and information are for."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from ..functions.derivatives import free_parameters
from ..functions.kernels import Theta
from ..operators import information as sums
from .engine import GPConfig, Plan, prepare


@dataclass
class Information:
    """Of a plan at one theta, by the parameters `names`; NaN throughout where any tile is singular."""

    names: tuple[str, ...]
    theta: Theta
    loglik: float
    gradient: np.ndarray
    observed: np.ndarray
    expected: np.ndarray

    def errors(self, kind: str = "observed") -> np.ndarray:
        """Standard errors: roots of the inverse information's diagonal; NaN where it has no positive inverse."""
        try:
            variance = np.diag(np.linalg.inv(getattr(self, kind)))
        except np.linalg.LinAlgError:
            variance = np.full(len(self.names), math.nan)
        return np.sqrt(np.where(variance > 0, variance, math.nan))


def information(plan: Plan, theta: Theta | None = None) -> Information:
    """Log-likelihood, gradient and both informations in one pass over the points.

    The first block is taken by the driver, so m may be no larger than the config's tile. No points: all are 0.
    """
    theta = theta or plan.config.theta
    kernel = plan.config.covariance(theta.nu)
    names = free_parameters(kernel)
    k = len(names)
    if not plan.n:
        return Information(names, theta, 0.0, np.zeros(k), np.zeros((k, k)), np.zeros((k, k)))
    if plan.m > plan.config.tile:
        raise ValueError(f"information needs m of at most a tile, {plan.config.tile}")
    ll, gradient, observed, expected, good = sums.block_scores(kernel, theta, *plan._block())
    if plan.m < plan.n:
        row = sums.partial_information(plan.neighbors, plan.m, kernel, theta).first()
        good = good and not row["bad"]
        ll, gradient = ll + row["ll"], gradient + np.array(row["gradient"])
        observed, expected = observed + np.reshape(row["observed"], (k, k)), expected + np.reshape(row["expected"], (k, k))
    if not good:
        ll, gradient, observed, expected = math.nan, gradient * math.nan, observed * math.nan, expected * math.nan
    return Information(names, theta, ll, gradient, observed, expected)


@dataclass
class ScoringFit:
    theta: Theta
    loglik: float
    steps: int
    trace: list[tuple[Theta, float]]
    at: Information

    def table(self, plan: Plan) -> DataFrame:
        """Rows (parameter, estimate, gradient, observed_error, expected_error)."""
        at = self.at
        columns = zip(at.names, at.theta.values(at.names), at.gradient, at.errors("observed"), at.errors("expected"))
        return plan.ranked.sparkSession.createDataFrame([(p, *map(float, x)) for p, *x in columns], "parameter string, estimate double, gradient double, observed_error double, expected_error double")


#: Parts of a step that are tried together, in one pass.
_LENGTHS = [2.0**-k for k in range(8)]


def fit_scoring(points: DataFrame | Plan, config: GPConfig) -> ScoringFit:
    """Fisher scoring in logarithms of the parameters, within the config's bounds.

    A step takes two passes: one for gradient and expected information, one for the likelihoods of the whole step and of
    its halvings; the best of these is taken. A parameter at a bound that the gradient points beyond stays there. It ends
    where no length gains more than tol of the likelihood's magnitude, or after maxiter steps. Raises ValueError if the
    likelihood at theta0 does not exist.
    """
    plan = points if isinstance(points, Plan) else prepare(points, config)
    at = information(plan, config.theta)
    if math.isnan(at.loglik):
        raise ValueError("the likelihood does not exist at theta0")
    every = ("sigma2", "range", "nu", "nugget")
    low, high = (np.array([b[every.index(p)] for p in at.names], float) for b in config.bounds)
    tol = 10.0**-config.tol if config.tol >= 1 else config.tol
    trace = [(at.theta, at.loglik)]
    for _ in range(config.maxiter):
        values = np.array(at.theta.values(at.names))
        here, slope, curve = np.log(values), at.gradient * values, at.expected * np.outer(values, values)
        free = ~((values <= low) & (slope < 0) | (values >= high) & (slope > 0))
        if not free.any():
            break
        step = np.zeros(len(here))
        step[free] = np.linalg.lstsq(curve[np.ix_(free, free)], slope[free], rcond=1e-12)[0]
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-300))  # no parameter by more than a factor of e**2
        tried = [replace(at.theta, **dict(zip(at.names, np.clip(np.exp(here + f * step), low, high).tolist()))) for f in _LENGTHS]
        found = [(-math.inf if math.isnan(v) else v, -i) for i, v in enumerate(plan.loglik_many(tried))]
        value, i = max(found)
        if value <= at.loglik:
            break
        gain, at = value - at.loglik, information(plan, tried[-i])
        trace.append((at.theta, at.loglik))
        if gain <= tol * abs(value):
            break
    return ScoringFit(at.theta, at.loglik, len(trace) - 1, trace, at)
