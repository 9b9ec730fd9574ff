"""Non-Gaussian likelihoods and fits: observations as Tukey's g-and-h transform of a Gaussian field."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from ..functions.kernels import Theta
from ..functions.tukey import Tukey
from ..operators.transformed import transformed_block, transformed_sums
from .engine import Plan
from .optimize import maximise


def loglik_transformed(plan: Plan, cases: list[tuple[Theta, Tukey]]) -> list[float]:
    """Log-likelihoods of several parameters in one pass; NaN where a tile is singular or a value has no inverse.

    The plan's smoothness holds for all. m may be no larger than the config's tile. Without points all are 0.
    """
    if not plan.n:
        return [0.0] * len(cases)
    if plan.m > plan.config.tile:
        raise ValueError(f"m must be at most a tile, {plan.config.tile}")
    kernel = plan.config.covariance()
    first = [transformed_block(kernel, theta, tukey, *plan._block()) for theta, tukey in cases]
    if plan.m >= plan.n:
        return first
    rows = {x["case_id"]: x for x in transformed_sums(plan.neighbors, plan.m, kernel, cases).collect()}
    return [math.nan if i in rows and rows[i]["bad"] else f + (rows[i]["ll"] if i in rows else 0.0) for i, f in enumerate(first)]


@dataclass
class TransformedFit:
    theta: Theta
    tukey: Tukey
    loglik: float
    evaluations: int


def fit_transformed(plan: Plan, start: Tukey, lower: tuple[float, ...], upper: tuple[float, ...], tol: float = 1e-5, maxiter: int = 200) -> TransformedFit:
    """Maximum likelihood over (range, xi, omega, g, h) within bounds given in that order. The field's variance is the
    config's, as omega scales it already; so are smoothness and nugget."""
    theta = plan.config.theta

    def case(x):
        return replace(theta, range=x[0]), Tukey(*x[1:])

    best = maximise(lambda xs: loglik_transformed(plan, [case(x) for x in xs]), [theta.range, start.xi, start.omega, start.g, start.h], list(lower), list(upper), tol, maxiter)
    return TransformedFit(*case(best.x), best.value, best.evaluations)
