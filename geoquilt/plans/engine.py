"""From points to likelihoods: one performance evaluation, a maximum-likelihood fit, and divergence from the exact model."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import flops
from ..functions.kernels import EARTH_SCALE_KM, FAMILIES, Kernel, Theta, kernel_for
from ..operators import likelihood
from ..operators.exact import joint_term
from ..operators.neighbors import conditioning, first_block
from ..operators.ordering import ordered
from ..sources import points as sources
from ..sources import sinks
from ..sources.work import cut
from .optimize import maximise


@dataclass(frozen=True)
class GPConfig:
    """What a run is told.

    kernel: a family of functions.kernels.FAMILIES. theta0: sigma2, range, smoothness[, nugget], None for the default
    (1, 0.1, 0.5, 0). m: conditioning size. how: knn (cells that follow the density), knn_grid (uniform cells, fewer jobs,
    for sites that are spread evenly) or sequential. tile: points taken jointly in one process; more are factored by tiles. order: morton, random or none. metric: euclidean, or
    earth for latitude and longitude. quantise: keep Morton's 16-bit coordinates. lower and upper: bounds, one
    number for every parameter or one for each. tol: relative change at which a fit stops, or its negative power of ten if 1 or more.
    """

    kernel: str = "univariate_matern_stationary_no_nugget"
    theta0: tuple[float | None, ...] = ()
    m: int = 30
    how: str = "knn"
    order: str = "morton"
    metric: str = "euclidean"
    quantise: bool = False
    seed: int = 0
    lower: float | tuple[float, ...] = 0.001
    upper: float | tuple[float, ...] = 2.0
    tol: float = 1e-5
    maxiter: int = 1000
    earth_scale: float = EARTH_SCALE_KM
    tile: int = 1024

    def __post_init__(self):
        checks = [
            (self.kernel in FAMILIES, f"kernel must be one of {', '.join(FAMILIES)}"), (isinstance(self.m, int) and self.m >= 1, "m must be a positive integer"),
            (self.how in ("knn", "knn_grid", "sequential"), "how must be knn, knn_grid or sequential"), (self.tile >= 1, "tile must be positive"), (self.order in ("morton", "random", "none"), "order must be morton, random or none"),
            (self.metric in ("euclidean", "earth"), "metric must be euclidean or earth"), (all(0 < a <= b for a, b in zip(*self.bounds)) and len(self.bounds[0]) == len(self.bounds[1]) == FAMILIES.get(self.kernel, 3), "bounds must be positive, in order and one or as many as parameters"),
            (len(self.theta0) in (0, FAMILIES.get(self.kernel, 3)), f"theta0 must have {FAMILIES.get(self.kernel)} values"), (self.maxiter >= 1 and self.tol > 0, "maxiter and tol must be positive"),
        ]
        for held, message in checks:
            if not held:
                raise ValueError(message)

    @property
    def bounds(self) -> tuple[list[float], list[float]]:
        each = lambda b: list(b) if isinstance(b, (tuple, list)) else [b] * FAMILIES.get(self.kernel, 3)
        return each(self.lower), each(self.upper)

    @property
    def theta(self) -> Theta:
        given = [*self.theta0, *[None] * 4][:4]
        return Theta(*[d if v is None else float(v) for v, d in zip(given, (1.0, 0.1, 0.5, 0.0))])

    def covariance(self, nu: float | None = None) -> Kernel:
        return kernel_for(self.kernel, self.theta.nu if nu is None else nu, self.metric, self.earth_scale)


@dataclass
class Plan:
    """Ordered points with their conditioning sets; what every evaluation shares, cut from its lineage once."""

    config: GPConfig
    ranked: DataFrame
    neighbors: DataFrame
    n: int
    m: int
    seconds: dict[str, float] = field(default_factory=dict)
    first: object = None

    def _block(self, z_zero: bool = False):
        """The first block's m points, `tile` at most, fetched once."""
        if self.first is None:
            self.first = first_block(self.ranked, self.m).select("rank", "x", "y", "z").toPandas().sort_values("rank")
        rows = self.first
        return rows["x"].to_numpy(float), rows["y"].to_numpy(float), np.zeros(len(rows)) if z_zero else rows["z"].to_numpy(float)

    def loglik_many(self, thetas: list[Theta], z_zero: bool = False) -> list[float]:
        """Log-likelihoods of several parameters in one pass over the points; NaN where a tile is singular."""
        if not self.n:
            return [0.0] * len(thetas)
        kernel = self.config.covariance(thetas[0].nu if self.config.kernel.startswith("univariate_matern") else None)
        first = [self.joint_term(t, z_zero, kernel)["ll"] for t in thetas]
        if self.m >= self.n:
            return first
        rows = self.neighbors
        if z_zero:
            rows = rows.withColumn("z", F.lit(0.0)).withColumn("nz", F.transform("nz", lambda _: F.lit(0.0)))
        sums = {x["theta_id"]: x for x in likelihood.partial_sums(rows, self.m, kernel, thetas).collect()}
        return [math.nan if i in sums and sums[i]["bad"] else f + (sums[i]["ll"] if i in sums else 0.0) for i, f in enumerate(first)]

    def joint_term(self, theta: Theta, z_zero: bool = False, kernel: Kernel | None = None) -> dict:
        """The first block's term; the driver factors it only if it is no larger than a tile."""
        kernel = kernel or self.config.covariance(theta.nu)
        if self.m <= self.config.tile:
            return likelihood.block_term(kernel, theta, *self._block(z_zero))
        rows = first_block(self.ranked, self.m)
        return joint_term(rows.withColumn("z", F.lit(0.0)) if z_zero else rows, self.m, kernel, theta, self.config.tile)

    def loglik(self, theta: Theta | None = None, z_zero: bool = False) -> float:
        return self.loglik_many([theta or self.config.theta], z_zero)[0]

    def terms(self, theta: Theta | None = None) -> DataFrame:
        return likelihood.terms(self.neighbors, self.m, self.config.covariance(), theta or self.config.theta)


def prepare(points: DataFrame, config: GPConfig) -> Plan:
    """points (id, x, y, z) ordered, with neighbours. m beyond n becomes n, which makes the likelihood exact.

    With the earth metric, or coordinates outside [0, 1], Morton codes are taken of rescaled coordinates and none is
    quantised. Ids must be distinct. Null, NaN or infinite numbers raise ValueError, as no distance or likelihood has a
    value with them.
    """
    began = time.perf_counter()
    points = cut(points.select("id", "x", "y", "z"))
    fine = F.coalesce(F.abs("x") + F.abs("y") + F.abs("z") < float("inf"), F.lit(False))  # NaN is above all numbers
    box = points.agg(F.count("*").alias("n"), F.min(F.least("x", "y")).alias("low"), F.max(F.greatest("x", "y")).alias("high"), F.count_if(~fine).alias("odd")).first()
    if box["odd"]:
        raise ValueError(f"{box['odd']} points have a null, NaN or infinite number")
    n = box["n"]
    rescale = config.metric == "earth" or (n > 0 and (box["low"] < 0 or box["high"] > 1))
    ranked = cut(ordered(points, config.order, config.quantise and not rescale, rescale))
    middle = time.perf_counter()
    m = max(1, min(config.m, n))
    neighbors = conditioning(ranked, m, config.how, config.metric, n)
    return Plan(config, ranked, neighbors, n, m, {"ordering": middle - began, "neighbours": time.perf_counter() - middle})


@dataclass
class FitResult:
    theta: Theta
    loglik: float
    evaluations: int
    trace: list[tuple]
    fit_log: DataFrame
    trace_log: DataFrame


def _theta(values: list[float], kernel: str) -> Theta:
    return Theta(*values[: FAMILIES[kernel]])


def fit(points: DataFrame | Plan, config: GPConfig) -> FitResult:
    """Maximum likelihood within the bounds; Matern keeps its smoothness unless its family is of any smoothness. Without theta0 the search begins at the lower bounds."""
    plan = points if isinstance(points, Plan) else prepare(points, config)
    began = time.perf_counter()
    low, high = config.bounds
    start = [b if v is None else float(v) for v, b in zip(config.theta0 or [None] * len(low), low)]
    if config.kernel == "univariate_matern_stationary_no_nugget":
        config.covariance()  # raises for an unknown smoothness
        low[2] = high[2] = start[2] = config.theta.nu
    tol = 10.0**-config.tol if config.tol >= 1 else config.tol
    best = maximise(lambda xs: plan.loglik_many([_theta(x, config.kernel) for x in xs]), start, low, high, tol, config.maxiter)
    theta = _theta(best.x, config.kernel)
    trace = [((*x, 0.0)[:4], v) for x, v in best.trace]
    spark = plan.ranked.sparkSession
    return FitResult(theta, best.value, best.evaluations, trace, sinks.fit_log(spark, best.evaluations, theta, best.value, config.order, time.perf_counter() - began), sinks.trace_log(spark, [(*x, v) for x, v in trace]))


def perf(spark: SparkSession, n: int, config: GPConfig) -> tuple[float, DataFrame]:
    """One evaluation at theta0 on the synthetic grid: its log-likelihood and (stage, seconds, gflops)."""
    points = sources.synthetic(spark, n, config.seed, "morton").select(F.col("rank").alias("id"), "x", "y", "z")
    plan = prepare(points, replace(config, order="none" if config.order == "morton" else config.order))
    began = time.perf_counter()
    value = plan.loglik()
    total = time.perf_counter() - began
    stages = {x["stage"]: x["seconds"] for x in likelihood.stage_seconds(plan.neighbors, plan.m, config.covariance(), config.theta).collect()}
    work = flops.evaluation(plan.n - plan.m + 1, plan.m)
    of = {"cholesky": "potrf", "triangular solve": "trsm", "quadratic": "dot"}
    rows = [("total", total, work["total"] / total), *((k, v, None) for k, v in plan.seconds.items())]
    rows += [(k, float(stages.get(k, 0.0)), work[of[k]] / stages[k] if of.get(k) and stages.get(k) else None) for k in likelihood.STAGES]
    return value, sinks.perf_log(spark, rows)


def _resized(plan: Plan, m: int) -> Plan:
    """The plan with m neighbours, over the same order."""
    size = max(1, min(m, plan.n))
    return replace(plan, config=replace(plan.config, m=m), m=size, first=None, neighbors=conditioning(plan.ranked, size, plan.config.how, plan.config.metric, plan.n))


def kl_divergences(points: DataFrame, config: GPConfig, sizes: tuple[int, ...]) -> list[float]:
    """Of the approximations with so many neighbours from the exact model, which is factored once, by tiles: the differences of log-likelihoods at z = 0."""
    plan = prepare(points, replace(config, m=sizes[0]))  # the order does not depend on m
    plans = [plan, *(_resized(plan, m) for m in sizes[1:])]
    n = max(1, plan.n)
    exact = replace(plan, config=replace(config, m=n), m=n, first=None).loglik(z_zero=True)
    return [exact - p.loglik(z_zero=True) for p in plans]


def kl_divergence(points: DataFrame, config: GPConfig) -> float:
    return kl_divergences(points, config, (config.m,))[0]
