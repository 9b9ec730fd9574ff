import math
from dataclasses import replace

import numpy as np
import pytest

from geoquilt.functions.derivatives import Derivatives, free_parameters
from geoquilt.functions.kernels import KERNELS, MATERN_ANY, Theta
from geoquilt.operators.information import block_scores, scores
from geoquilt.operators.likelihood import block_term, conditional
from geoquilt.plans import engine, scoring

THETA = Theta(1.5, 0.3, 0.8, 0.2)
ALL = [*KERNELS.values(), MATERN_ANY]


def tiles(kernel, count=12, m=4):
    r = np.random.Generator(np.random.PCG64(3))
    scale = 40.0 if kernel.metric == "earth" else 1.0
    return [r.random(count) * scale, r.random(count) * scale, r.normal(size=count), r.random((count, m)) * scale, r.random((count, m)) * scale, r.normal(size=(count, m))]


def shifted(theta, p, by):
    return replace(theta, **{p: getattr(theta, p) * (1 + by)})


def slope(f, theta, p, h=1e-4):
    a, b, c, d = (f(shifted(theta, p, k * h)) for k in (-2, -1, 1, 2))
    return (a - 8 * b + 8 * c - d) / (12 * h * getattr(theta, p))


@pytest.mark.parametrize("kernel", ALL, ids=lambda k: k.name)
def test_derivatives_are_slopes(kernel):
    d = np.array([0.0, 1e-6, 0.03, 0.4, 2.0, 5.0]) * kernel.unit
    for p in free_parameters(kernel):
        assert np.allclose(Derivatives(kernel, d, THETA).first(p), slope(lambda t: kernel.array(d, t), THETA, p), rtol=1e-7, atol=1e-9)
        for q in free_parameters(kernel):
            assert np.allclose(Derivatives(kernel, d, THETA).second(p, q), slope(lambda t: Derivatives(kernel, d, t).first(p), THETA, q), rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("kernel", ALL, ids=lambda k: k.name)
def test_scores_are_slopes_of_the_likelihood(kernel):
    arrays = tiles(kernel)
    ll, gradient, observed, expected, good = scores(kernel, THETA, *arrays)
    assert good.all() and np.allclose(ll, conditional(kernel, THETA, *arrays)["ll"], rtol=1e-11)
    x, y, z = arrays[3][0], arrays[4][0], arrays[5][0]
    block = block_scores(kernel, THETA, x, y, z)
    assert block[0] == pytest.approx(block_term(kernel, THETA, x, y, z)["ll"], rel=1e-11)
    for i, p in enumerate(free_parameters(kernel)):
        assert np.allclose(gradient[:, i], slope(lambda t: conditional(kernel, t, *arrays)["ll"], THETA, p), rtol=1e-6, atol=1e-7)
        assert np.allclose(-observed[:, i], slope(lambda t: scores(kernel, t, *arrays)[1], THETA, p), rtol=1e-5, atol=1e-5)
        assert block[1][i] == pytest.approx(slope(lambda t: block_term(kernel, t, x, y, z)["ll"], THETA, p), rel=1e-6, abs=1e-8)
        assert np.allclose(-block[2][i], slope(lambda t: block_scores(kernel, t, x, y, z)[1], THETA, p), rtol=1e-5, atol=1e-5)


def test_expected_information_is_the_mean_of_the_observed():
    """Over observations drawn from the model: neighbours jointly, the target given them."""
    kernel, r = KERNELS["matern12"], np.random.Generator(np.random.PCG64(8))
    x, y, _, nx, ny, _ = (a[:1] for a in tiles(kernel))
    sites = np.r_[nx[0], x], np.r_[ny[0], y]
    d = np.hypot(sites[0][:, None] - sites[0], sites[1][:, None] - sites[1])
    drawn = r.normal(size=(40_000, 5)) @ np.linalg.cholesky(kernel.array(d, THETA)).T
    many = lambda a: np.repeat(a, len(drawn), 0)
    _, gradient, observed, expected, _ = scores(kernel, THETA, many(x), many(y), drawn[:, 4], many(nx), many(ny), drawn[:, :4])
    assert np.allclose(gradient.mean(0), 0, atol=0.1)
    assert np.allclose(observed.mean(0), expected[0], rtol=0.1, atol=0.02)
    assert np.allclose(np.cov(gradient.T), expected[0], rtol=0.1, atol=0.02)


def test_tiles_without_a_factor_count_as_bad():
    arrays = tiles(KERNELS["matern32"], 3)
    arrays[3][1], arrays[4][1] = 0.5, 0.5
    ll, gradient, observed, _, good = scores(KERNELS["matern32"], THETA, *arrays)
    assert good.tolist() == [True, False, True] and ll[1] == 0 and not gradient[1].any() and not observed[1].any()
    assert np.isfinite(gradient).all()
    ll, *_, good = block_scores(KERNELS["matern32"], THETA, np.zeros(2), np.zeros(2), np.ones(2))
    assert math.isnan(ll) and not good


def test_a_fit_by_scoring(spark):
    r = np.random.Generator(np.random.PCG64(5))
    x, y = r.random(120), r.random(120)
    k = KERNELS["powexp_nugget"].array(np.hypot(x[:, None] - x, y[:, None] - y), Theta(1.0, 0.2, 1.0, 0.1))
    z = np.linalg.cholesky(k) @ r.normal(size=120)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x, y, z))], "id long, x double, y double, z double").repartition(3)
    config = engine.GPConfig("univariate_powexp_nugget_stationary", (0.5, 0.5, 0.7, 0.3), 5, "sequential", lower=0.001, upper=(20.0, 20.0, 1.9, 5.0), tol=1e-9, maxiter=30)
    plan = engine.prepare(points, config)
    at = scoring.information(plan)
    assert at.loglik == pytest.approx(plan.loglik(), rel=1e-10)
    got = scoring.fit_scoring(plan, config)
    about = [(p, shifted(got.theta, p, f)) for p in at.names for f in (-0.02, 0.02)]
    within = [t for p, t in about if config.lower <= getattr(t, p) <= dict(zip(at.names, config.upper))[p]]
    assert len(within) >= 6 and got.loglik >= max(plan.loglik_many(within)) - 1e-6
    assert [v for _, v in got.trace] == sorted(v for _, v in got.trace)
    assert [r["parameter"] for r in got.table(plan).collect()] == list(at.names)
    small = engine.prepare(points, replace(config, tile=2))
    with pytest.raises(ValueError):
        scoring.information(small)
    none = scoring.information(engine.prepare(points.limit(0), config))
    assert none.loglik == 0 and not none.gradient.any()
