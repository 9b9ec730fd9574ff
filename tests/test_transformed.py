import math

import numpy as np
import pytest

from geoquilt.functions.tukey import Tukey
from geoquilt.plans import engine
from geoquilt.plans.transformed import fit_transformed, loglik_transformed

CASES = [Tukey(), Tukey(0.3, 2.0), Tukey(0.0, 1.0, 0.4), Tukey(-1.0, 0.5, 0.0, 0.2), Tukey(0.1, 1.5, -0.6, 0.3), Tukey(0.0, 1.0, 1e-9, 0.1)]


@pytest.mark.parametrize("t", CASES, ids=str)
def test_inverse_and_slope(t):
    u = np.r_[0.0, np.linspace(-6, 6, 401)]
    z = t.transformed(u)
    assert np.all(np.diff(z[1:]) > 0) and np.allclose(t.inverse(z), u, atol=1e-9)
    h = 1e-6
    assert np.allclose(t.log_slope(u), np.log((t.transformed(u + h) - t.transformed(u - h)) / (2 * h)), atol=1e-6)


def test_values_without_an_inverse():
    assert np.isnan(Tukey(0, 1, 0.5).inverse(np.array([-2.0, -3.0, math.nan, math.inf]))).all()
    assert Tukey(0, 1, 0.5, 0.1).inverse(np.array([-50.0]))[0] < -2
    for bad in ((0, 0), (0, 1, 0, -0.1), (0, math.nan)):
        with pytest.raises(ValueError):
            Tukey(*bad)


@pytest.fixture(scope="module")
def plan(spark):
    r = np.random.Generator(np.random.PCG64(6))
    x, y = r.random(150), r.random(150)
    k = np.exp(-np.hypot(x[:, None] - x, y[:, None] - y) / 0.1)
    z = Tukey(0.5, 2.0, 0.5, 0.1).transformed(np.linalg.cholesky(k) @ r.normal(size=150))
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(x, y, z))], "id long, x double, y double, z double").repartition(3)
    return engine.prepare(points, engine.GPConfig(theta0=(1.0, 0.1, 0.5), m=6, how="sequential"))


def test_likelihood(plan):
    theta = plan.config.theta
    plain, scaled, lost = loglik_transformed(plan, [(theta, Tukey()), (theta, Tukey(0.0, 3.0)), (theta, Tukey(0.0, 1.0, 9.0))])
    assert plain == pytest.approx(plan.loglik(), rel=1e-12) and math.isnan(lost)  # the Gaussian value where nothing bends
    thirds = engine.prepare(plan.ranked.selectExpr("id", "x", "y", "z / 3 as z"), plan.config)
    assert scaled == pytest.approx(thirds.loglik() - 150 * math.log(3), rel=1e-12)


def test_fit(plan):
    got = fit_transformed(plan, Tukey(0.0, 1.0, 0.1, 0.05), (0.01, -3.0, 0.1, 0.0, 0.0), (1.0, 3.0, 6.0, 1.5, 0.5), maxiter=150)
    truth = loglik_transformed(plan, [(plan.config.theta, Tukey(0.5, 2.0, 0.5, 0.1))])[0]
    assert got.loglik >= truth - 0.5 and 0.1 < got.tukey.g < 1.2
