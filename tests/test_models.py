import math
from dataclasses import replace

import numpy as np
import pytest

from geoquilt.functions.models import Multivariate, NonStationary, SpaceTime, correlation
from geoquilt.operators.cells import knn_cells
from geoquilt.operators.modelled import _covariances, block_term, conditional
from geoquilt.plans.modelled import prepare

TWO = Multivariate((1.5, 0.8), 0.3, (0.5, 1.7), ((1.0, 0.5), (0.5, 1.0)), 0.05)
TIME = SpaceTime(1.5, 0.2, 0.8, 0.1, 0.7, 0.6, 0.1)
LOCAL = NonStationary(1.5, 0.05)


def sites(n, model, seed=1):
    r = np.random.Generator(np.random.PCG64(seed))
    return [r.random(n) + 0.2 for _ in model.columns], r.normal(size=(n, model.variables))


@pytest.mark.parametrize("model", [TWO, TIME, LOCAL], ids=lambda m: type(m).__name__)
def test_matrices_are_covariances_and_terms_are_conditionals(model):
    at, z = sites(40, model)
    k = _covariances(model, [a[None] for a in at], [a[None] for a in at], True)[0]
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > 0
    got = conditional(model, [a[-1:] for a in at], z[-1:], [a[None, :-1] for a in at], z[None, :-1])
    whole, before = block_term(model, at, z), block_term(model, [a[:-1] for a in at], z[:-1])
    assert got["status"].tolist() == ["ok"] and got["ll"][0] == pytest.approx(whole - before, rel=1e-9)


def test_special_cases():
    at, _ = sites(10, TWO)
    a, b = [x[:, None] for x in at], [x[None] for x in at]
    d = np.hypot(a[0] - b[0], a[1] - b[1])
    assert np.allclose(TWO.array(a, b, 0, 1), 0.5 * math.sqrt(1.2) * correlation(d / 0.3, 1.1))
    now = [*at, np.zeros(10)]
    assert np.allclose(TIME.array([x[:, None] for x in now], [x[None] for x in now]), 1.5 * correlation(d / 0.2, 0.8))  # at one time
    apart = replace(TIME, beta=0.0)
    times = np.arange(10.0)
    u = np.abs(times[:, None] - times)
    assert np.allclose(apart.array([*a, times[:, None]], [*b, times[None]]), apart.array([*a, 0 * u], [*b, 0 * u]) / ((u / 0.1) ** 1.4 + 1))  # separable
    flat = [*at, np.full(10, 1.3), np.full(10, 0.4)]
    assert np.allclose(LOCAL.array([x[:, None] for x in flat], [x[None] for x in flat]), 1.69 * correlation(d / 0.4, 1.5))


def test_what_is_no_covariance():
    with pytest.raises(ValueError):
        replace(TWO, rho=((1.0, 0.95), (0.95, 1.0)))  # the smoothnesses allow 0.84
    with pytest.raises(ValueError):
        replace(TWO, rho=((1.0, 0.5), (0.4, 1.0)))
    with pytest.raises(ValueError):
        replace(TIME, time_nu=1.2)
    with pytest.raises(ValueError):
        NonStationary(0.0)
    with pytest.raises(ValueError):
        TIME.sql("a", "b")


def frame(spark, model, n, seed=2):
    at, z = sites(n, model, seed)
    names = ", ".join(f"{c} double" for c in model.columns)
    return spark.createDataFrame([(i, *map(float, [a[i] for a in at]), z[i].tolist()) for i in range(n)], f"id long, {names}, z array<double>").repartition(3), at, z


@pytest.mark.parametrize("model", [TWO, LOCAL], ids=lambda m: type(m).__name__)
def test_all_neighbours_give_the_exact_likelihood(spark, model):
    df, at, z = frame(spark, model, 30)
    assert prepare(df, model, 99).loglik(model) == pytest.approx(block_term(model, at, z), rel=1e-9)


def test_odd_sites(spark):
    df, _, _ = frame(spark, TWO, 6)
    for bad in ("array(1D)", "array(1D, null)", "array(1D, double('nan'))", "null"):
        with pytest.raises(ValueError):
            prepare(df.selectExpr("id", "x", "y", f"if(id = 3, {bad}, z) z"), TWO, 2)
    with pytest.raises(ValueError):
        prepare(df.selectExpr("id", "if(id = 3, null, x) x", "y", "z"), TWO, 2)
    with pytest.raises(ValueError):
        prepare(df, TWO, 5, most_block=8)
    assert prepare(df.limit(0), TWO, 2).loglik(TWO) == 0
    extra = df.selectExpr("*", "7 as rank", "8 as code", "9 as nz")  # columns that clash are not read
    assert prepare(extra, TWO, 2, "knn_grid").loglik(TWO) == pytest.approx(prepare(df, TWO, 2, "knn_grid").loglik(TWO))


def test_neighbours_in_space_and_time(spark):
    """Against brute force, with a dense cluster, equal sites and one far point."""
    r = np.random.Generator(np.random.PCG64(4))
    p = np.r_[r.random((150, 3)), r.random((80, 3)) * 1e-4 + 0.5, np.repeat(r.random((1, 3)), 12, 0), [[9.0, 9.0, 9.0]]]
    p = p[r.permutation(len(p))]
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "rank long, x double, y double, t double").repartition(3)
    got = {(e["rank"], e["k"]): e["dist"] for e in knn_cells(df, 3, "spacetime").collect()}
    for i in range(3, len(p)):
        want = np.sort(np.sqrt(((p[:i] - p[i]) ** 2).sum(1)))[:3]
        assert [got[i, k] for k in (1, 2, 3)] == pytest.approx(want.tolist(), abs=1e-12)
    assert len(got) == 3 * (len(p) - 3)
