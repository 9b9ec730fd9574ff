"""Pairs of doubles, and terms of nearly singular tiles: against decimals of 80 digits, and against SQL on near copies."""

from decimal import Decimal, localcontext
from fractions import Fraction

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from geoquilt.functions import paired
from geoquilt.functions.kernels import KERNELS, Theta
from geoquilt.operators import likelihood
from geoquilt.plans.queries import ORACLES, QUERIES

ORDERS = {"matern12": 0, "matern32": 1, "matern52": 2}


def exact_term(name, theta, x, y, z, nx, ny, nz):
    """(var, quad, mu) of one target, by elimination in decimals."""
    with localcontext() as context:
        context.prec = 80
        px, py, pz = ([Decimal(float(v)) for v in (*near, own)] for near, own in ((nx, x), (ny, y), (nz, z)))
        n = len(px)

        def covariance(i, j):
            s = ((px[i] - px[j]) ** 2 + (py[i] - py[j]) ** 2).sqrt() / Decimal(theta.range)
            return Decimal(theta.sigma2) * (1, 1 + s, 1 + s + s * s / 3)[ORDERS[name]] * (-s).exp()

        rows = [[covariance(i, j) for j in range(n)] + [pz[i]] for i in range(n)]
        for p in range(n - 1):
            for i in range(p + 1, n):
                f = rows[i][p] / rows[p][p]
                rows[i] = [a - f * b for a, b in zip(rows[i], rows[p])]
        var, rest = rows[-1][-2:]
        return float(var), float(rest * rest / var), float(pz[-1] - rest)


def hard_tiles(count, m, seed=1):
    """Targets within a twentieth of the unit square, the first two neighbours 1e-6 apart."""
    r = np.random.Generator(np.random.PCG64(seed))
    nx, ny = r.random((2, count, m)) * 0.05
    nx[:, 1], ny[:, 1] = nx[:, 0] + 1e-6, ny[:, 0] - 1e-6
    return [r.random(count) * 0.05, r.random(count) * 0.05, r.normal(size=count), nx, ny, r.normal(size=(count, m))]


def spark_rows(spark, arrays):
    rows = [(i, *(float(a[i]) for a in arrays[:3]), *(a[i].tolist() for a in arrays[3:])) for i in range(len(arrays[0]))]
    return spark.createDataFrame(rows, "rank long, x double, y double, z double, nx array<double>, ny array<double>, nz array<double>").repartition(2)


def check_terms(rows, name, theta, arrays):
    for r in rows:
        var, quad, mu = exact_term(name, theta, *(a[r["rank"]] for a in arrays))
        assert r["status"] == "ok" and r["var"] == pytest.approx(var, rel=1e-12) and r["quad"] == pytest.approx(quad, rel=1e-11) and r["mu"] == pytest.approx(mu, rel=1e-11)


def test_arithmetic_is_exact_to_30_digits():
    r = np.random.Generator(np.random.PCG64(4))
    a, b = (paired.Pair(x, x * 2.0**-54 * r.random(50)) for x in r.random((2, 50)) + 0.5)
    exact = lambda p, i: Fraction(float(p.high[i])) + Fraction(float(p.low[i]))
    for got, want in ((paired.add(a, paired.minus(b)), lambda x, y: x - y), (paired.multiply(a, b), lambda x, y: x * y), (paired.divide(a, b), lambda x, y: x / y)):
        assert all(abs(exact(got, i) - want(exact(a, i), exact(b, i))) < Fraction(1, 10**30) for i in range(50))
    square = paired.root(a)
    assert all(abs(exact(square, i) ** 2 - exact(a, i)) < Fraction(1, 10**30) for i in range(50))
    s = np.array([0.0, 1e-9, 0.3, 7.0, 70.0, 650.0, 800.0])
    power = paired.exp_minus(paired.pair(s))
    with localcontext() as context:
        context.prec = 60
        assert all(abs((Decimal(float(power.high[i])) + Decimal(float(power.low[i]))) / Decimal(-float(x)).exp() - 1) < Decimal("1e-24") for i, x in enumerate(s[:-1]))
    assert power.high[0] == 1 and power.low[0] == 0 and power.high[-1] == 0


@pytest.mark.parametrize("name", ORDERS)
def test_terms_of_near_copies(spark, name):
    arrays, theta = hard_tiles(6, 12), Theta(1.5, 0.1)
    check_terms(likelihood.terms(spark_rows(spark, arrays), 12, KERNELS[name], theta).collect(), name, theta, arrays)


def test_coinciding_neighbours_are_singular():
    arrays = hard_tiles(5, 12)
    arrays[3][2, 7], arrays[4][2, 7] = arrays[3][2, 3], arrays[4][2, 3]
    got = likelihood.conditional_pairs(KERNELS["matern52"], Theta(1.5, 0.1), *arrays)
    assert got["status"].tolist() == ["ok", "ok", "singular", "ok", "ok"] and np.isnan(got["ll"]).tolist() == [False, False, True, False, False]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    """400 vectors, every other one a near copy of the one before."""
    r = np.random.Generator(np.random.PCG64(6))
    e = r.uniform(-0.2, 0.2, (400, 4))
    e[1::2] = e[::2] + r.normal(0, 2e-4, (200, 4))
    folder = tmp_path_factory.mktemp("copies")
    pq.write_table(pa.table({"vec_id": np.arange(400), "embedding": pa.array(e.astype(np.float32).tolist(), pa.list_(pa.float32()))}), folder / "embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", ["terms_m10_matern52_far", "terms_m30_matern52", "terms_mixed_m30_matern52", "terms_seq_m10"])
def test_query_equals_sql_on_near_copies(spark, copies, name):
    got = QUERIES[name](spark, str(copies))
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from '{copies}/embeddings.parquet'")
    want = duck.execute(ORACLES[name])
    assert got.columns == [d[0] for d in want.description]
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
