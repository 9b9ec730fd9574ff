import numpy as np
import pytest

from geoquilt.functions.kernels import KERNELS, Theta
from geoquilt.operators import likelihood, mixed


def tiles(count, m, seed=1):
    r = np.random.Generator(np.random.PCG64(seed))
    return [r.random(count), r.random(count), r.normal(size=count), r.random((count, m)), r.random((count, m)), r.normal(size=(count, m))]


@pytest.mark.parametrize("name, reach", [("matern12", 0.1), ("matern32", 0.05), ("powexp_nugget", 0.3)])
def test_refined_terms_equal_double_ones(name, reach):
    arrays, theta = tiles(200, 20), Theta(1.5, reach, 0.5, 0.2)
    got, want = mixed.conditional(KERNELS[name], theta, *arrays), likelihood.conditional(KERNELS[name], theta, *arrays)
    assert (got["steps"] > 0).all() and (got["factor_bytes"] == 4 * 400).all()
    assert all(np.allclose(got[k], want[k], rtol=1e-8, atol=1e-10) for k in ("mu", "var", "quad", "logdet", "ll"))


def test_hard_tiles_are_factored_in_double():
    r = np.random.Generator(np.random.PCG64(2))
    q = np.linalg.qr(r.normal(size=(3, 12, 12)))[0]
    k = np.einsum("bij,j,bkj->bik", q, np.logspace(0, -11, 12), q)
    k[0] = np.eye(12)
    k[2, 1], k[2, :, 1] = k[2, 0], k[2, :, 0]  # a row twice: no factor in any precision
    k[2, 1, 1] = k[2, 0, 0] = k[2, 0, 1] - 1.0
    right = r.normal(size=(3, 12, 2))
    x, steps, good = mixed.refined(k, right)
    assert steps[0] >= 0 and steps[1] == steps[2] == -1 and good.tolist() == [True, True, False]
    assert np.allclose(k[1] @ x[1], right[1], atol=1e-4) and np.allclose(x[0], right[0])


def test_terms_through_spark(spark):
    arrays = tiles(30, 5, 3)
    rows = [(i, *(float(a[i]) for a in arrays[:3]), *(a[i].tolist() for a in arrays[3:])) for i in range(30)]
    rows[7] = (7, 0.5, 0.5, 1.0, [0.2] * 5, [0.2] * 5, [1.0] * 5)  # singular
    df = spark.createDataFrame(rows, "rank long, x double, y double, z double, nx array<double>, ny array<double>, nz array<double>").repartition(3)
    kernel, theta = KERNELS["matern32"], Theta(1.5, 0.2)
    got = {r["rank"]: r for r in mixed.terms(df, 5, kernel, theta).collect()}
    want = {r["rank"]: r for r in likelihood.terms(df, 5, kernel, theta).collect()}
    assert got[7]["status"] == want[7]["status"] == "singular" and got[7]["steps"] == -1
    assert all(got[i]["ll"] == pytest.approx(want[i]["ll"], rel=1e-9) for i in range(30) if i != 7)
    assert mixed.terms(df.limit(0), 5, kernel, theta).count() == 0


def test_memory_of_a_batch():
    """However many rows a batch has, its stacks take about 100 MB together."""
    import tracemalloc

    import pyarrow as pa

    from geoquilt.functions.kernels import KERNELS, Theta
    from geoquilt.operators import likelihood, mixed

    r, m, n = np.random.Generator(np.random.PCG64(7)), 30, 4000
    lists = [pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(r.random(n * m))) for _ in range(3)]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), *(pa.array(r.random(n)) for _ in range(3)), *lists], ["rank", "x", "y", "z", "nx", "ny", "nz"])
    for run, stacks in ((likelihood.conditional, 1), (mixed.conditional, 2)):
        tracemalloc.start()
        for _, *arrays in likelihood._chunks(batch, m, stacks):
            run(KERNELS["matern12"], Theta(1.5, 0.1), *arrays)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 100 << 20


def test_a_pair_is_formed_once():
    from geoquilt.functions.kernels import KERNELS, Theta, pair_distances
    from geoquilt.operators import likelihood

    class Counted:
        metric, pairs = "euclidean", 0

        def array(self, d, theta):
            self.pairs += d.size
            return KERNELS["powexp_nugget"].array(d, theta)

    r = np.random.Generator(np.random.PCG64(8))
    x, y = r.random((2, 40, 5))
    kernel, theta = Counted(), Theta(1.5, 0.1, 0.5, 0.2)
    want = KERNELS["powexp_nugget"].array(pair_distances("euclidean", x[:, :, None], y[:, :, None], x[:, None], y[:, None]), theta)
    assert (likelihood._tiles(kernel, theta, x, y) == want).all() and kernel.pairs == 40 * 10 + 1
