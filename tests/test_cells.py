import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.operators.cells import knn_cells
from geoquilt.operators.neighbors import knn_exact
from geoquilt.operators.ordering import ordered
from geoquilt.sources.work import cut


def points(spark, xy):
    return spark.createDataFrame([(i, float(a), float(b), 0.0) for i, (a, b) in enumerate(xy)], "id long, x double, y double, z double")


def pairs(edges):
    return {(x["rank"], x.k, x.nrank, round(x.dist, 9)) for x in edges.collect()}


R = np.random.Generator(np.random.PCG64(1))
CASES = {
    "one cluster and two far points": ("euclidean", np.vstack([R.normal(0.5, 1e-4, (398, 2)), [[0, 0], [1, 1]]])),
    "many on one spot": ("euclidean", np.vstack([np.full((150, 2), 0.3), R.integers(0, 4, (100, 2)) / 4, R.random((150, 2))])),
    "around the earth": ("earth", np.vstack([np.c_[R.uniform(-90, 90, 300), R.uniform(-180, 180, 300)], [[10, 180], [10, -180], [90, 5], [90, 60]]])),
}


@pytest.mark.parametrize("name", CASES)
def test_equals_comparing_all(spark, name):
    metric, xy = CASES[name]
    p = cut(ordered(points(spark, xy), "random", rescale=metric == "earth"))
    assert pairs(knn_cells(p, 4, metric)) == pairs(knn_exact(p, 4, metric))


def test_few_and_odd_points(spark):
    p = ordered(points(spark, [(0.1, 0.2), (0.3, 0.4), (0.5, 0.6)]), "none")
    assert knn_cells(p, 3).count() == 0
    assert pairs(knn_cells(p, 2)) == pairs(knn_exact(p, 2))
    with pytest.raises(ValueError):
        knn_cells(ordered(points(spark, [(0.1, float("nan")), (0.3, 0.4)]), "none"), 1)


@pytest.mark.parametrize("order", ["random", "morton"])
@pytest.mark.parametrize("name", CASES)
def test_small_tiles_that_visit_each_other(spark, name, order):
    metric, xy = CASES[name]
    p = cut(ordered(points(spark, xy), order, rescale=True))
    assert pairs(knn_cells(p, 2, metric, cap=20)) == pairs(knn_exact(p, 2, metric))


def test_shuffled_bytes_a_point(spark):
    """A point and its lists travel a few times, not once for each level of a tree."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    xy = np.random.Generator(np.random.PCG64(2)).random((20_000, 2)) ** 4
    p = cut(ordered(points(spark, xy), "random"))
    before = written()
    assert knn_cells(p, 4, cap=4000).count() == 4 * (20_000 - 4)
    assert written() - before < 20_000 * 1500


def test_space_and_time_in_small_tiles(spark):
    from geoquilt.operators.modelled import nearby

    r = np.random.Generator(np.random.PCG64(3)).integers(0, 9, (300, 3)) / 8
    r = r[np.argsort(r[:, 2], kind="stable")]
    df = cut(spark.createDataFrame([(i, *map(float, v), [float(i)]) for i, v in enumerate(r)], "rank long, x double, y double, t double, z array<double>"))
    got = {x["rank"]: (x.n_t, x.nz) for x in nearby(df, 3, ("x", "y", "t"), 2.0).collect()}
    small = {(x["rank"], x.k, x.nrank) for x in knn_cells(df.withColumn("t", F.col("t") * 2), 3, "spacetime", cap=30).collect()}
    assert len(got) == 297 and len(small) == 3 * 297
    for i in range(3, 300):
        d = np.sqrt(((r[:i] - r[i]) ** 2 * (1, 1, 4)).sum(1))
        want = sorted(range(i), key=lambda j: (d[j], j))[:3]
        assert got[i] == ([float(r[j, 2]) for j in want], [[float(j)] for j in want])
        assert {(i, k + 1, j) for k, j in enumerate(want)} <= small
