import math

import numpy as np
import pytest

from geoquilt.functions.bessel import matern, scaled_k
from geoquilt.functions.kernels import KERNELS, MATERN_ANY, Theta, kernel_for
from geoquilt.operators.exact import joint_term
from geoquilt.operators.likelihood import block_term


@pytest.mark.parametrize("kernel, n, tile", [("matern12", 70, 16), ("powexp_nugget", 48, 16), ("matern32", 9, 20)])
def test_tiles_give_the_whole_matrix(spark, kernel, n, tile):
    r = np.random.Generator(np.random.PCG64(n))
    rows = [(i, *map(float, v)) for i, v in enumerate(r.random((n, 3)))]
    df = spark.createDataFrame(rows, "rank long, x double, y double, z double").repartition(3)
    theta = Theta(1.5, 0.1, 0.5, 0.2)
    got, want = joint_term(df, n, KERNELS[kernel], theta, tile), block_term(KERNELS[kernel], theta, *np.array(rows)[:, 1:].T)
    assert got["status"] == want["status"] == "ok"
    assert all(got[k] == pytest.approx(want[k], rel=1e-10) for k in ("quad", "logdet", "ll"))


def test_what_has_no_factor(spark):
    df = spark.createDataFrame([(i, 0.5, 0.5, 1.0) for i in range(6)], "rank long, x double, y double, z double")
    got = joint_term(df, 6, KERNELS["matern12"], Theta(1.0, 0.1), 2)
    assert got["status"] == "singular" and math.isnan(got["ll"])
    assert joint_term(df.limit(0), 0, KERNELS["matern12"], Theta(1.0, 0.1))["ll"] == 0


def test_bessel_against_its_integral():
    t = np.linspace(0, 12, 200_001)
    for nu in (0.0, 0.003, 0.05, 0.3, 0.49, 0.5, 0.77, 1.0, 1.5, 3.3, 4.9):
        for x in (0.01, 0.3, 1.99, 2.0, 2.01, 10.0, 50.0):
            want = np.trapezoid(np.exp(-x * (np.cosh(t) - 1)) * np.cosh(nu * t), t)
            assert scaled_k(np.array([x]), nu)[0] == pytest.approx(want, rel=1e-12)


def test_matern_has_its_closed_forms():
    s = np.r_[0.0, 1e-300, 1e-9, np.logspace(-6, 2.8, 500)]
    for nu, f in ((0.5, 1 + 0 * s), (1.5, 1 + s), (2.5, 1 + s + s * s / 3), (3.5, 1 + s + 0.4 * s * s + s**3 / 15)):
        assert np.allclose(matern(s, nu), f * np.exp(-s), rtol=1e-11, atol=0)
    assert matern(np.array([800.0]), 1.2)[0] == 0
    assert kernel_for("univariate_matern_any_smoothness", 1.3) is MATERN_ANY
    with pytest.raises(ValueError):
        kernel_for("univariate_matern_any_smoothness", 0.0)
    with pytest.raises(ValueError):
        MATERN_ANY.sql("d", Theta(1.0, 1.0))


def test_the_factor_is_written_once_and_goes(spark):
    """Nothing but the points is shuffled, and no tile stays."""
    from geoquilt.sources.work import work_folder

    import os

    r = np.random.Generator(np.random.PCG64(5))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(r.random((640, 3)))], "rank long, x double, y double, z double")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert joint_term(df, 640, KERNELS["matern12"], Theta(1.5, 0.1), 16)["status"] == "ok"
    assert written() - before < 640 * 640 * 8 / 2 / 10
    assert not [x for x in os.listdir(work_folder(spark).removeprefix("file://")) if x.startswith("tiles-")]


def test_no_task_works_alone_along_a_row(spark, monkeypatch):
    """Ten panels: what runs by itself reads a tile or two, and each task reads its tiles by few scans."""
    from pyspark.sql import readwriter

    from geoquilt.operators import exact

    monkeypatch.setattr(exact, "_WIDE", 16)
    r = np.random.Generator(np.random.PCG64(9))
    rows = [(i, *map(float, v)) for i, v in enumerate(r.random((160, 3)))]
    df = spark.createDataFrame(rows, "rank long, x double, y double, z double")
    scans, read = [], readwriter.DataFrameReader.parquet
    monkeypatch.setattr(readwriter.DataFrameReader, "parquet", lambda self, *paths, **more: (scans.append(len(paths)), read(self, *paths, **more))[1])
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    seen = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
    got = joint_term(df, 160, KERNELS["matern12"], Theta(1.5, 0.1), 16)
    want = block_term(KERNELS["matern12"], Theta(1.5, 0.1), *np.array(rows)[:, 1:].T)
    assert got["ll"] == pytest.approx(want["ll"], rel=1e-10)
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    new = [s for s in (stages().apply(i) for i in range(stages().size())) if s.stageId() > seen]
    alone = [s.inputRecords() for s in new if s.numTasks() == 1 and s.inputRecords()]
    assert max(alone) <= 4  # a row has up to ten
    assert len(scans) < 10**3 / 6
