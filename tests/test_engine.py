"""Goldens computed independently of this engine, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoquilt.functions import columns, flops, kernels, matrices
from geoquilt.functions.kernels import Theta
from geoquilt.operators import likelihood, neighbors, ordering
from geoquilt.plans import engine, optimize
from geoquilt.sources import points as sources
from geoquilt.sources import sinks

MATERN, POWER, NUGGET, _ = kernels.FAMILIES
P6 = [(0, 0.10, 0.20, 0.5), (1, 0.40, 0.25, -0.3), (2, 0.35, 0.70, 1.1), (3, 0.80, 0.60, 0.2), (4, 0.55, 0.90, -0.7), (5, 0.90, 0.15, 0.4)]


@pytest.fixture(scope="module")
def p6(spark):
    return spark.createDataFrame(P6, "id long, x double, y double, z double")


def test_morton(spark, p6):
    q = [columns.quantised(F.col(c)) for c in "xy"]
    rows = p6.select("id", *q, columns.morton_encode(*q).alias("code")).withColumn("bx", columns.morton_decode_x(F.col("code"))).withColumn("by", columns.morton_decode_y(F.col("code"))).collect()
    assert [r["code"] for r in sorted(rows)] == [189483854, 873731092, 2605402955, 3537031890, 3900209272, 1547451452]
    assert all((r[1], r[2]) == (r["bx"], r["by"]) for r in rows)
    assert [r["id"] for r in ordering.ordered(p6).orderBy("rank").collect()] == [0, 1, 5, 2, 3, 4]


def test_haversine(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (24.7, 46.7, 21.5, 39.2), (1.0, 2.0, 1.0, 2.0), (0.0, 179.5, 0.0, -179.5), (90.0, 0.0, 90.0, 77.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(columns.haversine(*map(F.col, "abcd"))).collect()]
    assert got[:3] == pytest.approx([111.19492664455873, 845.3880496459116, 0], abs=1e-9) and got[3] == pytest.approx(got[0]) and got[4] == pytest.approx(0, abs=1e-9)
    assert kernels.pair_distances("earth", 24.7, 46.7, 21.5, 39.2) == pytest.approx(got[1])
    assert spark.range(1).select(columns.rad2deg(columns.deg2rad(F.lit(33.0)))).first()[0] == pytest.approx(33)


@pytest.mark.parametrize("name,want", [
    ("matern12", [1.5, 0.909795989569, 0.551819161757, 0.010106920499]), ("matern32", [1.5, 1.364693984353, 1.103638323514, 0.060641522992]),
    ("matern52", [1.5, 1.440510316818, 1.2875780441, 0.14486586048]), ("powexp", [1.5, 0.160316888491, 0.063493829435, 0.001273988557]), ("powexp_nugget", [1.7, 0.160316888491, 0.063493829435, 0.001273988557]),
])
def test_kernels(spark, name, want):
    theta, d = Theta(1.5, 0.1, 0.5, 0.2), [0.0, 0.05, 0.1, 0.5]
    assert kernels.KERNELS[name].array(np.array(d), theta) == pytest.approx(want)
    frame = spark.createDataFrame([(x,) for x in d], "d double")
    assert [r[0] for r in frame.select(kernels.KERNELS[name].column(F.col("d"), theta)).collect()] == pytest.approx(want)


@pytest.mark.parametrize("family,nu,nugget,m,knn,sequential,zero", [
    (MATERN, 0.5, 0, 1, -7.5116095829, -7.4832960439, -6.7269770124), (MATERN, 0.5, 0, 2, -7.5128163496, -7.5123581714, -6.7267500982), (MATERN, 0.5, 0, 6, -7.5126515713, -7.5126515713, -6.7267499199),
    (MATERN, 1.5, 0, 3, -7.6151187970, -7.6113392198, -6.6747688959), (MATERN, 2.5, 0, 2, -7.7150258852, -7.7078213310, -6.5441846040), (POWER, 0.5, 0, 2, -7.4797069257, -7.4796643684, -6.7300018665),
    (NUGGET, 0.5, 0.2, 1, -7.7666355905, -7.7648796463, -7.1054987477), (NUGGET, 0.5, 0.2, 9, -7.7666359997, -7.7666359997, -7.1054966951),
])
def test_log_likelihoods(p6, family, nu, nugget, m, knn, sequential, zero):
    config = engine.GPConfig(family, (1.5, 0.1, nu, nugget)[: kernels.FAMILIES[family]], m, order="none")
    plan = engine.prepare(p6, config)
    assert plan.loglik() == pytest.approx(knn, abs=1e-9)
    assert plan.loglik(z_zero=True) == pytest.approx(zero, abs=1e-9)
    assert engine.prepare(p6, engine.replace(config, how="sequential")).loglik() == pytest.approx(sequential, abs=1e-9)


def test_terms(p6):
    plan = engine.prepare(p6, engine.GPConfig(MATERN, (1.5, 0.1, 0.5), 2, order="none"))
    rows = {r["rank"]: r for r in plan.terms().collect()}
    assert [rows[k]["mu"] for k in (2, 3, 4, 5)] == pytest.approx([-0.0015826578, 0.0094493458, 0.0687126431, 0.0001686847], abs=1e-9)
    assert [rows[k]["ll"] for k in (2, 3, 4, 5)] == pytest.approx([-1.5261537311, -1.1337146386, -1.3174688834, -1.1748988104], abs=1e-9)
    assert {r["rank"]: r["nrank"] for r in plan.neighbors.collect()} == {2: [1, 0], 3: [2, 1], 4: [2, 3], 5: [3, 1]}


def test_sites(spark):
    sites = sources.vector_sites(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet"))
    for quantise, values in ((False, {1: -5698.821682, 2: -5480.097358, 30: -5734.573600}), (True, {30: -5733.426969})):
        for m, want in values.items():
            plan = engine.prepare(sites, engine.GPConfig(MATERN, (1.5, 0.1, 0.5), m, quantise=quantise))
            assert plan.loglik() == pytest.approx(want, abs=1e-4)
    assert [r["id"] for r in plan.ranked.orderBy("rank").limit(5).collect()] == [449, 313, 450, 384, 468]
    exact = engine.prepare(sites, engine.GPConfig(MATERN, (1.5, 0.1, 0.5), 500))
    assert exact.loglik() == pytest.approx(-5727.501334, abs=1e-4)


def test_divergence_falls(spark):
    grid = sources.grid_locations(spark, 120, 3)
    values = [engine.kl_divergence(grid, engine.GPConfig(MATERN, (1.0, 0.1, 0.5), m, order="random")) for m in (2, 10, 120)]
    assert values[0] > values[1] > 0 and values[2] == pytest.approx(0, abs=1e-8)


@pytest.mark.parametrize("metric,order,m", [("euclidean", "random", 5), ("euclidean", "morton", 8), ("earth", "random", 4), ("euclidean", "none", 1)])
def test_grid_neighbours_equal_exact(spark, metric, order, m):
    grid = sources.grid_locations(spark, 400, 1)
    if metric == "earth":
        grid = grid.select("id", (F.col("x") * 180 - 90).alias("x"), (F.col("y") * 360 - 180).alias("y"), "z")
    grid = grid.union(grid.where("id < 9").withColumn("id", F.col("id") + 1000))  # duplicates: ties
    p = ordering.ordered(grid, order, rescale=metric == "earth").persist()
    key = lambda df: sorted((r["rank"], r["k"], r["nrank"], round(r["dist"], 9)) for r in df.collect())
    assert key(neighbors.knn_grid(p, m, metric)) == key(neighbors.knn_exact(p, m, metric))


def test_distributed_rank_equals_sort(spark, monkeypatch):
    monkeypatch.setattr(ordering, "_ROWS", 60)
    grid = sources.grid_locations(spark, 500, 2)
    want = {r["id"]: k for k, r in enumerate(sorted(grid.collect(), key=lambda r: (r["x"], r["id"])))}
    assert {r["id"]: r["rank"] for r in ordering.ranked(grid, "x", "id").collect()} == want
    assert ordering.ranked(grid.limit(0), "x", "id").count() == 0


def test_singular_and_odd(spark, p6):
    twice = p6.union(p6.where("id = 2").withColumn("id", F.lit(9).cast("long")))
    plan = engine.prepare(twice, engine.GPConfig(MATERN, (1.5, 0.1, 0.5), 6, order="none"))
    assert {r["status"] for r in plan.terms().collect()} <= {"variance", "singular"} and math.isnan(plan.loglik())
    fine = engine.prepare(twice, engine.GPConfig(NUGGET, (1.5, 0.1, 0.5, 0.2), 6, order="none"))
    cross = kernels.KERNELS["powexp_nugget"].array(np.array([0.0]), Theta(1.5, 0.1, 0.5, 0.2))
    assert cross[0] == 1.7 and {r["status"] for r in fine.terms().collect()} <= {"ok", "variance"}
    for bad in ({"m": 0}, {"kernel": "x"}, {"order": "x"}, {"metric": "x"}, {"theta0": (1.0,)}, {"lower": 3.0}, {"how": "x"}):
        with pytest.raises(ValueError):
            engine.GPConfig(**bad)
    with pytest.raises(ValueError, match="0.5, 1.5 or 2.5"):
        engine.GPConfig(MATERN, (1.0, 0.1, 0.1)).covariance()
    assert engine.prepare(p6.limit(0), engine.GPConfig()).loglik() == 0.0
    dense = np.random.Generator(np.random.PCG64(0)).random((40, 2))
    got = likelihood.conditional(kernels.KERNELS["matern52"], Theta(1.0, 0.1, 2.5), *[np.zeros(1)] * 3, dense[None, :, 0], dense[None, :, 1], np.zeros((1, 40)))
    assert got["status"][0] in ("ok", "singular", "variance")


def test_numbers_must_be_finite(spark, p6):
    for odd in (None, math.nan, math.inf):
        bad = p6.union(spark.createDataFrame([(9, 0.5, odd, 0.1)], p6.schema))
        with pytest.raises(ValueError, match="1 points"):
            engine.prepare(bad, engine.GPConfig())
    with pytest.raises(ValueError, match="finite"):
        neighbors.knn_grid(ordering.ordered(p6, "none").withColumn("x", F.when(F.col("rank") == 5, None).otherwise(F.col("x"))), 2, rounds=4).count()


def test_optimiser():
    peak = lambda xs: [-((x[0] - 0.7) ** 2) - 3 * (x[1] - 1.4) ** 2 if x[0] > 0.01 else math.nan for x in xs]
    best = optimize.maximise(peak, [0.001, 0.001, 0.5], [0.001, 0.001, 0.5], [2, 2, 0.5], 1e-10, 2000)
    assert best.x == pytest.approx([0.7, 1.4, 0.5], abs=1e-3)
    assert optimize.maximise(peak, [1, 1, 0.5], [0, 0, 0.5], [2, 2, 0.5], 1e-9, 7).evaluations == 7
    with pytest.raises(ValueError):
        optimize.maximise(peak, [1], [2], [1])
    for value, want in (
        (lambda x: -(100 * (x[1] - x[0] ** 2) ** 2 + (1 - x[0]) ** 2), [1, 1]), (lambda x: x[0] + 2 * x[1], [2, 2]), (lambda x: -abs(x[0] - 0.3) - abs(x[1] - 0.9), [0.3, 0.9]),
        (lambda x: -500 * (math.log(x[0]) + 1.3 / x[0]) - 200 * math.log((x[1] + 0.1) / 0.3) ** 2, [1.3, 0.2]), (lambda x: -((x[0] - 0.5) ** 2) if x[1] > 1.5 else math.nan, [0.5, None]),
    ):
        calls = []
        best = optimize.maximise(lambda xs: [calls.append(len(xs)) or value(x) for x in xs], [0.001, 0.001], [0.001] * 2, [2.0] * 2, 1e-9, 2000)
        assert all(w is None or abs(v - w) < 0.02 for v, w in zip(best.x, want)), (best.x, want)


def test_fit_beats_a_grid(spark, tmp_path):
    r = np.random.Generator(np.random.PCG64(2))
    xy = r.random((150, 2))
    d = kernels.pair_distances("euclidean", xy[:, None, 0], xy[:, None, 1], xy[None, :, 0], xy[None, :, 1])
    z = np.linalg.cholesky(kernels.KERNELS["matern12"].array(d, Theta(1.2, 0.15)) + 1e-10 * np.eye(150)) @ r.normal(size=150)
    points = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(xy, z))], "id long, x double, y double, z double")
    config = engine.GPConfig(MATERN, (None, None, 0.5), 10, maxiter=120)
    plan = engine.prepare(points, config)
    result = engine.fit(plan, config)
    grid = [Theta(s, b, 0.5) for s in (0.4, 0.8, 1.2, 1.9) for b in (0.05, 0.1, 0.2, 0.6)]
    assert result.loglik >= max(plan.loglik_many(grid)) - 0.05 and result.theta.nu == 0.5
    assert result.fit_log.count() == 1 and result.trace_log.count() == result.evaluations
    path = sinks.write_log(result.fit_log, f"file://{tmp_path}", sinks.log_name(150, 10, order="morton"), nugget=False)
    assert spark.read.option("header", True).csv(path).columns == ["iterations", "variance", "range", "smoothness", "loglik", "ordering", "seconds"]


def test_bounds_of_each_parameter():
    config = engine.GPConfig(MATERN, lower=(0.01, 1.0, 0.5), upper=(5.0, 900.0, 2.5))
    assert config.bounds == ([0.01, 1.0, 0.5], [5.0, 900.0, 2.5]) and engine.GPConfig(NUGGET).bounds == ([0.001] * 4, [2.0] * 4)
    for bad in ((0.1, 0.1), (0.1, 0.1, 9.0, 0.1)):
        with pytest.raises(ValueError, match="bounds"):
            engine.GPConfig(MATERN, lower=bad)


def test_perf(spark):
    value, log = engine.perf(spark, 300, engine.GPConfig(MATERN, (1.5, 0.1, 0.5), 20))
    assert math.isfinite(value) and {"total", "cholesky", "neighbours"} <= {r["stage"] for r in log.collect()}


def test_files(spark, tmp_path):
    (tmp_path / "xy").write_text("0.1,0.2,9\n0.3,0.4\n0.5,0.6\n")
    (tmp_path / "z").write_text(" 1.5 x\n-2\n3e0\n")
    (tmp_path / "short").write_text("1\n2\n")
    (tmp_path / "bad").write_text("1\noops\n3\n")
    at = lambda name: f"file://{tmp_path}/{name}"
    assert sorted(map(tuple, sources.load_points(spark, at("xy"), at("z")).collect())) == [(0, 0.1, 0.2, 1.5), (1, 0.3, 0.4, -2.0), (2, 0.5, 0.6, 3.0)]
    assert sources.load_points(spark, at("xy"), at("z"), 2).count() == 2
    for pair, n in ((("xy", "short"), None), (("xy", "z"), 5)):
        with pytest.raises(ValueError):
            sources.load_points(spark, *map(at, pair), n)
    with pytest.raises(Exception, match="oops"):
        sources.load_points(spark, at("xy"), at("bad")).collect()


def test_many_files_in_order(spark, tmp_path):
    lines = [(i / 7, i / 9, float(i)) for i in range(850)]
    low = 0
    for k, n in enumerate((50, 400, 100, 300)):
        for name, text in (("xy", "{0!r},{1!r}"), ("z", "{2!r}")):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"part-{k:05d}" if name == "xy" else tmp_path / name / f"a{k}").write_text("".join(text.format(*x) + "\n" for x in lines[low : low + n]))
        low += n
    (tmp_path / "one").write_text("".join(f"{x[2]!r}\n" for x in lines))
    want = [(i, *x) for i, x in enumerate(lines)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            for z in ("z", "one"):
                assert sorted(map(tuple, sources.load_points(spark, f"file://{tmp_path}/xy", f"file://{tmp_path}/{z}").collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_flops_and_matrices():
    assert (flops.potrf(60), flops.potrf(300), flops.trsm("L", 64, 1), flops.dot(60)) == pytest.approx((73810, 9045050, 4096, 120))
    assert flops.gemm(2, 3, 4) == 48 and flops.syrk(3, 4) == 60 and flops.potri(5) == flops.trtri(5) + flops.lauum(5) and flops.posv("L", 3, 2) == flops.potrf(2) + 2 * flops.trsm("L", 3, 2) == 5 + 36
    assert flops.symm("R", 3, 4) == flops.gemm(3, 4, 4) and flops.geqrf(5, 3) > 0 and flops.geqrf(3, 5) > 0 and flops.orgqr(5, 3, 3) > 0
    assert flops.gemm_lr_lld(7, 6, 5, 2, 3) == 2 * (2 * 3 * 5 + 2 * 6 * 3 + 7 * 6 * 2) and flops.potrf(4, True) > flops.potrf(4)
    # (7, 6, 5) with ranks 2, 3, 1: r = 3; counted by hand term by term
    parts = 2 * 2 * 3 * 7 + 2 * 6 * 2 * 3 + 6 * 1 + flops.geqrf(7, 3) + flops.geqrf(6, 3) + 27 + 27 * 3 + flops.orgqr(7, 3, 3) + flops.orgqr(6, 3, 3) + 2 * 7 * 9 + 2 * 6 * 9
    assert flops.gemm_lr_lll(7, 6, 5, 2, 3, 1) == pytest.approx(parts) and flops.geqrf(7, 3) == pytest.approx(3 * (3 * (0.5 - 1 + 7) + 7 + 23 / 6) + 3 * (3 * 6.5 + 5 / 6))
    assert flops.gemm_lr_lll(7, 6, 5, 2, 3, 1, True) > 3 * flops.gemm_lr_lll(7, 6, 5, 2, 3, 1)
    assert np.linalg.eigvalsh(matrices.make_hpd(matrices.random_matrix(6, 6))).min() > 0 and matrices.hilbert(2, 2)[1, 1] == pytest.approx(1 / 3)
    assert matrices.max_norm(np.array([[1.0, -5.0]])) == 5 and math.isnan(matrices.max_norm(np.array([1.0, np.nan]))) and matrices.magnitude(3 + 4j) == 5
    assert matrices.axpy(2.0, np.ones(2), np.ones(2)).tolist() == [3, 3] and matrices.ceil_div(7, 3) == 3


def test_divergences_order_the_points_once(spark, monkeypatch):
    grid = spark.createDataFrame([(i, (i * 37 % 64 + 0.5) / 64, (i * 23 % 61 + 0.5) / 64, 0.0) for i in range(64)], "id long, x double, y double, z double")
    calls, ordered = [], engine.ordered
    monkeypatch.setattr(engine, "ordered", lambda *a, **k: (calls.append(a), ordered(*a, **k))[1])
    config = engine.GPConfig(MATERN, (1.0, 0.1, 0.5), 3)
    both = engine.kl_divergences(grid, config, (3, 64))
    assert len(calls) == 1
    assert both[0] == pytest.approx(engine.kl_divergence(grid, config)) and both[0] > 0 and both[1] == pytest.approx(0, abs=1e-9)
