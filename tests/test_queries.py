"""Every registered query of the engine that has SQL equals it on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from geoquilt.plans import model_queries
from geoquilt.plans import queries as plain

QUERIES, ORACLES = plain.QUERIES | model_queries.QUERIES, plain.ORACLES | model_queries.ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("embeddings", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(table, names):
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in table), key=str)


@pytest.mark.parametrize("name", ["morton_order", "random_order", "dist_haversine", "cov_powexp_nugget_earth", "knn_grid", "seq_conditioning", "terms_m2_matern12", "loglik_seq_m2", "mle_grid", "flops_model", "csv_roundtrip", "gradient_m2_powexp_nugget", "information_m1", "fit_errors", "terms_bivariate_m2", "terms_nonstationary_m2", "loglik_spacetime", "loglik_tukey_m2", "terms_mixed_m30_matern12"])
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), [d[0] for d in want.description])


def test_registry(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["loglik"]


def test_the_tolerance_ends_the_fit(monkeypatch):
    from geoquilt.plans import queries

    monkeypatch.setattr(queries, "_sites", lambda spark, sf_dir: None)
    monkeypatch.setattr(queries.engine, "fit", lambda sites, config: config)
    assert queries._fitted(None, SF).maxiter == queries.engine.GPConfig.maxiter == 1000


def test_work_folder():
    from types import SimpleNamespace as Name

    from geoquilt.sources.work import work_folder

    def session(local, **conf):
        conf = {k.replace("_", "."): v for k, v in conf.items()}
        context = Name(_jsc=Name(sc=lambda: Name(isLocal=lambda: local)))
        return Name(conf=Name(get=lambda k, *default: conf[k] if k in conf else default[0]), sparkContext=context)

    assert work_folder(session(False, spark_checkpoint_dir="file:///shared/here/")) == "file:///shared/here"
    assert work_folder(session(False, spark_sql_warehouse_dir="hdfs://x/warehouse/")) == "hdfs://x/warehouse/geoquilt-work"
    assert work_folder(session(True)).startswith("file:///") and work_folder(session(True)) == work_folder(session(True))
