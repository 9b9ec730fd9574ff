"""The registered queries on the covariances of functions.models, and their SQL, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Multivariate, NonStationary, SpaceTime
from ..functions.tukey import Tukey
from . import queries
from .modelled import ModelPlan, prepare
from .queries import _MORTON, ELIMINATE, _digits, _digits_sql, _euclid, _knn_sql, _r
from .transformed import loglik_transformed

#: Smoothnesses whose means have closed forms, so that SQL can check them.
TWO = Multivariate((1.5, 0.8), 0.1, (0.5, 2.5), ((1.0, 0.5), (0.5, 1.0)), 0.05)
THREE = Multivariate((1.5, 0.8, 1.2), 0.05, (0.5, 2.5, 0.5), ((1.0, 0.4, -0.3), (0.4, 1.0, 0.2), (-0.3, 0.2, 1.0)), 0.05)
EVENTS = SpaceTime(1.5, 0.2, 0.5, 0.05, 0.8, 0.6, 0.1)
#: Time by this is as far as space by 1.
TIME_SCALE = 3.0
LOCAL = NonStationary(1.5, 0.05)
#: The first changes nothing: its row is that of loglik_m2.
BENT = [Tukey(), Tukey(0.1, 2.0, 0.3), Tukey(0.1, 2.0, 0.0, 0.15), Tukey(0.0, 1.5, -0.2, 0.1)]


def vector_sites(vectors: DataFrame, variables: int) -> DataFrame:
    """(id, x, y, sd, reach, z): places by the first two components, local parameters by the next two, observations by those after."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return vectors.select(F.col("vec_id").alias("id"), ((e(0) + 1) / 2).alias("x"), ((e(1) + 1) / 2).alias("y"), (1.2 + e(2)).alias("sd"), (0.05 * (1.5 + e(3))).alias("reach"), F.array(*[10 * e(4 + i) for i in range(variables)]).alias("z"))


def _sites_sql(variables: int) -> str:
    e = lambda i: f"CAST(embedding[{i}] AS DOUBLE)"
    return f"sites AS (SELECT vec_id AS id, ({e(1)} + 1) / 2 AS x, ({e(2)} + 1) / 2 AS y, 1.2::DOUBLE + {e(3)} AS sd, 0.05::DOUBLE * (1.5::DOUBLE + {e(4)}) AS reach, [{', '.join(f'10 * {e(5 + i)}' for i in range(variables))}] AS z FROM embeddings)"


def event_sites(events: DataFrame) -> DataFrame:
    """(id, x, y, t, z): users and values as places, the share of the time span, and the value's log."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    x, y, v = F.col("user_id") / 1000, F.col("value") / 600, F.col("value").cast("double")
    return events.select(F.col("event_id").alias("id"), x.alias("x"), y.cast("double").alias("y"), ((micros - (low or 0)) / ((high or 0) - (low or 0) or 1)).alias("t"), F.array(F.log(1 + v)).alias("z"))


_EVENT_SITES = """sites AS (SELECT event_id AS id, user_id::DOUBLE / 1000 AS x, CAST(value AS DOUBLE) / 600 AS y,
  (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events)::DOUBLE AS t, [ln(1 + CAST(value AS DOUBLE))] AS z FROM events),
ranked AS (SELECT *, row_number() OVER (ORDER BY t, id) - 1 AS rank FROM sites)"""


def _eliminated(model, m: int, head: str, tail: str) -> str:
    """Rows i of a target's neighbours, variable by variable, and of its own after them; its term is what those give together."""
    v = model.variables
    own = lambda i: f"({model.sql('a', 'b', i, i)} + {model.nugget!r}::DOUBLE)"
    cases = " ".join(f"WHEN a.v = {i} AND b.v = {j} THEN CASE WHEN a.i = b.i THEN {own(i)} ELSE {model.sql('a', 'b', i, j)} END" if i == j else f"WHEN a.v = {i} AND b.v = {j} THEN {model.sql('a', 'b', i, j)}" for i in range(v) for j in range(v))
    reads = ", ".join(f"n.{c} AS {c}_" for c in model.columns)
    named = ", ".join(f"{c}_ AS {c}" for c in model.columns)
    return f"""WITH RECURSIVE {head},
met AS (SELECT e.rank AS o_, e.k AS k, {reads}, n.z FROM edges e JOIN ranked n ON n.rank = e.nrank
  UNION ALL SELECT n.rank, {m} + 1, {reads}, n.z FROM ranked n WHERE n.rank >= {m}
  UNION ALL SELECT -1, n.rank + 1, {reads}, n.z FROM ranked n WHERE n.rank < {m}),
near AS (SELECT o_ AS o, (k - 1) * {v} + v + 1 AS i, v, {named}, z[v + 1] AS z FROM met, range({v}) r(v)),
cells AS (SELECT a.o AS t, a.i, a.z, b.i AS j, CASE {cases} END AS c FROM near a JOIN near b ON a.o = b.o),
{ELIMINATE}
terms AS (SELECT t AS rank, sum(u * u / d) AS quad, sum(ln(d)) AS logdet, -0.5 * sum(u * u / d + ln(d) + ln(2 * pi())) AS ll FROM pivots WHERE t < 0 OR i > {m * v} GROUP BY t)
{tail}"""


_TERMS_OUT = f"SELECT rank, {', '.join(_digits_sql(c) for c in ('quad', 'logdet', 'll'))}, 'ok' AS status FROM terms WHERE rank >= 0"
_SUM_OUT = "SELECT round(sum(ll), 4) + 0.0::DOUBLE AS loglik FROM terms"


def _plan(spark, sf_dir, model, m: int) -> ModelPlan:
    return prepare(vector_sites(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), model.variables), model, m, "knn_grid")


def _terms(model, m: int):
    return lambda spark, sf_dir: _plan(spark, sf_dir, model, m).terms(model).select("rank", *[x for c in ("quad", "logdet", "ll") for x in _digits(c)], "status")


def _loglik(model, m: int):
    return lambda spark, sf_dir: spark.createDataFrame([(_plan(spark, sf_dir, model, m).loglik(model),)], "loglik double").select(_r("loglik", 4).alias("loglik"))


def loglik_spacetime(spark, sf_dir):
    """The whole event table in space and time: ten neighbours each, all of them earlier."""
    plan = prepare(event_sites(spark.read.parquet(f"{sf_dir}/events.parquet")), EVENTS, 10, time_scale=TIME_SCALE)
    return spark.createDataFrame([(plan.n, plan.loglik(EVENTS))], "n long, loglik double").withColumn("loglik", _r("loglik", 4))


def _loglik_spacetime_sql() -> str:
    far = f"sqrt((t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y) + {TIME_SCALE * TIME_SCALE!r}::DOUBLE * (t.t - c.t) * (t.t - c.t))"
    head = f"{_EVENT_SITES}, kept AS (SELECT t.rank, min({{'dist': {far}, 'nrank': c.rank}}, 10) AS best FROM ranked t JOIN ranked c ON c.rank < t.rank WHERE t.rank >= 10 GROUP BY t.rank), edges AS (SELECT rank, CAST(k AS INTEGER) AS k, best[k].nrank AS nrank FROM kept, range(1, 11) r(k))"
    return f"SELECT (SELECT count(*) FROM events) AS n, loglik FROM ({_eliminated(EVENTS, 10, head, _SUM_OUT)})"


def _vectors_sql(model, m: int, tail: str) -> str:
    return _eliminated(model, m, f"{_sites_sql(model.variables)}, {_MORTON}, {_knn_sql(m, _euclid)}", tail)


def loglik_tukey_m2(spark, sf_dir):
    """The likelihood of the sites' observations as g-and-h transforms of a Gaussian field, for several g and h in one pass."""
    values = loglik_transformed(queries._plan(spark, sf_dir, "matern12", 2), [(queries.THETA, t) for t in BENT])
    return spark.createDataFrame([(t.g, t.h, v) for t, v in zip(BENT, values)], "g double, h double, loglik double").withColumn("loglik", _r("loglik", 4))


def _tukey_sql() -> str:
    """Each value is inverted by halving an interval 64 times; then as for Gaussian values, less the logs of the slopes."""
    rows = []
    for t in BENT:
        bend = lambda u: f"({f'(exp({t.g!r}::DOUBLE * {u}) - 1) / {t.g!r}::DOUBLE' if t.g else u}) * exp({t.h!r}::DOUBLE * {u} * {u} / 2)"  # noqa: E731, B023
        head = f"""raw AS (SELECT * FROM ({{sites}})),
halved(p, id, w, low, high) AS (SELECT 0, id, (z - {t.xi!r}::DOUBLE) / {t.omega!r}::DOUBLE, -32.0::DOUBLE, 32.0::DOUBLE FROM raw
  UNION ALL SELECT p + 1, id, w, CASE WHEN {bend('((low + high) / 2)')} < w THEN (low + high) / 2 ELSE low END, CASE WHEN {bend('((low + high) / 2)')} < w THEN high ELSE (low + high) / 2 END FROM halved WHERE p < 64),
sites AS (SELECT raw.id, x, y, (low + high) / 2 AS z FROM raw JOIN halved ON halved.id = raw.id AND p = 64)"""
        head = head.format(sites=queries._SITES.removeprefix("sites AS (").removesuffix(")"))
        slope = f"ln({t.omega!r}::DOUBLE * (exp({t.g!r}::DOUBLE * z + {t.h!r}::DOUBLE * z * z / 2) + {t.h!r}::DOUBLE * z * {bend('z')}))"
        tail = f"SELECT {t.g!r}::DOUBLE AS g, {t.h!r}::DOUBLE AS h, round((SELECT sum(-0.5 * (ln(d) + u * u / d + ln(2 * pi()))) FROM pivots WHERE t = -1 OR i = 3) - (SELECT sum({slope}) FROM sites), 4) + 0.0::DOUBLE AS loglik"
        rows.append("SELECT * FROM (" + queries._elimination_sql("matern12", 2, head=f"{head}, {_MORTON}, {_knn_sql(2, _euclid)}", tail=tail) + ")")
    return " UNION ALL ".join(rows)


QUERIES = {
    "terms_bivariate_m2": _terms(TWO, 2), "loglik_bivariate_m10": _loglik(TWO, 10), "terms_trivariate_m2": _terms(THREE, 2),
    "terms_nonstationary_m2": _terms(LOCAL, 2), "loglik_nonstationary_m10": _loglik(LOCAL, 10), "loglik_spacetime": loglik_spacetime,
    "loglik_tukey_m2": loglik_tukey_m2,
}

ORACLES = {
    "terms_bivariate_m2": _vectors_sql(TWO, 2, _TERMS_OUT), "loglik_bivariate_m10": _vectors_sql(TWO, 10, _SUM_OUT), "terms_trivariate_m2": _vectors_sql(THREE, 2, _TERMS_OUT),
    "terms_nonstationary_m2": _vectors_sql(LOCAL, 2, _TERMS_OUT), "loglik_nonstationary_m10": _vectors_sql(LOCAL, 10, _SUM_OUT), "loglik_spacetime": _loglik_spacetime_sql(),
    "loglik_tukey_m2": _tukey_sql(),
}
