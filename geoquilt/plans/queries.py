"""The registered queries on point sets and their SQL, over whole tables.

Sites are the vectors' first three components (see sources.points.vector_sites). Floats are rounded in both engines, as
sums depend on their order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, flops, paired
from ..functions.kernels import FAMILIES, KERNELS, MATERN_ANY, Theta
from ..operators import mixed, neighbors
from ..operators.cells import knn_cells
from ..operators.ordering import ordered
from ..sources import points as sources
from ..sources.work import work_folder
from . import engine, scoring

THETA = Theta(1.5, 0.1, 0.5, 0.2)
#: For smooth kernels with many neighbours, whose tiles are all but singular at a longer range.
SHORT = Theta(1.5, 0.02, 0.5, 0.2)
#: Parameters for the great-circle kernels and those compared in one pass.
GRID = [Theta(s, b, 0.5) for s in (0.5, 1.0, 1.5, 2.0) for b in (0.05, 0.1, 0.5, 2.0)]
MATERN, POWER, NUGGET, ANY_NU = FAMILIES


def _sites(spark: SparkSession, sf_dir: str, earth: bool = False) -> DataFrame:
    return sources.vector_sites(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), earth)


def _r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def _digits(name: str, digits: int = 6) -> list[Column]:
    """A column's leading digits as a whole number, and its power of ten: rounding that is relative."""
    c = F.col(name)
    power = F.when(c == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(c)))).cast("int")
    return [(F.round(c * F.pow(F.lit(10.0), digits - 1 - power), 0) + F.lit(0.0)).alias(name), power.alias(f"{name}_power")]


def _digits_sql(name: str, digits: int = 6) -> str:
    power = f"(CASE WHEN {name} = 0 THEN 0 ELSE floor(log10(abs({name}))) END)"
    return f"round({name} * pow(10.0::DOUBLE, {digits - 1} - {power}), 0) + 0.0::DOUBLE AS {name}, CAST({power} AS INTEGER) AS {name}_power"


# --- SQL pieces -------------------------------------------------------------------------------------------------------

_SITES = "sites AS (SELECT vec_id AS id, (CAST(embedding[1] AS DOUBLE) + 1) / 2 AS x, (CAST(embedding[2] AS DOUBLE) + 1) / 2 AS y, 10 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"
_EARTH = "sites AS (SELECT vec_id AS id, 90 * CAST(embedding[1] AS DOUBLE) AS x, 180 * CAST(embedding[2] AS DOUBLE) AS y, 10 * CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"


def _coded(source: str, unit: str = "{c}") -> str:
    """CTEs q0 (quantised) to q4 (spread) and coded, from a table with id, x, y, z."""
    out = f"q0 AS (SELECT *, CAST(floor({unit.format(c='x')} * 65535 + 0.5) AS BIGINT) AS qx, CAST(floor({unit.format(c='y')} * 65535 + 0.5) AS BIGINT) AS qy FROM {source}), s0 AS (SELECT *, qx & 65535 AS px, qy & 65535 AS py FROM q0)"
    for i, (shift, mask) in enumerate(columns.SPREAD, 1):
        out += f", s{i} AS (SELECT * EXCLUDE (px, py), xor(px, px << {shift}) & {mask} AS px, xor(py, py << {shift}) & {mask} AS py FROM s{i - 1})"
    return out + ", coded AS (SELECT *, (py << 1) + px AS code FROM s4)"


_BOX = "(({c} - (SELECT min({c}) FROM sites)) / ((SELECT max({c}) FROM sites) - (SELECT min({c}) FROM sites)))"
_MORTON = _coded("sites") + ", ranked AS (SELECT *, row_number() OVER (ORDER BY code, id) - 1 AS rank FROM coded)"
_MORTON_EARTH = _coded("sites", _BOX) + ", ranked AS (SELECT *, row_number() OVER (ORDER BY code, id) - 1 AS rank FROM coded)"
_RANDOM = "ranked AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR) || ':42'), id) - 1 AS rank FROM sites)"


def _euclid(a: str, b: str) -> str:
    return f"sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y))"


def _rad(e: str) -> str:
    return f"({e} * 3.141592653589793::DOUBLE / 180.0::DOUBLE)"


def _haversine(a: str, b: str) -> str:
    u, v = f"sin(({_rad(b + '.x')} - {_rad(a + '.x')}) / 2)", f"sin(({_rad(b + '.y')} - {_rad(a + '.y')}) / 2)"
    return f"(12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {u} * {u} + cos({_rad(a + '.x')}) * cos({_rad(b + '.x')}) * {v} * {v}))))"


def _knn_sql(m: int, dist: Callable[[str, str], str]) -> str:
    return f"""pairs AS (SELECT t.rank, c.rank AS nrank, {dist('t', 'c')} AS dist FROM ranked t JOIN ranked c ON c.rank < t.rank WHERE t.rank >= {m}),
edges AS (SELECT rank, CAST(k AS INTEGER) AS k, nrank, dist FROM (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY dist, nrank) AS k FROM pairs) WHERE k <= {m})"""


def _seq_sql(m: int) -> str:
    return f"edges AS (SELECT t.rank, CAST(c.rank - t.rank + {m} + 1 AS INTEGER) AS k, c.rank AS nrank FROM ranked t JOIN ranked c ON c.rank >= t.rank - {m} AND c.rank < t.rank WHERE t.rank >= {m})"


# --- plain operators --------------------------------------------------------------------------------------------------


def grid_locations(spark, sf_dir):
    return sources.synthetic(spark, 2500, 7).select("rank", "id", _r("x", 9).alias("x"), _r("y", 9).alias("y"), "z")


def _grid_sql() -> str:
    at = lambda k, axis: f"({k} + 0.5 + (-0.4::DOUBLE + (0.4::DOUBLE - -0.4::DOUBLE) * ((CAST(('0x' || substr(md5('7:' || id || ':{axis}'), 1, 13)) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE))) / 50"
    return f"""WITH sites AS (SELECT id, {at('floor(id / 50)', 'x')} AS x, {at('(id % 50)', 'y')} AS y, 0.0::DOUBLE AS z FROM range(2500) r(id)), {_MORTON}
SELECT rank, id, round(qx / 65535.0::DOUBLE, 9) + 0.0::DOUBLE AS x, round(qy / 65535.0::DOUBLE, 9) + 0.0::DOUBLE AS y, 0.0::DOUBLE AS z FROM ranked"""


def _with_code(spark, sf_dir) -> DataFrame:
    q = _sites(spark, sf_dir).select("id", columns.quantised(F.col("x")).alias("qx"), columns.quantised(F.col("y")).alias("qy"))
    return q.withColumn("code", columns.morton_encode(F.col("qx"), F.col("qy")))


def morton_encode(spark, sf_dir):
    return _with_code(spark, sf_dir)


def morton_decode(spark, sf_dir):
    x, y = columns.morton_decode_x(F.col("code")), columns.morton_decode_y(F.col("code"))
    return _with_code(spark, sf_dir).select("id", x.alias("qx"), y.alias("qy"), _r(columns.dequantised(x), 9).alias("x"), _r(columns.dequantised(y), 9).alias("y"))


def morton_order(spark, sf_dir):
    return ordered(_sites(spark, sf_dir), "morton", quantise=True).select("rank", "id", _r("x", 9).alias("x"), _r("y", 9).alias("y"), _r("z", 9).alias("z"))


def random_order(spark, sf_dir):
    return ordered(_sites(spark, sf_dir), "random").select("rank", "id")


def _steps(spark, sf_dir, metric: str) -> DataFrame:
    """Each site with its distance to the one before in Morton order, and with itself."""
    p = ordered(_sites(spark, sf_dir, metric == "earth"), "morton", rescale=metric == "earth")
    before = p.select("rank", "x", "y").join(p.select((F.col("rank") + 1).alias("rank"), F.col("x").alias("px"), F.col("y").alias("py")), "rank")
    both = before.withColumn("self", F.lit(0)).union(p.select("rank", "x", "y", "x", "y", F.lit(1)))
    return both.select("rank", "self", columns.distance(metric, F.col("x"), F.col("y"), F.col("px"), F.col("py")).alias("d"))


def _steps_sql(metric: str) -> str:
    d = _haversine if metric == "earth" else _euclid
    head = f"{_EARTH}, {_MORTON_EARTH}" if metric == "earth" else f"{_SITES}, {_MORTON}"
    return f"WITH {head}, steps AS (SELECT t.rank, CAST(c.rank = t.rank AS INTEGER) AS self, {d('t', 'c')} AS d FROM ranked t JOIN ranked c ON c.rank = t.rank - 1 OR c.rank = t.rank)"


def _dist(metric: str):
    return lambda spark, sf_dir: _steps(spark, sf_dir, metric).select("rank", "self", _r("d").alias("d"))


def _cov(name: str):
    metric = "earth" if name.endswith("earth") else "euclidean"
    return lambda spark, sf_dir: _steps(spark, sf_dir, metric).select("rank", "self", _r(KERNELS[name].column(F.col("d"), THETA)).alias("value"))


def _edges(points: DataFrame, m: int, metric: str = "euclidean", search=knn_cells) -> DataFrame:
    return search(points, m, metric).select("rank", F.col("k").cast("int").alias("k"), "nrank", _r("dist").alias("dist"))


def _knn(metric: str = "euclidean", order: str = "morton", m: int = 4, search=knn_cells):
    return lambda spark, sf_dir: _edges(ordered(_sites(spark, sf_dir, metric == "earth"), order, rescale=metric == "earth"), m, metric, search)


def knn_clustered(spark, sf_dir):
    """The events crowded towards one corner, by the fourth powers of their coordinates: densities differ by orders of magnitude."""
    p = sources.event_sites(spark.read.parquet(f"{sf_dir}/events.parquet"))
    x, y = (F.col(c) * F.col(c) * (F.col(c) * F.col(c)) for c in "xy")
    return _edges(ordered(p.select("id", x.alias("x"), y.alias("y"), "z"), "random"), 4)


def cov_matern_nu(spark, sf_dir):
    """The covariance of any smoothness over the steps of dist_euclid, at four smoothnesses that have closed forms."""

    def run(batches):
        for b in batches:
            d = np.asarray(b.column(2))
            for nu in (0.5, 1.5, 2.5, 3.5):
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(d), nu)), pa.array(MATERN_ANY.array(d, Theta(THETA.sigma2, THETA.range, nu)))], ["rank", "self", "nu", "value"])

    return _steps(spark, sf_dir, "euclidean").mapInArrow(run, "rank long, self int, nu double, value double").withColumn("value", _r("value"))


def seq_conditioning(spark, sf_dir):
    return neighbors.sequential(ordered(_sites(spark, sf_dir)), 3).select("rank", F.col("k").cast("int").alias("k"), "nrank")


def gathered_neighbors(spark, sf_dir):
    """The gather: each edge with its neighbour's coordinates and observation, in the order of k."""
    p = ordered(_sites(spark, sf_dir))
    g = neighbors.gathered(p, neighbors.sequential(p, 3))
    rows = g.select("rank", F.posexplode(F.arrays_zip("nrank", "nx", "ny", "nz")).alias("p", "v"))
    return rows.select("rank", (F.col("p") + 1).alias("k"), F.col("v.nrank").alias("nrank"), _r("v.nx").alias("x"), _r("v.ny").alias("y"), _r("v.nz").alias("z"))


# --- likelihoods ------------------------------------------------------------------------------------------------------


def _config(kernel: str, m: int, how: str = "knn_grid", theta: Theta = THETA, tile: int = 1024) -> engine.GPConfig:
    family = MATERN if kernel.startswith("matern") else NUGGET if "nugget" in kernel else POWER
    nu = {"matern32": 1.5, "matern52": 2.5}.get(kernel, 0.5)
    values = (theta.sigma2, theta.range, nu, theta.nugget)[: FAMILIES[family]]
    return engine.GPConfig(family, values, m, how, metric="earth" if kernel.endswith("earth") else "euclidean", tile=tile)


def _plan(spark, sf_dir, kernel: str, m: int, how: str = "knn_grid", theta: Theta = THETA) -> engine.Plan:
    return engine.prepare(_sites(spark, sf_dir, kernel.endswith("earth")), _config(kernel, m, how, theta))


def _terms(kernel: str, m: int, how: str = "knn_grid", theta: Theta = THETA, digits: int = 6):
    def query(spark, sf_dir):
        rows = _plan(spark, sf_dir, kernel, m, how, theta).terms()
        return rows.select("rank", *[_r(c, digits - 1).alias(c) for c in ("mu", "var")], *[x for c in ("quad", "logdet", "ll") for x in _digits(c, digits)], "status")

    return query


def _mixed(kernel: str, m: int, theta: Theta = THETA, digits: int = 6):
    """_terms with single-precision factors, refined."""

    def query(spark, sf_dir):
        plan = _plan(spark, sf_dir, kernel, m, "knn", theta)
        rows = mixed.terms(plan.neighbors, plan.m, plan.config.covariance(), plan.config.theta)
        return rows.select("rank", *[_r(c, digits - 1).alias(c) for c in ("mu", "var")], *[x for c in ("quad", "logdet", "ll") for x in _digits(c, digits)], "status")

    return query


def _terms_out(digits: int = 6) -> str:
    return f"SELECT rank, round(mu, {digits - 1}) + 0.0::DOUBLE AS mu, round(var, {digits - 1}) + 0.0::DOUBLE AS var, " + ", ".join(_digits_sql(c, digits) for c in ("quad", "logdet", "ll")) + ", 'ok' AS status FROM terms"


_TERMS_OUT = _terms_out()


def _terms_sql(kernel: str, m: int, how: str = "knn", theta: Theta | None = None, tail: str | None = None) -> str:
    """Closed forms for one and two neighbours: the first block's row `block(ll)` and `terms(rank, mu, var, ll)`."""
    k, t = KERNELS[kernel], theta or THETA
    earth = k.metric == "earth"
    d = _haversine if earth else _euclid
    v = repr(k.marginal(t)) + "::DOUBLE"
    head = (f"{_EARTH}, {_MORTON_EARTH}" if earth else f"{_SITES}, {_MORTON}") + ", " + (_knn_sql(m, d) if how == "knn" else _seq_sql(m))
    cov = lambda a, b: k.sql(d(a, b), t)
    if m == 1:
        body = f"""w AS (SELECT t.rank, t.z, {cov('t', 'n')} AS c, n.z AS z1 FROM edges e JOIN ranked t ON t.rank = e.rank JOIN ranked n ON n.rank = e.nrank),
c AS (SELECT rank, z, c / {v} * z1 AS mu, {v} - c / {v} * c AS var FROM w),
block AS (SELECT -0.5 * (ln({v}) + z * z / {v} + ln(2 * pi())) AS ll FROM ranked WHERE rank = 0)"""
    else:
        body = f"""w AS (SELECT t.rank, t.z, {cov('t', 'n')} AS c1, {cov('t', 'o')} AS c2, {cov('n', 'o')} AS k, n.z AS z1, o.z AS z2
  FROM edges e JOIN edges f ON f.rank = e.rank AND e.k = 1 AND f.k = 2 JOIN ranked t ON t.rank = e.rank JOIN ranked n ON n.rank = e.nrank JOIN ranked o ON o.rank = f.nrank),
s AS (SELECT *, ({v} * c1 - k * c2) / ({v} * {v} - k * k) AS w1, ({v} * c2 - k * c1) / ({v} * {v} - k * k) AS w2 FROM w),
c AS (SELECT rank, z, w1 * z1 + w2 * z2 AS mu, {v} - w1 * c1 - w2 * c2 AS var FROM s),
b AS (SELECT n.z AS z1, o.z AS z2, {cov('n', 'o')} AS k FROM ranked n JOIN ranked o ON n.rank = 0 AND o.rank = 1),
block AS (SELECT -0.5 * (ln({v} * {v} - k * k) + ({v} * z1 * z1 - 2 * k * z1 * z2 + {v} * z2 * z2) / ({v} * {v} - k * k) + 2 * ln(2 * pi())) AS ll FROM b)"""
    body += ", terms AS (SELECT rank, mu, var, (z - mu) * (z - mu) / var AS quad, ln(var) AS logdet, -0.5 * ((z - mu) * (z - mu) / var + ln(var) + ln(2 * pi())) AS ll FROM c)"
    return f"WITH {head}, {body} " + (tail or _TERMS_OUT)


#: From cells(t, i, z, j, c), each point's covariances, to the pivots of their rows: d, and u, the observation less its mean given the rows before.
ELIMINATE = """lines AS (SELECT t, i, any_value(z) AS z, list_append(list(c ORDER BY j), any_value(z)) AS r FROM cells GROUP BY t, i),
step(p, t, i, z, r) AS (
  SELECT 1, t, i, z, r FROM lines
  UNION ALL
  SELECT s.p + 1, s.t, s.i, s.z, list_transform(s.r, lambda x, n: x - s.r[s.p] / k.r[s.p] * k.r[n]) FROM step s JOIN step k ON k.t = s.t AND k.i = s.p AND k.p = s.p WHERE s.i > s.p
),
pivots AS (SELECT t, i, z, r[i] AS d, r[len(r)] AS u FROM step WHERE p = i),"""


def _elimination_sql(kernel: str, m: int | str, how: str = "knn", tail: str = _TERMS_OUT, head: str | None = None, theta: Theta = THETA) -> str:
    """Any m: rows of each point's covariances, with its neighbours' before it and the observation behind them, are
    eliminated pivot by pivot. A last row then holds the conditional variance and the observation less the conditional
    mean; the first block's rows, each less those before, make up its term (t = -1). Gives `pivots` (t, i, d, u, z) and `terms`."""
    k = KERNELS[kernel]
    earth = k.metric == "earth"
    d, v = _haversine if earth else _euclid, repr(k.marginal(theta)) + "::DOUBLE"
    head = head or (f"{_EARTH}, {_MORTON_EARTH}" if earth else f"{_SITES}, {_MORTON}") + ", " + (_knn_sql(m, d) if how == "knn" else _seq_sql(m))
    return f"""WITH RECURSIVE {head},
near AS (SELECT e.rank AS t, e.k AS i, n.x, n.y, n.z FROM edges e JOIN ranked n ON n.rank = e.nrank
  UNION ALL SELECT rank, {m} + 1, x, y, z FROM ranked WHERE rank >= {m}
  UNION ALL SELECT -1, rank + 1, x, y, z FROM ranked WHERE rank < {m}),
cells AS (SELECT a.t, a.i, a.z, b.i AS j, CASE WHEN a.i = b.i THEN {v} ELSE {k.sql(d('a', 'b'), theta)} END AS c FROM near a JOIN near b ON a.t = b.t),
{ELIMINATE}
terms AS (SELECT t AS rank, z - u AS mu, d AS var, u * u / d AS quad, ln(d) AS logdet, -0.5 * (u * u / d + ln(d) + ln(2 * pi())) AS ll FROM pivots WHERE t >= 0 AND i = {m} + 1)
{tail}"""


# Pairs of doubles in SQL (see functions.paired, whose sums and products these are): a number v is the columns vh and vl.
# Each function below gives layers of columns; a layer reads those before it.


def _half(a: str) -> str:
    """The upper half of a double's digits."""
    return f"({paired.SPLIT!r}::DOUBLE * {a} - ({paired.SPLIT!r}::DOUBLE * {a} - {a}))"


def _error(a: str, b: str, p: str, a1: str, b1: str) -> str:
    """a b - p, exactly, with the upper halves a1 and b1."""
    return f"((({a1} * {b1} - {p}) + {a1} * ({b} - {b1}) + ({a} - {a1}) * {b1}) + ({a} - {a1}) * ({b} - {b1}))"


def _whole(v: str, high: str, low: str) -> dict[str, str]:
    return {f"{v}h": f"{high} + {low}", f"{v}l": f"{low} - (({high} + {low}) - {high})"}


def _times(v: str, a: tuple[str, str], b: tuple[str, str]) -> list[dict[str, str]]:
    (ah, al), (bh, bl) = a, b
    return [{"p": f"{ah} * {bh}", "a1": _half(ah), "b1": _half(bh)}, {"e": f"{_error(ah, bh, 'p', 'a1', 'b1')} + ({ah} * {bl} + {al} * {bh})"}, _whole(v, "p", "e")]


def _plus(v: str, a: tuple[str, str], b: tuple[str, str]) -> list[dict[str, str]]:
    (ah, al), (bh, bl) = a, b
    return [{"s": f"{ah} + {bh}"}, {"e": f"({ah} - (s - (s - {ah}))) + ({bh} - (s - {ah})) + ({al} + {bl})"}, _whole(v, "s", "e")]


def _over(v: str, a: tuple[str, str], b: tuple[str, str]) -> list[dict[str, str]]:
    (ah, al), (bh, bl) = a, b
    return [{"q": f"{ah} / {bh}"}, {"p": f"q * {bh}", "a1": _half("q"), "b1": _half(bh)}, {"e": f"((({ah} - p) - {_error('q', bh, 'p', 'a1', 'b1')}) + {al} - q * {bl}) / {bh}"}, _whole(v, "q", "e")]


def _root(v: str, a: tuple[str, str]) -> list[dict[str, str]]:
    ah, al = a
    return [{"q": f"sqrt({ah})"}, {"p": "q * q", "a1": _half("q")}, {"e": f"((({ah} - p) - {_error('q', 'q', 'p', 'a1', 'a1')}) + {al}) / (CASE WHEN q = 0 THEN 1.0::DOUBLE ELSE 2 * q END)"}, _whole(v, "q", "e")]


def _layers(source: str, kept: list[str], layers: list[dict[str, str]]) -> str:
    """The layers as subqueries over source; every one passes on what it does not give anew."""
    sql, have = source, list(kept)
    for layer in layers:
        sql = "(SELECT " + ", ".join([*(c for c in have if c not in layer), *(f"{e} AS {c}" for c, e in layer.items())]) + f" FROM {sql})"
        have += [c for c in layer if c not in have]
    return sql


def _lit(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def _pair_cells_sql(kernel: str, theta: Theta) -> str:
    """cells(t, i, z, j, ch, cl) from near(t, i, x, y, z), whose coordinates are doubles: the Matern covariances as pairs."""
    of = lambda v: (f"{v}h", f"{v}l")
    zero = _lit(0.0)
    steps = [*_plus("dx", ("xa", zero), ("(-xb)", zero)), *_plus("dy", ("ya", zero), ("(-yb)", zero)), *_times("dx", of("dx"), of("dx")), *_times("dy", of("dy"), of("dy"))]
    steps += [*_plus("d", of("dx"), of("dy")), *_root("d", of("d")), *_over("s", of("d"), (_lit(theta.range), zero))]
    steps += [{"far": "sh > 700"}, {"rh": f"CASE WHEN far THEN 0 ELSE -sh END * {_lit(2.0**-paired.HALVINGS)}", "rl": f"CASE WHEN far THEN 0 ELSE -sl END * {_lit(2.0**-paired.HALVINGS)}"}]
    terms, plain = paired.series(), zero
    for high, _ in reversed(terms[paired.PLAIN :]):
        plain = f"({plain} * rh + {_lit(high)})"
    steps += [{"vh": plain, "vl": zero}]
    for high, low in reversed(terms[: paired.PLAIN]):
        steps += [*_times("v", of("v"), of("r")), *_plus("v", of("v"), (_lit(high), _lit(low)))]
    for _ in range(paired.HALVINGS):
        steps += _times("v", of("v"), of("v"))
    rise = {"matern12": [], "matern32": _plus("g", (_lit(1.0), zero), of("s")), "matern52": [*_times("g", of("s"), of("s")), *_over("g", of("g"), (_lit(3.0), zero)), *_plus("g", of("g"), of("s")), *_plus("g", of("g"), (_lit(1.0), zero))]}[kernel]
    steps += [*rise, *(_times("v", of("v"), of("g")) if rise else []), *_times("c", of("v"), (_lit(theta.sigma2), zero))]
    upper = "(SELECT a.t, a.i, a.z AS az, b.i AS j, b.z AS bz, a.x AS xa, a.y AS ya, b.x AS xb, b.y AS yb FROM near a JOIN near b ON a.t = b.t AND a.i < b.i)"
    v = _lit(KERNELS[kernel].marginal(theta))
    return f"""upper AS MATERIALIZED (SELECT t, i, az, j, bz, CASE WHEN far THEN 0 ELSE ch END AS ch, CASE WHEN far THEN 0 ELSE cl END AS cl FROM {_layers(upper, ["t", "i", "az", "j", "bz", "xa", "ya", "xb", "yb"], steps)}),
cells AS (SELECT t, i, az AS z, j, ch, cl FROM upper UNION ALL SELECT t, j, bz, i, ch, cl FROM upper UNION ALL SELECT t, i, z, i, {v}, {zero} FROM near)"""


def _pair_eliminate_sql() -> str:
    """ELIMINATE in pairs, from cells(t, i, z, j, ch, cl) to pivots(t, i, z, dh, dl, uh, ul). A row's list begins at its pivot's column."""
    each = lambda over, e: f"list_transform({over}, lambda x, n: {e})"
    kept = ["done", "t", "i", "z", "rh", "rl", "kh", "kl", "ah", "al", "bh", "bl"]
    joined = "(SELECT s.p AS done, s.t, s.i, s.z, s.rh[2:] AS rh, s.rl[2:] AS rl, k.rh[2:] AS kh, k.rl[2:] AS kl, s.rh[1] AS ah, s.rl[1] AS al, k.rh[1] AS bh, k.rl[1] AS bl FROM step s JOIN step k ON k.t = s.t AND k.i = s.p AND k.p = s.p WHERE s.i > s.p)"
    steps = [*_over("f", ("ah", "al"), ("bh", "bl")), {"f1": _half("fh")}, {"ph": each("kh", "fh * x"), "k1": each("kh", _half("x"))},
             {"pe": each("ph", _error("fh", "kh[n]", "x", "f1", "k1[n]") + " + (fh * kl[n] + fl * kh[n])"), "sh": each("ph", "rh[n] - x")},
             {"se": each("sh", "(rh[n] - (x - (x - rh[n]))) + ((-ph[n]) - (x - rh[n])) + (rl[n] - pe[n])")},
             {"nh": each("sh", "x + se[n]"), "nl": each("sh", "se[n] - ((x + se[n]) - x)")}]
    return f"""lines AS (SELECT t, i, any_value(z) AS z, list_append(list(ch ORDER BY j), any_value(z)) AS rh, list_append(list(cl ORDER BY j), 0.0::DOUBLE) AS rl FROM cells GROUP BY t, i),
step(p, t, i, z, rh, rl) AS (
  SELECT 1, t, i, z, rh, rl FROM lines
  UNION ALL
  SELECT done + 1, t, i, z, nh, nl FROM {_layers(joined, kept, steps)}
),
pivots AS (SELECT t, i, z, rh[1] AS dh, rl[1] AS dl, rh[len(rh)] AS uh, rl[len(rl)] AS ul FROM step WHERE p = i),"""


def _pair_elimination_sql(kernel: str, m: int, how: str = "knn", tail: str = _TERMS_OUT, theta: Theta = THETA) -> str:
    """_elimination_sql in pairs of doubles, for tiles whose last digits shown doubles would lose."""
    return f"""WITH RECURSIVE {_SITES}, {_MORTON}, {_knn_sql(m, _euclid) if how == "knn" else _seq_sql(m)},
near AS (SELECT e.rank AS t, e.k AS i, n.x, n.y, n.z FROM edges e JOIN ranked n ON n.rank = e.nrank
  UNION ALL SELECT rank, {m} + 1, x, y, z FROM ranked WHERE rank >= {m}
  UNION ALL SELECT -1, rank + 1, x, y, z FROM ranked WHERE rank < {m}),
{_pair_cells_sql(kernel, theta)},
{_pair_eliminate_sql()}
terms AS (SELECT t AS rank, (z - uh) - ul AS mu, dh AS var, uh * uh / dh AS quad, ln(dh) AS logdet, -0.5 * (uh * uh / dh + ln(dh) + ln(2 * pi())) AS ll FROM pivots WHERE t >= 0 AND i = {m} + 1)
{tail}"""


_PIVOTS_SUM = "SELECT round(sum(-0.5 * (ln(d) + u * u / d + ln(2 * pi()))), 4) + 0.0::DOUBLE AS loglik FROM pivots WHERE t = -1 OR i = {m} + 1"
#: For the exact model: all points are the first block.
_ALL = f"{_SITES}, {_MORTON}, edges AS (SELECT rank, CAST(1 AS INTEGER) AS k, rank AS nrank FROM ranked WHERE false)"
_EVERY = "(SELECT count(*) FROM sites)"


def _kl_sql() -> str:
    """Half the difference of the log-determinants, as with z = 0 nothing else is left."""
    half = lambda m, head=None: _elimination_sql("matern12", m, tail=f"SELECT sum(ln(d)) AS l FROM pivots WHERE t = -1 OR i = {m} + 1", head=head)
    rows = [f"SELECT CAST({m} AS INTEGER) AS m, round(0.5 * ((SELECT l FROM ({half(m)})) - (SELECT l FROM ({half(_EVERY, _ALL)}))), 6) + 0.0::DOUBLE AS kl" for m in (10, 60)]
    return " UNION ALL ".join(rows)


_SUM = "SELECT round((SELECT ll FROM block) + sum(ll), 4) + 0.0::DOUBLE AS loglik FROM terms"


def _loglik(m: int, how: str = "knn_grid"):
    def query(spark, sf_dir):
        return spark.createDataFrame([(_plan(spark, sf_dir, "matern12", m, how).loglik(),)], "loglik double").select(_r("loglik", 4).alias("loglik"))

    return query


def first_block(spark, sf_dir):
    plan = _plan(spark, sf_dir, "matern12", 2)
    term = engine.likelihood.block_term(KERNELS["matern12"], THETA, *plan._block())
    return spark.createDataFrame([(term["ll"],)], "ll double").select(_r("ll").alias("ll"))


def loglik_exact(spark, sf_dir):
    sites = _sites(spark, sf_dir)
    return spark.createDataFrame([(engine.prepare(sites, _config("matern12", max(1, sites.count()), tile=256)).loglik(),)], "loglik double").select(_r("loglik", 4).alias("loglik"))


def kl_divergence(spark, sf_dir):
    sites = _sites(spark, sf_dir)
    rows = list(zip((10, 60), engine.kl_divergences(sites, _config("matern12", 10, "knn", tile=256), (10, 60))))
    return spark.createDataFrame(rows, "m int, kl double").withColumn("kl", _r("kl"))


def theta_grid(spark, sf_dir):
    values = _plan(spark, sf_dir, "matern12", 1).loglik_many(GRID)
    rows = [(i, t.sigma2, t.range, v) for i, (t, v) in enumerate(zip(GRID, values))]
    return spark.createDataFrame(rows, "theta_id int, sigma2 double, range double, loglik double").withColumn("loglik", _r("loglik", 3))


def mle_grid(spark, sf_dir):
    best = theta_grid(spark, sf_dir).agg(F.max_by(F.struct("theta_id", "sigma2", "range", "loglik"), F.struct("loglik", -F.col("theta_id"))).alias("b"))
    return best.select("b.*")


def _theta_grid_sql() -> str:
    rows = []
    for i, t in enumerate(GRID):
        inner = _terms_sql("matern12", 1, theta=t, tail=f"SELECT CAST({i} AS INTEGER) AS theta_id, {t.sigma2!r}::DOUBLE AS sigma2, {t.range!r}::DOUBLE AS range, round((SELECT ll FROM block) + sum(ll), 3) + 0.0::DOUBLE AS loglik FROM terms")
        rows.append(f"SELECT * FROM ({inner})")
    return " UNION ALL ".join(rows)


#: Two grids of variance and range: a wide one, and factors about the best of it.
_WIDE = [(0.25 * 2.0**i, 0.005 * 2.0**j) for i in range(7) for j in range(9)]
_CLOSE = [(2.0 ** (i / 4), 2.0 ** (j / 4)) for i in range(-4, 5) for j in range(-4, 5)]


def mle_refined(spark, sf_dir):
    """The likelihood's maximum over two grids, the second about the first one's best, and whether the fit is as high."""
    plan = _plan(spark, sf_dir, "matern12", 1)
    value, theta = _best_on_grids(plan)
    fitted = engine.fit(plan, engine.GPConfig(MATERN, (1.0, 0.1, 0.5), 1, lower=(0.1, 0.001, 0.5), upper=(40.0, 4.0, 0.5), tol=1e-8))
    rows = [(theta.sigma2, theta.range, value, fitted.loglik >= value - 1e-6 * abs(value))]
    return spark.createDataFrame(rows, "sigma2 double, range double, loglik double, fit_as_high boolean").select(_r("sigma2").alias("sigma2"), _r("range", 9).alias("range"), _r("loglik", 3).alias("loglik"), "fit_as_high")


def _grids_sql() -> str:
    """Closed form of one neighbour, over a table of parameters: w(z, z1, d) and the best row of each grid, wide and close(s, b, ll)."""
    table = lambda grid: "(VALUES " + ", ".join(f"({a!r}::DOUBLE, {b!r}::DOUBLE)" for a, b in grid) + ")"
    sums = lambda grid: f"""SELECT s, b, sum(ll) AS ll FROM (
    SELECT s, b, -0.5 * ((z - c / s * z1) * (z - c / s * z1) / (s - c / s * c) + ln(s - c / s * c) + ln(2 * pi())) AS ll FROM (SELECT s, b, z, z1, s * exp(-(d / b)) AS c FROM w, {grid})
    UNION ALL SELECT s, b, -0.5 * (ln(s) + z * z / s + ln(2 * pi())) FROM ranked, {grid} WHERE rank = 0) GROUP BY s, b ORDER BY ll DESC LIMIT 1"""  # noqa: E731
    return f"""WITH {_SITES}, {_MORTON}, {_knn_sql(1, _euclid)},
w AS (SELECT t.z, n.z AS z1, {_euclid('t', 'n')} AS d FROM edges e JOIN ranked t ON t.rank = e.rank JOIN ranked n ON n.rank = e.nrank),
wide AS ({sums(f'(SELECT s, b FROM {table(_WIDE)} v(s, b))')}), close AS ({sums(f'(SELECT wide.s * f AS s, wide.b * g AS b FROM wide, {table(_CLOSE)} v(f, g))')})"""


def _mle_refined_sql() -> str:
    return _grids_sql() + " SELECT round(s, 6) AS sigma2, round(b, 9) AS range, round(ll, 3) AS loglik, true AS fit_as_high FROM close"


def _gradient(kernel: str, m: int):
    """The likelihood's gradient by each free parameter, as leading digits."""

    def query(spark, sf_dir):
        at = scoring.information(_plan(spark, sf_dir, kernel, m))
        rows = spark.createDataFrame([(p, float(g)) for p, g in zip(at.names, at.gradient)], "parameter string, gradient double")
        return rows.select("parameter", *_digits("gradient", 5))

    return query


def _gradient_sql(kernel: str, m: int, names: tuple[str, ...]) -> str:
    """Five-point differences of the likelihood by elimination; the points' neighbours do not depend on the parameters."""
    theta = _config(kernel, m).theta

    def at(p: str, by: float) -> str:
        moved = replace(theta, **{p: getattr(theta, p) * (1 + by)})
        return "(SELECT l FROM (" + _elimination_sql(kernel, m, theta=moved, tail=f"SELECT sum(-0.5 * (ln(d) + u * u / d + ln(2 * pi()))) AS l FROM pivots WHERE t = -1 OR i = {m} + 1") + "))"

    h = 1e-3
    rows = [f"SELECT '{p}' AS parameter, ({at(p, -2 * h)} - 8 * {at(p, -h)} + 8 * {at(p, h)} - {at(p, 2 * h)}) / {12 * h * getattr(theta, p)!r}::DOUBLE AS gradient" for p in names]
    return f"SELECT parameter, {_digits_sql('gradient', 5)} FROM ({' UNION ALL '.join(rows)})"


def information_m1(spark, sf_dir):
    """Observed and expected information at THETA, an entry for each pair of parameters."""
    at = scoring.information(_plan(spark, sf_dir, "matern12", 1))
    rows = [(at.names[i], at.names[j], float(at.observed[i, j]), float(at.expected[i, j])) for i in range(2) for j in range(i, 2)]
    return spark.createDataFrame(rows, "p string, q string, observed double, expected double").select("p", "q", *_digits("observed"), *_digits("expected"))


#: Of one neighbour under matern12, from w(z, z1, d) and one row here(s, b): with r = exp(-d / b), g = 1 - r**2 and h = (z - r z1)**2 / g
#: a term is -(ln s + ln g + h / s + ln 2 pi) / 2. Gives info(oss, osb, obb, ess, esb, ebb), the first site's term included.
_INFO_M1 = """e0 AS (SELECT s, b, z, z1, d, exp(-(d / b)) AS r FROM w, here),
e1 AS (SELECT *, r * d / (b * b) AS r1, r * (d * d / (b * b * b * b) - 2 * d / (b * b * b)) AS r2, 1 - r * r AS g, z - r * z1 AS e FROM e0),
e2 AS (SELECT *, -2 * r * r1 AS g1, -2 * (r1 * r1 + r * r2) AS g2, -r1 * z1 AS f1, -r2 * z1 AS f2 FROM e1),
e3 AS (SELECT *, e * e / g AS h, 2 * e * f1 / g - e * e * g1 / (g * g) AS h1,
  2 * (f1 * f1 + e * f2) / g - 4 * e * f1 * g1 / (g * g) - e * e * g2 / (g * g) + 2 * e * e * g1 * g1 / (g * g * g) AS h2 FROM e2),
info AS (SELECT sum(oss) AS oss, sum(osb) AS osb, sum(obb) AS obb, sum(ess) AS ess, sum(esb) AS esb, sum(ebb) AS ebb FROM (
  SELECT 0.5 * (2 * h / (s * s * s) - 1 / (s * s)) AS oss, -0.5 * h1 / (s * s) AS osb, 0.5 * (g2 / g - g1 * g1 / (g * g) + h2 / s) AS obb,
    0.5 / (s * s) AS ess, 0.5 * g1 / (s * g) AS esb, 0.5 * g1 * g1 / (g * g) + r1 * r1 / g AS ebb FROM e3
  UNION ALL SELECT 0.5 * (2 * z * z / (s * s * s) - 1 / (s * s)), 0, 0, 0.5 / (s * s), 0, 0 FROM ranked, here WHERE rank = 0))"""


def _information_sql() -> str:
    rows = [f"SELECT '{p}' AS p, '{q}' AS q, o{k} AS observed, e{k} AS expected FROM info" for p, q, k in (("sigma2", "sigma2", "ss"), ("sigma2", "range", "sb"), ("range", "range", "bb"))]
    return f"""WITH {_SITES}, {_MORTON}, {_knn_sql(1, _euclid)},
w AS (SELECT t.z, n.z AS z1, {_euclid('t', 'n')} AS d FROM edges e JOIN ranked t ON t.rank = e.rank JOIN ranked n ON n.rank = e.nrank),
here AS (SELECT {THETA.sigma2!r}::DOUBLE AS s, {THETA.range!r}::DOUBLE AS b), {_INFO_M1}
SELECT p, q, {_digits_sql('observed')}, {_digits_sql('expected')} FROM ({' UNION ALL '.join(rows)})"""


def _best_on_grids(plan: engine.Plan) -> tuple[float, Theta]:
    best = lambda grid: max(zip(plan.loglik_many([Theta(s, b, 0.5) for s, b in grid]), grid))
    _, (s, b) = best(_WIDE)
    value, (s, b) = best([(s * f, b * g) for f, g in _CLOSE])
    return value, Theta(s, b, 0.5)


def fit_errors(spark, sf_dir):
    """Standard errors at the best parameters of two grids (mle_refined), null where the information gives none, and
    whether a fit by Fisher scoring is as high."""
    plan = _plan(spark, sf_dir, "matern12", 1)
    value, theta = _best_on_grids(plan)
    at = scoring.information(plan, theta)
    fitted = scoring.fit_scoring(plan, engine.GPConfig(MATERN, (1.0, 0.1, 0.5), 1, lower=(0.1, 0.001, 0.5), upper=(40.0, 4.0, 0.5), tol=1e-10, maxiter=60))
    rows = [(p, *map(float, x), fitted.loglik >= value - 1e-6 * abs(value)) for p, *x in zip(at.names, theta.values(at.names), at.errors("observed"), at.errors("expected"))]
    shaped = spark.createDataFrame([tuple(None if x != x else x for x in row) for row in rows], "parameter string, estimate double, observed_error double, expected_error double, scoring_as_high boolean")
    return shaped.select("parameter", *_digits("estimate"), *_digits("observed_error", 5), *_digits("expected_error", 5), "scoring_as_high")


def _fit_errors_sql() -> str:
    """Inverses of two-by-two informations, by their determinants."""
    error = lambda k, over: f"CASE WHEN {k}{over} / ({k}ss * {k}bb - {k}sb * {k}sb) > 0 THEN sqrt({k}{over} / ({k}ss * {k}bb - {k}sb * {k}sb)) END"
    rows = [f"SELECT '{p}' AS parameter, {v} AS estimate, {error('o', over)} AS observed_error, {error('e', over)} AS expected_error FROM info, here" for p, v, over in (("sigma2", "s", "bb"), ("range", "b", "ss"))]
    return f"""{_grids_sql()}, here AS (SELECT s, b FROM close), {_INFO_M1}
SELECT parameter, {_digits_sql('estimate')}, {_digits_sql('observed_error', 5)}, {_digits_sql('expected_error', 5)}, true AS scoring_as_high FROM ({' UNION ALL '.join(rows)})"""


def fit_smoothness(spark, sf_dir):
    """A fit that leaves the smoothness free, from the best of the fixed ones."""
    config = engine.GPConfig(ANY_NU, (1.0, 0.05, 0.5), 5, lower=(0.05, 0.002, 0.2), upper=(20.0, 2.0, 3.0), tol=1e-4, maxiter=120)
    return engine.fit(_sites(spark, sf_dir), config).fit_log


def _fitted(spark, sf_dir) -> engine.FitResult:
    config = engine.GPConfig(MATERN, (1.0, 0.1, 0.5), 10, upper=20.0)
    return engine.fit(_sites(spark, sf_dir), config)


def mle_fit(spark, sf_dir):
    return _fitted(spark, sf_dir).fit_log


def opt_trace(spark, sf_dir):
    return _fitted(spark, sf_dir).trace_log


def perf_log(spark, sf_dir):
    return engine.perf(spark, 2500, engine.GPConfig(MATERN, (1.5, 0.1, 0.5), 30))[1]


def flops_model(spark, sf_dir):
    """Operations of an evaluation over the sites for several m, from the sites' number."""
    n = F.col("n")
    sizes = [(m, *map(float, (flops.potrf(m), flops.trsm("L", -(-m // 32) * 32, 1), flops.dot(m)))) for m in (10, 30, 60, 300)]
    counted = _sites(spark, sf_dir).agg(F.count("*").alias("n"))
    rows = counted.crossJoin(spark.createDataFrame(sizes, "m int, potrf double, trsm double, dot double"))  # one row by four
    return rows.select("m", *[_r((n - F.col("m") + 1) * f * F.col(c), 0).alias(c) for c, f in (("potrf", 1.0), ("trsm", 2.0), ("dot", 2.0))])


_FLOPS_SQL = """WITH s AS (SELECT count(*) AS n FROM embeddings), m AS (SELECT CAST(unnest([10, 30, 60, 300]) AS INTEGER) AS m),
f AS (SELECT m, m::DOUBLE AS d, ceil(m / 32.0) * 32 AS p FROM m)
SELECT m, round((n - m + 1) * (d * (d * d / 6 + d / 2 + 1.0::DOUBLE / 3) + d * (d * d / 6 - 1.0::DOUBLE / 6)), 0) + 0.0::DOUBLE AS potrf,
  round((n - m + 1) * 2.0::DOUBLE * p * p, 0) + 0.0::DOUBLE AS trsm, round((n - m + 1) * 2.0::DOUBLE * 2 * d, 0) + 0.0::DOUBLE AS dot FROM s, f
"""
_FLOPS_SQL = _FLOPS_SQL.replace("2.0::DOUBLE * p * p", "2.0::DOUBLE * (0.5::DOUBLE * p * (p + 1) + 0.5::DOUBLE * p * (p - 1))")


def flops_all(spark, sf_dir):
    """Every operation count, real and complex, for sizes made of each nation's numbers."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    sizes = nation.select(*[(F.expr(e) + F.lit(0.0)).alias(c) for c, e in _SIZES.items()])
    m, n, k, a, b, c = (F.col(x) for x in _SIZES)
    counts = lambda x: [f.alias(name + "_complex" * x) for name, f in (
        ("gemm", flops.gemm(m, n, k, x)), ("dot", flops.dot(m, x)), ("trmm_l", flops.trmm("L", m, n, x)), ("trmm_r", flops.trmm("R", m, n, x)), ("trsm_l", flops.trsm("L", m, n, x)),
        ("trsm_r", flops.trsm("R", m, n, x)), ("potrf", flops.potrf(n, x)), ("potrs_l", flops.potrs("L", m, n, x)), ("trtri", flops.trtri(n, x)), ("lauum", flops.lauum(n, x)),
        ("potri", flops.potri(n, x)), ("potrf_potri", flops.potrf_potri(n, x)), ("posv_l", flops.posv("L", m, n, x)), ("symm_l", flops.symm("L", m, n, x)), ("symm_r", flops.symm("R", m, n, x)),
        ("syrk", flops.syrk(k, n, x)), ("geqrf", flops.geqrf(m, n, x)), ("orgqr", flops.orgqr(m, n, k, x)), ("lld", flops.gemm_lr_lld(m, n, k, a, b, x)), ("lll", flops.gemm_lr_lll(m, n, k, a, b, c, x)),
    )]
    rows = sizes.select(*_SIZES, *counts(False), *counts(True))
    return rows.select(*_SIZES, *[_r(x, 3).alias(x) for x in rows.columns if x not in _SIZES])


_SIZES = {"m": "n_nationkey + 3", "n": "n_nationkey % 7 + n_regionkey + 2", "k": "n_nationkey % 5 + 1", "ra": "n_regionkey + 1", "rb": "n_nationkey % 4 + 1", "rc": "n_nationkey % 3 + 1"}


def _flops_all_sql() -> str:
    """Each count as its multiplications (f) and additions (a), written out from the published operation counts."""
    t = lambda k, w: (f"0.5 * {w} * {k} * ({k} + 1)", f"0.5 * {w} * {k} * ({k} - 1)")
    potrf = ("(1/6.0 * n * n * n + 0.5 * n * n + n / 3.0)", "(1/6.0 * n * n * n - n / 6.0)")
    trtri = ("(1/6.0 * n * n * n + 0.5 * n * n + n / 3.0)", "(1/6.0 * n * n * n - 0.5 * n * n + n / 3.0)")
    plus = lambda *x: tuple("(" + " + ".join(y[i] for y in x) + ")" for i in (0, 1))
    same = lambda e: (f"({e})", f"({e})")

    def geqrf(m, n):
        tall = (f"{n} * {n} * (0.5 - {n} / 3.0 + {m}) + {n} * {m} + 23 / 6.0 * {n}", f"{n} * {n} * (0.5 - {n} / 3.0 + {m}) + 5 / 6.0 * {n}")
        wide = (f"{m} * {m} * (-0.5 - {m} / 3.0 + {n}) + 2 * {n} * {m} + 23 / 6.0 * {m}", f"{m} * {m} * (-0.5 - {m} / 3.0 + {n}) + {n} * {m} + 5 / 6.0 * {m}")
        return tuple(f"(CASE WHEN {m} > {n} THEN {x} ELSE {y} END)" for x, y in zip(tall, wide))

    def orgqr(m, n, k):
        return (f"({k} * (2 * {m} * {n} + 2 * {n} - 5 / 3.0 + {k} * (2 / 3.0 * {k} - ({m} + {n}) - 1)))", f"({k} * (2 * {m} * {n} + {n} - {m} + 1 / 3.0 + {k} * (2 / 3.0 * {k} - ({m} + {n}))))")

    r = "(ra + rc)"
    lll = plus(same("ra * rb * m"), same("n * ra * rb"), geqrf("m", r), (f"n * rc + {r} * {r} * {r}", f"2 * {r} * {r} * {r}"), geqrf("n", r), t(r, r), orgqr("m", r, r), orgqr("n", r, r), same(f"m * {r} * {r}"), same(f"n * {r} * {r}"))
    counts = {
        "gemm": same("m * n * k"), "dot": same("m"), "trmm_l": t("m", "n"), "trmm_r": t("n", "m"), "trsm_l": t("m", "n"), "trsm_r": t("n", "m"), "potrf": potrf, "potrs_l": plus(t("m", "n"), t("m", "n")), "trtri": trtri,
        "lauum": potrf, "potri": plus(trtri, potrf), "potrf_potri": plus(potrf, trtri, potrf), "posv_l": plus(potrf, t("m", "n"), t("m", "n")), "symm_l": same("m * m * n"), "symm_r": same("m * n * n"), "syrk": same("0.5 * k * n * (n + 1)"),
        "geqrf": geqrf("m", "n"), "orgqr": orgqr("m", "n", "k"), "lld": plus(same("ra * rb * k"), same("ra * n * rb"), same("m * n * ra")), "lll": lll,
    }
    columns = [f"round(CAST({x} * ({f}) + {y} * ({a}) AS DOUBLE), 3) + 0.0::DOUBLE AS {name}{end}" for x, y, end in ((1, 1, ""), (6, 2, "_complex")) for name, (f, a) in counts.items()]
    sizes = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in _SIZES.items())
    return f"WITH s AS (SELECT {sizes} FROM nation) SELECT {', '.join(_SIZES)}, {', '.join(columns)} FROM s"


def csv_roundtrip(spark, sf_dir):
    """The sites written as the two text files and read back, joined by line."""
    base = f"{work_folder(spark)}/csv-{uuid.uuid4().hex}"
    sites = _sites(spark, sf_dir).orderBy("id")
    engine.cut(sites.select(F.concat_ws(",", "x", "y").alias("xy"), F.col("z").cast("string").alias("z"))).createOrReplaceTempView("geoquilt_lines")
    lines = spark.table("geoquilt_lines")
    lines.select("xy").write.text(f"{base}/xy")
    lines.select("z").write.text(f"{base}/z")
    return sources.load_points(spark, f"{base}/xy", f"{base}/z").select(_r("x", 9).alias("x"), _r("y", 9).alias("y"), _r("z", 9).alias("z"))


def event_sites(spark, sf_dir):
    p = sources.event_sites(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return p.select("id", *[_r(c).alias(c) for c in "xyz"])


_EVENTS_SQL = """WITH t AS (SELECT event_id AS id, epoch_us(ts) AS t, CAST(value AS DOUBLE) AS v FROM events), s AS (SELECT min(t) AS low, max(t) AS high FROM t)
SELECT id, round((t - low)::DOUBLE / (high - low)::DOUBLE, 6) + 0.0::DOUBLE AS x, round(v / 600, 6) + 0.0::DOUBLE AS y, round(ln(1 + v), 6) + 0.0::DOUBLE AS z FROM t, s"""


_EVENT_SITES = "SELECT event_id AS id, (epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM events))::DOUBLE / (SELECT max(epoch_us(ts)) - min(epoch_us(ts)) FROM events)::DOUBLE AS x, CAST(value AS DOUBLE) / 600 AS y, ln(1 + CAST(value AS DOUBLE)) AS z FROM events"


def _near_sql(m: int) -> str:
    """As _knn_sql, but each point's nearest ones are kept while its distances are formed, as there are many points."""
    return f"kept AS (SELECT t.rank, min({{'dist': {_euclid('t', 'c')}, 'nrank': c.rank}}, {m}) AS best FROM ranked t JOIN ranked c ON c.rank < t.rank WHERE t.rank >= {m} GROUP BY t.rank), edges AS (SELECT rank, CAST(k AS INTEGER) AS k, best[k].nrank AS nrank, best FROM kept, range(1, {m} + 1) r(k))"


def loglik_events(spark, sf_dir):
    """The whole event table as sites: grid neighbours, a nugget for coinciding sites, ten neighbours each."""
    p = sources.event_sites(spark.read.parquet(f"{sf_dir}/events.parquet"))
    plan = engine.prepare(p, engine.GPConfig(NUGGET, (1.5, 0.1, 0.5, 0.2), 10))
    return spark.createDataFrame([(plan.n, plan.loglik())], "n long, loglik double").withColumn("loglik", _r("loglik", 4))


def _gentle(kernel: str) -> Theta:
    return SHORT if kernel == "matern52" else THETA


def _loglik_events_sql() -> str:
    inner = _elimination_sql("powexp_nugget", 10, head=f"sites AS ({_EVENT_SITES}), {_MORTON}, {_near_sql(10)}", tail=_PIVOTS_SUM.format(m=10))
    return f"SELECT (SELECT count(*) FROM events) AS n, loglik FROM ({inner})"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "grid_locations": grid_locations, "morton_encode": morton_encode, "morton_decode": morton_decode, "morton_order": morton_order, "random_order": random_order,
    "dist_euclid": _dist("euclidean"), "dist_haversine": _dist("earth"), **{f"cov_{k}": _cov(k) for k in KERNELS},
    "knn_euclid": _knn(), "knn_earth": _knn("earth"), "knn_random_order": _knn(order="random"), "knn_clustered": knn_clustered, "cov_matern_nu": cov_matern_nu,
    "knn_grid": _knn(order="random", m=10, search=neighbors.knn_grid), "knn_grid_earth": _knn("earth", m=7, search=neighbors.knn_grid),
    "seq_conditioning": seq_conditioning, "gathered_neighbors": gathered_neighbors, "first_block": first_block,
    **{f"terms_m{m}_{k}": _terms(k, m, theta=_gentle(k)) for m in (1, 2, 10) for k in KERNELS},
    "terms_m1_matern52_far": _terms("matern52", 1), "terms_m2_matern52_far": _terms("matern52", 2), "terms_m10_matern52_far": _terms("matern52", 10, digits=3),
    "terms_seq_m10": _terms("matern32", 10, "sequential"), "terms_m30_matern52": _terms("matern52", 30, "knn", SHORT), "terms_mixed_m30_matern12": _mixed("matern12", 30), "terms_mixed_m30_matern52": _mixed("matern52", 30, SHORT, 5),
    "loglik_m1": _loglik(1), "loglik_m2": _loglik(2), "loglik_seq_m2": _loglik(2, "sequential"), "loglik_m30": _loglik(30, "knn"), "loglik_exact": loglik_exact,
    "kl_divergence": kl_divergence, "theta_grid": theta_grid, "mle_grid": mle_grid, "mle_refined": mle_refined, "gradient_m10_matern32": _gradient("matern32", 10), "gradient_m2_powexp_nugget": _gradient("powexp_nugget", 2), "information_m1": information_m1, "fit_errors": fit_errors, "fit_smoothness": fit_smoothness, "mle_fit": mle_fit, "opt_trace": opt_trace, "perf_log": perf_log,
    "flops_model": flops_model, "flops_all": flops_all, "csv_roundtrip": csv_roundtrip, "event_sites": event_sites, "loglik_events": loglik_events,
}

_KNN_OUT = "SELECT rank, k, nrank, round(dist, 6) + 0.0::DOUBLE AS dist FROM edges"
ORACLES: dict[str, str] = {
    "grid_locations": _grid_sql(),
    "morton_encode": f"WITH {_SITES}, {_coded('sites')} SELECT id, qx, qy, code FROM coded",
    "morton_decode": f"WITH {_SITES}, {_coded('sites')} SELECT id, qx, qy, round(qx / 65535.0::DOUBLE, 9) + 0.0::DOUBLE AS x, round(qy / 65535.0::DOUBLE, 9) + 0.0::DOUBLE AS y FROM coded",
    "morton_order": f"WITH {_SITES}, {_MORTON} SELECT rank, id, round(qx / 65535.0::DOUBLE, 9) + 0.0::DOUBLE AS x, round(qy / 65535.0::DOUBLE, 9) + 0.0::DOUBLE AS y, round(z, 9) + 0.0::DOUBLE AS z FROM ranked",
    "random_order": f"WITH {_SITES}, {_RANDOM} SELECT rank, id FROM ranked",
    "dist_euclid": _steps_sql("euclidean") + " SELECT rank, self, round(d, 6) + 0.0::DOUBLE AS d FROM steps",
    "dist_haversine": _steps_sql("earth") + " SELECT rank, self, round(d, 6) + 0.0::DOUBLE AS d FROM steps",
    **{f"cov_{k}": _steps_sql("earth" if k.endswith("earth") else "euclidean") + f" SELECT rank, self, round({KERNELS[k].sql('d', THETA)}, 6) + 0.0::DOUBLE AS value FROM steps" for k in KERNELS},
    "knn_euclid": f"WITH {_SITES}, {_MORTON}, {_knn_sql(4, _euclid)} {_KNN_OUT}",
    "knn_earth": f"WITH {_EARTH}, {_MORTON_EARTH}, {_knn_sql(4, _haversine)} {_KNN_OUT}",
    "knn_random_order": f"WITH {_SITES}, {_RANDOM}, {_knn_sql(4, _euclid)} {_KNN_OUT}",
    "knn_clustered": f"WITH sites AS (SELECT id, x * x * (x * x) AS x, y * y * (y * y) AS y, z FROM ({_EVENT_SITES})), {_RANDOM}, {_near_sql(4)} SELECT rank, k, nrank, round(best[k].dist, 6) + 0.0::DOUBLE AS dist FROM edges",
    "cov_matern_nu": _steps_sql("euclidean") + f", s AS (SELECT rank, self, d / {THETA.range!r}::DOUBLE AS s FROM steps), m AS (SELECT *, unnest([{{'nu': 0.5::DOUBLE, 'f': 1.0::DOUBLE}}, {{'nu': 1.5::DOUBLE, 'f': 1 + s}}, {{'nu': 2.5::DOUBLE, 'f': 1 + s + s * s / 3}}, {{'nu': 3.5::DOUBLE, 'f': 1 + s + 0.4::DOUBLE * s * s + s * s * s / 15}}]) AS v FROM s) SELECT rank, self, v.nu, round({THETA.sigma2!r}::DOUBLE * v.f * exp(-s), 6) + 0.0::DOUBLE AS value FROM m",
    "knn_grid": f"WITH {_SITES}, {_RANDOM}, {_knn_sql(10, _euclid)} {_KNN_OUT}",
    "knn_grid_earth": f"WITH {_EARTH}, {_MORTON_EARTH}, {_knn_sql(7, _haversine)} {_KNN_OUT}",
    "seq_conditioning": f"WITH {_SITES}, {_MORTON}, {_seq_sql(3)} SELECT rank, k, nrank FROM edges",
    "gathered_neighbors": f"WITH {_SITES}, {_MORTON}, {_seq_sql(3)} SELECT e.rank, e.k, e.nrank, round(r.x, 6) + 0.0::DOUBLE AS x, round(r.y, 6) + 0.0::DOUBLE AS y, round(r.z, 6) + 0.0::DOUBLE AS z FROM edges e JOIN ranked r ON r.rank = e.nrank",
    "first_block": _terms_sql("matern12", 2, tail="SELECT round(ll, 6) + 0.0::DOUBLE AS ll FROM block"),
    **{f"terms_m1_{k}": _terms_sql(k, 1, theta=_gentle(k)) for k in KERNELS},
    **{f"terms_m{m}_{k}": _elimination_sql(k, m, theta=_gentle(k)) for m in (2, 10) for k in KERNELS},
    "terms_m1_matern52_far": _terms_sql("matern52", 1), "terms_m2_matern52_far": _elimination_sql("matern52", 2), "terms_m10_matern52_far": _pair_elimination_sql("matern52", 10, tail=_terms_out(3)),
    "terms_seq_m10": _pair_elimination_sql("matern32", 10, "sequential"), "terms_m30_matern52": _pair_elimination_sql("matern52", 30, theta=SHORT), "terms_mixed_m30_matern12": _elimination_sql("matern12", 30), "terms_mixed_m30_matern52": _pair_elimination_sql("matern52", 30, tail=_terms_out(5), theta=SHORT),
    "loglik_m30": _elimination_sql("matern12", 30, tail=_PIVOTS_SUM.format(m=30)), "loglik_exact": _elimination_sql("matern12", _EVERY, tail=_PIVOTS_SUM.format(m=_EVERY), head=_ALL), "kl_divergence": _kl_sql(),
    "loglik_m1": _terms_sql("matern12", 1, tail=_SUM), "loglik_m2": _terms_sql("matern12", 2, tail=_SUM), "loglik_seq_m2": _terms_sql("matern12", 2, "sequential", tail=_SUM),
    "theta_grid": _theta_grid_sql(), "mle_refined": _mle_refined_sql(), "gradient_m10_matern32": _gradient_sql("matern32", 10, ("sigma2", "range")), "gradient_m2_powexp_nugget": _gradient_sql("powexp_nugget", 2, ("sigma2", "range", "nu", "nugget")),
    "information_m1": _information_sql(), "fit_errors": _fit_errors_sql(), "mle_grid": f"SELECT * FROM ({_theta_grid_sql()}) ORDER BY loglik DESC, theta_id LIMIT 1",
    "flops_model": _FLOPS_SQL, "flops_all": _flops_all_sql(),
    "csv_roundtrip": f"WITH {_SITES} SELECT round(x, 9) + 0.0::DOUBLE AS x, round(y, 9) + 0.0::DOUBLE AS y, round(z, 9) + 0.0::DOUBLE AS z FROM sites",
    "event_sites": _EVENTS_SQL, "loglik_events": _loglik_events_sql(),
}
