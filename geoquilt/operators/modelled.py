"""Vecchia terms under the covariances of functions.models: sites with any number of columns and variables.

Sites are rows (id, *columns, z), z an array of the site's variables. All variables of a site are conditioned together on
all those of its neighbours, so a term is a multivariate one.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import nearest
from .likelihood import _TILE_BYTES, _factor, _forward

TERMS = "rank long, quad double, logdet double, ll double, status string"


def checked(sites: DataFrame, model) -> DataFrame:
    """sites, of (id, *columns, z); ValueError if a number is null, NaN or infinite, or a site has other than the model's variables."""
    z = F.transform("z", lambda v: F.coalesce(F.abs(v), F.lit(math.inf)))
    fine = (sum(F.abs(c) for c in model.columns) < math.inf) & F.forall(z, lambda v: v < math.inf)
    odd = sites.where(~F.coalesce((F.size("z") == model.variables) & fine, F.lit(False))).count()
    if odd:
        raise ValueError(f"{odd} sites have a null, NaN or infinite number, or not {model.variables} variables")
    return sites.select("id", *model.columns, "z")


def gathered(sites: DataFrame, edges: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row (rank, *columns, z, n_*, nz) for each target; arrays in the order of k."""
    c = sites.select(F.col("rank").alias("nrank"), *[F.col(x).alias(f"n_{x}") for x in columns], F.col("z").alias("nz"))
    names = [*[f"n_{x}" for x in columns], "nz"]
    lists = edges.select("rank", "k", "nrank").join(c, "nrank").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("k", *names))).alias("s"))  # m entries each
    return sites.select("rank", *columns, "z").join(lists.select("rank", *[F.col(f"s.{x}").alias(x) for x in names]), "rank")


def nearby(sites: DataFrame, m: int, columns: tuple[str, ...], time_scale: float | None = None) -> DataFrame:
    """gathered() for the m nearest sites before each, with time in units of time_scale if it is given, cut from its lineage."""
    if time_scale is None:
        rows = nearest(sites, m, "euclidean", (*columns[2:], "z"), tuple(f"n_{c}" for c in (*columns, "z")))
        kept = columns
    else:
        kept = tuple("at" if c == "t" else c for c in columns)
        rest = tuple(c for c in kept if c not in ("x", "y"))
        rows = nearest(sites.withColumn("at", F.col("t")).withColumn("t", F.col("t") * time_scale), m, "spacetime", (*rest, "z"), tuple(f"n_{c}" for c in (*kept, "z")))
    return rows.select("rank", *[F.col(k).alias(c) for k, c in zip(kept, columns)], "z", *[F.col(f"n_{k}").alias(f"n_{c}") for k, c in zip(kept, columns)], F.col("n_z").alias("nz"))


def _covariances(model, a, b, same: bool) -> np.ndarray:
    """Between all of (B, p) and all of (B, q) sites, as (B, p V, q V); the nugget joins the diagonal where they are the same."""
    a, b = [x[:, :, None] for x in a], [x[:, None, :] for x in b]
    v = model.variables
    blocks = [[model.array(a, b, i, j) for j in range(v)] for i in range(v)]
    out = np.stack([np.stack(row, -1) for row in blocks], -2)  # (B, p, q, i, j)
    out = out.transpose(0, 1, 3, 2, 4).reshape(len(out), out.shape[1] * v, out.shape[2] * v)
    if same:
        diagonal = np.arange(out.shape[1])
        out[:, diagonal, diagonal] += model.nugget
    return out


def conditional(model, sites, z, near, nz) -> dict[str, np.ndarray]:
    """quad, logdet, ll and status of targets (B,) with z (B, V), given neighbours (B, m) with nz (B, m, V)."""
    at = [x[:, None] for x in sites]
    factor, good = _factor(_covariances(model, near, near, True))
    cross = _covariances(model, near, at, False)
    u = _forward(factor, np.concatenate([cross, nz.reshape(len(nz), -1, 1)], 2))
    own, seen = u[:, :, :-1], u[:, :, -1]
    mu = np.einsum("bij,bi->bj", own, seen)
    rest, fine = _factor(_covariances(model, at, at, True) - np.einsum("bij,bik->bjk", own, own))
    w = _forward(rest, (z - mu)[:, :, None])[:, :, 0]
    ok = good & fine
    quad = np.where(ok, (w * w).sum(1), np.nan)
    logdet = np.where(ok, 2 * np.log(np.einsum("bii->bi", rest)).sum(1), np.nan)
    return {"quad": quad, "logdet": logdet, "ll": -0.5 * (quad + logdet + z.shape[1] * math.log(2 * math.pi)), "status": np.where(good, np.where(fine, "ok", "variance"), "singular")}


def terms(neighbors: DataFrame, m: int, model) -> DataFrame:
    """(rank, quad, logdet, ll, status) of every conditioned site, as gathered() gives them; what has no factor gets a status and NaN."""
    k, v = len(model.columns), model.variables

    def run(batches):
        step = max(1, _TILE_BYTES // (8 * (m * v) ** 2))
        for whole in batches:
            for low in range(0, whole.num_rows, step):
                b = whole.slice(low, step)
                sites = [np.asarray(b.column(1 + i), np.float64) for i in range(k)]
                near = [np.asarray(b.column(k + 2 + i).flatten(), np.float64).reshape(-1, m) for i in range(k)]
                z = np.asarray(b.column(k + 1).flatten(), np.float64).reshape(-1, v)
                nz = np.asarray(b.column(2 * k + 2).flatten().flatten(), np.float64).reshape(-1, m, v)
                got = conditional(model, sites, z, near, nz)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(got[c]) for c in ("quad", "logdet", "ll")), pa.array(got["status"].tolist(), pa.string())], ["rank", "quad", "logdet", "ll", "status"])

    return neighbors.mapInArrow(run, TERMS)


def block_term(model, sites: list[np.ndarray], z: np.ndarray) -> float:
    """The joint log-likelihood of the first block, m sites on the driver; NaN if it has no factor."""
    factor, good = _factor(_covariances(model, [x[None] for x in sites], [x[None] for x in sites], True))
    u = _forward(factor, z.reshape(1, -1, 1))[0, :, 0]
    return float(-0.5 * (u @ u + 2 * np.log(np.diag(factor[0])).sum() + z.size * math.log(2 * math.pi))) if good[0] else math.nan
