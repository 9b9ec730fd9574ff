"""Likelihoods under the covariances of functions.models."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import modelled as operators
from ..operators.neighbors import first_block, knn_grid
from ..operators.ordering import morton_code, ranked
from ..sources.work import cut


@dataclass
class ModelPlan:
    """Ranked sites with their neighbours' columns and observations, shared by every evaluation of models over the same columns."""

    ranked: DataFrame
    neighbors: DataFrame
    n: int
    m: int
    columns: tuple[str, ...]

    def terms(self, model) -> DataFrame:
        return operators.terms(self.neighbors, self.m, model)

    def loglik(self, model) -> float:
        """NaN if a tile has no factor; 0 without sites."""
        if not self.n:
            return 0.0
        rows = sorted(first_block(self.ranked, self.m).select("rank", *self.columns, "z").collect())  # m sites
        first = operators.block_term(model, [np.array([r[c] for r in rows], float) for c in self.columns], np.array([r["z"] for r in rows], float))
        rest = self.terms(model).agg(F.sum("ll").alias("ll"), F.count_if(F.col("status") != "ok").alias("bad")).first()
        return math.nan if rest["bad"] else first + (rest["ll"] or 0.0)


def prepare(sites: DataFrame, model, m: int, how: str = "knn", time_scale: float | None = None, most_block: int = 1024) -> ModelPlan:
    """sites (id, *columns of the model, z array) ranked, with the m nearest sites before each.

    A model without a column t takes Morton order (of rescaled coordinates beyond [0, 1]) and nearness in the plane; one
    with t takes the order of time, so that only what came before conditions, and nearness over (x, y, time_scale t). Ids
    must be distinct; a null, NaN or infinite number raises ValueError. m beyond the number of sites becomes that number,
    which makes the likelihood exact; the first block is factored on the driver and may have most_block rows at most.
    """
    sites = cut(operators.checked(sites, model))
    n = sites.count()
    m = max(1, min(m, n))
    if m * model.variables > most_block:
        raise ValueError(f"the first block would have {m * model.variables} rows, more than {most_block}")
    if "t" in model.columns:
        placed = cut(ranked(sites, "t", "id", n=n))
        near = operators.nearby(placed, m, model.columns, 1.0 if time_scale is None else time_scale)
    else:
        box = sites.agg(F.min(F.least("x", "y")).alias("low"), F.max(F.greatest("x", "y")).alias("high")).first()
        placed = cut(ranked(morton_code(sites, n > 0 and (box["low"] < 0 or box["high"] > 1)), "code", "id", n=n).drop("code"))
        near = operators.nearby(placed, m, model.columns) if how == "knn" else cut(operators.gathered(placed, knn_grid(placed, m, "euclidean", n), model.columns))
    return ModelPlan(placed, near, n, m, model.columns)
