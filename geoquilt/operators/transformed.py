"""Likelihoods of observations that are a transform of a Gaussian field."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel, Theta
from ..functions.tukey import Tukey
from .likelihood import _chunks, block_term, conditional


def transformed_sums(neighbors: DataFrame, m: int, kernel: Kernel, cases: list[tuple[Theta, Tukey]]) -> DataFrame:
    """(case_id, ll, n, bad), a row for each case: the terms of the Gaussian values less the logs of the transform's slopes.

    One narrow pass: neighbours do not depend on the observations' scale, so each value is inverted where it is used.
    """

    def run(batches):
        for batch in batches:
            sums, bad, n = np.zeros(len(cases)), np.zeros(len(cases), np.int64), 0
            for rank, x, y, z, nx, ny, nz in _chunks(batch, m):
                n += len(rank)
                for i, (theta, tukey) in enumerate(cases):
                    u, nu = tukey.inverse(z), tukey.inverse(nz)
                    lost = np.isnan(u) | np.isnan(nu).any(1)
                    got = conditional(kernel, theta, x, y, np.where(lost, 0.0, u), nx, ny, np.where(lost[:, None], 0.0, nu))
                    lost |= got["status"] != "ok"
                    bad[i] += int(lost.sum())
                    sums[i] += math.fsum((got["ll"] - tukey.log_slope(u))[~lost])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cases), dtype=np.int32)), pa.array(sums), pa.array(np.full(len(cases), n)), pa.array(bad)], ["case_id", "ll", "n", "bad"])

    parts = neighbors.select("rank", "x", "y", "z", "nx", "ny", "nz").mapInArrow(run, "case_id int, ll double, n long, bad long")
    return parts.groupBy("case_id").agg(F.sum("ll").alias("ll"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def transformed_block(kernel: Kernel, theta: Theta, tukey: Tukey, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> float:
    """The first block's term; NaN if it has no factor or a value no inverse."""
    u = tukey.inverse(z)
    return math.nan if np.isnan(u).any() else block_term(kernel, theta, x, y, u)["ll"] - float(tukey.log_slope(u).sum())
