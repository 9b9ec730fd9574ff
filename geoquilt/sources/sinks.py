"""Fit, trace and timing tables, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FIT = "iterations int, variance double, range double, smoothness double, nugget double, loglik double, ordering string, seconds double"
TRACE = "iter int, sigma2 double, range double, nu double, nugget double, llk double"
PERF = "stage string, seconds double, gflops double"


def fit_log(spark: SparkSession, iterations: int, theta, loglik: float, ordering: str, seconds: float | None = None) -> DataFrame:
    """One row: what a fit found, after how many evaluations and seconds."""
    return spark.createDataFrame([(iterations, float(theta.sigma2), float(theta.range), float(theta.nu), float(theta.nugget), float(loglik), ordering, seconds)], FIT)


def trace_log(spark: SparkSession, trace: list[tuple]) -> DataFrame:
    return spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(trace, 1)], TRACE)


def perf_log(spark: SparkSession, rows: list[tuple[str, float, float | None]]) -> DataFrame:
    return spark.createDataFrame(rows, PERF)


def log_name(n: int, m: int, seed: int | None = None, theta=None, order: str | None = None) -> str:
    """A run's file name: sizes, and the seed and parameters of a performance run."""
    name = f"locs_{n}_cs_{m}" + (f"_seed_{seed}_kernel_{theta.sigma2}:{theta.range}:{theta.nu}" if seed is not None and theta is not None else "")
    return name + (f"_{order}" if order in ("morton", "random") else "")


def write_log(df: DataFrame, folder: str, name: str, nugget: bool = True) -> str:
    """df as CSV with a header under folder/name; the nugget column only where the kernel has one. Returns the path."""
    path = f"{folder.rstrip('/')}/{name}"
    if not nugget and "nugget" in df.columns:
        df = df.drop("nugget")
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
