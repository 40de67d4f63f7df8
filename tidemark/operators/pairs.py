"""Pairs of assets: cointegration and Ornstein-Uhlenbeck fits from sums over common days."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ols(x: str, y: str) -> tuple[Column, Column]:
    """Intercept and slope as aggregates; a flat x has slope 0."""
    n, sx, sy, sxy, sxx = F.count(F.lit(1)), F.sum(x), F.sum(y), F.sum(F.col(x) * F.col(y)), F.sum(F.col(x) * F.col(x))
    d = n * sxx - sx * sx
    slope = F.when(F.abs(d) < 1e-12, 0.0).otherwise((n * sxy - sx * sy) / d)
    return (sy - slope * sx) / n, slope


def pair_series(prices: DataFrame, key: str = "day") -> DataFrame:
    """a, b, key, p1, p2 for a < b on their common keys."""
    left = prices.select(F.col("asset").alias("a"), key, F.col("close").alias("p1"))
    right = prices.select(F.col("asset").alias("b"), key, F.col("close").alias("p2"))
    return left.join(right, key).where("a < b")


def spreads(prices: DataFrame, key: str = "day") -> DataFrame:
    """a, b, key, alpha, beta, spread, by OLS of p1 on p2."""
    series = pair_series(prices, key)
    alpha, beta = ols("p2", "p1")
    fit = series.groupBy("a", "b").agg(alpha.alias("alpha"), beta.alias("beta"))
    return series.join(F.broadcast(fit), ["a", "b"]).select("a", "b", key, "alpha", "beta", (F.col("p1") - F.col("alpha") - F.col("beta") * F.col("p2")).alias("spread"))


def steps(spread: DataFrame, key: str = "day") -> DataFrame:
    w = Window.partitionBy("a", "b").orderBy(key)
    return spread.withColumn("lag", F.lag("spread").over(w)).withColumn("d", F.col("spread") - F.col("lag")).where("lag is not null")


def engle_granger(prices: DataFrame, least: int = 30, critical: float = -2.86) -> DataFrame:
    """a, b, n, beta, adf, cointegrated. The residual of the ADF step leaves the intercept out and
    Sxx is not centred, as the fixed rule has it."""
    s = steps(spreads(prices))
    _, slope = ols("lag", "d")
    fit = s.groupBy("a", "b").agg(slope.alias("slope"), F.count(F.lit(1)).alias("m"), F.first("beta").alias("beta"))
    rest = s.drop("beta").join(F.broadcast(fit), ["a", "b"]).withColumn("r", F.col("d") - F.col("slope") * F.col("lag"))
    out = rest.groupBy("a", "b").agg(F.first("m").alias("m"), F.first("beta").alias("beta"), F.first("slope").alias("slope"), F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("lag") * F.col("lag")).alias("xx"))
    adf = F.col("slope") / F.sqrt(F.col("rr") / (F.col("m") - 2) / F.col("xx"))
    return out.where(F.col("m") + 1 >= least).select("a", "b", (F.col("m") + 1).alias("n"), "beta", adf.alias("adf")).withColumn("cointegrated", F.col("adf") < critical)


def ou(prices: DataFrame) -> DataFrame:
    """a, b, kappa, theta, sigma, half_life of the spread, and its last z-score."""
    spread = spreads(prices)
    s = steps(spread)
    a, b = ols("lag", "d")
    fit = s.groupBy("a", "b").agg(a.alias("c"), b.alias("slope"), F.max_by("spread", "day").alias("now"))
    rest = s.join(F.broadcast(fit), ["a", "b"]).withColumn("r", F.col("d") - F.col("c") - F.col("slope") * F.col("lag"))
    out = rest.groupBy("a", "b").agg(F.first("c").alias("c"), F.greatest(-F.first("slope"), F.lit(1e-8)).alias("kappa"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("sigma"), F.first("now").alias("now"))
    out = out.withColumn("theta", F.col("c") / F.col("kappa"))
    z = (F.col("now") - F.col("theta")) / F.greatest(F.col("sigma") / F.sqrt(2 * F.col("kappa")), F.lit(1e-10))
    return out.select("a", "b", "kappa", "theta", "sigma", (math.log(2) / F.col("kappa")).alias("half_life"), z.alias("z"))
