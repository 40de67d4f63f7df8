"""The assembled feature row: 18 market values and 9 spectral ones for each (asset, open_time)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_div
from tidemark.operators.windows import PERIODS, by_time

# fixed values: the columns in order, and what each is where its part is missing
BASE = {
    "garch_vol": 0.0, "kalman_level_dev": 0.0, "kalman_velocity": 0.0, "spread_bps": 0.0, "depth_ofi": 0.0, "depth_ratio": 0.0, "price_impact": 0.0, "micro_price_dev": 0.0,
    "trade_imbalance": 0.5, "hawkes_cross_ratio": 0.0, "funding_z": 0.0, "funding_momentum": 0.0, "vol_ratio": 1.0, "premium_pct": 0.0, "beta": 1.0, "idiosyncratic_ret": 0.0,
    "ou_z_score": 0.0, "corr": 0.0,
}
SPECTRAL = [*(f"p{p}" for p in PERIODS), "dominant_period", "spectral_entropy", "noise_trend_ratio", "dominant_phase"]


def assemble(returns: DataFrame, anchor_returns: DataFrame, parts: Sequence[DataFrame] = (), by_asset: Sequence[DataFrame] = (), least: int = 30) -> DataFrame:
    """One row for each bar that has at least `least` bars of its asset up to it.

    returns has (asset, open_time, close, ret), anchor_returns (open_time, anchor_ret); parts are
    keyed by (asset, open_time) and by_asset by asset, one row a key, with any columns of BASE or
    SPECTRAL, or kalman_level. What is missing takes its default; the return beyond beta times the
    anchor's is computed here. Joins are by equality and left, so rows are never lost or repeated."""
    out = returns.select("asset", "open_time", "close", "ret").withColumn("_n", F.row_number().over(by_time())).where(F.col("_n") >= least).drop("_n")
    for part in parts:
        out = out.join(part, ["asset", "open_time"], "left")
    for part in by_asset:
        out = out.join(part, "asset", "left")
    out = out.join(anchor_returns.select("open_time", "anchor_ret"), "open_time", "left")
    for name, value in BASE.items():
        have = F.col(name) if name in out.columns else F.lit(None).cast("double")
        out = out.withColumn(name, F.coalesce(have, F.lit(value)))
    if "kalman_level" in out.columns:
        out = out.withColumn("kalman_level_dev", F.coalesce(safe_div(F.col("close") - F.col("kalman_level"), F.col("kalman_level")), F.lit(0.0)))
    out = out.withColumn("idiosyncratic_ret", F.col("ret") - F.col("beta") * F.coalesce("anchor_ret", F.lit(0.0)))
    have = [c if c in out.columns else None for c in SPECTRAL]
    return out.select("asset", "open_time", *BASE, *(F.col(c).cast("double").alias(c) if c else F.lit(None).cast("double").alias(n) for c, n in zip(have, SPECTRAL, strict=True)))


def vector(rows: DataFrame) -> Column:
    """The 27 values in order; the spectral ones scaled, and zero while their window is not full."""
    scaled = {"dominant_period": F.col("dominant_period") / PERIODS[-1], "noise_trend_ratio": F.when(F.col("noise_trend_ratio") > 10, 1.0).otherwise(F.col("noise_trend_ratio") / 10), "dominant_phase": F.col("dominant_phase") / math.pi}
    return F.array(*(F.col(c) for c in BASE), *(F.coalesce(scaled.get(c, F.col(c)), F.lit(0.0)) for c in SPECTRAL))


def matrix(rows: DataFrame, newest: int | None = None) -> DataFrame:
    """asset, open_time, features: the last `newest` rows of each asset, or all of them."""
    out = rows.select("asset", "open_time", vector(rows).alias("features"))
    if newest is None:
        return out
    from pyspark.sql import Window

    late = Window.partitionBy("asset").orderBy(F.col("open_time").desc())
    return out.withColumn("_n", F.row_number().over(late)).where(F.col("_n") <= newest).drop("_n")


def latest(rows: DataFrame) -> DataFrame:
    """Each asset's last row."""
    names = [c for c in rows.columns if c != "asset"]
    return rows.groupBy("asset").agg(F.max(F.struct("open_time", *(c for c in names if c != "open_time"))).alias("_r")).select("asset", "_r.*")
