"""Sizing over several periods: values of a grid of fractions, worked back from the horizon.

All of it is array expressions on one row, so it needs no shuffle but the one that scales a
tick's fractions to the exposure limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, sign_up

POINTS = 41


def _one_period(mean: Column, second: Column, current: Column, fraction: float, cap: float, tc_weight: float, tc_bps: float) -> Column:
    raw = F.when(second > 1e-15, fraction * mean / second).otherwise(0.0)
    return clamp(raw - tc_weight * sign_up(raw - current) * tc_bps * 1e-4, -cap, cap)


def dp_fraction(mean: Column, std: Column, current: Column, horizon: int, fraction: float = 0.5, cap: float = 0.3, tc_weight: float = 0.001, tc_bps: float = 5.0) -> Column:
    """The fraction to hold next, of equal values the largest; a horizon of 1 is plain Kelly."""
    second = std * std + mean * mean
    if horizon <= 1:
        return _one_period(mean, second, current, fraction, cap, tc_weight, tc_bps)
    grid = F.array(*(F.lit(-cap + 2 * cap * i / (POINTS - 1)) for i in range(POINTS)))
    growth = lambda f: f * mean - 0.5 * f * f * second

    def last(f):
        best = _one_period(mean, second, f, fraction, cap, tc_weight, tc_bps)
        return growth(best) - tc_weight * F.abs(best - f)

    def gain(now, values):
        return F.zip_with(grid, values, lambda f, v: growth(f) - tc_weight * F.abs(f - now) + v)

    values = F.aggregate(F.sequence(F.lit(2), F.lit(horizon)), F.transform(grid, last), lambda v, _: F.transform(grid, lambda now: F.array_max(gain(now, v))))
    at = clamp(F.round((current + cap) / (2 * cap) * (POINTS - 1)), 0.0, POINTS - 1.0).cast("int")
    return F.array_max(F.arrays_zip(gain(grid[at], values).alias("v"), grid.alias("f")))["f"]


def dp_decisions(dists: DataFrame, horizon: int, nav: float, least_confidence: float = 0.55, max_gross: float = 3.0, max_net: float = 1.8, cap: float = 0.3, max_leverage: float = 3.0) -> DataFrame:
    """From dists (open_time, asset, p_up, p_down, mean, std, confidence, regime, current): one row
    for each asset that is worth holding, scaled to the tick's exposure limits."""
    c = F.col
    rows = dists.where((c("confidence") > least_confidence) & (F.abs(c("p_up") - c("p_down")) >= 0.05) & F.lit(nav >= 1.0))
    second = c("std") * c("std") + c("mean") * c("mean")
    single = _one_period(c("mean"), second, c("current"), 0.5, cap, 0.001, 5.0)
    rows = rows.withColumn("f", dp_fraction(c("mean"), c("std"), c("current"), horizon, cap=cap)).where(F.abs("f") >= 1e-4)
    rows = rows.withColumn("one", single).withColumn("elg", c("one") * c("mean") - 0.5 * c("one") * c("one") * second)
    tick = Window.partitionBy("open_time")
    gross, net = F.sum(F.abs("f")).over(tick), F.abs(F.sum("f").over(tick))
    scale = F.least(F.when(gross > max_gross, max_gross / gross).otherwise(1.0), F.when(net > max_net, max_net / net).otherwise(1.0))
    rows = rows.withColumn("scaled", c("f") * scale)
    size = F.least(F.abs("scaled"), F.lit(cap))
    return rows.select(
        "open_time", "asset", F.when(c("scaled") >= 0, "LONG").otherwise("SHORT").alias("direction"), size.alias("fraction"), clamp(size * max_leverage, 1.0, max_leverage).alias("leverage"),
        (size * nav).alias("size_usd"), "elg", "confidence", "regime",
    )
