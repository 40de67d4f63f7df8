"""Signals, their fusion, sizing, subset choice, risk gates and execution costs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, entropy_confidence, logistic, normal_cdf, regime, risk_reward, safe_div, sign_up
from tidemark.operators.windows import ema
from tidemark.settings import RiskLimits, Settings


def frequency_signal(features: DataFrame) -> DataFrame:
    """From spectral_entropy, noise_trend_ratio and velocity: p_up, p_down, mean, std, log_evidence."""
    h, r = F.col("spectral_entropy"), F.col("noise_trend_ratio")
    trend = clamp((1 - h) * F.least(1 / F.greatest(r, F.lit(0.1)), F.lit(1.0)), 0.0, 1.0)
    noise = clamp(h * F.least(r, F.lit(1.0)), 0.0, 1.0)
    bias, std = trend * sign_up(F.col("velocity")) * F.sqrt(trend), 0.005 + 0.02 * noise
    up, down = clamp(0.5 + bias / 2, 0.01, 0.99), clamp(0.5 - bias / 2, 0.01, 0.99)
    evidence = clamp(-F.ln(F.greatest(h, F.lit(1e-5))) * (1 - h) - 1, -20.0, 0.0)
    return features.select("asset", "open_time", F.lit("frequency").alias("source"), up.alias("p_up"), down.alias("p_down"), (bias * std).alias("mean"), std.alias("std"), evidence.alias("log_evidence"))


def orderbook_signal(df: DataFrame) -> DataFrame:
    """From ofi and cross (excitation ratio)."""
    tail = F.least(clamp(F.col("cross"), 0.0, 5.0) / 5, F.lit(0.5))
    std, ofi = 0.003 + 0.015 * tail, F.col("ofi")
    up, down = (clamp(normal_cdf(s * ofi / std * 0.5), 0.01, 0.99) for s in (F.lit(1.0), F.lit(-1.0)))
    return df.select("asset", "open_time", F.lit("orderbook").alias("source"), up.alias("p_up"), down.alias("p_down"), (ofi * std).alias("mean"), std.alias("std"), (-0.5 * (1 - F.abs(ofi)) - tail).alias("log_evidence"))


def kalman_signal(posterior: DataFrame, sigma: float = 1e-3) -> DataFrame:
    """From level, velocity, drift, level_variance and log_predictive of the dual Kalman filter."""
    mean = F.col("level") + F.col("velocity") + F.col("drift")
    std = F.greatest(F.sqrt(F.col("level_variance") + sigma * sigma), F.lit(1e-10))
    up, down = (clamp(normal_cdf(s * mean / std), 0.0, 1.0) for s in (F.lit(1.0), F.lit(-1.0)))
    return posterior.select("asset", "open_time", F.lit("dual_kalman").alias("source"), up.alias("p_up"), down.alias("p_down"), mean.alias("mean"), std.alias("std"), F.col("log_predictive").alias("log_evidence"))


def fuse(signals: DataFrame, floor: float = 0.05, decay: float = 0.99, sources: int = 3) -> DataFrame:
    """One row for each (asset, open_time) that has a signal: the mixture of its sources.

    Each source's evidence, held to [-50, 0], is averaged over the asset's signals so far (see
    windows.ema). Weights are the softmax of those averages over the sources at hand, with a floor
    for each of at most 1 / sources; confidence is the mean of the sources' own by weight."""
    floor = min(max(floor, 0.0), 1 / sources)
    held = signals.withColumn("evidence", clamp(F.col("log_evidence"), -50.0, 0.0))
    held = ema(held, "evidence", ["asset", "source"], decay, "memory")
    by = Window.partitionBy("asset", "open_time")
    e = F.exp(F.col("memory") - F.max("memory").over(by))
    n = F.count(F.lit(1)).over(by)
    weight = F.when(floor * n >= 1, 1 / n).otherwise(floor + (1 - floor * n) * e / F.greatest(F.sum(e).over(by), F.lit(1e-30)))
    w = held.withColumn("w", weight).withColumn("mixed", F.sum(F.col("w") * F.col("mean")).over(by))
    mix = lambda c: F.sum(F.col("w") * c)
    off = F.col("mean") - F.col("mixed")
    out = w.groupBy("asset", "open_time").agg(
        clamp(mix(F.col("p_up")), 0.0, 1.0).alias("p_up"), clamp(mix(F.col("p_down")), 0.0, 1.0).alias("p_down"), F.first("mixed").alias("mean"),
        F.greatest(F.sqrt(mix(F.col("std") * F.col("std") + off * off)), F.lit(1e-10)).alias("std"),
        clamp(mix(entropy_confidence(F.col("p_up"), F.col("p_down"))), 0.0, 1.0).alias("confidence"), F.max("w").alias("top_weight"),
    )
    return out.withColumn("regime", regime(F.col("std"), F.col("p_up") - F.col("p_down")))


def kelly(dists: DataFrame, fraction: float = 0.5, cap: float = 0.3, tc_weight: float = 0.001) -> DataFrame:
    """dists (mean, std, tc_bps, current) with f, elg (expected log growth) and turnover cost."""
    second = F.col("std") * F.col("std") + F.col("mean") * F.col("mean")
    raw = F.when(second > 1e-15, fraction * F.col("mean") / second).otherwise(0.0)
    f = clamp(raw - tc_weight * sign_up(raw - F.col("current")) * F.col("tc_bps") * 1e-4, -cap, cap)
    out = dists.withColumn("f", f)
    elg = F.col("f") * F.col("mean") - 0.5 * F.col("f") * F.col("f") * second
    return out.withColumn("elg", elg).withColumn("cost_bps", F.abs(F.col("f") - F.col("current")) * F.col("tc_bps"))


def candidates(sized: DataFrame, least_confidence: float = 0.55, least_edge: float = 0.05, least_elg: float = 0.0) -> DataFrame:
    edge = F.abs(F.col("p_up") - F.col("p_down"))
    return sized.where((F.col("confidence") > 0.55) & (F.col("confidence") >= least_confidence) & (edge >= least_edge) & (F.abs("f") >= 1e-4) & (F.col("elg") >= least_elg))


def best_subset(cands: DataFrame, most: int = 3, budget: float = 25.0, cap: int = 10) -> DataFrame:
    """For each tick (open_time), the subset of up to most of its candidates with the highest sum of
    net scores within the cost budget, as rows (open_time, asset, ...). Ticks with more than cap
    candidates use greedy choice. Subsets are grown by joins on the tick, so no rows leave it."""
    rank = Window.partitionBy("open_time").orderBy("asset")
    greedy = Window.partitionBy("open_time").orderBy(F.col("net").desc(), "asset")
    rows = cands.withColumn("net", F.col("elg") - F.col("cost_bps") * 1e-4)
    rows = rows.withColumn("i", F.row_number().over(rank)).withColumn("g", F.row_number().over(greedy)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("open_time")))
    one = rows.where(F.col("n") <= cap).select("open_time", F.col("i").alias("last"), F.array("i").alias("ids"), "net", F.col("cost_bps").alias("cost"))
    item = rows.where(F.col("n") <= cap).select("open_time", "i", F.col("net").alias("net1"), F.col("cost_bps").alias("cost1"))
    sets, level = one, one
    for _ in range(most - 1):
        level = level.join(item, "open_time").where("i > last").select("open_time", F.col("i").alias("last"), F.array_append("ids", F.col("i")).alias("ids"), (F.col("net") + F.col("net1")).alias("net"), (F.col("cost") + F.col("cost1")).alias("cost"))
        sets = sets.union(level)
    # of equal sums the smaller set counts, then the earlier one
    order = F.struct(F.round("net", 12).alias("s"), -F.size("ids"), F.transform("ids", lambda x: -x))
    best = sets.where(F.col("cost") <= budget).groupBy("open_time").agg(F.max_by("ids", order).alias("ids"))
    exact = rows.join(best, "open_time").where(F.array_contains("ids", F.col("i")))
    spent = F.aggregate(F.array_sort(F.collect_list(F.struct("g", "cost_bps", "i"))), F.struct(F.lit(0.0).alias("c"), F.array().cast("array<int>").alias("ids")), lambda a, x: F.when(a["c"] + x["cost_bps"] <= budget, F.struct((a["c"] + x["cost_bps"]).alias("c"), F.array_append(a["ids"], x["i"]).alias("ids"))).otherwise(a))
    top = rows.where((F.col("n") > cap) & (F.col("g") <= most)).groupBy("open_time").agg(spent["ids"].alias("ids"))
    rest = rows.join(top, "open_time").where(F.array_contains("ids", F.col("i")))
    return exact.unionByName(rest).drop("ids", "i", "g", "n")


def legs(chosen: DataFrame, max_gross: float = 3.0, max_net: float = 1.8, cap: float = 0.3, max_leverage: float = 3.0) -> DataFrame:
    """Scale the chosen fractions to the exposure limits, and add direction, leverage, stop, target;
    confidence is kept where it is there."""
    tick = Window.partitionBy("open_time")
    gross, net = F.sum(F.abs("f")).over(tick), F.abs(F.sum("f").over(tick))
    scale = F.least(F.when(gross > max_gross, max_gross / gross).otherwise(1.0), F.when(net > max_net, max_net / net).otherwise(1.0))
    out = chosen.withColumn("scaled", F.col("f") * scale)
    size = F.least(F.abs("scaled"), F.lit(cap))
    distance = 2 * F.greatest(F.col("std"), F.lit(0.001)) * F.col("close")
    rr = F.when(F.col("regime") == "high_vol", 3.0).when(F.col("regime") == "trending", 2.0).otherwise(1.5)
    side = sign_up(F.col("scaled"))
    return out.select("open_time", "asset", F.when(F.col("scaled") >= 0, "LONG").otherwise("SHORT").alias("direction"), size.alias("fraction"), clamp(size * max_leverage, 1.0, max_leverage).alias("leverage"), (F.col("close") - side * distance).alias("stop"), (F.col("close") + side * distance * rr).alias("target"), F.col("close").alias("entry"), "elg", "regime", *(c for c in ("confidence",) if c in chosen.columns))


def first_reason(gates: list[tuple]) -> Column:
    """The name of the first failing gate, or null."""
    return reduce(lambda c, g: c.when(g[0], g[1]), gates[1:], F.when(gates[0][0], gates[0][1]))


def risk_gates(df: DataFrame, limits: RiskLimits | None = None) -> DataFrame:
    """Seven gates in order; reject_reason is the first that fails. df has the signal and portfolio
    columns named below; limits default to the fixed ones."""
    own = limits or RiskLimits()
    c = F.col
    nav = F.greatest(c("nav"), F.lit(1.0))
    gates = [
        (c("drawdown") > own.max_daily_drawdown, "drawdown"), ((c("gross") + c("size") * c("leverage")) / nav > own.max_gross_exposure, "leverage"),
        ((c("size") + c("held")) / nav > own.max_single_asset_weight, "concentration"), (c("corr") > own.max_pairwise_correlation, "correlation"),
        (risk_reward(c("entry"), c("stop"), c("target")) < own.min_risk_reward, "risk_reward"), (c("n_open") >= own.max_concurrent_positions, "positions"),
        (c("confidence") < own.min_signal_confidence, "confidence"),
    ]
    return df.withColumn("reject_reason", first_reason(gates))


def kill_switch(df: DataFrame, limits: RiskLimits | None = None) -> DataFrame:
    """action by the first rule that holds, or null, from drawdown, gross_leverage, vol, log_predictive."""
    c, own = F.col, limits or RiskLimits()
    gates = [
        (c("drawdown") > own.max_portfolio_drawdown, "close_all"), (c("gross_leverage") > own.max_gross_exposure * 1.5, "close_all"),
        (c("vol") > own.target_daily_vol * own.vol_kill_multiplier, "reduce_all"), (c("log_predictive") < own.min_log_predictive, "reduce_all"),
        (c("drawdown") > own.max_daily_drawdown, "halt"), (c("gross_leverage") > own.max_gross_exposure, "halt"),
    ]
    return df.withColumn("action", first_reason(gates))


def position_stop(df: DataFrame, most_ms: int = 86_400_000, adverse: float = 0.05) -> DataFrame:
    moved = F.when(F.col("is_long"), 1.0).otherwise(-1.0) * safe_div(F.col("price") - F.col("entry"), F.col("entry"))
    late = F.greatest(F.col("now_ms") - F.col("opened_ms"), F.lit(0)) > most_ms
    return df.withColumn("close_reason", F.when(late, "time_stop").when(moved < -adverse, "vol_stop"))


def execution(df: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Costs, fill probability and whether a signal is worth sending."""
    c, own = F.col, settings or Settings()
    max_age_ms, eta, kappa = own.max_signal_age_ms, own.impact_eta, own.impact_kappa
    stale = F.greatest(c("now_ms") - c("made_ms"), F.lit(0)) > max_age_ms
    size = c("size") * c("leverage")
    q = size / F.greatest(c("adv"), F.lit(1.0))
    cost = c("spread") * 0.5 + eta * q + kappa * F.greatest(c("spread"), F.lit(1e-4)) * F.sqrt(q)
    fill = logistic(c("depth") / F.greatest(size, F.lit(1.0)) - 1)
    out = df.withColumn("cost", F.when(stale, 0.0).otherwise(cost)).withColumn("fill", F.when(stale, 0.0).otherwise(fill))
    reason = F.when(stale, "stale").when(c("fill") <= 0.3, "low_fill").when(F.abs("edge") <= 100 * c("cost"), "edge_below_cost")
    return out.withColumn("reason", reason).withColumn("executable", c("reason").isNull())
