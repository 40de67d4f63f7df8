"""Walk-forward folds in two stages: signals by (fold, asset), then one book by fold.

A fold is train + test bars by position. NAV makes a fold's book sequential, so the second stage
gets only what it needs: a few columns of the fold's test bars."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.scans import DualKalman


def folds(bars: DataFrame, train: int, test: int) -> DataFrame:
    """bars with i (position), fold and phase; only whole folds of the shortest asset."""
    own = bars.withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("open_time")) - 1)
    shortest = own.groupBy("asset").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("n"))
    size = train + test
    got = own.crossJoin(F.broadcast(shortest)).withColumn("fold", F.floor(F.col("i") / size))
    return got.where(F.col("fold") < F.floor(F.col("n") / size)).withColumn("testing", F.col("i") % size >= train).drop("n")


def signals(folded: DataFrame) -> DataFrame:
    """fold, i, asset, close, edge, std of each test bar, from a filter on log prices."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, kf, out = pdf.sort_values("i"), DualKalman(), []
        last = None
        for i, close, testing in zip(pdf["i"], pdf["close"], pdf["testing"], strict=True):
            r = 0.0 if last is None or last < 1e-10 else math.log(close / last)
            level, velocity, drift, _, _, var = kf.step(r)
            mean, std = level + velocity + drift, max(math.sqrt(max(var, 0) + 1e-6), 1e-10)
            if testing:
                up = 0.5 * (1 + math.erf(mean / std / math.sqrt(2)))
                out.append((pdf["fold"].iloc[0], i, pdf["asset"].iloc[0], close, 2 * up - 1, std))
            last = close
        return pd.DataFrame(out, columns=["fold", "i", "asset", "close", "edge", "std"])

    return folded.select("fold", "asset", "i", "close", "testing").groupBy("fold", "asset").applyInPandas(run, "fold long, i long, asset string, close double, edge double, std double")


def book(signals: DataFrame, start: float = 10_000.0, kelly: float = 0.3, cap: float = 0.3, most: int = 5, least_edge: float = 0.1, cost_bps: float = 5.0) -> DataFrame:
    """One row a bar, as metrics() reads it: each bar closes what the bar before opened."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nav, held, out = start, [], []
        for i, bar in pdf.sort_values(["i", "asset"]).groupby("i", sort=True):
            price, before = dict(zip(bar["asset"], bar["close"], strict=True)), nav
            closed = [(s * (price[a] / p - 1), abs(s)) for a, p, s in held if a in price]
            nav += sum(x for x, _ in closed)
            held = []
            for a, p, e, std in zip(bar["asset"], bar["close"], bar["edge"], bar["std"], strict=True):
                if abs(e) >= least_edge and len(held) < most:
                    held.append((a, p, nav * min(kelly * abs(e) / max(std, 0.001), cap) * (1 if e > 0 else -1)))
            cost = sum(abs(s) for _, _, s in held) * cost_bps * 1e-4
            nav -= cost
            won = [x / max(s, 1.0) for x, s in closed if x > 0]
            lost = [-x / max(s, 1.0) for x, s in closed if x <= 0]
            out.append((pdf["fold"].iloc[0], i, nav, nav - before, sum(s for _, s in closed), cost, len(won), len(lost), sum(won), sum(lost)))
        return pd.DataFrame(out, columns=["fold", "i", "nav", "pnl", "traded", "cost", "wins", "losses", "win_share", "loss_share"])

    return signals.groupBy("fold").applyInPandas(run, "fold long, i long, nav double, pnl double, traded double, cost double, wins long, losses long, win_share double, loss_share double")


def metrics(curve: DataFrame, start: float = 10_000.0, per_year: int = 105_120) -> DataFrame:
    """One row a fold from its bars (fold, i, nav, pnl, traded, cost, wins, losses, win_share,
    loss_share). Returns are pnl over the starting value; a fold of one bar has zeros.

    win_share and loss_share are the sums of gains and losses over the size of their trades;
    longest_drawdown is the most bars without a new high of the summed returns, which start at 0."""
    c, w = F.col, Window.partitionBy("fold").orderBy("i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    rows = curve.withColumn("r", c("pnl") / start).withColumn("_sum", F.sum("pnl").over(upto)).withColumn("_k", F.row_number().over(w))
    rows = rows.withColumn("_new", c("_sum") > F.greatest(F.coalesce(F.max("_sum").over(before), F.lit(0.0)), F.lit(0.0)))
    rows = rows.withColumn("_since", c("_k") - F.coalesce(F.max(F.when(c("_new"), c("_k"))).over(upto), F.lit(0)))
    rows = rows.withColumn("peak", F.greatest(F.max("nav").over(upto), F.lit(start)))
    mean, floor = F.avg("r"), lambda x: F.greatest(x, F.lit(1e-10))
    down = F.sqrt(F.avg(F.when(c("r") < 0, c("r") * c("r")).otherwise(0.0)))
    each = lambda total, n: F.when(F.sum(n) > 0, F.sum(total) / F.sum(n)).otherwise(0.0)
    got = rows.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_bars"), F.sum(c("wins") + c("losses")).alias("n_trades"), (F.max_by("nav", "i") / start - 1).alias("total_return"),
        (mean / floor(F.coalesce(F.stddev_samp("r"), F.lit(0.0))) * math.sqrt(per_year)).alias("sharpe"), (mean / floor(down) * math.sqrt(per_year)).alias("sortino"),
        F.max((c("peak") - c("nav")) / c("peak")).alias("max_drawdown"), F.max("_since").alias("longest_drawdown"), (F.sum("wins") / F.greatest(F.sum(c("wins") + c("losses")), F.lit(1))).alias("hit_rate"),
        each("win_share", "wins").alias("average_win"), each("loss_share", "losses").alias("average_loss"), F.sum("traded").alias("turnover"), F.sum("cost").alias("costs"),
    )
    got = got.withColumn("annual_return", c("total_return") * per_year / c("n_bars"))
    got = got.withColumn("calmar", F.when(c("max_drawdown") > 1e-10, c("annual_return") / c("max_drawdown")).otherwise(0.0))
    return got.select("fold", *(F.when(c("n_bars") >= 2, c(n)).otherwise(F.lit(0).cast(t)).alias(n) for n, t in got.dtypes if n != "fold"))


def overall(folds: DataFrame) -> DataFrame:
    """One row over all folds of metrics(): counts, turnover and costs summed, ratios averaged, the
    worst drawdowns. total_return is the product of the folds' returns less 1, as the fixed rule has
    it; compounded is the product of their growth less 1."""
    c = F.col
    mean = [F.avg(n).alias(n) for n in ("annual_return", "sharpe", "sortino", "calmar", "hit_rate", "average_win", "average_loss")]
    total = [F.sum(n).alias(n) for n in ("n_bars", "n_trades", "turnover", "costs")]
    return folds.agg(
        F.count(F.lit(1)).alias("folds"), *total, *mean, F.max("max_drawdown").alias("max_drawdown"), F.max("longest_drawdown").alias("longest_drawdown"),
        (F.product(c("total_return")) - 1).alias("total_return"), (F.product(1 + c("total_return")) - 1).alias("compounded"),
    )
