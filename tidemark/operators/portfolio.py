"""Portfolio state from positions and accounts, and the checks that need both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def state(positions: DataFrame, accounts: DataFrame) -> DataFrame:
    """One row for each account (account, nav, peak): its positions (account, asset, is_long, size,
    leverage) summed before the join. Accounts without positions have zeros."""
    held = F.col("size") * F.col("leverage")
    sums = positions.groupBy("account").agg(
        F.count(F.lit(1)).alias("n_open"), F.sum(held).alias("gross"), F.sum(F.when(F.col("is_long"), held).otherwise(-held)).alias("net")
    )
    out = accounts.join(sums, "account", "left").fillna(0, ["n_open"]).fillna(0.0, ["gross", "net"])
    ratio = F.when(F.col("nav") < 1e-10, 0.0).otherwise(F.col("gross") / F.col("nav"))
    fall = F.when(F.col("peak") < 1e-10, 0.0).otherwise((F.col("peak") - F.col("nav")) / F.col("peak"))
    return out.withColumn("gross_leverage", ratio).withColumn("drawdown", fall)


def modal(rows: DataFrame, keys: list[str], label: str = "regime") -> DataFrame:
    """The most frequent label of each key; of equally frequent ones the first by name."""
    counts = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("label")))["label"].alias(label))


def held_against(signals: DataFrame, positions: DataFrame, correlations: DataFrame, otherwise: float = 0.5) -> DataFrame:
    """signals (account, asset, ...) with held (has the account this asset), n_open and corr: the
    largest correlation with any asset the account holds, null without positions.

    correlations (a, b, corr) has each pair once, a < b; pairs it lacks count as `otherwise`."""
    open_ = positions.select("account", F.col("asset").alias("_held"))
    pairs = signals.select("account", "asset").distinct().join(open_, "account")
    pairs = pairs.withColumn("a", F.least("asset", "_held")).withColumn("b", F.greatest("asset", "_held"))
    known = pairs.join(correlations.select("a", "b", "corr"), ["a", "b"], "left")
    worst = known.groupBy("account", "asset").agg(
        F.max(F.coalesce("corr", F.lit(otherwise))).alias("corr"), F.max((F.col("asset") == F.col("_held")).cast("int")).alias("_own"), F.countDistinct("_held").alias("n_open")
    )
    out = signals.join(worst, ["account", "asset"], "left")
    return out.withColumn("held", F.coalesce(F.col("_own") == 1, F.lit(False))).withColumn("n_open", F.coalesce("n_open", F.lit(0))).drop("_own")
