"""Order-book features, over arrays of levels (px, sz) with the best first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.columns import safe_div


def depth(side: str, n: int = 5) -> Column:
    return F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda a, l: a + l["sz"])


def walk(side: str, notional: Column) -> Column:
    """(left, cost, size) after taking notional from the levels in turn."""
    start = F.struct(notional.alias("left"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("size"))

    def step(a, l):
        take = F.least(a["left"], l["px"] * l["sz"])
        return F.struct((a["left"] - take).alias("left"), (a["cost"] + take).alias("cost"), (a["size"] + take / l["px"]).alias("size"))

    return F.aggregate(side, start, step)


def features(books: DataFrame, share: float = 0.01, adv: float = 1e6) -> DataFrame:
    """asset, mid, spread_bps, ofi, depth_ratio, micro_price, vwap_impact; the mean price paid
    beyond the middle for share of adv, 1 where the book runs out."""
    bid, ask = F.get("bids", F.lit(0)), F.get("asks", F.lit(0))
    b, a = depth("bids"), depth("asks")
    got = books.select("asset", bid.alias("b"), ask.alias("a"), b.alias("db"), a.alias("da"), walk("asks", F.lit(share * adv)).alias("w"))
    got = got.withColumn("mid", (F.col("b.px") + F.col("a.px")) / 2)
    return got.select(
        "asset", "mid", ((F.col("a.px") - F.col("b.px")) / F.col("mid") * 1e4).alias("spread_bps"), safe_div(F.col("db") - F.col("da"), F.col("db") + F.col("da")).alias("ofi"),
        F.when(F.col("da") == 0, 1.0).otherwise(F.col("db") / F.col("da")).alias("depth_ratio"),
        ((F.col("b.px") * F.col("a.sz") + F.col("a.px") * F.col("b.sz")) / (F.col("a.sz") + F.col("b.sz"))).alias("micro_price"),
        F.when(F.col("w.left") > 1e-9, 1.0).otherwise(F.col("w.cost") / F.col("w.size") / F.col("mid") - 1).alias("vwap_impact"),
    )


def ratio_impact(books: DataFrame, notional: float = 10_000.0) -> DataFrame:
    """asset, impact by the fixed rule (1 - mid) / mid where the book suffices, else 1."""
    mid = (F.get("bids", F.lit(0))["px"] + F.get("asks", F.lit(0))["px"]) / 2
    return books.select("asset", F.when(walk("asks", F.lit(notional))["left"] > 1e-9, 1.0).otherwise((1 - mid) / mid).alias("impact"))
