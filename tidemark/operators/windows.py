"""Ordered windows over bars, each partitioned by asset and ordered by open_time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import clamp, safe_div

PERIODS = (4, 8, 16, 32, 64)

def by_time():
    return Window.partitionBy("asset").orderBy("open_time")



def last(n: int):
    return by_time().rowsBetween(1 - n, 0)


def log_returns(bars: DataFrame) -> DataFrame:
    prev = F.lag("close").over(by_time())
    return bars.withColumn("ret", F.when(prev > 0, F.ln(F.col("close") / prev)).otherwise(0.0))


def spectrum(bars: DataFrame, n: int = 64) -> DataFrame:
    """Powers of five Goertzel bins over the last n closes, share by share, and the phase inputs;
    rows without n closes are dropped. The newest sample has lag 0."""
    got = bars.withColumn("w", F.collect_list("close").over(last(n))).where(F.size("w") == n)
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / n
    got = got.withColumn("x", F.reverse("w")).withColumn("m", mean)
    for p in PERIODS:
        for name, f in (("re", math.cos), ("im", math.sin)):
            wave = F.array(*(F.lit(f(2 * math.pi * i / p)) for i in range(n)))
            pairs = F.zip_with("x", wave, lambda v, c: (v - F.col("m")) * c)
            got = got.withColumn(f"{name}{p}", F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v) if p <= n else F.lit(0.0))
        got = got.withColumn(f"p{p}", F.col(f"re{p}") * F.col(f"re{p}") + F.col(f"im{p}") * F.col(f"im{p}"))
    total = F.greatest(sum((F.col(f"p{p}") for p in PERIODS), F.lit(0.0)), F.lit(1e-20))
    return got.select("asset", "open_time", "close", *((F.col(f"p{p}") / total).alias(f"p{p}") for p in PERIODS))


def spectral_features(powers: DataFrame) -> DataFrame:
    """dominant_period (of equal powers the longest), spectral_entropy, noise_trend_ratio."""
    h = sum((F.when(F.col(f"p{p}") > 1e-15, -F.col(f"p{p}") * F.ln(f"p{p}")).otherwise(0.0) for p in PERIODS), F.lit(0.0))
    best = F.array_max(F.array(*(F.struct(F.col(f"p{p}").alias("p"), F.lit(p).alias("n")) for p in PERIODS)))
    return powers.select(
        "asset", "open_time", "close", best["n"].alias("dominant_period"), clamp(h / math.log(5), 0.0, 1.0).alias("spectral_entropy"),
        ((F.col("p4") + F.col("p8")) / F.greatest(F.col("p16") + F.col("p32") + F.col("p64"), F.lit(1e-15))).alias("noise_trend_ratio"),
    )


def adv(bars: DataFrame, n: int = 24) -> DataFrame:
    return bars.withColumn("adv", F.sum(F.col("volume") * F.col("close")).over(last(n)))


def retain_last(bars: DataFrame, n: int = 2000) -> DataFrame:
    newest = Window.partitionBy("asset").orderBy(F.col("open_time").desc())
    return bars.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n")


def trade_window(ticks: DataFrame, width_ms: int = 7_200_000) -> DataFrame:
    """n_buy, n_sell and imbalance (0.5 where empty) over the last width_ms up to each trade."""
    w = Window.partitionBy("asset").orderBy("ms").rangeBetween(-width_ms, 0)
    buy, sell = (F.count(F.when(c, 1)).over(w) for c in (F.col("is_buy"), ~F.col("is_buy")))
    return ticks.select("asset", "event_id", "ms", buy.alias("n_buy"), sell.alias("n_sell"), (buy / (buy + sell)).alias("imbalance"))


def funding_features(funding: DataFrame, n: int = 200) -> DataFrame:
    """Of (asset, open_time, rate): z-score over the last n, momentum, annualised, contrarian signal."""
    z = (F.col("rate") - F.avg("rate").over(last(n))) / F.greatest(F.stddev_pop("rate").over(last(n)), F.lit(1e-15))
    momentum = F.coalesce(F.col("rate") - F.lag("rate").over(by_time()), F.lit(0.0))
    return funding.select("asset", "open_time", "rate", z.alias("z"), momentum.alias("momentum"), (F.col("rate") * 3 * 365).alias("annualised"), F.tanh(-z / 2.5).alias("contrarian"))


def vol_ratio(returns: DataFrame, short: int = 24, long: int = 168, per_year: int = 24 * 365) -> DataFrame:
    vol = lambda n: F.sqrt(F.var_pop("ret").over(last(n)) * per_year)
    return returns.select("asset", "open_time", vol(short).alias("short_vol"), vol(long).alias("long_vol")).withColumn("ratio", safe_div(F.col("short_vol"), F.col("long_vol"), 1.0))


def beta_corr(returns: DataFrame, anchor: str, n: int = 60) -> DataFrame:
    """Beta and correlation to the anchor's returns over n common times; null before that. The
    anchor is one asset's series and is joined by time."""
    own = returns.select("asset", "open_time", "ret")
    other = own.where(F.col("asset") == anchor).select("open_time", F.col("ret").alias("anchor_ret"))
    got = own.join(other, "open_time")
    w = last(n)
    cov, va, vo = F.covar_pop("ret", "anchor_ret").over(w), F.var_pop("anchor_ret").over(w), F.var_pop("ret").over(w)
    full = F.count(F.lit(1)).over(w) == n
    beta = F.when(full, F.when(va < 1e-15, 0.0).otherwise(cov / va))
    corr = F.when(full, F.when((va < 1e-15) | (vo < 1e-15), 0.0).otherwise(cov / F.sqrt(va * vo)))
    return got.select("asset", "open_time", beta.alias("beta"), corr.alias("corr"))


def forward_labels(bars: DataFrame, h: int = 5, bound: float = 0.003) -> DataFrame:
    ahead = F.ln(F.lead("close", h).over(by_time()) / F.col("close"))
    return bars.select("asset", "open_time", ahead.alias("ahead")).where("ahead is not null").withColumn("label", F.when(F.col("ahead") > bound, 1).when(F.col("ahead") < -bound, -1).otherwise(0))


def forward_vol(returns: DataFrame, h: int = 5) -> DataFrame:
    w = by_time().rowsBetween(0, h - 1)
    vol = F.greatest(F.stddev_pop(F.abs("ret")).over(w) * math.sqrt(h), F.lit(1e-3))
    return returns.select("asset", "open_time", vol.alias("vol"), F.count(F.lit(1)).over(w).alias("_n")).where(F.col("_n") == h).drop("_n")


def drawdown(curve: DataFrame, value: str = "close") -> DataFrame:
    """Peak so far (0 at least), drawdown, and bars since the peak was last reached."""
    upto = by_time().rowsBetween(Window.unboundedPreceding, 0)
    got = curve.select("asset", "open_time", value, F.greatest(F.max(value).over(upto), F.lit(0.0)).alias("peak"), F.row_number().over(by_time()).alias("_n"))
    got = got.withColumn("_at", F.max(F.when(F.col(value) >= F.col("peak"), F.col("_n"))).over(upto))
    return got.select("asset", "open_time", "peak", ((F.col("peak") - F.col(value)) / F.col("peak")).alias("drawdown"), (F.col("_n") - F.coalesce("_at", F.lit(0))).alias("bars_since_peak"))


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of right's last row at or before it, null where there is none: one
    shuffle by key, no range join. Of right's rows of one time, the greatest by values counts."""
    one = right.groupBy(key, F.col(right_time).alias("_t")).agg(F.max(F.struct(*values)).alias("_v"))
    both = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).unionByName(one.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    got = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return got.select(*left.columns, *(F.col("_v")[v].alias(v) for v in values))


def fold_ewma(returns: DataFrame, decay: float = 0.94) -> DataFrame:
    """EWMA volatility as an ordered scan: one pass over each asset's returns, in Arrow batches."""

    def scan(pdf):
        pdf = pdf.sort_values("open_time")
        v, out = None, []
        for r in pdf["ret"]:
            v = r * r if v is None else decay * v + (1 - decay) * r * r
            out.append(math.sqrt(v))
        return pdf[["asset", "open_time"]].assign(vol=out)

    return returns.select("asset", "open_time", "ret").groupBy("asset").applyInPandas(scan, "asset string, open_time long, vol double")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """df with its doubles rounded, and no negative zeros, for comparison."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def ema(df: DataFrame, value: str, keys: list[str], decay: float, name: str) -> DataFrame:
    """df with name: the running average e = decay * e + (1 - decay) * value over each key's rows by
    open_time, from 0.

    The recursion is linear, so it is summed in chunks whose weights stay within 1e3, and what the
    chunks before leave over is added from the last of them whose weight reaches 1e-18."""
    rate = -math.log(decay)
    size, back = max(1, int(math.log(1e3) / rate)), 0
    while decay ** (size * back) > 1e-18:
        back += 1
    whole = Window.partitionBy(*keys).orderBy("open_time")
    n = F.row_number().over(whole) - 1
    rows = df.withColumn("_n", n).withColumn("_chunk", F.floor(F.col("_n") / size)).withColumn("_at", F.col("_n") % size)
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_at")
    upto = F.sum(F.col(value) * F.pow(F.lit(decay), -F.col("_at"))).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_own", (1 - decay) * F.pow(F.lit(decay), F.col("_at")) * upto)
    ends = rows.where(F.col("_at") == size - 1).select(*keys, F.col("_chunk").alias("_of"), F.col("_own").alias("_end"))
    by = Window.partitionBy(*keys).orderBy("_of")
    carried = sum((F.coalesce(F.lag("_end", j).over(by), F.lit(0.0)) * decay ** (size * j) for j in range(1, back)), F.col("_end"))
    carry = ends.select(*keys, (F.col("_of") + 1).alias("_chunk"), carried.alias("_carry"))
    out = rows.join(carry, [*keys, "_chunk"], "left")
    total = F.col("_own") + F.pow(F.lit(decay), F.col("_at") + 1) * F.coalesce("_carry", F.lit(0.0))
    return out.withColumn(name, total).select(*df.columns, name)
