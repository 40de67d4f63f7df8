"""Return distributions: fitted rows, and their densities, quantiles and tail means as Columns.

Cauchy and histogram methods are plain expressions; Student t needs the incomplete beta function,
which Spark lacks, so those run on Arrow batches. `var` at 0.95 is the 5 % quantile of returns and
`cvar` the mean below it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- Cauchy -----------------------------------------------------------------------------------

#: fixed value: the quantile at which the Cauchy tail is cut, since its mean is not finite
CAUCHY_LOWEST = 0.001


def cauchy_log_pdf(x: Column, x0: Column, g: Column) -> Column:
    z = (x - x0) / g
    return -math.log(math.pi) - F.ln(g) - F.ln(1 + z * z)


def cauchy_cdf(x: Column, x0: Column, g: Column) -> Column:
    return F.atan((x - x0) / g) / math.pi + 0.5


def cauchy_quantile(p: float, x0: Column, g: Column) -> Column:
    return x0 + g * math.tan(math.pi * (p - 0.5))


def cauchy_var(alpha: float, x0: Column, g: Column) -> Column:
    return cauchy_quantile(1 - alpha, x0, g)


def cauchy_cvar(alpha: float, x0: Column, g: Column) -> Column:
    """The integral of x f(x) from the cut to the quantile, over 1 - alpha."""
    p = 1 - alpha
    inner, outer = (1 + math.tan(math.pi * (q - 0.5)) ** 2 for q in (p, CAUCHY_LOWEST))
    return (x0 * (p - CAUCHY_LOWEST) + g * (math.log(inner / outer) / (2 * math.pi))) / p


def quartile_cauchy(returns: DataFrame) -> DataFrame:
    """asset, location, scale (half the quartile range), ll, aic of (asset, ret)."""
    by = Window.partitionBy("asset")
    rows = returns.select("asset", "ret", F.row_number().over(by.orderBy("ret")).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    at = lambda k: F.max(F.when(F.col("i") == F.floor(F.col("n") * k / 4) + 1, F.col("ret")))
    fit = rows.groupBy("asset").agg(F.median("ret").alias("location"), F.greatest((at(3) - at(1)) / 2, F.lit(1e-12)).alias("scale"))
    each = cauchy_log_pdf(F.col("ret"), F.col("location"), F.col("scale"))
    ll = returns.select("asset", "ret").join(fit, "asset").groupBy("asset", "location", "scale").agg(F.sum(each).alias("ll"))
    return ll.withColumn("aic", 4 - 2 * F.col("ll"))


# ---- histogram --------------------------------------------------------------------------------


def histogram(returns: DataFrame, least: int = 30) -> DataFrame:
    """One row for each asset with at least `least` returns: n, lo, width, probs (smoothed mass of
    every bin), cum (mass before each edge), ll, ks, aic.

    5 to 100 bins of Scott's width, so the arrays are short; counts are aggregated by bin before
    they meet in one row."""
    c = F.col
    r = returns.select("asset", "ret")
    s = r.groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.min("ret").alias("least"), F.max("ret").alias("most"), F.stddev_pop("ret").alias("sd")).where(c("n") >= least)
    raw = 3.5 * F.greatest(c("sd"), F.lit(1e-10)) * F.pow(c("n"), F.lit(-1.0 / 3))
    s = s.withColumn("raw", raw).withColumn("span", c("most") - c("least") + 2 * c("raw")).withColumn("lo", c("least") - c("raw"))
    s = s.withColumn("bins", F.least(F.greatest(F.ceil(c("span") / c("raw")), F.lit(5)), F.lit(100)).cast("int")).withColumn("width", c("span") / c("bins"))
    bin_ = F.least(F.floor((c("ret") - c("lo")) / c("width")), c("bins") - 1).cast("int")
    rows = r.join(s.select("asset", "n", "lo", "bins", "width"), "asset")
    counts = rows.groupBy("asset", "n", "lo", "bins", "width", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    one = counts.groupBy("asset", "n", "lo", "bins", "width").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("at"))
    mass = lambda i: (F.coalesce(c("at")[i], F.lit(0)) + 0.5) / (c("n") + 0.5 * c("bins"))
    one = one.withColumn("probs", F.transform(F.sequence(F.lit(0), c("bins") - 1), mass))
    before = lambda i: F.aggregate(F.slice("probs", 1, i), F.lit(0.0), lambda a, p: a + p)
    one = one.withColumn("cum", F.transform(F.sequence(F.lit(0), c("bins")), before))
    ll = F.aggregate(F.map_entries("at"), F.lit(0.0), lambda a, e: a + e["value"] * F.ln(F.get("probs", e["key"]) / c("width")))
    one = one.withColumn("ll", ll).withColumn("aic", 2.0 * (F.size("at") - 1) - 2 * c("ll"))
    fit = one.select("asset", "n", "lo", "width", "probs", "cum", "ll", "aic")
    ranked = r.withColumn("i", F.row_number().over(Window.partitionBy("asset").orderBy("ret"))).join(fit, "asset")
    off = F.abs(c("i") / c("n") - histogram_cdf(c("ret")))
    return fit.join(ranked.groupBy("asset").agg(F.max(off).alias("ks")), "asset")


def histogram_cdf(x: Column) -> Column:
    """Linear within a bin; over the columns of histogram()."""
    size = F.size("probs")
    at = (x - F.col("lo")) / F.col("width")
    i = F.least(F.greatest(F.floor(at), F.lit(0)), size - 1).cast("int")
    inside = F.get("cum", i) + F.get("probs", i) * F.least(F.greatest(at - i, F.lit(0.0)), F.lit(1.0))
    return F.when(at <= 0, 0.0).when(at >= size, 1.0).otherwise(inside)


def histogram_log_pdf(x: Column) -> Column:
    """Minus infinity outside the bins."""
    at = (x - F.col("lo")) / F.col("width")
    i = F.least(F.floor(at), F.size("probs") - 1).cast("int")
    inside = (at >= 0) & (at <= F.size("probs"))
    return F.when(inside, F.ln(F.get("probs", F.greatest(i, F.lit(0))) / F.col("width"))).otherwise(F.lit(-math.inf))


def _bin_of(p: float) -> Column:
    return F.greatest(F.size(F.filter("cum", lambda m: m < p)) - 1, F.lit(0))


def histogram_quantile(p: float) -> Column:
    i = _bin_of(p)
    return F.col("lo") + F.col("width") * (i + (p - F.get("cum", i)) / F.get("probs", i))


def histogram_var(alpha: float) -> Column:
    return histogram_quantile(1 - alpha)


def histogram_cvar(alpha: float) -> Column:
    """Mean of the bins' middles below the quantile, by mass."""
    q, lo, width = histogram_var(alpha), F.col("lo"), F.col("width")

    def part(i):
        left = lo + i * width
        share = F.least(F.greatest((q - left) / width, F.lit(0.0)), F.lit(1.0)) * F.get("probs", i)
        return F.struct((share * (left + F.least(q, left + width)) / 2).alias("x"), share.alias("p"))

    parts = F.transform(F.sequence(F.lit(0), F.size("probs") - 1), part)
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda a, e: a + e[f])
    return F.when(total("p") < 1e-15, q).otherwise(total("x") / total("p"))


# ---- Student t --------------------------------------------------------------------------------

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def _beta_share(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction, from the end where that
    converges fast."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0.0, 1.0))
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    tiny = 1e-300
    value, above, below = np.ones_like(y), np.ones_like(y), np.zeros_like(y)
    for k in range(300):
        m = k // 2
        if k == 0:
            term = np.ones_like(y)
        elif k % 2 == 0:
            term = m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m))
        else:
            term = -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))
        below = 1 + term * below
        below = 1 / np.where(np.abs(below) < tiny, tiny, below)
        above = 1 + term / np.where(np.abs(above) < tiny, tiny, above)
        change = above * below
        value = value * change
        if k and np.all(np.abs(change - 1) < 1e-15):
            break
    with np.errstate(divide="ignore"):
        front = np.exp(p * np.log(y) + q * np.log1p(-y) + _lgamma(p + q) - _lgamma(p) - _lgamma(q)) / p
    share = np.where(y <= 0, 0.0, front * (value - 1))
    return np.where(turned, 1 - share, share)


def t_pdf(t, nu) -> np.ndarray:
    t, nu = np.broadcast_arrays(np.asarray(t, float), np.asarray(nu, float))
    return np.exp(_lgamma((nu + 1) / 2) - _lgamma(nu / 2) - 0.5 * np.log(math.pi * nu) - (nu + 1) / 2 * np.log1p(t * t / nu))


def t_cdf(t, nu) -> np.ndarray:
    t, nu = np.broadcast_arrays(np.asarray(t, float), np.asarray(nu, float))
    half = 0.5 * _beta_share(nu / 2, np.full_like(nu, 0.5), nu / (nu + t * t))
    return np.where(t < 0, half, 1 - half)


def t_quantile(p, nu) -> np.ndarray:
    """By halving [-50, 0], so for p up to one half; -50 at least."""
    p, nu = np.broadcast_arrays(np.asarray(p, float), np.asarray(nu, float))
    low, high = np.full_like(nu, -50.0), np.zeros_like(nu)
    for _ in range(60):
        middle = (low + high) / 2
        under = t_cdf(middle, nu) < p
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def t_tail(alpha: float, mu, sigma, nu) -> tuple[np.ndarray, np.ndarray]:
    """Quantile at 1 - alpha and the mean below it."""
    z = t_quantile(1 - alpha, nu)
    mass = t_cdf(z, nu)
    mean = -t_pdf(z, nu) * (nu + z * z) / ((nu - 1) * np.maximum(mass, 1e-300))
    var = mu + sigma * z
    return var, np.where(mass < 1e-15, var, mu + sigma * mean)


def student_t_cdf(x: str, location: str, scale: str, nu: str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, mu: pd.Series, sigma: pd.Series, nu: pd.Series) -> pd.Series:
        return pd.Series(t_cdf((x - mu) / sigma, nu))

    return run(x, location, scale, nu)


def student_t_log_pdf(x: str, location: str, scale: str, nu: str) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, mu: pd.Series, sigma: pd.Series, nu: pd.Series) -> pd.Series:
        return pd.Series(np.log(t_pdf((x - mu) / sigma, nu)) - np.log(sigma))

    return run(x, location, scale, nu)


def student_t_risk(fits: DataFrame, alpha: float = 0.95) -> DataFrame:
    """fits (location, scale, nu) with var and cvar."""

    @F.pandas_udf("struct<var: double, cvar: double>")
    def run(mu: pd.Series, sigma: pd.Series, nu: pd.Series) -> pd.DataFrame:
        var, cvar = t_tail(alpha, mu.to_numpy(), sigma.to_numpy(), nu.to_numpy())
        return pd.DataFrame({"var": var, "cvar": cvar})

    return fits.withColumn("_t", run("location", "scale", "nu")).select(*fits.columns, "_t.var", "_t.cvar")


def best(fits: dict[str, DataFrame]) -> DataFrame:
    """Of each asset's fits (asset, aic, var, cvar) the one of least AIC; of equal ones the first."""
    rows = [df.select("asset", F.struct("aic", F.lit(k).alias("k"), F.lit(name).alias("name"), "var", "cvar").alias("d")) for k, (name, df) in enumerate(fits.items())]
    out = rows[0]
    for other in rows[1:]:
        out = out.unionByName(other)
    return out.groupBy("asset").agg(F.min("d").alias("d")).select("asset", "d.name", "d.aic", "d.var", "d.cvar")
