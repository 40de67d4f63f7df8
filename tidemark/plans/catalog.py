"""Queries over the input tables, and the same results as SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import backtest, book, orders, pairs, scans, signals, sizing, windows
from tidemark.operators.windows import rounded
from tidemark.sources import market

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int = 6):
    def add(f):
        name = f.__name__
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def _bars(spark, sf_dir):
    return market.bars(market.ticks(spark, sf_dir))


def _returns(spark, sf_dir):
    return windows.log_returns(_bars(spark, sf_dir))


BARS = """WITH bars AS (SELECT * FROM (SELECT event_type AS asset, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 3600000 AS open_time,
 arg_min(value, (epoch_us(ts) // 1000) * 1000000 + event_id) AS open, max(value) AS high, min(value) AS low, arg_max(value, (epoch_us(ts) // 1000) * 1000000 + event_id) AS close,
 sum(value) AS volume, count(*) AS num_trades FROM events GROUP BY 1, 2) WHERE close > 0)"""
RETS = BARS + """, rets AS (SELECT *, CASE WHEN lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) ELSE 0.0 END AS ret FROM bars WINDOW w AS (PARTITION BY asset ORDER BY open_time))"""
_T = "PARTITION BY asset ORDER BY open_time"


@query(BARS + " SELECT asset, open_time, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, num_trades FROM bars")
def bars_hourly(spark, sf_dir):
    return _bars(spark, sf_dir)


@query(RETS + " SELECT asset, open_time, round(ret, 6) AS ret FROM rets")
def log_returns(spark, sf_dir):
    return _returns(spark, sf_dir).select("asset", "open_time", "ret")


@query(RETS + f" SELECT asset, open_time, round(sqrt(list_reduce(list(ret * ret) OVER ({_T}), lambda v, x: 0.94 * v + 0.06 * x)), 6) AS vol FROM rets")
def ewma_vol(spark, sf_dir):
    return windows.fold_ewma(_returns(spark, sf_dir))


_WAVES = ", ".join(f"list_sum(list_transform(x, lambda v, i: (v - m) * {f}(2 * pi() * (i - 1) / {p}))) AS {n}{p}" for p in windows.PERIODS for n, f in (("re", "cos"), ("im", "sin")))
_SUM = " + ".join(f"(re{p} * re{p} + im{p} * im{p})" for p in windows.PERIODS)
SPECTRUM = BARS + f""", w AS (SELECT asset, open_time, close, list_reverse(list(close) OVER ({_T} ROWS 63 PRECEDING)) AS x, count(*) OVER ({_T} ROWS 63 PRECEDING) AS n,
 avg(close) OVER ({_T} ROWS 63 PRECEDING) AS m FROM bars), g AS (SELECT asset, open_time, close, {_WAVES} FROM w WHERE n = 64),
 powers AS (SELECT asset, open_time, close, {", ".join(f"(re{p} * re{p} + im{p} * im{p}) / greatest({_SUM}, 1e-20) AS p{p}" for p in windows.PERIODS)} FROM g)"""
_H = " + ".join(f"(CASE WHEN p{p} > 1e-15 THEN -p{p} * ln(p{p}) ELSE 0.0 END)" for p in windows.PERIODS)
_TOP = "greatest(p4, p8, p16, p32, p64)"
FEATURES = SPECTRUM + f""", feats AS (SELECT asset, open_time, close, CASE {" ".join(f"WHEN p{p} = {_TOP} THEN {p}" for p in reversed(windows.PERIODS))} END AS dominant_period,
 greatest(least(({_H}) / ln(5), 1.0), 0.0) AS spectral_entropy, (p4 + p8) / greatest(p16 + p32 + p64, 1e-15) AS noise_trend_ratio FROM powers)"""


@query(SPECTRUM + " SELECT asset, open_time, " + ", ".join(f"round(p{p}, 4) AS p{p}" for p in windows.PERIODS) + " FROM powers", 4)
def spectral_powers(spark, sf_dir):
    return windows.spectrum(_bars(spark, sf_dir)).drop("close")


@query(FEATURES + " SELECT asset, open_time, dominant_period, round(spectral_entropy, 4) AS spectral_entropy, round(noise_trend_ratio, 4) AS noise_trend_ratio FROM feats", 4)
def spectral_features(spark, sf_dir):
    return windows.spectral_features(windows.spectrum(_bars(spark, sf_dir))).drop("close")


@query(BARS + f" SELECT asset, open_time, round(sum(volume * close) OVER ({_T} ROWS 23 PRECEDING), 4) AS adv FROM bars", 4)
def adv_24h(spark, sf_dir):
    return windows.adv(_bars(spark, sf_dir)).select("asset", "open_time", "adv")


@query(BARS + " SELECT asset, open_time, round(close, 6) AS close FROM bars QUALIFY row_number() OVER (PARTITION BY asset ORDER BY open_time DESC) <= 200")
def retention_last_n(spark, sf_dir):
    return windows.retain_last(_bars(spark, sf_dir), 200).select("asset", "open_time", "close")


@query("""SELECT asset, event_id, ms, n_buy, n_sell, round(n_buy / (n_buy + n_sell), 6) AS imbalance FROM (SELECT event_type AS asset, event_id, (epoch_us(ts) // 1000) AS ms,
 count(*) FILTER (event_id % 2 = 0) OVER w AS n_buy, count(*) FILTER (event_id % 2 <> 0) OVER w AS n_sell FROM events
 WINDOW w AS (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000) RANGE 7200000 PRECEDING))""")
def trade_window_2h(spark, sf_dir):
    return windows.trade_window(market.ticks(spark, sf_dir))


_Z = "(rate - avg(rate) OVER w) / greatest(stddev_pop(rate) OVER w, 1e-15)"


@query(RETS + f""", f AS (SELECT asset, open_time, ret AS rate FROM rets WHERE (open_time // 3600000) % 8 = 0)
 SELECT asset, open_time, round(rate, 6) AS rate, round({_Z}, 5) + 0.0 AS z, round(coalesce(rate - lag(rate) OVER ({_T}), 0.0), 6) + 0.0 AS momentum, round(rate * 3 * 365, 5) + 0.0 AS annualised,
 round(tanh(-({_Z}) / 2.5), 5) + 0.0 AS contrarian FROM f WINDOW w AS ({_T} ROWS 199 PRECEDING)""".replace("round(rate, 6)", "round(rate, 5)").replace("0.0), 6)", "0.0), 5)"), 5)
def funding_features(spark, sf_dir):
    rates = _returns(spark, sf_dir).where((F.col("open_time") / 3_600_000).cast("long") % 8 == 0).select("asset", "open_time", F.col("ret").alias("rate"))
    return windows.funding_features(rates)


@query(RETS + f""", v AS (SELECT asset, open_time, sqrt(var_pop(ret) OVER ({_T} ROWS 23 PRECEDING) * 8760) AS short_vol, sqrt(var_pop(ret) OVER ({_T} ROWS 167 PRECEDING) * 8760) AS long_vol FROM rets)
 SELECT asset, open_time, round(short_vol, 4) AS short_vol, round(long_vol, 4) AS long_vol, round(CASE WHEN abs(long_vol) < 1e-10 THEN 1.0 ELSE short_vol / long_vol END, 4) AS ratio FROM v""", 4)
def vol_ratio(spark, sf_dir):
    return windows.vol_ratio(_returns(spark, sf_dir))


@query(RETS + f""", j AS (SELECT r.asset, r.open_time, r.ret, a.ret AS b FROM rets r JOIN rets a ON a.asset = 'click' AND a.open_time = r.open_time),
 s AS (SELECT asset, open_time, count(*) OVER w AS n, covar_pop(ret, b) OVER w AS c, var_pop(b) OVER w AS va, var_pop(ret) OVER w AS vo FROM j WINDOW w AS ({_T} ROWS 59 PRECEDING))
 SELECT asset, open_time, round(CASE WHEN n = 60 THEN CASE WHEN va < 1e-15 THEN 0.0 ELSE c / va END END, 5) AS beta,
 round(CASE WHEN n = 60 THEN CASE WHEN va < 1e-15 OR vo < 1e-15 THEN 0.0 ELSE c / sqrt(va * vo) END END, 5) AS corr FROM s""", 5)
def rolling_beta_corr(spark, sf_dir):
    return windows.beta_corr(_returns(spark, sf_dir), "click")


@query(BARS + f""", l AS (SELECT asset, open_time, ln(lead(close, 5) OVER ({_T}) / close) AS ahead FROM bars) SELECT asset, open_time, round(ahead, 6) AS ahead,
 CASE WHEN ahead > 0.003 THEN 1 WHEN ahead < -0.003 THEN -1 ELSE 0 END AS label FROM l WHERE ahead IS NOT NULL""")
def forward_labels(spark, sf_dir):
    return windows.forward_labels(_bars(spark, sf_dir))


@query(RETS + f""", v AS (SELECT asset, open_time, count(*) OVER w AS n, greatest(stddev_pop(abs(ret)) OVER w * sqrt(5), 1e-3) AS vol FROM rets
 WINDOW w AS ({_T} ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) SELECT asset, open_time, round(vol, 5) AS vol FROM v WHERE n = 5""", 5)
def forward_vol(spark, sf_dir):
    return windows.forward_vol(_returns(spark, sf_dir))


@query(BARS + f""", p AS (SELECT asset, open_time, close, greatest(max(close) OVER ({_T}), 0.0) AS peak, row_number() OVER ({_T}) AS n FROM bars),
 q AS (SELECT *, max(CASE WHEN close >= peak THEN n END) OVER ({_T}) AS reached FROM p)
 SELECT asset, open_time, round(peak, 6) AS peak, round((peak - close) / peak, 6) AS drawdown, n - coalesce(reached, 0) AS bars_since_peak FROM q""")
def drawdown_duration(spark, sf_dir):
    return windows.drawdown(_bars(spark, sf_dir))


@query(BARS + """, t AS (SELECT event_type AS asset, event_id, (epoch_us(ts) // 1000) AS ms FROM events) SELECT t.asset, event_id, ms, round(b.close, 6) AS close
 FROM t ASOF LEFT JOIN bars b ON t.asset = b.asset AND t.ms - 3600000 >= b.open_time""")
def asof_bar(spark, sf_dir):
    """The last bar that was complete at each trade."""
    trades = market.ticks(spark, sf_dir).select("asset", "event_id", "ms", (F.col("ms") - market.HOUR).alias("done"))
    return windows.as_of(trades, _bars(spark, sf_dir), "asset", "done", "open_time", ["close"]).drop("done")


BOOKS = """WITH px AS (SELECT l_returnflag AS asset, floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS px, sum(l_quantity) AS sz FROM lineitem GROUP BY 1, 2),
 med AS (SELECT asset, quantile_cont(px, 0.5) AS mid0 FROM px GROUP BY 1), s AS (SELECT px.*, px > mid0 AS ask, mid0 FROM px JOIN med USING (asset) WHERE px <> mid0),
 l AS (SELECT *, row_number() OVER (PARTITION BY asset, ask ORDER BY abs(px - mid0), px) AS n FROM s QUALIFY n <= 10),
 top AS (SELECT asset, max(CASE WHEN NOT ask AND n = 1 THEN px END) AS bpx, max(CASE WHEN NOT ask AND n = 1 THEN sz END) AS bsz, max(CASE WHEN ask AND n = 1 THEN px END) AS apx,
 max(CASE WHEN ask AND n = 1 THEN sz END) AS asz, sum(CASE WHEN NOT ask AND n <= 5 THEN sz ELSE 0 END) AS db, sum(CASE WHEN ask AND n <= 5 THEN sz ELSE 0 END) AS da FROM l GROUP BY 1),
 cum AS (SELECT asset, n, px, px * sz AS v, coalesce(sum(px * sz) OVER (PARTITION BY asset ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l WHERE ask),
 fill AS (SELECT asset, sum(least(v, greatest(10000 - before, 0))) AS cost, sum(least(v, greatest(10000 - before, 0)) / px) AS size FROM cum GROUP BY 1)"""


@query(BOOKS + """ SELECT asset, round((bpx + apx) / 2, 6) AS mid, round((apx - bpx) / ((bpx + apx) / 2) * 1e4, 6) AS spread_bps, round((db - da) / (db + da), 6) AS ofi, round(db / da, 6) AS depth_ratio,
 round((bpx * asz + apx * bsz) / (asz + bsz), 6) AS micro_price, round(CASE WHEN cost < 10000 - 1e-9 THEN 1.0 ELSE cost / size / ((bpx + apx) / 2) - 1 END, 6) AS vwap_impact FROM top JOIN fill USING (asset)""")
def book_features(spark, sf_dir):
    return book.features(market.books(spark, sf_dir))


@query(BOOKS + " SELECT asset, round(CASE WHEN cost < 10000 - 1e-9 THEN 1.0 ELSE (1 - (bpx + apx) / 2) / ((bpx + apx) / 2) END, 6) AS impact FROM top JOIN fill USING (asset)")
def price_impact_ratio(spark, sf_dir):
    return book.ratio_impact(market.books(spark, sf_dir))


PAIRS = """WITH d AS (SELECT o_orderpriority AS asset, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2),
 s AS (SELECT x.asset AS a, y.asset AS b, x.day, x.close AS p1, y.close AS p2 FROM d x JOIN d y ON x.day = y.day AND x.asset < y.asset),
 f AS (SELECT a, b, (count(*) * sum(p2 * p1) - sum(p2) * sum(p1)) / (count(*) * sum(p2 * p2) - sum(p2) * sum(p2)) AS beta, avg(p1) AS m1, avg(p2) AS m2 FROM s GROUP BY 1, 2),
 sp AS (SELECT s.a, s.b, day, beta, p1 - (m1 - beta * m2) - beta * p2 AS spread FROM s JOIN f ON s.a = f.a AND s.b = f.b),
 st AS (SELECT *, lag(spread) OVER (PARTITION BY a, b ORDER BY day) AS lg FROM sp), dd AS (SELECT *, spread - lg AS d FROM st WHERE lg IS NOT NULL),
 o AS (SELECT a, b, count(*) AS m, any_value(beta) AS beta, (count(*) * sum(lg * d) - sum(lg) * sum(d)) / (count(*) * sum(lg * lg) - sum(lg) * sum(lg)) AS slope, avg(d) AS md, avg(lg) AS ml, arg_max(spread, day) AS now FROM dd GROUP BY 1, 2)"""


@query(PAIRS + """, r AS (SELECT dd.a, dd.b, sum((d - slope * lg) ^ 2) AS rr, sum(lg * lg) AS xx FROM dd JOIN o ON dd.a = o.a AND dd.b = o.b GROUP BY 1, 2)
 SELECT o.a, o.b, m + 1 AS n, round(o.beta, 5) AS beta, round(slope / sqrt(rr / (m - 2) / xx), 5) AS adf, slope / sqrt(rr / (m - 2) / xx) < -2.86 AS cointegrated FROM o JOIN r ON o.a = r.a AND o.b = r.b""", 5)
def engle_granger_pairs(spark, sf_dir):
    return pairs.engle_granger(market.daily(spark, sf_dir))


@query(PAIRS + """, k AS (SELECT *, greatest(-slope, 1e-8) AS kappa, md - slope * ml AS c FROM o), r AS (SELECT k.a, k.b, sqrt(avg((d - c - slope * lg) ^ 2)) AS sigma FROM dd JOIN k ON dd.a = k.a AND dd.b = k.b GROUP BY 1, 2)
 SELECT k.a, k.b, round(kappa, 5) AS kappa, round(c / kappa, 3) AS theta, round(sigma, 3) AS sigma, round(ln(2) / kappa, 5) AS half_life, round((now - c / kappa) / greatest(sigma / sqrt(2 * kappa), 1e-10), 5) AS z FROM k JOIN r ON k.a = r.a AND k.b = r.b""", 5)
def ou_fit(spark, sf_dir):
    return pairs.ou(market.daily(spark, sf_dir)).withColumns({"theta": F.round("theta", 3), "sigma": F.round("sigma", 3)})


@query(RETS + """, s AS (SELECT asset, count(*) AS n, min(ret) AS lo, max(ret) AS hi, stddev_pop(ret) AS sd FROM rets GROUP BY 1),
 p AS (SELECT asset, n, lo - w AS lo, w, least(greatest(ceil((hi - lo + 2 * w) / w), 5), 100) AS bins, hi - lo + 2 * w AS span FROM (SELECT *, 3.5 * sd * n ^ (-1.0 / 3) AS w FROM s)),
 b AS (SELECT r.asset, CAST(least(floor((ret - p.lo) / (span / bins)), bins - 1) AS BIGINT) AS bin, count(*) AS c, any_value(bins) AS bins, any_value(p.n) AS n FROM rets r JOIN p ON r.asset = p.asset GROUP BY 1, 2)
 SELECT asset, bin, c AS n, round((c + 0.5) / (n + 0.5 * bins), 6) AS prob FROM b""")
def histogram_dist(spark, sf_dir):
    """Filled bins of each asset's return histogram, by Scott's width, with add-half smoothing."""
    r = _returns(spark, sf_dir).select("asset", "ret")
    s = r.groupBy("asset").agg(F.count(F.lit(1)).alias("all"), F.min("ret").alias("lo"), F.max("ret").alias("hi"), F.stddev_pop("ret").alias("sd"))
    s = s.withColumn("w", 3.5 * F.col("sd") * F.pow(F.col("all"), F.lit(-1.0 / 3))).withColumn("span", F.col("hi") - F.col("lo") + 2 * F.col("w"))
    s = s.withColumn("bins", F.least(F.greatest(F.ceil(F.col("span") / F.col("w")), F.lit(5)), F.lit(100)))
    bin_ = F.least(F.floor((F.col("ret") - (F.col("lo") - F.col("w"))) / (F.col("span") / F.col("bins"))), F.col("bins") - 1).cast("long")
    got = r.join(s, "asset").groupBy("asset", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.first("bins").alias("bins"), F.first("all").alias("all"))
    return got.select("asset", "bin", "n", ((F.col("n") + 0.5) / (F.col("all") + 0.5 * F.col("bins"))).alias("prob"))


@query(RETS + f""", q AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ret, open_time) AS i, count(*) OVER (PARTITION BY asset) AS n FROM rets),
 m AS (SELECT asset, median(ret) AS x0, (max(CASE WHEN i = 3 * n // 4 + 1 THEN ret END) - max(CASE WHEN i = n // 4 + 1 THEN ret END)) / 2 AS g FROM q GROUP BY 1)
 SELECT q.asset, round(any_value(x0), 6) AS location, round(any_value(g), 6) AS scale, round(max(abs(i / n - (atan((ret - x0) / g) / pi() + 0.5))), 6) AS ks, round(any_value(x0 + g * tan(pi() * (0.05 - 0.5))), 6) AS var_95 FROM q JOIN m ON q.asset = m.asset GROUP BY 1""")
def cauchy_eval(spark, sf_dir):
    """Quartile Cauchy fit of each asset's returns, its KS distance and 5 % quantile."""
    from pyspark.sql import Window

    by = Window.partitionBy("asset")
    q = _returns(spark, sf_dir).select("asset", "ret", F.row_number().over(by.orderBy("ret", "open_time")).alias("i"), F.count(F.lit(1)).over(by).alias("n"))
    at = lambda k: F.max(F.when(F.col("i") == F.floor(F.col("n") * k / 4) + 1, F.col("ret")))
    m = q.groupBy("asset").agg(F.median("ret").alias("x0"), ((at(3) - at(1)) / 2).alias("g"))
    cdf = F.atan((F.col("ret") - F.col("x0")) / F.col("g")) / math.pi + 0.5
    out = q.join(F.broadcast(m), "asset").groupBy("asset").agg(F.first("x0").alias("location"), F.first("g").alias("scale"), F.max(F.abs(F.col("i") / F.col("n") - cdf)).alias("ks"))
    return out.withColumn("var_95", F.col("location") + F.col("scale") * math.tan(math.pi * (0.05 - 0.5)))


_KF_LEVEL = "(1 - greatest(least({k}, 0.98), 0.001)) * x0 + x1 + greatest(least({k}, 0.98), 0.001) * mn + greatest(least({m}, 0.01), -0.01)"
_KF_AT = lambda m, k: _KF_LEVEL.format(m=m, k=k)
#: The dual Kalman filter on closes, row after row: state (x0, x1), running mean, variances, drift and kappa with theirs.
KALMAN = """, bn AS (SELECT asset, open_time, close AS z, row_number() OVER (PARTITION BY asset ORDER BY open_time) AS n FROM bars),
 kf AS (SELECT asset, open_time, n, z AS x0, CAST(0.0 AS DOUBLE) AS x1, z AS mn, CAST(1.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS b, CAST(1.0 AS DOUBLE) AS c, CAST(0.0 AS DOUBLE) AS t0, CAST(0.05 AS DOUBLE) AS t1,
 CAST(0.1 AS DOUBLE) AS p00, CAST(0.0 AS DOUBLE) AS p01, CAST(0.0 AS DOUBLE) AS p10, CAST(0.1 AS DOUBLE) AS p11, CAST(0.0 AS DOUBLE) AS lp FROM bn WHERE n = 1
 UNION ALL
 SELECT asset, open_time, n, px + k0 * e, pv + k1 * e, mn, m00 * (1 - k0) - m01 * k0 + k0 * k0 * 1e-4, m01 * (1 - k1) - m00 * k1 + k0 * k1 * 1e-4, m11 * (1 - k1) - m10 * k1 + k1 * k1 * 1e-4,
 greatest(least(t0 + g0 * e, 0.01), -0.01), greatest(least(t1 + g1 * e, 0.98), 0.001), w00 - g0 * u0, p01 - g0 * u1, p10 - g1 * u0, w11 - g1 * u1, -0.5 * (e * e / s + ln(s) + ln(2 * pi()))
 FROM (SELECT *, h0 / greatest(j0 * h0 + j1 * h1 + s, 1e-30) AS g0, h1 / greatest(j0 * h0 + j1 * h1 + s, 1e-30) AS g1,
  (1 - k0) * pa - k0 * pb AS m00, (1 - k0) * pb - k0 * pc AS m01, (1 - k1) * pb - k1 * pa AS m10, (1 - k1) * pc - k1 * pb AS m11 FROM (
 SELECT *, pa / s AS k0, pb / s AS k1, z - px AS e, w00 * j0 + p01 * j1 AS h0, p10 * j0 + w11 * j1 AS h1, j0 * w00 + j1 * p10 AS u0, j0 * p01 + j1 * w11 AS u1 FROM (
 SELECT *, pa + 1e-4 AS s, p00 + 1e-6 AS w00, p11 + 1e-7 AS w11 FROM (
 SELECT *, f * f * a + 2 * f * b + c + exp(2 * ln(1e-3)) AS pa, 0.9 * (f * b + c) AS pb, 0.9 * 0.9 * c + 0.1 * exp(2 * ln(1e-3)) AS pc, """ + _KF_AT("t0", "t1") + """ AS px, 0.9 * x1 AS pv,
 ((""" + _KF_AT("(t0 + 1e-5)", "t1") + ") - (" + _KF_AT("(t0 - 1e-5)", "t1") + """)) / 2e-5 AS j0, ((""" + _KF_AT("t0", "(t1 + 1e-5)") + ") - (" + _KF_AT("t0", "(t1 - 1e-5)") + """)) / 2e-5 AS j1 FROM (
 SELECT kf.* EXCLUDE (open_time, n, mn), bn.open_time, bn.n, bn.z, 0.99 * kf.mn + 0.01 * bn.z AS mn, 1 - greatest(least(t1, 0.98), 0.001) AS f FROM kf JOIN bn ON kf.asset = bn.asset AND bn.n = kf.n + 1)))))),
 kp AS (SELECT asset, open_time, x0 AS level, x1 AS velocity, t0 AS drift, t1 AS kappa, lp AS log_predictive, a AS level_variance FROM kf)"""


FSIG = FEATURES.replace("WITH bars", "WITH RECURSIVE bars", 1) + KALMAN + """, v AS (SELECT feats.*, kp.velocity AS vel FROM feats JOIN kp USING (asset, open_time)),
 tn AS (SELECT asset, open_time, CASE WHEN vel < 0 THEN -1 ELSE 1 END AS sg, spectral_entropy AS h, greatest(least((1 - spectral_entropy) * least(1 / greatest(noise_trend_ratio, 0.1), 1.0), 1.0), 0.0) AS tr,
 greatest(least(spectral_entropy * least(noise_trend_ratio, 1.0), 1.0), 0.0) AS ns FROM v),
 fs AS (SELECT asset, open_time, greatest(least(0.5 + tr * sg * sqrt(tr) / 2, 0.99), 0.01) AS p_up, greatest(least(0.5 - tr * sg * sqrt(tr) / 2, 0.99), 0.01) AS p_down,
 tr * sg * sqrt(tr) * (0.005 + 0.02 * ns) AS mean, 0.005 + 0.02 * ns AS std, greatest(least(-ln(greatest(h, 1e-5)) * (1 - h) - 1, 0.0), -20.0) AS le FROM tn)"""


def _posterior(spark, sf_dir):
    return scans.dual_kalman(_bars(spark, sf_dir))


def _frequency(spark, sf_dir):
    feats = windows.spectral_features(windows.spectrum(_bars(spark, sf_dir)))
    return signals.frequency_signal(feats.join(_posterior(spark, sf_dir).select("asset", "open_time", "velocity"), ["asset", "open_time"]))


@query(FSIG + " SELECT asset, open_time, 'frequency' AS source, round(p_up, 4) AS p_up, round(p_down, 4) AS p_down, round(mean, 4) + 0.0 AS mean, round(std, 4) AS std, round(le, 4) + 0.0 AS log_evidence FROM fs", 4)
def frequency_signal(spark, sf_dir):
    return _frequency(spark, sf_dir)


_CDF = lambda z: f"(0.5 * (1 + CASE WHEN {z} < 0 THEN -1 ELSE 1 END * (1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) + 1.421413741) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) - 0.284496736) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({z}) / sqrt(2))) * exp(-({z}) * ({z}) / 2))))"  # noqa: E731, E501
OSIG = """, tk AS (SELECT event_type AS asset, (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % 3600000 AS open_time, count(*) FILTER (event_id % 2 = 0) AS nb, count(*) FILTER (event_id % 2 <> 0) AS nsl FROM events GROUP BY 1, 2),
 ob AS (SELECT asset, open_time, (nb - nsl) / (nb + nsl) AS ofi, 0.003 + 0.015 * (1.0 / 15) AS std FROM tk),
 os AS (SELECT asset, open_time, greatest(least(""" + _CDF("(ofi / std * 0.5)") + ", 0.99), 0.01) AS p_up, greatest(least(" + _CDF("(-ofi / std * 0.5)") + """, 0.99), 0.01) AS p_down,
 ofi * std AS mean, std, -0.5 * (1 - abs(ofi)) - 1.0 / 15 AS le FROM ob)"""


def _orderbook(spark, sf_dir):
    t = F.col("ms") - F.col("ms") % market.HOUR
    n = market.ticks(spark, sf_dir).groupBy("asset", t.alias("open_time")).agg(F.count(F.when(F.col("is_buy"), 1)).alias("b"), F.count(F.when(~F.col("is_buy"), 1)).alias("s"))
    # at epoch times the excitation fit keeps its start, whose ratio is a third
    return signals.orderbook_signal(n.select("asset", "open_time", ((F.col("b") - F.col("s")) / (F.col("b") + F.col("s"))).alias("ofi"), F.lit(1 / 3).alias("cross")))


@query(FSIG + OSIG + " SELECT asset, open_time, 'orderbook' AS source, round(p_up, 4) AS p_up, round(p_down, 4) AS p_down, round(mean, 4) + 0.0 AS mean, round(std, 4) AS std, round(le, 4) + 0.0 AS log_evidence FROM os", 4)
def orderbook_signal(spark, sf_dir):
    return _orderbook(spark, sf_dir)


_ENTROPY = "greatest(least(1 + (greatest(p_up, 1e-10) * ln(greatest(p_up, 1e-10)) + greatest(p_down, 1e-10) * ln(greatest(p_down, 1e-10)) + greatest(greatest(least(1 - p_up - p_down, 1.0), 0.0), 1e-10) * ln(greatest(greatest(least(1 - p_up - p_down, 1.0), 0.0), 1e-10))) / ln(3), 1.0), 0.0)"
KSIG = """, ks0 AS (SELECT asset, open_time, level + velocity + drift AS mean, greatest(sqrt(level_variance + 1e-6), 1e-10) AS std, log_predictive AS le FROM kp),
 ks AS (SELECT asset, open_time, greatest(least(""" + _CDF("(mean / std)") + ", 1.0), 0.0) AS p_up, greatest(least(" + _CDF("(-mean / std)") + """, 1.0), 0.0) AS p_down, mean, std, le FROM ks0)"""
# the average of evidence row by row, then softmax with a floor, then the mixture
FUSED = FSIG + OSIG + KSIG + """, al AS (SELECT 'f' AS src, * FROM fs UNION ALL SELECT 'o', * FROM os UNION ALL SELECT 'k', * FROM ks),
 em AS (SELECT *, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(CAST(greatest(least(le, 0.0), -50.0) AS DOUBLE)) OVER (PARTITION BY asset, src ORDER BY open_time)), lambda m, x: 0.99 * m + 0.01 * x) AS mem FROM al),
 ex AS (SELECT *, exp(mem - max(mem) OVER t) AS e, count(*) OVER t AS n FROM em WINDOW t AS (PARTITION BY asset, open_time)),
 wt AS (SELECT *, CASE WHEN 0.05 * n >= 1 THEN 1 / n ELSE 0.05 + (1 - 0.05 * n) * e / sum(e) OVER (PARTITION BY asset, open_time) END AS w FROM ex),
 wm AS (SELECT *, sum(w * mean) OVER (PARTITION BY asset, open_time) AS mm FROM wt),
 fu AS (SELECT asset, open_time, greatest(least(sum(w * p_up), 1.0), 0.0) AS p_up, greatest(least(sum(w * p_down), 1.0), 0.0) AS p_down, any_value(mm) AS mean,
 greatest(sqrt(sum(w * (std * std + (mean - mm) * (mean - mm)))), 1e-10) AS std, max(w) AS top_weight, greatest(least(sum(w * (""" + _ENTROPY + """)), 1.0), 0.0) AS confidence FROM wm GROUP BY 1, 2)"""


def _fused(spark, sf_dir):
    every = _frequency(spark, sf_dir).unionByName(_orderbook(spark, sf_dir)).unionByName(signals.kalman_signal(_posterior(spark, sf_dir)))
    return signals.fuse(every)


@query(FSIG + KSIG + " SELECT asset, open_time, 'dual_kalman' AS source, round(p_up, 4) AS p_up, round(p_down, 4) AS p_down, round(mean, 4) + 0.0 AS mean, round(std, 4) AS std, round(le, 4) + 0.0 AS log_evidence FROM ks", 4)
def kalman_signal(spark, sf_dir):
    return signals.kalman_signal(_posterior(spark, sf_dir))


@query(FUSED + """ SELECT asset, open_time, round(p_up, 4) AS p_up, round(p_down, 4) AS p_down, round(mean, 4) + 0.0 AS mean, round(top_weight, 4) AS top_weight, round(std, 4) AS std, round(confidence, 4) AS confidence FROM fu""", 4)
def fusion_mixture(spark, sf_dir):
    return _fused(spark, sf_dir).drop("regime")


CANDS = FUSED + """, kl AS (SELECT fu.*, bars.close, greatest(least(0.5 * mean / (std * std + mean * mean) - 0.001 * (CASE WHEN mean < 0 THEN -1 ELSE 1 END) * 5.0 * 1e-4, 0.3), -0.3) AS f FROM fu JOIN bars USING (asset, open_time)),
 cd AS (SELECT *, f * mean - 0.5 * f * f * (std * std + mean * mean) AS elg, abs(f) * 5.0 AS cost_bps FROM kl), ok AS (SELECT * FROM cd WHERE confidence > 0.55 AND abs(p_up - p_down) >= 0.05 AND abs(f) >= 1e-4 AND elg >= 0.0)"""


def _candidates(spark, sf_dir):
    dists = _fused(spark, sf_dir).join(_bars(spark, sf_dir).select("asset", "open_time", "close"), ["asset", "open_time"])
    return signals.candidates(signals.kelly(dists.withColumns({"tc_bps": F.lit(5.0), "current": F.lit(0.0)})))


@query(CANDS + " SELECT asset, open_time, round(f, 4) AS f, round(elg, 4) AS elg, round(cost_bps, 4) AS cost_bps FROM ok", 4)
def kelly_candidates(spark, sf_dir):
    return _candidates(spark, sf_dir).select("asset", "open_time", "f", "elg", "cost_bps")


@query()
def combo_legs(spark, sf_dir):
    return signals.legs(signals.best_subset(_candidates(spark, sf_dir)))


_LEGS = CANDS + """, tk2 AS (SELECT *, sum(abs(f)) OVER (PARTITION BY open_time) AS g, abs(sum(f) OVER (PARTITION BY open_time)) AS nt FROM ok),
 sc AS (SELECT *, f * least(CASE WHEN g > 3.0 THEN 3.0 / g ELSE 1.0 END, CASE WHEN nt > 1.8 THEN 1.8 / nt ELSE 1.0 END) AS s, 2 * greatest(std, 0.001) * close AS dist,
 CASE WHEN std > 0.02 THEN 3.0 WHEN abs(p_up - p_down) > 0.3 THEN 2.0 ELSE 1.5 END AS rr FROM tk2),
 lg AS (SELECT *, CASE WHEN s < 0 THEN -1 ELSE 1 END AS side, least(abs(s), 0.3) AS fr FROM sc),
 si AS (SELECT sha256(asset || '/' || open_time) AS signal_id, asset, s >= 0 AS up, close AS entry, close - side * dist AS stop, close + side * dist * rr AS target,
 10000 * fr * greatest(least(fr * 3.0, 3.0), 1.0) / close AS contracts FROM lg)"""


@query(_LEGS + """ SELECT signal_id, asset, 'entry' AS kind, up AS is_buy, round(entry, 4) AS limit_px, round(contracts, 4) AS contracts, false AS reduce_only, 'gtc' AS tif, CAST(NULL AS VARCHAR) AS trigger FROM si
 UNION ALL SELECT signal_id, asset, 'stop_loss', NOT up, round(stop, 4) + 0.0, round(contracts, 4), true, NULL, 'market' FROM si UNION ALL SELECT signal_id, asset, 'take_profit', NOT up, round(target, 4) + 0.0, round(contracts, 4), true, NULL, 'limit' FROM si""", 4)
def order_intents(spark, sf_dir):
    return orders.brackets(orders.leg_signals(signals.legs(_candidates(spark, sf_dir)), nav=10_000.0))


def _dp_sql(horizon: int) -> str:
    """The grid's values as lists, one step of the horizon in each CTE."""
    growth = "{f} * mean - 0.5 * {f} * {f} * sec"
    single = "greatest(least(raw - 0.001 * (CASE WHEN raw - {f} < 0 THEN -1 ELSE 1 END) * 5.0 * 1e-4, 0.3), -0.3)"
    held = single.format(f="f")
    out = FUSED + f""", g0 AS (SELECT *, std * std + mean * mean AS sec, list_transform(range(41), lambda i: -0.3 + 0.6 * i / 40) AS grid FROM fu WHERE confidence > 0.55 AND abs(p_up - p_down) >= 0.05),
 g1 AS (SELECT *, CASE WHEN sec > 1e-15 THEN 0.5 * mean / sec ELSE 0.0 END AS raw FROM g0),
 h1 AS (SELECT *, list_transform(grid, lambda f: {growth.format(f=held)} - 0.001 * abs({held} - f)) AS v FROM g1)"""
    gain = "list_transform(grid, lambda h, j: " + growth.format(f="h") + " - 0.001 * abs(h - {now}) + v[j])"
    for step in range(2, horizon + 1):
        out += f", h{step} AS (SELECT * REPLACE (list_transform(grid, lambda f: list_max({gain.format(now='f')})) AS v) FROM h{step - 1})"
    out += f""", pick AS (SELECT *, {gain.format(now="grid[21]")} AS w FROM h{horizon}), best AS (SELECT *, grid[42 - list_position(list_reverse(w), list_max(w))] AS f FROM pick),
 big AS (SELECT *, sum(abs(f)) OVER (PARTITION BY open_time) AS gr, abs(sum(f) OVER (PARTITION BY open_time)) AS nt, {single.format(f="0.0")} AS one FROM best WHERE abs(f) >= 1e-4),
 scl AS (SELECT *, f * least(CASE WHEN gr > 3.0 THEN 3.0 / gr ELSE 1.0 END, CASE WHEN nt > 1.8 THEN 1.8 / nt ELSE 1.0 END) AS s FROM big)
 SELECT open_time, asset, CASE WHEN s >= 0 THEN 'LONG' ELSE 'SHORT' END AS direction, round(least(abs(s), 0.3), 4) AS fraction, round(greatest(least(least(abs(s), 0.3) * 3.0, 3.0), 1.0), 4) AS leverage,
 round(least(abs(s), 0.3) * 10000, 4) AS size_usd, round(one * mean - 0.5 * one * one * sec, 4) + 0.0 AS elg FROM scl"""
    return out


@query(_dp_sql(3), 4)
def dp_sizing(spark, sf_dir):
    """Decisions over three periods from a flat book."""
    got = sizing.dp_decisions(_fused(spark, sf_dir).withColumn("current", F.lit(0.0)), 3, 10_000.0)
    return got.drop("confidence", "regime")


@query(BOOKS + """ SELECT asset, asset AS signal_id, 'close' AS kind, asset <> 'A' AS is_buy, round(CASE WHEN asset = 'A' THEN apx ELSE bpx END, 4) AS limit_px, CAST(5.0 AS DOUBLE) AS contracts, true AS reduce_only, 'ioc' AS tif, CAST(NULL AS VARCHAR) AS trigger FROM top""", 4)
def close_intents(spark, sf_dir):
    books = market.books(spark, sf_dir)
    side = F.when(F.col("asset") == "A", "LONG").otherwise("SHORT").alias("direction")
    held = books.select("asset", F.col("asset").alias("signal_id"), side, F.lit(200.0).alias("entry"), F.lit(500.0).alias("size_usd"), F.lit(2.0).alias("leverage"))
    return orders.closes(held, books)


_EACH = " UNION ALL ".join(
    f"""SELECT event_type AS asset, '{n}' AS "interval", (epoch_us(ts) // 1000) - (epoch_us(ts) // 1000) % {w} AS open_time, arg_min(value, (epoch_us(ts) // 1000) * 1000000 + event_id) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, (epoch_us(ts) // 1000) * 1000000 + event_id) AS close, sum(value) AS volume, count(*) AS num_trades FROM events GROUP BY 1, 2, 3"""
    for n, w in market.INTERVALS.items()
)


@query(f"""SELECT asset, "interval", open_time, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, round(volume, 4) AS volume, num_trades FROM ({_EACH}) WHERE close > 0""", 4)
def bars_all_intervals(spark, sf_dir):
    return market.all_bars(market.ticks(spark, sf_dir))


@query(RETS + """, f AS (SELECT asset, open_time, ret AS rate FROM rets WHERE (open_time // 3600000) % 8 = 0) SELECT asset, open_time, round(rate, 6) AS rate FROM f WHERE open_time >= (SELECT max(open_time) FROM f) - 604800000""")
def funding_recent(spark, sf_dir):
    """The funding rates of the last seven days."""
    rates = _returns(spark, sf_dir).where((F.col("open_time") / 3_600_000).cast("long") % 8 == 0).select("asset", "open_time", F.col("ret").alias("rate"))
    return market.recent(rates, "open_time", 7 * 86_400_000)


_STATE = BARS + f""", dw AS (SELECT asset, open_time, (greatest(max(close) OVER ({_T}), 0.0) - close) / greatest(max(close) OVER ({_T}), 0.0) AS drawdown, num_trades / 2.0 AS lev, volume, close, high, low FROM bars)"""


def _state(spark, sf_dir):
    b = _bars(spark, sf_dir)
    return windows.drawdown(b).join(b, ["asset", "open_time"]).select("asset", "open_time", "drawdown", (F.col("num_trades") / 2.0).alias("lev"), "volume", F.col("close"), "high", "low")


@query(_STATE + """ SELECT asset, open_time, CASE WHEN drawdown / 4 > 0.20 THEN 'close_all' WHEN lev > 4.5 THEN 'close_all' WHEN (high - low) / 5000 > 0.045 THEN 'reduce_all' WHEN -volume / 200 < -10 THEN 'reduce_all'
 WHEN drawdown / 4 > 0.08 THEN 'halt' WHEN lev > 3.0 THEN 'halt' END AS action FROM dw""")
def kill_switch(spark, sf_dir):
    s = _state(spark, sf_dir).select("asset", "open_time", (F.col("drawdown") / 4).alias("drawdown"), F.col("lev").alias("gross_leverage"), ((F.col("high") - F.col("low")) / 5000).alias("vol"), (-F.col("volume") / 200).alias("log_predictive"))
    return signals.kill_switch(s).select("asset", "open_time", "action")


@query(_STATE + """ SELECT asset, open_time, CASE WHEN drawdown / 10 > 0.08 THEN 'drawdown' WHEN (volume * 8 + close * 10) / 10000 > 3.0 THEN 'leverage' WHEN (close * 10 + low * 5) / 10000 > 0.30 THEN 'concentration'
 WHEN low / greatest(high, 1e-9) > 0.75 THEN 'correlation' WHEN (CASE WHEN abs(low - close) < 1e-10 THEN 0.0 ELSE abs(high - close) / abs(low - close) END) < 1.5 THEN 'risk_reward' WHEN lev >= 5 THEN 'positions' WHEN drawdown < 0.60 THEN 'confidence' END AS reject_reason FROM dw""")
def risk_gates(spark, sf_dir):
    c = F.col
    s = _state(spark, sf_dir).select(
        "asset", "open_time", (c("drawdown") / 10).alias("drawdown"), (c("volume") * 8).alias("gross"), (c("close") * 10).alias("size"), F.lit(1.0).alias("leverage"), F.lit(10_000.0).alias("nav"), (c("low") * 5).alias("held"),
        (c("low") / F.greatest(c("high"), F.lit(1e-9))).alias("corr"), c("close").alias("entry"), c("low").alias("stop"), c("high").alias("target"), c("lev").alias("n_open"), c("drawdown").alias("confidence"),
    )
    return signals.risk_gates(s).select("asset", "open_time", "reject_reason")


@query(_STATE + """, e AS (SELECT *, volume * 10.0 AS size, (volume * 10.0) / greatest(close * 1e4, 1.0) AS q, (high - low) / 1e5 AS spread, open_time // 3600000 % 7 * 1000 AS age FROM dw),
 c AS (SELECT *, CASE WHEN age > 5000 THEN 0.0 ELSE spread * 0.5 + 0.1 * q + 0.3 * greatest(spread, 1e-4) * sqrt(q) END AS cost, CASE WHEN age > 5000 THEN 0.0 ELSE 1 / (1 + exp(-(high * 20 / greatest(size, 1.0) - 1))) END AS fill FROM e)
 SELECT asset, open_time, round(cost, 6) AS cost, round(fill, 6) AS fill, CASE WHEN age > 5000 THEN 'stale' WHEN fill <= 0.3 THEN 'low_fill' WHEN drawdown <= 100 * cost THEN 'edge_below_cost' END AS reason FROM c""")
def execution_metrics(spark, sf_dir):
    c = F.col
    s = _state(spark, sf_dir).select(
        "asset", "open_time", (c("volume") * 10).alias("size"), F.lit(1.0).alias("leverage"), (c("close") * 1e4).alias("adv"), ((c("high") - c("low")) / 1e5).alias("spread"), (c("high") * 20).alias("depth"), c("drawdown").alias("edge"),
        (c("open_time") + (c("open_time") / 3_600_000).cast("long") % 7 * 1000).alias("now_ms"), c("open_time").alias("made_ms"),
    )
    return signals.execution(s).select("asset", "open_time", "cost", "fill", "reason")


@query(BARS + f""", p AS (SELECT asset, open_time, close AS price, lag(close) OVER ({_T}) AS entry, lag(open_time) OVER ({_T}) AS opened, num_trades % 2 = 0 AS up FROM bars)
 SELECT asset, open_time, CASE WHEN greatest(open_time - opened, 0) > 7200000 THEN 'time_stop' WHEN (CASE WHEN up THEN 1 ELSE -1 END) * (price - entry) / entry < -0.05 THEN 'vol_stop' END AS close_reason FROM p WHERE entry IS NOT NULL""")
def position_stops(spark, sf_dir):
    from pyspark.sql import Window

    b = _bars(spark, sf_dir).withColumn("entry", F.lag("close").over(windows.by_time())).withColumn("opened_ms", F.lag("open_time").over(windows.by_time())).where("entry is not null")
    rows = b.select("asset", "open_time", F.col("close").alias("price"), "entry", "opened_ms", F.col("open_time").alias("now_ms"), (F.col("num_trades") % 2 == 0).alias("is_long"))
    return signals.position_stop(rows, most_ms=2 * market.HOUR).select("asset", "open_time", "close_reason")


@query(BARS.replace("WITH bars", "WITH RECURSIVE bars", 1) + """, bn AS (SELECT asset, open_time, close AS z, row_number() OVER (PARTITION BY asset ORDER BY open_time) AS n FROM bars),
 kf AS (SELECT asset, CAST(0 AS BIGINT) AS open_time, CAST(0 AS BIGINT) AS n, CAST(0.0 AS DOUBLE) AS x0, CAST(0.0 AS DOUBLE) AS x1, CAST(1.0 AS DOUBLE) AS a, CAST(0.0 AS DOUBLE) AS b, CAST(1.0 AS DOUBLE) AS c FROM bn WHERE n = 1
 UNION ALL SELECT asset, open_time, n, px + k0 * (z - px), x1 + k1 * (z - px), (1 - k0) * pa, (1 - k0) * pb, pc - k1 * pb
 FROM (SELECT *, pa / (pa + 1e-3) AS k0, pb / (pa + 1e-3) AS k1 FROM (SELECT kf.asset, bn.open_time, bn.n, bn.z, x0 + x1 AS px, x1, a + 2 * b + c + 1e-4 AS pa, b + c AS pb, c + 1e-7 AS pc FROM kf JOIN bn ON kf.asset = bn.asset AND bn.n = kf.n + 1)))
 SELECT asset, open_time, round(x0, 4) AS level, round(x1, 4) + 0.0 AS velocity FROM kf WHERE n > 0""", 4)
def linear_kalman(spark, sf_dir):
    return scans.linear_kalman(_bars(spark, sf_dir))


@query(FSIG + " SELECT asset, open_time, round(level, 4) AS level, round(velocity, 4) + 0.0 AS velocity, round(drift, 4) + 0.0 AS drift, round(kappa, 4) AS kappa, round(log_predictive, 4) + 0.0 AS log_predictive, round(level_variance, 4) AS level_variance FROM kp", 4)
def dual_kalman(spark, sf_dir):
    return scans.dual_kalman(_bars(spark, sf_dir))


@query()
def walk_forward(spark, sf_dir):
    folded = backtest.folds(_bars(spark, sf_dir), 100, 60)
    return backtest.metrics(backtest.book(backtest.signals(folded)))


def _fit(fit, names, least=30):
    return lambda spark, sf_dir: scans.by_asset(_returns(spark, sf_dir), ["ret"], "open_time", fit, names, least)


@query()
def student_t_fit(spark, sf_dir):
    return _fit(scans.student_t, ("location", "scale", "nu", "ll", "aic"))(spark, sf_dir)


@query()
def cauchy_fit(spark, sf_dir):
    return _fit(scans.cauchy, ("location", "scale", "ll", "aic"))(spark, sf_dir)


@query()
def return_dist_best(spark, sf_dir):
    """Of the fitted distributions the one with the lowest AIC; ties go to the first."""
    t = _fit(scans.student_t, ("aic",))(spark, sf_dir).select("asset", F.struct("aic", F.lit(0).alias("k"), F.lit("student_t").alias("name")).alias("d"))
    c = _fit(scans.cauchy, ("aic",))(spark, sf_dir).select("asset", F.struct("aic", F.lit(1).alias("k"), F.lit("cauchy").alias("name")).alias("d"))
    h = _fit(scans.discrete, ("aic",))(spark, sf_dir).select("asset", F.struct("aic", F.lit(2).alias("k"), F.lit("discrete").alias("name")).alias("d"))
    return t.unionByName(c).unionByName(h).groupBy("asset").agg(F.min("d").alias("d")).select("asset", F.col("d.name").alias("name"), F.col("d.aic").alias("aic"))


@query()
def garch_fit(spark, sf_dir):
    return _fit(scans.garch, ("omega", "alpha", "beta", "nu", "ll", "forecast", "unconditional"), 50)(spark, sf_dir)


@query()
def hawkes_fit(spark, sf_dir):
    ticks = windows.trade_window(market.ticks(spark, sf_dir), 0).select("asset", (F.col("ms") / 1000.0).alias("s"), (F.col("event_id") % 2 == 0).alias("is_buy"))
    return scans.by_asset(ticks, ["s", "is_buy"], "s", scans.hawkes, ("mu_buy", "mu_sell", "a_bb", "a_bs", "a_sb", "a_ss", "beta", "ll", "cross", "intensity_ofi"), 20)


@query()
def hmm_viterbi(spark, sf_dir):
    import numpy as np

    def fit(ret, volume):
        obs = np.column_stack([ret, np.abs(ret), np.log1p(volume)])
        model = scans.hmm(obs, rounds=30)
        path = scans.viterbi(obs, *model[:4])
        return {"ll": model[4], "last_state": path[-1], "switches": int((path[1:] != path[:-1]).sum())}

    return scans.by_asset(_returns(spark, sf_dir), ["ret", "volume"], "open_time", fit, ("ll", "last_state", "switches"), 10)


@query()
def gbt_signal(spark, sf_dir):
    import numpy as np

    def fit(ret, volume):
        y = np.sign(ret[5:])
        x = np.column_stack([ret[i : len(ret) - 5 + i] for i in range(5)] + [volume[4:-1]])
        now = np.array([[*ret[-5:], volume[-1]]])
        s = np.array([scans.boosted_values(scans.boosted(x, (y == k).astype(float)), now)[0] for k in (-1, 0, 1)])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        return {"p_down": p[0], "p_flat": p[1], "p_up": p[2]}

    return scans.by_asset(_returns(spark, sf_dir), ["ret", "volume"], "open_time", fit, ("p_down", "p_flat", "p_up"), 40)


# ---- plain relational coverage ------------------------------------------------------------------


def _tables(spark, sf_dir, *names):
    return [spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names]


@query("""SELECT n_name, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
 GROUP BY n_name""", 2)
def orders_by_nation(spark, sf_dir):
    o, c, n = _tables(spark, sf_dir, "orders", "customer", "nation")
    by = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("k"), F.sum("o_totalprice").alias("t"))
    got = by.join(c, by["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == n["n_nationkey"])
    return got.groupBy("n_name").agg(F.sum("k").alias("n_orders"), F.sum("t").alias("total"))


@query("""SELECT l_returnflag, l_linestatus, grouping(l_returnflag) + grouping(l_linestatus) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem
 GROUP BY CUBE (l_returnflag, l_linestatus)""", 2)
def lineitem_cube(spark, sf_dir):
    (x,) = _tables(spark, sf_dir, "lineitem")
    level = F.grouping("l_returnflag").cast("long") + F.grouping("l_linestatus").cast("long")
    return x.cube("l_returnflag", "l_linestatus").agg(level.alias("level"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def customers_without_urgent_orders(spark, sf_dir):
    c, o = _tables(spark, sf_dir, "customer", "orders")
    return c.join(o.where("o_orderpriority = '1-URGENT'"), c["c_custkey"] == o["o_custkey"], "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT c_nationkey AS nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def shared_nations(spark, sf_dir):
    c, s = _tables(spark, sf_dir, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nationkey")).intersect(s.select("s_nationkey"))


@query("SELECT n_nationkey AS nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def nations_without_debt(spark, sf_dir):
    n, s = _tables(spark, sf_dir, "nation", "supplier")
    return n.select(F.col("n_nationkey").alias("nationkey")).subtract(s.where("s_acctbal < 0").select("s_nationkey"))


@query("""SELECT c_nationkey, c_custkey, round(c_acctbal, 2) AS c_acctbal, place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer)
 WHERE place <= 3""", 2)
def top_customers(spark, sf_dir):
    """The three highest balances of each nation."""
    from pyspark.sql import Window

    (c,) = _tables(spark, sf_dir, "customer")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey"))
    return c.select("c_nationkey", "c_custkey", "c_acctbal", place.alias("place")).where("place <= 3")


from tidemark.plans import assembly  # noqa: E402, F401  registers its queries here
