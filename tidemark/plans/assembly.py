"""Queries over assembled features, distributions, portfolio state and fold metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest, distributions, features, portfolio, scans, windows
from tidemark.plans.catalog import _T, BARS, FEATURES, RETS, _bars, _fit, _returns, query
from tidemark.sources import market

_HIST = (
    RETS
    + """, s AS (SELECT asset, count(*) AS n, min(ret) AS mn, max(ret) AS mx, 3.5 * greatest(stddev_pop(ret), 1e-10) * count(*) ^ (-1.0 / 3) AS w FROM rets GROUP BY 1 HAVING count(*) >= 30),
 p AS (SELECT asset, n, mn - w AS lo, CAST(least(greatest(ceil((mx - mn + 2 * w) / w), 5), 100) AS BIGINT) AS bins, mx - mn + 2 * w AS span FROM s),
 rb AS (SELECT r.asset, r.ret, CAST(least(floor((ret - lo) / (span / bins)), bins - 1) AS BIGINT) AS bin FROM rets r JOIN p ON r.asset = p.asset),
 k AS (SELECT asset, bin, count(*) AS c FROM rb GROUP BY 1, 2),
 g AS (SELECT asset, n, lo, bins, span / bins AS width, unnest(range(bins)) AS bin FROM p),
 h AS (SELECT g.*, coalesce(c, 0) AS c, (coalesce(c, 0) + 0.5) / (n + 0.5 * bins) AS pr FROM g LEFT JOIN k ON g.asset = k.asset AND g.bin = k.bin),
 cu AS (SELECT *, coalesce(sum(pr) OVER (PARTITION BY asset ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS below FROM h),
 q AS (SELECT asset, arg_min(lo + (bin + (0.05 - below) / pr) * width, bin) AS var_95 FROM cu WHERE below + pr >= 1 - 0.95 GROUP BY 1),
 pt AS (SELECT cu.asset, c, pr, width, var_95, lo + bin * width AS l, pr * least(greatest((var_95 - (lo + bin * width)) / width, 0), 1) AS m FROM cu JOIN q ON cu.asset = q.asset),
 t AS (SELECT asset, any_value(var_95) AS var_95, sum(m * (l + least(var_95, l + width)) / 2) / sum(m) AS cvar_95, sum(CASE WHEN c > 0 THEN c * ln(pr / width) ELSE 0 END) AS ll,
 count(*) FILTER (c > 0) AS filled FROM pt GROUP BY 1),
 rk AS (SELECT asset, ret, bin, row_number() OVER (PARTITION BY asset ORDER BY ret) AS i FROM rb),
 d AS (SELECT cu.asset, max(abs(i / n - (below + pr * ((ret - lo) / width - cu.bin)))) AS ks FROM rk JOIN cu ON rk.asset = cu.asset AND rk.bin = cu.bin GROUP BY 1)"""
)


@query(
    _HIST
    + """ SELECT t.asset, round(var_95, 5) AS var_95, round(cvar_95, 5) AS cvar_95, round(ll, 3) AS ll, round(2 * (filled - 1) - 2 * ll, 3) AS aic, round(ks, 5) AS ks
 FROM t JOIN d ON t.asset = d.asset""",
    5,
)
def histogram_risk(spark, sf_dir):
    """Histogram fit of each asset's returns with its 5 % quantile and the mean below it."""
    fit = distributions.histogram(_returns(spark, sf_dir))
    return fit.select("asset", distributions.histogram_var(0.95).alias("var_95"), distributions.histogram_cvar(0.95).alias("cvar_95"), F.round("ll", 3).alias("ll"), F.round("aic", 3).alias("aic"), "ks")


@query(
    RETS
    + """, q AS (SELECT asset, ret, row_number() OVER (PARTITION BY asset ORDER BY ret) AS i, count(*) OVER (PARTITION BY asset) AS n FROM rets),
 m AS (SELECT asset, median(ret) AS x0, greatest((max(CASE WHEN i = 3 * n // 4 + 1 THEN ret END) - max(CASE WHEN i = n // 4 + 1 THEN ret END)) / 2, 1e-12) AS g FROM q GROUP BY 1),
 l AS (SELECT r.asset, any_value(x0) AS x0, any_value(g) AS g, sum(-ln(pi()) - ln(g) - ln(1 + ((ret - x0) / g) ^ 2)) AS ll FROM rets r JOIN m ON r.asset = m.asset GROUP BY 1),
 v AS (SELECT *, x0 + g * tan(pi() * (0.05 - 0.5)) AS v95, x0 + g * tan(pi() * (0.001 - 0.5)) AS cut FROM l)
 SELECT asset, round(v95, 5) AS var_95, round((x0 * 0.049 + g / (2 * pi()) * (ln(1 + ((v95 - x0) / g) ^ 2) - ln(1 + ((cut - x0) / g) ^ 2))) / 0.05, 5) AS cvar_95, round(ll, 3) AS ll, round(4 - 2 * ll, 3) AS aic FROM v""",
    5,
)
def cauchy_risk(spark, sf_dir):
    """Quartile Cauchy fit with its 5 % quantile and the cut mean below it."""
    c, fit = F.col, distributions.quartile_cauchy(_returns(spark, sf_dir))
    tail = [f(0.95, c("location"), c("scale")).alias(n) for n, f in (("var_95", distributions.cauchy_var), ("cvar_95", distributions.cauchy_cvar))]
    return fit.select("asset", *tail, F.round("ll", 3).alias("ll"), F.round("aic", 3).alias("aic"))


@query()
def student_t_tail(spark, sf_dir):
    """Student t fit with its 5 % quantile and the mean below it."""
    fits = _fit(scans.student_t, ("location", "scale", "nu", "ll", "aic"))(spark, sf_dir)
    return distributions.student_t_risk(fits, 0.95)


@query()
def return_dist_risk(spark, sf_dir):
    """Tail of the distribution that return_dist_best chooses."""
    c = F.col
    t = student_t_tail(spark, sf_dir)
    k = _fit(scans.cauchy, ("location", "scale", "aic"))(spark, sf_dir)
    k = k.withColumn("var", distributions.cauchy_var(0.95, c("location"), c("scale"))).withColumn("cvar", distributions.cauchy_cvar(0.95, c("location"), c("scale")))
    h = distributions.histogram(_returns(spark, sf_dir))
    h = h.withColumn("var", distributions.histogram_var(0.95)).withColumn("cvar", distributions.histogram_cvar(0.95))
    return distributions.best({"student_t": t, "cauchy": k, "discrete": h})


def _positions(spark, sf_dir):
    """Each customer's latest order of a priority as a position."""
    o = market.table(spark, sf_dir, "orders")
    rows = o.groupBy(F.col("o_custkey").alias("account"), F.col("o_orderpriority").alias("asset")).agg(F.max(F.struct("o_orderkey", "o_totalprice")).alias("o"))
    return rows.select("account", "asset", (F.col("o.o_orderkey") % 2 == 0).alias("is_long"), (F.col("o.o_totalprice") / 100).alias("size"), (1.0 + F.col("o.o_orderkey") % 3).alias("leverage"))


POSITIONS = """WITH pos AS (SELECT o_custkey AS account, o_orderpriority AS asset, max(o_orderkey) % 2 = 0 AS is_long, arg_max(o_totalprice, o_orderkey) / 100 AS size, 1.0 + max(o_orderkey) % 3 AS leverage
 FROM orders GROUP BY 1, 2)"""


@query(
    POSITIONS
    + """, s AS (SELECT account, count(*) AS n_open, sum(size * leverage) AS gross, sum(CASE WHEN is_long THEN size * leverage ELSE -size * leverage END) AS net FROM pos GROUP BY 1)
 SELECT c_custkey AS account, coalesce(n_open, 0) AS n_open, round(coalesce(gross, 0.0), 6) AS gross, round(coalesce(net, 0.0), 6) + 0.0 AS net, round(CASE WHEN c_acctbal < 1e-10 THEN 0.0 ELSE coalesce(gross, 0.0) / c_acctbal END, 6) AS gross_leverage,
 round((greatest(c_acctbal, 5000.0) - c_acctbal) / greatest(c_acctbal, 5000.0), 6) + 0.0 AS drawdown FROM customer LEFT JOIN s ON c_custkey = account""",
)
def portfolio_state(spark, sf_dir):
    """Exposure, leverage and drawdown of each account."""
    accounts = market.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.col("c_acctbal").alias("nav"), F.greatest("c_acctbal", F.lit(5000.0)).alias("peak"))
    return portfolio.state(_positions(spark, sf_dir), accounts).drop("nav", "peak")


@query("""SELECT order_id, regime FROM (SELECT l_orderkey AS order_id, l_returnflag AS regime, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS k
 FROM lineitem GROUP BY 1, 2) WHERE k = 1""")
def modal_regime(spark, sf_dir):
    rows = market.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_returnflag").alias("regime"))
    return portfolio.modal(rows, ["order_id"])


_CORR = RETS + """, j AS (SELECT x.asset AS a, y.asset AS b, corr(x.ret, y.ret) AS corr FROM rets x JOIN rets y ON x.open_time = y.open_time AND x.asset < y.asset GROUP BY 1, 2)"""


@query(
    _CORR
    + """, sg AS (SELECT DISTINCT user_id AS account, event_type AS asset FROM events WHERE event_id % 3 = 0), ps AS (SELECT DISTINCT user_id AS account, event_type AS asset FROM events WHERE event_id % 3 = 1),
 w AS (SELECT sg.account, sg.asset, ps.asset AS other, coalesce(j.corr, 0.5) AS corr FROM sg JOIN ps ON sg.account = ps.account LEFT JOIN j ON j.a = least(sg.asset, ps.asset) AND j.b = greatest(sg.asset, ps.asset))
 SELECT sg.account, sg.asset, round(max(w.corr), 4) AS corr, coalesce(bool_or(w.other = sg.asset), false) AS held, count(w.other) AS n_open FROM sg LEFT JOIN w ON sg.account = w.account AND sg.asset = w.asset GROUP BY 1, 2""",
    4,
)
def signal_correlation(spark, sf_dir):
    """Each signal's largest correlation with what its account holds, and whether it holds it."""
    e = market.table(spark, sf_dir, "events").select(F.col("user_id").alias("account"), F.col("event_type").alias("asset"), "event_id")
    side = lambda k: e.where(F.col("event_id") % 3 == k).select("account", "asset").distinct()
    r = _returns(spark, sf_dir).select("asset", "open_time", "ret")
    other = r.select(F.col("asset").alias("b"), "open_time", F.col("ret").alias("other"))
    corr = r.withColumnRenamed("asset", "a").join(other, "open_time").where("a < b").groupBy("a", "b").agg(F.corr("ret", "other").alias("corr"))
    return portfolio.held_against(side(0), side(1), corr)


_FOLD = BARS + f""", c AS (SELECT asset AS fold, open_time AS i, round((close - open) * 100) AS pnl, round(volume) AS size FROM bars),
 d AS (SELECT *, sum(pnl) OVER (PARTITION BY fold ORDER BY i) AS total, row_number() OVER (PARTITION BY fold ORDER BY i) AS k FROM c),
 e AS (SELECT *, 1e6 + total AS nav, greatest(coalesce(max(total) OVER (PARTITION BY fold ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS high FROM d),
 f AS (SELECT *, k - coalesce(max(CASE WHEN total > high THEN k END) OVER (PARTITION BY fold ORDER BY i), 0) AS since, greatest(max(nav) OVER (PARTITION BY fold ORDER BY i), 1e6) AS peak FROM e),
 m AS (SELECT fold, count(*) AS n_bars, count(*) AS n_trades, arg_max(nav, i) / 1e6 - 1 AS total_return, avg(pnl / 1e6) / greatest(stddev_samp(pnl / 1e6), 1e-10) * sqrt(105120) AS sharpe,
 avg(pnl / 1e6) / greatest(sqrt(avg(least(pnl / 1e6, 0) ^ 2)), 1e-10) * sqrt(105120) AS sortino, max((peak - nav) / peak) AS max_drawdown, max(since) AS longest_drawdown, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate,
 coalesce(avg(pnl / greatest(size, 1)) FILTER (pnl > 0), 0) AS average_win, coalesce(avg(-pnl / greatest(size, 1)) FILTER (pnl <= 0), 0) AS average_loss, sum(size) AS turnover, sum(size * 5e-4) AS costs FROM f GROUP BY 1),
 z AS (SELECT *, total_return * 105120 / n_bars AS annual_return, CASE WHEN max_drawdown > 1e-10 THEN total_return * 105120 / n_bars / max_drawdown ELSE 0 END AS calmar FROM m)"""
_NAMES = "total_return sharpe sortino max_drawdown hit_rate average_win average_loss turnover costs annual_return calmar".split()


def _folds(spark, sf_dir):
    """Each asset as a fold with one trade a bar."""
    c, b = F.col, _bars(spark, sf_dir)
    rows = b.select(c("asset").alias("fold"), c("open_time").alias("i"), F.round((c("close") - c("open")) * 100).alias("pnl"), F.round("volume").alias("traded"))
    share = F.abs("pnl") / F.greatest("traded", F.lit(1.0))
    won = c("pnl") > 0
    rows = rows.withColumn("nav", 1e6 + F.sum("pnl").over(windows.Window.partitionBy("fold").orderBy("i"))).withColumn("cost", c("traded") * 5e-4)
    rows = rows.withColumn("wins", won.cast("long")).withColumn("losses", (~won).cast("long"))
    return backtest.metrics(rows.withColumn("win_share", F.when(won, share).otherwise(0.0)).withColumn("loss_share", F.when(won, 0.0).otherwise(share)), start=1e6)


@query(_FOLD + f" SELECT fold, n_bars, n_trades, longest_drawdown, {', '.join(f'round({n}, 4) + 0.0 AS {n}' for n in _NAMES)} FROM z", 4)
def fold_metrics(spark, sf_dir):
    return _folds(spark, sf_dir)


@query(
    _FOLD
    + f""" SELECT count(*) AS folds, CAST(sum(n_bars) AS BIGINT) AS n_bars, CAST(sum(n_trades) AS BIGINT) AS n_trades, max(longest_drawdown) AS longest_drawdown, round(max(max_drawdown), 4) AS max_drawdown, round(sum(turnover), 4) AS turnover, round(sum(costs), 4) AS costs,
 {", ".join(f"round(avg({n}), 4) + 0.0 AS {n}" for n in ("annual_return", "sharpe", "sortino", "calmar", "hit_rate", "average_win", "average_loss"))},
 round(product(total_return) - 1, 4) AS total_return, round(product(1 + total_return) - 1, 4) AS compounded FROM z""",
    4,
)
def fold_aggregate(spark, sf_dir):
    return backtest.overall(_folds(spark, sf_dir))


_ROWS = FEATURES + RETS.removeprefix(BARS) + f""", fn AS (SELECT asset, open_time, ret AS rate FROM rets WHERE (open_time // 3600000) % 8 = 0),
 fz AS (SELECT asset, open_time, (rate - avg(rate) OVER w) / greatest(stddev_pop(rate) OVER w, 1e-15) AS z, coalesce(rate - lag(rate) OVER ({_T}), 0.0) AS mo FROM fn WINDOW w AS ({_T} ROWS 199 PRECEDING)),
 an AS (SELECT open_time, ret AS ar FROM rets WHERE asset = 'click'),
 bj AS (SELECT r.asset, r.open_time, r.ret, ar FROM rets r JOIN an ON r.open_time = an.open_time),
 bs AS (SELECT asset, open_time, count(*) OVER w AS n, covar_pop(ret, ar) OVER w AS c, var_pop(ar) OVER w AS va, var_pop(ret) OVER w AS vo FROM bj WINDOW w AS ({_T} ROWS 59 PRECEDING)),
 bc AS (SELECT asset, open_time, CASE WHEN n = 60 THEN CASE WHEN va < 1e-15 THEN 0.0 ELSE c / va END END AS beta, CASE WHEN n = 60 THEN CASE WHEN va < 1e-15 OR vo < 1e-15 THEN 0.0 ELSE c / sqrt(va * vo) END END AS corr FROM bs),
 vr AS (SELECT asset, open_time, CASE WHEN lv < 1e-10 THEN 1.0 ELSE sv / lv END AS ratio FROM (SELECT asset, open_time, sqrt(var_pop(ret) OVER ({_T} ROWS 23 PRECEDING) * 8760) AS sv, sqrt(var_pop(ret) OVER ({_T} ROWS 167 PRECEDING) * 8760) AS lv FROM rets)),
 nr AS (SELECT *, row_number() OVER ({_T}) AS k FROM rets)
 SELECT nr.asset, nr.open_time, round(coalesce(fz.z, 0.0), 4) + 0.0 AS funding_z, round(coalesce(fz.mo, 0.0), 4) + 0.0 AS funding_momentum, round(coalesce(ratio, 1.0), 4) AS vol_ratio, round(coalesce(beta, 1.0), 4) + 0.0 AS beta,
 round(nr.ret - coalesce(beta, 1.0) * coalesce(ar, 0.0), 4) + 0.0 AS idiosyncratic_ret, round(coalesce(corr, 0.0), 4) + 0.0 AS corr, CAST(0.5 AS DOUBLE) AS trade_imbalance,
 round(coalesce(dominant_period / 64.0, 0.0), 4) AS dominant_share, round(coalesce(spectral_entropy, 0.0), 4) AS spectral_entropy, round(CASE WHEN noise_trend_ratio IS NULL THEN 0.0 WHEN noise_trend_ratio > 10 THEN 1.0 ELSE noise_trend_ratio / 10 END, 4) AS noise_share, CAST(27 AS INT) AS n_features
 FROM nr LEFT JOIN feats f ON nr.asset = f.asset AND nr.open_time = f.open_time LEFT JOIN an ON nr.open_time = an.open_time LEFT JOIN bc ON nr.asset = bc.asset AND nr.open_time = bc.open_time
 LEFT JOIN vr ON nr.asset = vr.asset AND nr.open_time = vr.open_time ASOF LEFT JOIN fz ON nr.asset = fz.asset AND nr.open_time >= fz.open_time WHERE k >= 30"""


@query(_ROWS, 4)
def feature_rows(spark, sf_dir):
    """The assembled row of each bar from 30 bars on, as the model input has it; order-book, Kalman
    and excitation parts are left at their defaults here."""
    r = _returns(spark, sf_dir)
    rates = r.where((F.col("open_time") / market.HOUR).cast("long") % 8 == 0).select("asset", "open_time", F.col("ret").alias("rate"))
    funding = windows.funding_features(rates).select("asset", "open_time", F.col("z").alias("funding_z"), F.col("momentum").alias("funding_momentum"))
    known = windows.as_of(r.select("asset", "open_time"), funding, "asset", "open_time", "open_time", ["funding_z", "funding_momentum"])
    spectral = windows.spectral_features(windows.spectrum(r)).drop("close")
    ratio = windows.vol_ratio(r).select("asset", "open_time", F.col("ratio").alias("vol_ratio"))
    anchor = r.where("asset = 'click'").select("open_time", F.col("ret").alias("anchor_ret"))
    rows = features.assemble(r, anchor, [known, spectral, ratio, windows.beta_corr(r, "click")])
    v = rows.withColumn("v", features.vector(rows))
    at = {"dominant_share": 23, "spectral_entropy": 24, "noise_share": 25}
    base = ["funding_z", "funding_momentum", "vol_ratio", "beta", "idiosyncratic_ret", "corr", "trade_imbalance"]
    return v.select("asset", "open_time", *base, *(F.col("v")[i].alias(n) for n, i in at.items()), F.size("v").alias("n_features"))
