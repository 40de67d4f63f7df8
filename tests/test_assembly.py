"""Distributions against closed forms and integrals; fold metrics, portfolio and features on small tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest, distributions, features, portfolio, signals
from tidemark.settings import RiskLimits


def test_student_t_forms():
    t = np.array([-40.0, -3.0, -1.0, -0.1, 0.0, 0.5, 2.0])
    assert np.allclose(distributions.t_cdf(t, 1.0), 0.5 + np.arctan(t) / math.pi, atol=1e-12)
    assert np.allclose(distributions.t_cdf(t, 2.0), 0.5 + t / (2 * np.sqrt(2 + t * t)), atol=1e-12)
    q = distributions.t_quantile(0.05, np.array([2.1, 5.0, 80.0]))
    assert np.allclose(distributions.t_cdf(q, np.array([2.1, 5.0, 80.0])), 0.05, atol=1e-10)


def test_student_t_tail_by_integral(spark):
    fits = spark.createDataFrame([("a", 0.001, 0.02, 4.0)], "asset string, location double, scale double, nu double")
    row = distributions.student_t_risk(fits, 0.95).withColumn("p", distributions.student_t_cdf("var", "location", "scale", "nu")).first()
    assert row.p == pytest.approx(0.05, abs=1e-9)
    z = np.linspace(-2000, (row["var"] - 0.001) / 0.02, 4_000_001)
    mean = np.trapezoid((0.001 + 0.02 * z) * distributions.t_pdf(z, 4.0), z) / 0.05
    assert row.cvar == pytest.approx(mean, rel=1e-4)


def test_cauchy_tail_by_integral(spark):
    x0, g = F.lit(0.01), F.lit(0.3)
    row = spark.range(1).select(
        distributions.cauchy_var(0.95, x0, g).alias("v"), distributions.cauchy_cvar(0.95, x0, g).alias("c"), distributions.cauchy_log_pdf(F.lit(0.4), x0, g).alias("l"),
        distributions.cauchy_cdf(distributions.cauchy_quantile(0.2, x0, g), x0, g).alias("p"),
    ).first()
    p = np.linspace(0.001, 0.05, 1_000_001)
    assert row.c == pytest.approx(np.trapezoid(0.01 + 0.3 * np.tan(np.pi * (p - 0.5)), p) / 0.05, rel=1e-6)
    assert row.v == pytest.approx(0.01 + 0.3 * math.tan(math.pi * -0.45))
    assert row.l == pytest.approx(-math.log(math.pi * 0.3 * (1 + 1.3**2))) and row.p == pytest.approx(0.2)


def test_histogram_methods(spark):
    r = np.random.default_rng(5).normal(0, 0.02, 400)
    df = spark.createDataFrame([("a", float(x)) for x in r] + [("b", 0.1)] * 29 + [("c", 0.0)] * 30, "asset string, ret double")
    fit = {x.asset: x for x in distributions.histogram(df).collect()}
    assert set(fit) == {"a", "c"}  # b has too few returns
    a = fit["a"]
    assert sum(a.probs) == pytest.approx(1.0) and a.cum[-1] == pytest.approx(1.0)
    at = lambda x: min(int((x - a.lo) / a.width), len(a.probs) - 1)
    assert a.ll == pytest.approx(sum(math.log(a.probs[at(x)] / a.width) for x in r))
    cdf = lambda x: a.cum[at(x)] + a.probs[at(x)] * ((x - a.lo) / a.width - at(x))
    assert a.ks == pytest.approx(max(abs((i + 1) / 400 - cdf(x)) for i, x in enumerate(sorted(r))))
    one = distributions.histogram(df).where("asset = 'a'")
    got = one.select(
        distributions.histogram_var(0.95).alias("v"), distributions.histogram_cvar(0.95).alias("c"), distributions.histogram_cdf(distributions.histogram_var(0.95)).alias("p"),
        distributions.histogram_cdf(F.lit(9.0)).alias("one"), distributions.histogram_cdf(F.lit(-9.0)).alias("zero"), distributions.histogram_log_pdf(F.lit(9.0)).alias("out"),
        distributions.histogram_log_pdf(F.lit(0.0)).alias("l"),
    ).first()
    assert got.p == pytest.approx(0.05) and (got.one, got.zero, got.out) == (1.0, 0.0, -math.inf)
    assert got.l == pytest.approx(math.log(a.probs[at(0.0)] / a.width))
    p = np.linspace(0, 0.05, 200_001)[1:-1]
    inverse = np.interp(p, a.cum, a.lo + a.width * np.arange(len(a.cum)))
    assert got.c < got.v and got.c == pytest.approx(inverse.mean(), rel=1e-3)


def test_best_takes_the_first_of_equals(spark):
    rows = lambda aic: spark.createDataFrame([("a", aic, 0.0, 0.0)], "asset string, aic double, var double, cvar double")
    assert distributions.best({"x": rows(2.0), "y": rows(1.0), "z": rows(1.0)}).first().name == "y"


def test_fold_metrics(spark):
    schema = "fold long, i long, nav double, pnl double, traded double, cost double, wins long, losses long, win_share double, loss_share double"
    pnl = [10.0, -5.0, 0.0, 6.0, -1.0, -1.0, -1.0]
    rows, nav = [], 100.0
    for i, x in enumerate(pnl):
        nav += x
        rows.append((0, i, nav, x, 50.0, 0.1, int(x > 0), int(x <= 0), max(x, 0) / 50, max(-x, 0) / 50))
    got = {r.fold: r for r in backtest.metrics(spark.createDataFrame(rows + [(1, 0, 90.0, -10.0, 5.0, 0.1, 0, 1, 0.0, 2.0)], schema), start=100.0).collect()}
    a, r = got[0], np.array(pnl) / 100
    assert (a.n_bars, a.n_trades, a.longest_drawdown) == (7, 7, 3)
    assert a.total_return == pytest.approx(0.08) and a.annual_return == pytest.approx(0.08 * 105_120 / 7)
    assert a.sharpe == pytest.approx(r.mean() / r.std(ddof=1) * math.sqrt(105_120))
    assert a.sortino == pytest.approx(r.mean() / math.sqrt((np.minimum(r, 0) ** 2).mean()) * math.sqrt(105_120))
    assert a.max_drawdown == pytest.approx(5 / 110) and a.calmar == pytest.approx(a.annual_return * 110 / 5)
    assert a.hit_rate == pytest.approx(2 / 7) and a.average_win == pytest.approx(0.16) and a.average_loss == pytest.approx(8 / 50 / 5)
    assert a.turnover == 350 and a.costs == pytest.approx(0.7)
    assert not any(got[1][n] for n in got[1].asDict() if n != "fold")  # too short: zeros
    total = backtest.overall(spark.createDataFrame(rows, schema).transform(lambda d: backtest.metrics(d, start=100.0))).first()
    assert total.total_return == pytest.approx(0.08 - 1) and total.compounded == pytest.approx(0.08)


def test_portfolio(spark):
    pos = spark.createDataFrame([("u", "btc", True, 100.0, 2.0), ("u", "eth", False, 50.0, 1.0)], "account string, asset string, is_long boolean, size double, leverage double")
    acc = spark.createDataFrame([("u", 100.0, 125.0), ("v", 0.0, 0.0)], "account string, nav double, peak double")
    got = {r.account: r for r in portfolio.state(pos, acc).collect()}
    assert (got["u"].gross, got["u"].net, got["u"].gross_leverage, got["u"].n_open, got["u"].drawdown) == (250.0, 150.0, 2.5, 2, 0.2)
    assert (got["v"].gross, got["v"].gross_leverage, got["v"].n_open, got["v"].drawdown) == (0.0, 0.0, 0, 0.0)
    sig = spark.createDataFrame([("u", "btc"), ("u", "sol"), ("v", "btc")], "account string, asset string")
    corr = spark.createDataFrame([("btc", "sol", 0.9), ("btc", "eth", 0.4)], "a string, b string, corr double")
    held = {(r.account, r.asset): (r.corr, r.held, r.n_open) for r in portfolio.held_against(sig, pos, corr).collect()}
    assert held == {("u", "btc"): (0.5, True, 2), ("u", "sol"): (0.9, False, 2), ("v", "btc"): (None, False, 0)}
    legs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "b"), (2, "z"), (2, "y")], "k int, regime string")
    assert {r.k: r.regime for r in portfolio.modal(legs, ["k"]).collect()} == {1: "b", 2: "y"}


def test_limits_reach_the_gates(spark):
    row = spark.createDataFrame([(0.05, 1.0, 0.01, 0.0)], "drawdown double, gross_leverage double, vol double, log_predictive double")
    assert signals.kill_switch(row).first().action is None
    assert signals.kill_switch(row, RiskLimits(max_daily_drawdown=0.04)).first().action == "halt"
    assert signals.kill_switch(row, RiskLimits(max_gross_exposure=0.5)).first().action == "close_all"


def test_features_defaults_and_order(spark):
    bars = spark.createDataFrame([("a", i, 10.0, 0.01) for i in range(30)], "asset string, open_time long, close double, ret double")
    anchor = spark.createDataFrame([(29, 0.004)], "open_time long, anchor_ret double")
    part = spark.createDataFrame([("a", 29, 8.0, 0.5)], "asset string, open_time long, kalman_level double, beta double")
    rows = features.assemble(bars, anchor, [part], [spark.createDataFrame([("a", 0.3)], "asset string, ou_z_score double")])
    v = features.matrix(rows).first().features
    assert rows.count() == 1 and len(v) == 27
    assert v[1] == 0.25 and v[8] == 0.5 and v[12] == 1.0 and v[14] == 0.5 and v[15] == pytest.approx(0.008) and v[16] == 0.3 and v[18:] == [0.0] * 9
    plain = features.assemble(bars, anchor).first()
    assert plain.beta == 1.0 and plain.corr == 0.0 and plain.kalman_level_dev == 0.0
    assert features.latest(rows).first().open_time == 29 and features.assemble(bars.limit(0), anchor).count() == 0
