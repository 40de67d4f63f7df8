"""Settings, sizing over several periods, and order intents."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import orders, sizing
from tidemark.settings import RiskLimits, Settings
from tidemark.sources import market


def test_settings(spark):
    assert Settings.from_env({}) == Settings() and RiskLimits.from_env({}) == RiskLimits()
    got = Settings.from_env({"HISTORY_DAYS": "7", "USE_TESTNET": "true", "IMPACT_ETA": "0.5"})
    assert (got.history_days, got.use_testnet, got.impact_eta) == (7, True, 0.5)
    for bad in ({"HISTORY_DAYS": "-1"}, {"HISTORY_DAYS": "1.5"}, {"IMPACT_ETA": "much"}):
        with pytest.raises(ValueError):
            Settings.from_env(bad)
    assert not Settings.from_env({"USE_TESTNET": "yes"}).use_testnet
    assert RiskLimits.from_env({"RISK_MIN_RR": "x", "RISK_MAX_POSITIONS": "3"}) == RiskLimits(max_concurrent_positions=3)
    spark.conf.set("tidemark.history_days", "9")
    try:
        assert Settings.from_env({"HISTORY_DAYS": "7"}, spark).history_days == 9
    finally:
        spark.conf.unset("tidemark.history_days")


def brute(mean, std, current, horizon, cap=0.3, lam=0.001, k=0.5, tc=5.0):
    second = std * std + mean * mean
    raw = k * mean / second if second > 1e-15 else 0.0

    def single(now):
        return min(max(raw - lam * (-1 if raw - now < 0 else 1) * tc * 1e-4, -cap), cap)

    if horizon <= 1:
        return single(current)
    grid = [-cap + 2 * cap * i / 40 for i in range(41)]
    grow = lambda f: f * mean - 0.5 * f * f * second
    v = [grow(single(f)) - lam * abs(single(f) - f) for f in grid]
    for _ in range(horizon - 1):
        v = [max(grow(h) - lam * abs(h - f) + x for h, x in zip(grid, v, strict=True)) for f in grid]
    now = grid[int(min(max(np.floor((current + cap) / (2 * cap) * 40 + 0.5), 0), 40))]
    return max((grow(h) - lam * abs(h - now) + x, h) for h, x in zip(grid, v, strict=True))[1]


@pytest.mark.parametrize("horizon", [1, 2, 5])
def test_dp_fraction(spark, horizon):
    rows = [(m, s, c) for m in (-0.02, 0.0, 0.0004, 0.003, 0.01) for s in (0.01, 0.05, 0.2) for c in (-0.5, -0.1, 0.0, 0.22)]
    df = spark.createDataFrame(rows, "mean double, std double, current double")
    got = df.withColumn("f", sizing.dp_fraction(F.col("mean"), F.col("std"), F.col("current"), horizon)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.f == pytest.approx(brute(r["mean"], r["std"], r["current"], horizon), abs=1e-12)


def test_dp_decisions_scale(spark):
    rows = [(0, f"a{i}", 0.8, 0.1, 0.02, 0.05, 0.7, "trending", 0.0) for i in range(10)] + [(0, "weak", 0.8, 0.1, 0.02, 0.05, 0.55, "mixed", 0.0), (0, "flat", 0.4, 0.4, 0.02, 0.05, 0.9, "mixed", 0.0)]
    df = spark.createDataFrame(rows, "open_time long, asset string, p_up double, p_down double, mean double, std double, confidence double, regime string, current double")
    got = sizing.dp_decisions(df, 3, 1000.0).collect()
    assert len(got) == 10 and sum(r.fraction for r in got) == pytest.approx(1.8) and all(r.direction == "LONG" and r.leverage == 1.0 for r in got)
    assert sizing.dp_decisions(df, 3, 0.5).count() == 0


def test_intents(spark, tmp_path):
    legs = spark.createDataFrame([(7, "X", "LONG", 0.1, 2.0, 90.0, 120.0, 100.0, 0.01, 0.7, "mixed"), (7, "Y", "SHORT", 0.2, 1.0, 11.0, 8.0, 10.0, 0.02, 0.6, "mixed")], "open_time long, asset string, direction string, fraction double, leverage double, stop double, target double, entry double, elg double, confidence double, regime string")
    sigs = orders.leg_signals(legs, 1000.0)
    by = {r.asset: r for r in sigs.collect()}
    assert by["X"].p_up == 0.7 and by["X"].edge == 0.7 and by["Y"].p_down == 0.6 and by["Y"].edge == -0.6
    got = {(r.asset, r.kind): r for r in orders.brackets(sigs).collect()}
    assert len(got) == 6 and got["X", "entry"].contracts == pytest.approx(2.0) and got["X", "entry"].is_buy and got["X", "entry"].tif == "gtc"
    assert got["X", "stop_loss"].limit_px == 90.0 and not got["X", "stop_loss"].is_buy and got["Y", "take_profit"].is_buy and got["Y", "take_profit"].trigger == "limit"
    orders.write_intents(orders.brackets(sigs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    assert orders.as_json(orders.brackets(sigs)).count() == 6


def test_closes_and_cancels(spark):
    held = spark.createDataFrame([("s", "X", "LONG", 100.0, 50.0, 2.0, 5, None), ("t", "Y", "SHORT", 10.0, 50.0, 1.0, None, None), ("u", "Z", "LONG", 10.0, 50.0, 1.0, 1, 2)], "signal_id string, asset string, direction string, entry double, size_usd double, leverage double, stop_oid long, target_oid long")
    books = spark.createDataFrame([("X", [(99.0, 1.0)], [(101.0, 1.0)]), ("Y", [], [(11.0, 1.0)])], "asset string, bids array<struct<px double, sz double>>, asks array<struct<px double, sz double>>")
    got = {r.asset: (r.limit_px, r.is_buy) for r in orders.closes(held, books).collect()}
    assert got == {"X": (101.0, False), "Y": (pytest.approx(10.1), True), "Z": (pytest.approx(10.1), False)}
    assert sorted((r.asset, r.oid) for r in orders.cancels(held).collect()) == [("X", 5), ("Z", 1), ("Z", 2)]
    answers = spark.createDataFrame([([("error", None), ("filled", 4), ("resting", 5)],), ([],)], "a array<struct<kind string, oid long>>")
    assert [r.o for r in answers.select(orders.first_oid(F.col("a")).alias("o")).collect()] == [4, None]
    nav = orders.refresh_nav(spark.createDataFrame([("w", 5.0, 6.0), ("v", 5.0, 6.0)], "wallet string, nav double, peak_nav double"), spark.createDataFrame([("w", 9.0)], "wallet string, account_value double"))
    assert {r.wallet: (r.nav, r.peak_nav) for r in nav.collect()} == {"w": (9.0, 9.0), "v": (5.0, 6.0)}


def test_all_bars_equal_bars_of_each_width(spark):
    ticks = market.ticks(spark, "/root/testdata/sf0.001")
    every = market.all_bars(ticks)
    for name, width in market.INTERVALS.items():
        own = {(r.asset, r.open_time): (r.open, r.high, r.low, r.close, r.num_trades) for r in market.bars(ticks, width).collect()}
        got = {(r.asset, r.open_time): (r.open, r.high, r.low, r.close, r.num_trades) for r in every.where(F.col("interval") == name).collect()}
        assert own == got
