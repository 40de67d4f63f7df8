"""Operators on closed-form series."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.columns import entropy_confidence, normal_cdf
from tidemark.operators import backtest, scans, signals, windows


def series(spark, values, asset="A"):
    return spark.createDataFrame([(asset, i * 300_000, float(v), 1.0) for i, v in enumerate(values)], "asset string, open_time long, close double, volume double")


def test_dual_kalman_reverts_and_trends():
    p, kf = 100.0, scans.DualKalman()
    for i in range(200):
        p += 0.3 * (100 - p) + 0.5 * math.sin(0.7 * i)
        level, _, _, kappa, *_ = kf.step(p)
    assert abs(level - 100) < 5 and kappa > 0
    kf = scans.DualKalman()
    for i in range(200):
        _, velocity, *_ = kf.step(100 + 0.05 * i)
    assert velocity > 0


def test_spectrum(spark):
    feats = lambda v: windows.spectral_features(windows.spectrum(series(spark, v))).collect()[-1]
    assert abs(feats([100 + 2 * math.sin(2 * math.pi * i / 16) for i in range(64)]).dominant_period - 16) <= 8
    assert feats([100 + sum(math.sin(a * i) for a in (0.123, 0.456, 0.789, 1.234)) for i in range(64)]).spectral_entropy > 0.5
    assert feats([100 + 0.1 * i for i in range(64)]).noise_trend_ratio < 1
    assert windows.spectrum(series(spark, range(1, 64))).count() == 0


def test_ewma_of_constant_returns(spark):
    df = series(spark, [1] * 50).withColumn("ret", F.lit(0.01))
    assert all(abs(r.vol - 0.01) < 1e-12 for r in windows.fold_ewma(df).collect())


def test_columns(spark):
    rows = spark.createDataFrame([(x / 10,) for x in range(-40, 41)], "x double").select("x", normal_cdf(F.col("x")).alias("p")).collect()
    assert all(abs(r.p - 0.5 * (1 + math.erf(r.x / math.sqrt(2)))) < 2e-7 for r in rows)
    got = spark.range(1).select(entropy_confidence(F.lit(1 / 3), F.lit(1 / 3)).alias("a"), entropy_confidence(F.lit(1.0), F.lit(0.0)).alias("b")).first()
    assert abs(got.a) < 1e-9 and got.b > 0.99


def sources(spark, rows):
    return spark.createDataFrame([("A", 0, *r) for r in rows], "asset string, open_time long, source string, p_up double, p_down double, mean double, std double, log_evidence double")


def test_fusion(spark):
    both = signals.fuse(sources(spark, [("a", 0.6, 0.2, 0.4, 0.01, -1.0), ("b", 0.4, 0.4, 0.0, 0.01, -2.0)])).first()
    assert 0.4 < both.p_up < 0.6 and both.top_weight > 0.5
    assert abs(signals.fuse(sources(spark, [("a", 0.7, 0.1, 0.6, 0.01, -0.5)])).first().p_up - 0.7) < 0.01


def cands(spark, rows):
    return spark.createDataFrame([(t, a, float(f), float(e), float(c), 0.01, 100.0, "mixed") for t, a, f, e, c in rows], "open_time long, asset string, f double, elg double, cost_bps double, std double, close double, regime string")


def test_best_subset_against_all_subsets(spark):
    import itertools
    import random

    rnd = random.Random(1)
    rows = [(t, f"a{i:02d}", rnd.uniform(-0.3, 0.3), rnd.uniform(0, 0.01), rnd.uniform(1, 15)) for t in range(20) for i in range(rnd.randint(1, 12))]
    got = {}
    for r in signals.best_subset(cands(spark, rows)).collect():
        got.setdefault(r.open_time, set()).add(r.asset)
    for t in range(20):
        own = sorted(r for r in rows if r[0] == t)
        net = lambda r: r[3] - r[4] * 1e-4
        if len(own) <= 10:
            sets = [s for k in (1, 2, 3) for s in itertools.combinations(own, k) if sum(r[4] for r in s) <= 25]
            best = max(sets, key=lambda s: sum(map(net, s)))
            want = {r[1] for r in best}
        else:
            want, spent = set(), 0.0
            for r in sorted(own, key=lambda r: -net(r))[:3]:
                if spent + r[4] <= 25:
                    want.add(r[1])
                    spent += r[4]
        assert got.get(t, set()) == want


def test_exposure_is_capped(spark):
    legs = signals.legs(cands(spark, [(0, f"a{i}", 0.9, 0.01, 1) for i in range(5)]), cap=0.9).collect()
    assert sum(r.fraction for r in legs) <= 1.8 + 1e-9 and all(r.direction == "LONG" and r.stop < 100 < r.target for r in legs)


def test_kill_switch(spark):
    rows = [(0.25, 2.0, 0.01, -1.0), (0.09, 2.0, 0.01, -1.0), (0.03, 1.5, 0.01, -1.0)]
    got = signals.kill_switch(spark.createDataFrame(rows, "drawdown double, gross_leverage double, vol double, log_predictive double"))
    assert [r.action for r in got.orderBy(F.desc("drawdown")).collect()] == ["close_all", "halt", None]


def test_execution(spark):
    rows = [(1_000_000, 990_000, 1e6), (1_000_000, 999_900, 1e7)]
    df = spark.createDataFrame(rows, "now_ms long, made_ms long, depth double").withColumns({"size": F.lit(1000.0), "leverage": F.lit(1.0), "adv": F.lit(1e8), "spread": F.lit(1e-4), "edge": F.lit(0.5)})
    stale, deep = signals.execution(df).orderBy("made_ms").collect()
    assert stale.reason == "stale" and not stale.executable
    assert deep.fill > 0.7 and deep.cost < 0.01 and deep.executable


def test_as_of(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1), ("a", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1.0), ("a", 7, 2.0), ("b", 2, 3.0)], "k string, at long, v double")
    got = {(r.k, r.t): r.v for r in windows.as_of(left, right, "k", "t", "at", ["v"]).collect()}
    assert got == {("a", 5): 1.0, ("a", 10): 2.0, ("b", 1): None, ("a", 1): None}


def test_fits():
    rnd = np.random.default_rng(3)
    t = scans.student_t(rnd.standard_t(5, 4000) * 0.02)
    assert 3.5 < t["nu"] < 8 and abs(t["scale"] - 0.02) < 0.003
    c = scans.cauchy(rnd.standard_cauchy(4000) * 0.5 + 1)
    assert abs(c["location"] - 1) < 0.1 and abs(c["scale"] - 0.5) < 0.06
    g = scans.garch(rnd.normal(0, 0.01, 400))
    assert g["alpha"] + g["beta"] < 1 and g["omega"] > 0
    obs = np.concatenate([rnd.normal(0, 1, (100, 2)), rnd.normal(8, 1, (100, 2))])
    model = scans.hmm(obs, states=2)
    path = scans.viterbi(obs, *model[:4])
    assert len(set(path[:100])) == 1 and len(set(path[100:])) == 1 and path[0] != path[-1]
    x = rnd.uniform(0, 1, (200, 2))
    y = (x[:, 0] > 0.5).astype(float)
    assert np.abs(scans.boosted_values(scans.boosted(x, y, rounds=60), x) - y).mean() < 0.05


def test_backtest(spark):
    rows = []
    for a, drift in (("BTC", 1e-4), ("ETH", 8e-5)):
        p = 100.0
        for i in range(350):
            p *= 1 + drift + 0.001 * math.sin(0.1 * i)
            rows.append((a, i * 300_000, p))
    bars = spark.createDataFrame(rows, "asset string, open_time long, close double")
    got = backtest.metrics(backtest.book(backtest.signals(backtest.folds(bars, 100, 50)))).collect()
    assert len(got) == 2 and all(r.n_bars == 50 and 0 <= r.max_drawdown < 1 for r in got)


def test_stream_equals_batch(spark, tmp_path):
    from tidemark.streaming.live import stream_kalman

    rnd = np.random.default_rng(1)
    for k in range(3):
        pdf = pd.DataFrame([(a, k * 20 + i, float(rnd.normal())) for a in "AB" for i in range(20)], columns=["asset", "open_time", "close"])
        spark.createDataFrame(pdf).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("asset string, open_time long, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_kalman(src).writeStream.format("memory").queryName("kf").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.asset, r.open_time): r.level for r in spark.table("kf").collect()}
    assert len(got) == 120
    batch = {(r.asset, r.open_time): r.level for r in scans.linear_kalman(spark.read.parquet(str(tmp_path / "in"))).collect()}
    assert batch.keys() == got.keys()
    assert all(got[k] == pytest.approx(batch[k]) for k in got)


def test_discrete_wins_on_two_peaks(spark, monkeypatch):
    import numpy as np

    from tidemark.plans import catalog

    rnd = np.random.default_rng(2)
    r = np.concatenate([rnd.normal(-1, 0.05, 300), rnd.normal(1, 0.05, 300)])
    rows = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(r)], "asset string, open_time long, ret double")
    monkeypatch.setattr(catalog, "_returns", lambda *_: rows)
    got = catalog.QUERIES["return_dist_best"](spark, "").collect()
    assert [x.name for x in got] == ["discrete"]


def test_ema_is_the_plain_recursion(spark):
    import random

    from tidemark.operators.windows import ema

    rnd = random.Random(2)
    rows = [(k, t, rnd.uniform(-5, 0)) for k in ("a", "b") for t in range(1500 if k == "a" else 40)]
    for decay in (0.5, 0.99):
        got = {(r.k, r.open_time): r.e for r in ema(spark.createDataFrame(rows, "k string, open_time long, v double"), "v", ["k"], decay, "e").collect()}
        now = {"a": 0.0, "b": 0.0}
        for k, t, v in rows:
            now[k] = decay * now[k] + (1 - decay) * v
            assert abs(got[k, t] - now[k]) < 1e-9


def test_better_evidence_gets_more_weight(spark):
    # fixed values: twenty-one ticks of two sources
    rows = [("x", t, s, *v) for t in range(21) for s, *v in (("good", 0.8, 0.1, 0.7, 0.01, -0.1), ("bad", 0.5, 0.4, 0.1, 0.01, -5.0))]
    df = spark.createDataFrame(rows, "asset string, open_time long, source string, p_up double, p_down double, mean double, std double, log_evidence double")
    got = {r.open_time: r for r in signals.fuse(df, floor=0.0, decay=0.5, sources=2).collect()}
    good, bad = 0.0, 0.0
    for t in range(21):
        good, bad = 0.5 * good - 0.05, 0.5 * bad - 2.5
        w = math.exp(good) / (math.exp(good) + math.exp(bad))
        assert abs(got[t].top_weight - w) < 1e-9 and abs(got[t].p_up - (w * 0.8 + (1 - w) * 0.5)) < 1e-9
        mean = w * 0.7 + (1 - w) * 0.1
        assert abs(got[t].std - math.sqrt(1e-4 + w * (0.7 - mean) ** 2 + (1 - w) * (0.1 - mean) ** 2)) < 1e-9
    assert got[20].top_weight > 0.5
