"""Streaming twins: tumbling bars with a watermark, and Kalman state kept by asset."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemark.operators.scans import LinearKalman


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """asset, open_time (ms), high, low, volume, num_trades of a stream (event_type, ts, value)."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    got = rows.groupBy(F.col("event_type").alias("asset"), F.window("ts", width).alias("w")).agg(F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("num_trades"))
    return got.select("asset", F.unix_millis("w.start").alias("open_time"), "high", "low", "volume", "num_trades")


def stream_kalman(prices: DataFrame) -> DataFrame:
    """asset, open_time, level, velocity for each row of a stream (asset, open_time, close); a batch's
    rows of an asset are taken in order of time, and the filter's state lives in the state store."""

    def run(key, parts, state):
        kf = LinearKalman()
        if state.exists:
            x0, x1, a, b, c = state.get
            kf.x, kf.p = (x0, x1), (a, b, c)
        pdf = pd.concat(list(parts)).sort_values("open_time")
        out = [kf.step(v) for v in pdf["close"].tolist()]
        state.update((*kf.x, *kf.p))
        yield pd.DataFrame({"asset": key[0], "open_time": pdf["open_time"].tolist(), "level": [x[0] for x in out], "velocity": [x[1] for x in out]})

    kept = "x0 double, x1 double, a double, b double, c double"
    return prices.select("asset", "open_time", "close").groupBy("asset").applyInPandasWithState(run, "asset string, open_time long, level double, velocity double", kept, "append", GroupStateTimeout.NoTimeout)
