"""Bars, trades, books and funding, derived from the events, orders and lineitem tables.

Times are BIGINT epoch milliseconds. Each table is a projection or one aggregation by its key, so
filters on asset and time reach the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HOUR = 3_600_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, ms, event_id, value, is_buy."""
    ms = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), ms.alias("ms"), "event_id", "value", (F.col("event_id") % 2 == 0).alias("is_buy"))


def bars(ticks: DataFrame, width_ms: int = HOUR) -> DataFrame:
    """asset, open_time, open, high, low, close, volume, num_trades; bars that close at 0 are dropped."""
    t = F.col("ms") - F.col("ms") % width_ms
    order = F.struct("ms", "event_id")
    out = ticks.groupBy("asset", t.alias("open_time")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.sum("value").alias("volume"), F.count(F.lit(1)).alias("num_trades"),
    )
    return out.where("close > 0")


#: Widths of the bars that are kept, in milliseconds.
INTERVALS = {"1m": 60_000, "5m": 300_000, "1h": HOUR, "1d": 86_400_000}


def all_bars(ticks: DataFrame) -> DataFrame:
    """Bars of all INTERVALS, with interval: ticks are aggregated once, to minutes, and the wider
    bars are made from those. Bars that close at 0 are dropped at each width."""
    order = F.struct("ms", "event_id")
    minute = ticks.groupBy("asset", (F.col("ms") - F.col("ms") % INTERVALS["1m"]).alias("minute")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.sum("value").alias("volume"), F.count(F.lit(1)).alias("num_trades"),
    )
    widths = F.explode(F.array(*(F.struct(F.lit(n).alias("interval"), F.lit(w).cast("long").alias("width")) for n, w in INTERVALS.items())))
    rows = minute.withColumn("i", widths)
    out = rows.groupBy("asset", F.col("i.interval").alias("interval"), (F.col("minute") - F.col("minute") % F.col("i.width")).alias("open_time")).agg(
        F.min_by("open", "minute").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "minute").alias("close"),
        F.sum("volume").alias("volume"), F.sum("num_trades").alias("num_trades"),
    )
    return out.where("close > 0")


def recent(df: DataFrame, time: str, width_ms: int) -> DataFrame:
    """The rows of df from width_ms before its latest time on."""
    return df.where(F.col(time) >= df.agg(F.max(time)).scalar() - width_ms)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset, day (days since 1970), close: from orders."""
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("asset"), day.alias("day"), "o_orderkey", "o_totalprice")
    return rows.groupBy("asset", "day").agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


def books(spark: SparkSession, sf_dir: str, levels: int = 10) -> DataFrame:
    """asset, bids, asks: arrays of (px, sz), best first; the levels nearest to the median price."""
    px = F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("asset"), px.alias("px"), F.col("l_quantity").alias("sz"))
    rows = rows.groupBy("asset", "px").agg(F.sum("sz").alias("sz"))
    mid = rows.groupBy("asset").agg(F.percentile("px", 0.5).alias("mid"))
    sided = rows.join(F.broadcast(mid), "asset").withColumn("ask", F.col("px") > F.col("mid"))
    near = Window.partitionBy("asset", "ask").orderBy(F.abs(F.col("px") - F.col("mid")), "px")
    top = sided.where("px != mid").withColumn("n", F.row_number().over(near)).where(F.col("n") <= levels)
    level = F.struct("n", F.struct("px", "sz").alias("l"))
    sorted_side = lambda flag: F.transform(F.array_sort(F.collect_list(F.when(flag, level))), lambda x: x["l"])
    return top.groupBy("asset").agg(sorted_side(~F.col("ask")).alias("bids"), sorted_side(F.col("ask")).alias("asks"))
