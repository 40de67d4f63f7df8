"""Order intents as rows: what would be sent, with ids that a second run gives again.

A signal becomes an entry and its two brackets in one projection. Sinks append the rows; a stream
writes them once through its checkpoint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def leg_signals(legs: DataFrame, nav: float) -> DataFrame:
    """legs (see signals.legs) as signals, with their id, size in USD, edge and probabilities."""
    c, long = F.col, F.col("direction") == "LONG"
    return legs.select(
        F.sha2(F.concat_ws("/", "asset", c("open_time").cast("string")), 256).alias("signal_id"), c("open_time").alias("generated_at_ms"), "asset", "direction", "entry", "stop", "target", "leverage",
        (c("fraction") * nav).alias("size_usd"), c("elg").alias("expected_value"), "confidence", F.when(long, c("confidence")).otherwise(-c("confidence")).alias("edge"),
        F.when(long, c("confidence")).otherwise(1 - c("confidence")).alias("p_up"), F.when(long, 1 - c("confidence")).otherwise(c("confidence")).alias("p_down"), "regime",
    )


def contracts() -> Column:
    return F.col("size_usd") * F.col("leverage") / F.col("entry")


def brackets(signals: DataFrame) -> DataFrame:
    """Three intents for each signal: a good-till-cancelled entry, a stop that triggers a market
    order and a target that triggers a limit order; the last two only reduce."""
    long = F.col("direction") == "LONG"

    def intent(kind, buy, price, reduces, tif, trigger):
        cells = (F.lit(kind).alias("kind"), buy.alias("is_buy"), F.col(price).alias("limit_px"), F.lit(reduces).alias("reduce_only"), F.lit(tif).cast("string").alias("tif"), F.lit(trigger).cast("string").alias("trigger"))
        return F.struct(*cells)

    kinds = F.array(
        intent("entry", long, "entry", False, "gtc", None), intent("stop_loss", ~long, "stop", True, None, "market"), intent("take_profit", ~long, "target", True, None, "limit"),
    )
    rows = signals.select("signal_id", "asset", contracts().alias("contracts"), F.explode(kinds).alias("o"))
    return rows.select("signal_id", "asset", "o.kind", "o.is_buy", "o.limit_px", "contracts", "o.reduce_only", "o.tif", "o.trigger")


def closes(positions: DataFrame, books: DataFrame) -> DataFrame:
    """An immediate-or-cancel intent that closes each of positions (signal_id, asset, direction,
    entry, size_usd, leverage), priced at the book's ask for a long and its bid for a short, or at
    the entry plus 1 % without one. books has one row an asset."""
    long = F.col("direction") == "LONG"
    # an empty side gives null, and an asset without a book too
    best = lambda side: F.try_element_at(side, F.lit(1))["px"]
    px = F.when(long, best(F.col("asks"))).otherwise(best(F.col("bids")))
    rows = positions.join(books.select("asset", "bids", "asks"), "asset", "left")
    return rows.select(
        "signal_id", "asset", F.lit("close").alias("kind"), (~long).alias("is_buy"), F.coalesce(px, F.col("entry") * 1.01).alias("limit_px"), contracts().alias("contracts"),
        F.lit(True).alias("reduce_only"), F.lit("ioc").alias("tif"), F.lit(None).cast("string").alias("trigger"),
    )


def cancels(positions: DataFrame) -> DataFrame:
    """asset, oid: the bracket orders (stop_oid, target_oid) of positions that are there."""
    rows = positions.select("asset", F.explode(F.array("stop_oid", "target_oid")).alias("oid"))
    return rows.where("oid is not null")


def first_oid(statuses: Column) -> Column:
    """The id of the first answer that rests or was filled, of an array of (kind, oid); or null."""
    return F.try_element_at(F.filter(statuses, lambda s: s["kind"].isin("resting", "filled")), F.lit(1))["oid"]


def refresh_nav(portfolio: DataFrame, accounts: DataFrame) -> DataFrame:
    """portfolio (wallet, nav, peak_nav) with the account's value where it is known."""
    value = F.coalesce(F.col("account_value"), F.col("nav"))
    rows = portfolio.join(accounts.select("wallet", "account_value"), "wallet", "left")
    return rows.select("wallet", value.alias("nav"), F.greatest("peak_nav", value).alias("peak_nav"))


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_intents(intents: DataFrame, path: str) -> None:
    intents.write.mode("append").partitionBy("kind").parquet(path)


def stream_intents(intents: DataFrame, path: str, checkpoint: str):
    return intents.writeStream.format("parquet").partitionBy("kind").option("checkpointLocation", checkpoint).outputMode("append").start(path)
