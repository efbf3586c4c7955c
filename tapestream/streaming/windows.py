"""Trade windows over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trade_bars(trades: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Volumes, count and imbalance per instrument and event-time window; rows later than ``late`` are dropped.

    trades: inst, ts, price, qty, side.  The watermark bounds the state that is kept.
    """
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    side, qty = F.col("side"), F.col("qty")
    out = trades.withWatermark("ts", late).groupBy(window.alias("w"), "inst").agg(
        F.sum(F.when(side == "buy", qty).otherwise(0)).alias("buy_volume"), F.sum(F.when(side == "sell", qty).otherwise(0)).alias("sell_volume"), F.count("*").alias("trade_count")
    )
    imbalance = F.try_divide((F.col("buy_volume") - F.col("sell_volume")).cast("double"), (F.col("buy_volume") + F.col("sell_volume")).cast("double"))
    return out.select("inst", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "buy_volume", "sell_volume", "trade_count", imbalance.alias("imbalance"))
