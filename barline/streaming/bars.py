"""Bars from a stream of ticks: event-time windows under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bar_stream(ticks: DataFrame, symbol: str, time: str, price: str, every: str = "1 day", late: str = "1 hour", tie: str | None = None) -> DataFrame:
    """OHLCV bars by symbol and tumbling window of `every`. In append mode a bar comes once its window is
    closed by the watermark (`late` behind the newest tick); later ticks of it are dropped. State is one row
    for each open window and symbol. The event time must be a TIMESTAMP, to which it is cast once."""
    timed = ticks.select(F.col(symbol).alias("symbol"), F.col(time).cast("timestamp").alias("at"), F.col(price).cast("double").alias("price"), *([F.col(tie).alias("tie")] if tie else []))
    if timed.isStreaming:
        timed = timed.withWatermark("at", late)
    key = F.struct("at", "tie") if tie else F.col("at")
    bars = timed.groupBy(F.window("at", every), "symbol").agg(
        F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"), F.count("*").alias("volume")
    )
    return bars.select("symbol", F.col("window.start").alias("datetime"), "open", "high", "low", "close", "volume")
