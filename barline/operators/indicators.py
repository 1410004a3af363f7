"""Indicators: each adds columns to a panel (symbol, datetime, prices) and keeps all others.

Windows are by symbol in time order; equal windows of one call share a shuffle and a sort. Rolling
figures are null until the window is full. Division by zero gives null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.ewm import Mean, span_alpha, with_means
from barline.functions.windows import by_symbol, full, ratio, rolling


def sma(df: DataFrame, period: int, column: str = "close", result: str | None = None) -> DataFrame:
    x, w = F.col(column), rolling(period)
    return df.withColumn(result or f"sma_{period}", full(x, F.avg(x).over(w), period, w))


def ema(df: DataFrame, period: int, column: str = "close", result: str | None = None) -> DataFrame:
    """Recursive (not adjusted): starts with the first value, alpha = 2 / (period + 1)."""
    return with_means(df, {result or f"ema_{period}": Mean(column, span_alpha(period))})


def rsi(df: DataFrame, period: int = 14, column: str = "close", result: str | None = None) -> DataFrame:
    """Wilder's: means with alpha = 1 / period of gains and losses; the first row has neither; a mean loss of
    zero gives 100."""
    w = by_symbol()
    change = F.col(column) - F.lag(column).over(w)
    df = df.withColumn("_gain", F.when(change > 0, change).otherwise(0.0)).withColumn("_loss", F.when(change < 0, -change).otherwise(0.0))
    df = with_means(df, {"_up": Mean("_gain", 1.0 / period), "_down": Mean("_loss", 1.0 / period)})
    value = F.when(F.col("_down") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio(F.col("_up"), F.col("_down"))))
    return df.withColumn(result or f"rsi_{period}", value).drop("_gain", "_loss", "_up", "_down")


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close") -> DataFrame:
    """macd, macd_signal and macd_hist."""
    df = with_means(df, {"_fast": Mean(column, span_alpha(fast)), "_slow": Mean(column, span_alpha(slow))})
    df = df.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    df = with_means(df, {"macd_signal": Mean("macd", span_alpha(signal))})
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))


def bollinger_bands(df: DataFrame, period: int = 20, std_dev: float = 2.0, column: str = "close") -> DataFrame:
    """bb_middle, bb_upper and bb_lower: the mean and std_dev sample deviations around it."""
    x, w = F.col(column), rolling(period)
    middle, around = F.avg(x).over(w), F.stddev_samp(x).over(w) * std_dev
    return df.select("*", full(x, middle, period, w).alias("bb_middle"), full(x, middle + around, period, w).alias("bb_upper"), full(x, middle - around, period, w).alias("bb_lower"))


def atr(df: DataFrame, period: int = 14, result: str | None = None) -> DataFrame:
    """Wilder's mean of the true range; the first row's range is high - low."""
    w = by_symbol()
    before = F.lag("close").over(w)
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    df = df.withColumn("_range", true_range)
    return with_means(df, {result or f"atr_{period}": Mean("_range", 1.0 / period)}).drop("_range")


def returns(df: DataFrame, period: int = 1, column: str = "close", result: str | None = None) -> DataFrame:
    return df.withColumn(result or f"returns_{period}", ratio(F.col(column), F.lag(column, period).over(by_symbol())) - 1.0)


def volatility(df: DataFrame, period: int = 20, column: str = "close", result: str | None = None) -> DataFrame:
    """Sample deviation of the one-bar returns of the last `period` bars."""
    r, w = F.col("_return"), rolling(period)
    return returns(df, 1, column, "_return").withColumn(result or f"volatility_{period}", full(r, F.stddev_samp(r).over(w), period, w)).drop("_return")


def _cross(df: DataFrame, a: str, b: str, up: bool, result: str) -> DataFrame:
    w = by_symbol()
    x, y, u, v = F.col(a), F.col(b), F.lag(a).over(w), F.lag(b).over(w)
    hit = (x > y) & (u <= v) if up else (x < y) & (u >= v)
    return df.withColumn(result, F.coalesce(hit, F.lit(False)))


def crossover(df: DataFrame, a: str, b: str, result: str = "crossover") -> DataFrame:
    """a rises above b on this bar; unknown is false."""
    return _cross(df, a, b, True, result)


def crossunder(df: DataFrame, a: str, b: str, result: str = "crossunder") -> DataFrame:
    return _cross(df, a, b, False, result)


def liquidity(df: DataFrame, period: int = 20, result: str = "adtv") -> DataFrame:
    """Average traded value: the rolling mean of close * volume."""
    x, w = F.col("close") * F.col("volume"), rolling(period)
    return df.withColumn(result, full(x, F.avg(x).over(w), period, w))
