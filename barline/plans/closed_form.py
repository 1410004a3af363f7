"""Signal-only long/flat backtests as window expressions: no Python, any number of runs and symbols.

With one symbol per run, all capital in or out and exclusive buy and sell signals, the position is the last
signal so far, and equity is the product of the returns of the bars that were entered long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import cumulative, ratio
from barline.plans.strategy import MovingAverageCross


def _key(df: DataFrame) -> Window:
    keys = ["run_id", "symbol"] if "run_id" in df.columns else ["symbol"]
    return Window.partitionBy(*keys).orderBy("datetime")


def positions(signals: DataFrame) -> DataFrame:
    """Adds position: 1 from a buy until a sell, as known at the bar's close."""
    mark = F.when(F.col("buy"), 1).when(F.col("sell"), 0)
    return signals.withColumn("position", F.coalesce(F.last(mark, ignorenulls=True).over(cumulative(_key(signals))), F.lit(0)))


def equity_curve(signals: DataFrame, capital: float = 100_000.0, cost: float = 0.0) -> DataFrame:
    """Adds total_equity and position_value; each change of position costs the share `cost` of the equity."""
    df = positions(signals)
    w = _key(df)
    held = F.coalesce(F.lag("position").over(w), F.lit(0))
    change = F.when(held == 1, ratio(F.col("close"), F.lag("close").over(w))).otherwise(1.0)
    paid = F.when(F.col("position") != held, F.lit(1.0 - cost)).otherwise(1.0)
    df = df.withColumn("_step", F.ln(change * paid))
    df = df.withColumn("total_equity", capital * F.exp(F.sum("_step").over(cumulative(_key(df))))).drop("_step")
    return df.withColumn("position_value", F.when(F.col("position") == 1, F.col("total_equity")).otherwise(0.0))


def trades(signals: DataFrame, run: str = "symbol") -> DataFrame:
    """The changes of position as BUY and SELL rows at the close: price, pnl per unit (of a SELL)."""
    df = positions(signals)
    w = _key(df)
    before = F.coalesce(F.lag("position").over(w), F.lit(0))
    df = df.withColumn("side", F.when(F.col("position") > before, "BUY").when(F.col("position") < before, "SELL"))
    entry = F.last(F.when(F.col("side") == "BUY", F.col("close")), ignorenulls=True).over(cumulative(w))
    df = df.withColumn("_entry", entry).where("side IS NOT NULL")
    pnl = F.when(F.col("side") == "SELL", F.col("close") - F.col("_entry")).otherwise(0.0)
    return df.select(F.col(run).alias("run_id"), "datetime", "symbol", "side", F.col("close").alias("price"), F.lit(1.0).alias("quantity"), F.lit(0.0).alias("fee"), pnl.alias("pnl"), F.lit("signal").alias("reason"))


def moving_average_cross(panel: DataFrame, fast: int = 5, slow: int = 20, capital: float = 100_000.0) -> DataFrame:
    """The panel with signals, position and equity of a moving-average cross, symbol by symbol."""
    return equity_curve(MovingAverageCross(fast, slow).signals(panel), capital)
