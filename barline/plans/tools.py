"""Ready-made questions: functions that answer with a small DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators import indicators, metrics
from barline.plans import factors, simulate
from barline.plans.pipeline import Pipeline, last_date_top, run_pipeline
from barline.plans.strategy import Strategy


def bars_summary(panel: DataFrame) -> DataFrame:
    """Rows, first and last time, lowest and highest price of each symbol."""
    return panel.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"))


class EmaCross(Strategy):
    """Buys when the fast recursive mean rises above the slow one; sells when it falls below."""

    def __init__(self, fast: int = 10, slow: int = 20, **settings):
        super().__init__(**settings)
        self.fast, self.slow = fast, slow

    def prepare(self, panel: DataFrame) -> DataFrame:
        df = indicators.ema(indicators.ema(panel, self.fast, result="fast"), self.slow, result="slow")
        return indicators.crossunder(indicators.crossover(df, "fast", "slow", "up"), "fast", "slow", "down")

    def buy(self):
        return F.col("up")

    def sell(self):
        return F.col("down")


def ema_backtest(panel: DataFrame, fast: int = 10, slow: int = 20, capital: float = 100_000.0) -> DataFrame:
    """The portfolio simulator's summary of an EMA cross."""
    return simulate.summary(simulate.backtest(EmaCross(fast, slow), panel, capital), capital)


def rank_symbols(panel: DataFrame, window: int = 5, n: int = 5, descending: bool = False) -> DataFrame:
    """The n symbols ranked first by return at the last time (the weakest first, unless descending)."""
    ret = factors.returns(window)
    chosen = -ret if descending else ret

    class Ranking(Pipeline):
        latest = factors.latest("close")
        returns = ret
        rank = chosen.rank()

    return last_date_top(run_pipeline(panel, Ranking).where("rank IS NOT NULL"), "rank", n)


def key_metrics(equity: DataFrame) -> DataFrame:
    return metrics.equity_metrics(equity).select("run_id", "total_return", "cagr", "annualized_volatility", "sharpe_ratio", "max_drawdown")


def last_signal(panel: DataFrame, fast: int = 5, slow: int = 10) -> DataFrame:
    """BUY, SELL or HOLD of each symbol by the cross of its last two bars; symbols with fewer than slow bars
    are left out."""
    df = indicators.sma(indicators.sma(panel, fast, result="fast"), slow, result="slow")
    df = indicators.crossunder(indicators.crossover(df, "fast", "slow", "up"), "fast", "slow", "down")
    last = df.groupBy("symbol").agg(F.max_by(F.struct("datetime", "close", "fast", "slow", "up", "down"), "datetime").alias("b")).select("symbol", "b.*")
    signal = F.when(F.col("up"), "BUY").when(F.col("down"), "SELL").otherwise("HOLD")
    return last.where("slow IS NOT NULL").select("symbol", "datetime", signal.alias("signal"), "fast", "slow", F.col("close").alias("price"))
