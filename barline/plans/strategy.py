"""Strategies: subclasses give signals as Columns of a prepared panel; rules and costs are class attributes."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.operators import indicators
from barline.operators.costs import TradingCost
from barline.plans.rules import Cooldown, Exit, PositionSize, Scaling
from barline.schema import Interval, StrategyError, TimeUnit

SIGNALS = ("buy", "sell", "scale_in", "scale_out")
_SETTINGS = ("algorithm_id", "strategy_id", "time_unit", "every", "market", "product_type", "long_only", "symbols", "intervals", "position_sizes", "stop_losses", "take_profits", "scaling_rules", "cooldowns", "trading_costs", "metadata")


class Strategy:
    """Settings may be given to the class or to an instance. Override buy and sell, and prepare to add the
    columns that they use; scale_in is buy unless overridden, scale_out never."""

    algorithm_id: str | None = None
    strategy_id: str | None = None
    time_unit: TimeUnit | str = TimeUnit.DAY
    every: int = 1
    market: str = "NSE"
    product_type: str = "CNC"
    long_only: bool = True
    symbols: tuple[str, ...] = ()
    intervals: tuple[str, ...] = ()
    position_sizes: tuple[PositionSize, ...] = ()
    stop_losses: tuple[Exit, ...] = ()
    take_profits: tuple[Exit, ...] = ()
    scaling_rules: tuple[Scaling, ...] = ()
    cooldowns: tuple[Cooldown, ...] = ()
    trading_costs: tuple[TradingCost, ...] = ()
    metadata: dict[str, Any] = {}

    def __init__(self, **settings: Any):
        unknown = set(settings) - set(_SETTINGS)
        if unknown:
            raise StrategyError(f"no such setting: {sorted(unknown)}")
        for name, value in settings.items():
            setattr(self, name, value)
        self.strategy_id = self.strategy_id or type(self).__name__
        self.time_unit = TimeUnit.of(self.time_unit)
        smallest = min((Interval.of(x).minutes for x in self.intervals), default=0)
        if self.time_unit.minutes * self.every < smallest:
            raise StrategyError("the schedule is finer than the smallest data interval")

    def prepare(self, panel: DataFrame) -> DataFrame:
        return panel

    def buy(self) -> Column:
        raise NotImplementedError

    def sell(self) -> Column:
        raise NotImplementedError

    def scale_in(self) -> Column:
        return self.buy()

    def scale_out(self) -> Column:
        return F.lit(False)

    def signals(self, panel: DataFrame) -> DataFrame:
        """The panel with the four signal columns; unknown is false."""
        df = self.prepare(panel)
        return df.withColumns({name: F.coalesce(getattr(self, name)().cast("boolean"), F.lit(False)) for name in SIGNALS})

    def parameters(self) -> dict[str, str]:
        """Simple settings of the instance, as text."""
        values = {k: v for k, v in vars(self).items() if isinstance(v, (str, int, float, bool))}
        return {k: str(v) for k, v in {**values, "time_unit": TimeUnit.of(self.time_unit).value}.items()}


class MovingAverageCross(Strategy):
    """Buys when the fast mean rises above the slow one and sells when it falls below."""

    def __init__(self, fast: int = 5, slow: int = 20, **settings: Any):
        super().__init__(**settings)
        self.fast, self.slow = fast, slow

    def prepare(self, panel: DataFrame) -> DataFrame:
        df = indicators.sma(indicators.sma(panel, self.fast, result="fast"), self.slow, result="slow")
        return indicators.crossunder(indicators.crossover(df, "fast", "slow", "up"), "fast", "slow", "down")

    def buy(self) -> Column:
        return F.col("up")

    def sell(self) -> Column:
        return F.col("down")


class PipelineStrategy(Strategy):
    """Buys what a pipeline ranks within top_n and sells all else."""

    def __init__(self, pipeline, rank_column: str, top_n: int = 1, descending: bool = False, **settings: Any):
        super().__init__(**settings)
        self.pipeline, self.rank_column, self.top_n, self.descending = pipeline, rank_column, top_n, descending

    def prepare(self, panel: DataFrame) -> DataFrame:
        from barline.plans.pipeline import rank_signals, run_pipeline

        out = rank_signals(panel, run_pipeline(panel, self.pipeline), self.rank_column, self.top_n, self.descending)
        return out.withColumnsRenamed({"buy": "ranked_in", "sell": "ranked_out"})

    def buy(self) -> Column:
        return F.col("ranked_in")

    def sell(self) -> Column:
        return F.col("ranked_out")
