"""Names and types: bar intervals, time units, order enums, table schemas, errors."""

from __future__ import annotations

from datetime import date, timedelta
from enum import Enum

from pyspark.sql import types as T


class BarlineError(Exception):
    """Base of the library's errors."""


class UnsupportedInterval(BarlineError):
    """A provider doesn't have the interval."""


class SymbolNotFound(BarlineError):
    """The instrument master doesn't have the symbol."""


class ProviderError(BarlineError):
    """A provider could not give the bars."""


class StrategyError(BarlineError):
    """A strategy contradicts itself or its data."""


class Interval(str, Enum):
    MINUTE_1 = "1minute"
    MINUTE_3 = "3minute"
    MINUTE_5 = "5minute"
    MINUTE_15 = "15minute"
    MINUTE_30 = "30minute"
    MINUTE_60 = "60minute"
    DAY = "day"
    WEEK = "week"
    MONTH = "month"

    @classmethod
    def of(cls, value: str | Interval) -> Interval:
        """By value or alias, in any case."""
        text = str(getattr(value, "value", value)).strip().lower()
        try:
            return cls(INTERVAL_ALIASES.get(text, text))
        except ValueError:
            raise UnsupportedInterval(text) from None

    @property
    def minutes(self) -> int:
        return INTERVAL_MINUTES[self.value]

    @property
    def is_intraday(self) -> bool:
        return self.minutes <= 60


# Other names of the intervals.
INTERVAL_ALIASES = {
    "1m": "1minute", "1min": "1minute", "3m": "3minute", "5m": "5minute", "15m": "15minute", "30m": "30minute",
    "30min": "30minute", "60m": "60minute", "1h": "60minute", "1d": "day", "daily": "day", "1w": "week",
    "weekly": "week", "1wk": "week", "1mo": "month", "monthly": "month",
}
# Minutes of the intervals; a month has 30 days.
INTERVAL_MINUTES = {"1minute": 1, "3minute": 3, "5minute": 5, "15minute": 15, "30minute": 30, "60minute": 60, "day": 1440, "week": 10080, "month": 43200}


class TimeUnit(str, Enum):
    MINUTE = "MINUTE"
    HOUR = "HOUR"
    DAY = "DAY"
    WEEK = "WEEK"
    MONTH = "MONTH"

    @classmethod
    def of(cls, value: str | TimeUnit) -> TimeUnit:
        return cls(str(getattr(value, "value", value)).strip().upper().removesuffix("S"))

    @property
    def minutes(self) -> int:
        return {"MINUTE": 1, "HOUR": 60, "DAY": 1440, "WEEK": 10080, "MONTH": 43200}[self.value]

    def after(self, start: date, n: int) -> date:
        """The date n units on; units below a day stay on the date, a month has 30 days."""
        return start + timedelta(days=n * (self.minutes // 1440))


BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("datetime", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close")]
    + [T.StructField("volume", T.LongType())]
)
EQUITY = "run_id string, datetime timestamp_ntz, cash double, position_value double, total_equity double"
TRADES = "run_id string, datetime timestamp_ntz, symbol string, side string, price double, quantity double, fee double, pnl double, reason string"
INSTRUMENTS = "exchange string, instrument_key string, instrument_type string, isin string, lot_size int, name string, segment string, tick_size double, trading_symbol string"
