"""Live signals: a moving-average cross per symbol as state in a stream, with a daily order cap; and a runner
that hands new bars to a signal function in market hours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import datetime, time
from functools import reduce
from operator import add
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barline.operators.calendar import CLOSES, OPENS, ZONE

SIGNAL = "symbol string, datetime timestamp, signal string, fast double, slow double, price double, accepted boolean"
_STATE = "closes array<double>, last timestamp, tie long, day string, orders int"


def cross_signals(bars: DataFrame, fast: int = 5, slow: int = 10, most_orders: int = 5, tie: str | None = None) -> DataFrame:
    """BUY, SELL or HOLD for each bar (symbol, datetime TIMESTAMP, close) once there are enough. The state of a
    symbol is its last slow + 1 closes, the last bar's time and the day's orders, of fixed size. Bars not
    after the last one are ignored; a signal is accepted while the day's orders are below the cap. Bars of one time
    are one bar that came again, unless `tie`, a column of whole numbers, tells them apart and orders them."""

    def mean(values: list[float]) -> float:
        """Added up one after the other, as in the windows of a batch. Python's sum() corrects roundings since 3.12:
        fast and slow means that are equal but for roundings would then cross elsewhere than in the batch."""
        return reduce(add, values) / len(values)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closes, last, tied, day, orders = state.get if state.exists else ([], None, 0, "", 0)
        closes, out = list(closes), []
        for r in pd.concat(list(frames)).sort_values(["datetime", "tie"]).itertuples(index=False):
            if last is not None and (r.datetime, r.tie) <= (last, tied):
                continue
            last, tied = r.datetime, r.tie
            closes = [*closes, float(r.close)][-(slow + 1) :]
            if str(last.date()) != day:
                day, orders = str(last.date()), 0
            if len(closes) <= slow:
                continue
            f, s, f0, s0 = mean(closes[-fast:]), mean(closes[-slow:]), mean(closes[-fast - 1 : -1]), mean(closes[-slow - 1 : -1])
            signal = "BUY" if f0 <= s0 and f > s else "SELL" if f0 >= s0 and f < s else "HOLD"
            accepted = signal != "HOLD" and orders < most_orders
            orders += accepted
            out.append((key[0], last, signal, f, s, closes[-1], accepted))
        state.update((closes, last, tied, day, orders))
        yield pd.DataFrame(out, columns=["symbol", "datetime", "signal", "fast", "slow", "price", "accepted"])

    given = bars.select("symbol", F.col("datetime").cast("timestamp").alias("datetime"), F.col("close").cast("double").alias("close"), F.coalesce(F.col(tie).cast("long"), F.lit(0)).alias("tie") if tie else F.lit(0).cast("long").alias("tie"))
    return given.groupBy("symbol").applyInPandasWithState(step, SIGNAL, _STATE, "append", GroupStateTimeout.NoTimeout)


def market_open(now: datetime, holidays: frozenset = frozenset()) -> bool:
    """Whether the market is open at an instant (with zone)."""
    local = now.astimezone(ZoneInfo(ZONE))
    if local.weekday() >= 5 or local.date() in holidays:
        return False
    return time.fromisoformat(OPENS) <= local.time() <= time.fromisoformat(CLOSES)


class LiveRunner:
    """For each micro-batch of bars: the last bar of each symbol goes to signal_fn(symbol, bar), and BUY or
    SELL becomes an order while the symbol's orders of the day are below the cap. Only last bars of symbols
    that are traded here come to the driver. A failing symbol doesn't stop the others. With `journal`, a
    folder, a batch's orders are stored there before they are placed, and a runner that is started again counts
    the day's orders from it (also one whose placing failed); without, counts last as long as the runner."""

    JOURNAL = "symbol string, day string, side string"

    def __init__(self, symbols: list[str], signal_fn: Callable[[str, dict], str | None], place: Callable[[dict], None], most_orders: int = 5, holidays: frozenset = frozenset(), clock: Callable[[], datetime] | None = None, journal: str | None = None):
        self.symbols, self.signal_fn, self.place, self.most_orders, self.holidays = symbols, signal_fn, place, most_orders, holidays
        self.clock = clock or (lambda: datetime.now(ZoneInfo(ZONE)))
        self.journal, self.recalled = journal, ""
        self.orders: dict[tuple[str, str], int] = {}
        self.failed: list[tuple[str, str]] = []

    def batch(self, bars: DataFrame, number: int = 0) -> None:
        """For foreachBatch."""
        now = self.clock()
        if not market_open(now, self.holidays):
            return
        spark, day = bars.sparkSession, str(now.date())
        self._recall(spark, day)
        names = [c for c in bars.columns if c != "symbol"]
        last = bars.where(F.col("symbol").isin(self.symbols)).groupBy("symbol").agg(F.max_by(F.struct(*names), "datetime").alias("bar"))
        wanted = []
        for r in last.orderBy("symbol").collect():
            with self._noted(r.symbol):
                order = self._order(r.symbol, r.bar.asDict(), day)
                wanted += [order] if order else []
        if wanted and self.journal:
            spark.createDataFrame([(o["symbol"], day, o["side"]) for o in wanted], self.JOURNAL).coalesce(1).write.mode("append").parquet(self.journal)
        for order in wanted:
            with self._noted(order["symbol"]):
                self.place(order)
                self.orders[order["symbol"], day] = self.orders.get((order["symbol"], day), 0) + 1

    @contextmanager
    def _noted(self, symbol: str):
        """One symbol's failure is noted and the others go on."""
        try:
            yield
        except Exception as e:  # noqa: BLE001
            self.failed.append((symbol, repr(e)))

    def _recall(self, spark, day: str) -> None:
        if not self.journal or self.recalled == day:
            return
        path = spark._jvm.org.apache.hadoop.fs.Path(self.journal)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            counts = spark.read.schema(self.JOURNAL).parquet(self.journal).where((F.col("day") == day) & F.col("symbol").isin(self.symbols)).groupBy("symbol").count()
            self.orders |= {(r.symbol, day): r["count"] for r in counts.collect()}
        self.recalled = day

    def _order(self, symbol: str, bar: dict, day: str) -> dict | None:
        signal = self.signal_fn(symbol, bar)
        if signal in ("BUY", "SELL") and self.orders.get((symbol, day), 0) < self.most_orders:
            return {"symbol": symbol, "side": signal, "kind": "MARKET", "quantity": 1, "product": "MIS", "price": bar.get("close")}
        return None

    def start(self, bars: DataFrame, checkpoint: str, every: str = "60 seconds"):
        return bars.writeStream.foreachBatch(self.batch).trigger(processingTime=every).option("checkpointLocation", checkpoint).start()
