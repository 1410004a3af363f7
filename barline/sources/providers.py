"""Bar providers: a plug-in point, files, chains of providers, vendor payloads, and a Spark data source.

A provider gives a DataFrame of bars for a symbol, an interval and a date range. Nothing here uses a
network: payloads that a vendor's client has stored are read and shaped by the functions below.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from barline.schema import BARS, INSTRUMENTS, Interval, ProviderError, SymbolNotFound, UnsupportedInterval
from barline.sources.panels import between

YEARS_BACK = 5


def date_range(start: date | None, end: date | None, today: date | None = None) -> tuple[date, date]:
    """Defaults: to today, from five years before the end."""
    end = end or today or date.today()
    if start is None:
        try:
            start = end.replace(year=end.year - YEARS_BACK)
        except ValueError:  # 29 February
            start = end.replace(year=end.year - YEARS_BACK, day=28)
    if start > end:
        raise ProviderError(f"{start} is after {end}")
    return start, end


#: The longest range of one request, by interval; others have ten years.
CHUNK_DAYS = {"1minute": 30, "30minute": 90}


def chunks(spark: SparkSession, start: str, end: str, interval: str) -> DataFrame:
    """The requests that cover a range: chunk_no, chunk_start, chunk_end; neighbours share a date."""
    days = CHUNK_DAYS.get(Interval.of(interval).value)
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    step = F.make_dt_interval(F.lit(days)) if days else F.make_ym_interval(F.lit(10), F.lit(0))
    starts = spark.range(1).select(F.posexplode(F.sequence(a, b, step)).alias("chunk_no", "chunk_start"))
    ends = F.coalesce(F.lead("chunk_start").over(Window.partitionBy(F.lit(0)).orderBy("chunk_no")), b)  # a few rows
    return starts.withColumn("chunk_end", ends).where((F.col("chunk_start") < F.col("chunk_end")) | (a == b))


def candles(payloads: DataFrame, column: str = "candles") -> DataFrame:
    """Rows of a JSON column of candles [time, open, high, low, close, volume, open interest]: the local time
    without its zone, prices and volume; the rest is dropped."""
    c = F.explode(F.from_json(F.col(column), "array<array<string>>"))
    rows = payloads.select(*(x for x in payloads.columns if x != column), c.alias("c"))
    at = F.to_timestamp_ntz(F.substring(F.element_at("c", 1), 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    numbers = [F.element_at("c", k + 2).cast("double").alias(n) for k, n in enumerate(("open", "high", "low", "close"))]
    return rows.select(*(x for x in rows.columns if x != "c"), at.alias("datetime"), *numbers, F.coalesce(F.element_at("c", 6).cast("double").cast("long"), F.lit(0)).alias("volume"))


def keep_first(bars: DataFrame, order: str, keys: tuple[str, ...] = ("symbol", "datetime")) -> DataFrame:
    """One row for each key: that of the lowest `order`."""
    w = Window.partitionBy(*keys).orderBy(order)
    return bars.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def instruments(raw: DataFrame, segment: str) -> DataFrame:
    """Equities of a segment, with their upper-case symbol."""
    return raw.where((F.col("segment") == segment) & (F.col("instrument_type") == "EQ")).withColumn("symbol", F.upper("trading_symbol"))


def read_instruments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INSTRUMENTS).option("multiLine", True).json(path)


def resolve(symbols: DataFrame, master: DataFrame, strict: bool = True) -> DataFrame:
    """Adds instrument_key; with strict, an unknown symbol is an error when the row is read."""
    key = master.select("symbol", "instrument_key")
    df = symbols.withColumn("symbol", F.upper("symbol")).join(key, "symbol", "left")
    if not strict:
        return df
    missing = F.raise_error(F.concat(F.lit("unknown symbol "), F.col("symbol"))).cast("string")
    return df.withColumn("instrument_key", F.coalesce("instrument_key", missing))


def suffixed(symbol: Column, exchange: Column) -> Column:
    """A symbol with its exchange's suffix, unless it has one."""
    s = F.upper(symbol)
    return F.when(s.contains("."), s).otherwise(F.concat(s, F.when(F.upper(exchange) == "BSE", ".BO").otherwise(".NS")))


class Provider(ABC):
    """Subclasses give bars; `intervals` are those they have."""

    intervals: tuple[Interval, ...] = tuple(Interval)

    def checked(self, interval: str | Interval) -> Interval:
        got = Interval.of(interval)
        if got not in self.intervals:
            raise UnsupportedInterval(f"{type(self).__name__} has no {got.value} bars")
        return got

    @abstractmethod
    def bars(self, symbol: str, interval: str, start: date | None = None, end: date | None = None, exchange: str = "NSE") -> DataFrame: ...

    @abstractmethod
    def instrument(self, symbol: str, exchange: str = "NSE") -> dict: ...


class FileProvider(Provider):
    """Parquet bars under <path>/interval=.../ with a symbol column: partition pruning by interval and filters
    on symbol and time reach the scan."""

    def __init__(self, spark: SparkSession, path: str, master: DataFrame | None = None):
        self.spark, self.path, self.master = spark, path, master

    def bars(self, symbol, interval, start=None, end=None, exchange="NSE"):
        got = self.checked(interval)
        start, end = date_range(start, end)
        df = self.spark.read.parquet(self.path).where((F.col("interval") == got.value) & (F.col("symbol") == symbol.upper()))
        df = between(df, start.isoformat(), end.isoformat())
        if df.isEmpty():
            raise ProviderError(f"no {got.value} bars of {symbol}")
        return df.select(*BARS.names)

    def instrument(self, symbol, exchange="NSE"):
        rows = self.master.where(F.col("symbol") == symbol.upper()).limit(1).collect() if self.master is not None else []
        if not rows:
            raise SymbolNotFound(symbol)
        return rows[0].asDict()


class ChainedProvider(Provider):
    """The first provider that doesn't fail."""

    def __init__(self, *providers: Provider):
        if not providers:
            raise ValueError("no providers")
        self.providers = providers

    def _first(self, call):
        failed = []
        for p in self.providers:
            try:
                return call(p)
            except (ProviderError, UnsupportedInterval, SymbolNotFound) as e:
                failed.append(f"{type(p).__name__}: {e}")
        raise ProviderError("; ".join(failed))

    def bars(self, symbol, interval, start=None, end=None, exchange="NSE"):
        return self._first(lambda p: p.bars(symbol, interval, start, end, exchange))

    def instrument(self, symbol, exchange="NSE"):
        return self._first(lambda p: p.instrument(symbol, exchange))


def prefer(*frames: DataFrame) -> DataFrame:
    """Bars of several loaded sources; where they overlap, the earlier frame's."""
    out = None
    for k, f in enumerate(frames):
        f = f.withColumn("__source", F.lit(k))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return keep_first(out, "__source").drop("__source")


class _Chunk(InputPartition):
    def __init__(self, start: date, end: date):
        self.start, self.end = start, end


class _ChunkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.symbol = options["path"], options["symbol"].upper()
        self.start, self.end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.days = int(options.get("chunk_days", 30))

    def partitions(self) -> list[InputPartition]:
        out, at = [], self.start
        while at <= self.end:
            last = min(at + timedelta(days=self.days - 1), self.end)
            out.append(_Chunk(at, last))
            at = last + timedelta(days=1)
        return out

    def read(self, partition: _Chunk) -> Iterator[tuple]:
        """The bars of one request, from the payload file that the vendor's client stored for the symbol."""
        import json
        from datetime import datetime

        with open(f"{self.folder}/{self.symbol}.json") as f:
            rows = json.load(f)
        for at, o, h, low, c, v, *_ in rows:
            t = datetime.fromisoformat(at).replace(tzinfo=None)
            if partition.start <= t.date() <= partition.end:
                yield self.symbol, t, float(o), float(h), float(low), float(c), int(v or 0)


class CandleSource(DataSource):
    """spark.read.format("candles").option("path", ...).option("symbol", ...).option("start", ...)
    .option("end", ...): one partition for each request of at most chunk_days days."""

    @classmethod
    def name(cls) -> str:
        return "candles"

    def schema(self):
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return _ChunkReader(self.options)
