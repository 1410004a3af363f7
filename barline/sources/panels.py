"""Panels: one long table (symbol, datetime, open, high, low, close, volume, others) of any number of symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.windows import filled

PRICES = ("open", "high", "low", "close")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def symbol_of(key: Column) -> Column:
    """Of a key SYMBOL or SYMBOL_interval."""
    return F.upper(F.split(key, "_")[0])


def normalise(df: DataFrame) -> DataFrame:
    """Lower-case names, timestamps without zone; datetime and symbol first."""
    names = {c: c.lower() for c in df.columns}
    out = df.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    rest = [c for c in out.columns if c not in ("datetime", "symbol")]
    return out.select(F.col("datetime").cast("timestamp_ntz").alias("datetime"), F.col("symbol").cast("string").alias("symbol"), *rest)


def union(frames: dict[str, DataFrame]) -> DataFrame:
    """One panel of frames by key; columns that a frame lacks are null."""
    parts = [normalise(f.withColumn("symbol", symbol_of(F.lit(key)))) for key, f in frames.items()]
    if not parts:
        raise ValueError("no frames")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def between(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "datetime") -> DataFrame:
    """Closed range; an end that is a bare date holds to the end of that day."""
    if start is not None:
        df = df.where(F.col(column) >= F.lit(str(start)).cast("timestamp_ntz"))
    if end is not None:
        last = f"{end} 23:59:59.999999" if len(str(end)) == 10 else str(end)
        df = df.where(F.col(column) <= F.lit(last).cast("timestamp_ntz"))
    return df


def resample(ticks: DataFrame, symbol: str, time: str, price: str, every: str, order: list[str] | None = None) -> DataFrame:
    """Bars of ticks: `every` is a date_trunc unit. Ties in time are ordered by `order`. Two-phase hash
    aggregation: each tick adds to partial firsts, lasts, minima and maxima before the shuffle."""
    key = F.struct(time, *(order or []))
    at = F.date_trunc(every, F.col(time)).cast("timestamp_ntz")
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), at.alias("datetime"))
        .agg(F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("volume"))
    )


def order_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of total prices by order priority."""
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("datetime")).agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").alias("volume")
    )


def event_bars(spark: SparkSession, folder: str, every: str = "hour") -> DataFrame:
    """Bars of event values by event type."""
    return resample(table(spark, folder, "events"), "event_type", "ts", "value", every, ["event_id"])


def supplier_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Daily bars of unit prices by supplier."""
    line = table(spark, folder, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", price.alias("p"))
    return line.groupBy(F.concat(F.lit("S"), F.col("l_suppkey")).alias("symbol"), F.col("l_shipdate").alias("datetime")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").alias("volume")
    )


def calendar(panel: DataFrame) -> DataFrame:
    """The distinct times of all symbols."""
    return panel.select("datetime").distinct()


def densify(panel: DataFrame, backward: bool = True, keys: tuple[str, ...] = ("symbol",), flags: tuple[str, ...] = ()) -> DataFrame:
    """Every symbol (or other keys) on every time of the panel: missing prices take the last known ones (before
    the first bar, with backward, the first to come), missing volumes are 0, missing flags false; `observed`
    tells the real bars. The cross product is of distinct times and distinct keys, as the result itself is."""
    grid = calendar(panel).crossJoin(panel.select(*keys).distinct())
    df = grid.join(panel.withColumn("observed", F.lit(True)), [*keys, "datetime"], "left")
    w = Window.partitionBy(*keys).orderBy("datetime")
    volume = [F.coalesce("volume", F.lit(0)).alias("volume")] if "volume" in panel.columns else []
    return df.select(
        *keys, "datetime",
        *(filled(F.col(c), w, backward).alias(c) for c in PRICES), *volume,
        *(F.coalesce(F.col(c), F.lit(False)).alias(c) for c in flags),
        F.coalesce("observed", F.lit(False)).alias("observed"),
    )


def latest_bars(panel: DataFrame) -> DataFrame:
    """The last bar of each symbol."""
    last = F.max_by(F.struct("datetime", *PRICES, "volume"), "datetime")
    return panel.groupBy("symbol").agg(last.alias("b")).select("symbol", "b.*")
