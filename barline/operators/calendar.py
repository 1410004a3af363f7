"""Trading calendar: weekends and a holiday table (dates), as joins and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Market hours.
OPENS, CLOSES, ZONE = "09:15:00", "15:30:00", "Asia/Kolkata"


def is_weekday(day: Column) -> Column:
    return F.weekday(day) < 5


def days_between(spark: SparkSession, start: str, end: str, inclusive: bool = True) -> DataFrame:
    """All dates of a range; exclusive leaves out both ends."""
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    if not inclusive:
        a, b = F.date_add(a, 1), F.date_sub(b, 1)
    days = F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<date>"))
    return spark.range(1).select(F.explode(days).alias("day"))


def trading_days(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """The days (column day) that are neither weekend nor holiday (column day)."""
    return days.where(is_weekday(F.col("day"))).join(holidays.select("day").distinct(), "day", "left_anti")


def trading_days_between(spark: SparkSession, start: str, end: str, holidays: DataFrame, inclusive: bool = True) -> DataFrame:
    return trading_days(days_between(spark, start, end, inclusive), holidays)


def is_trading_day(days: DataFrame, holidays: DataFrame) -> DataFrame:
    """Adds open."""
    off = holidays.select(F.col("day").alias("_off")).distinct()
    return days.join(off, F.col("day") == F.col("_off"), "left").withColumn("open", is_weekday(F.col("day")) & F.isnull("_off")).drop("_off")


def nearest_trading_day(days: DataFrame, holidays: DataFrame, forward: bool = True) -> DataFrame:
    """Adds next_day (previous_day): the first trading day on or after (before) each day, however far away. The
    calendar has one row per date from the first to the last day or holiday and a week more on both sides, where
    nothing is a holiday; one window over its dates, not over the rows of `days`, hands the open days on."""
    name = "next_day" if forward else "previous_day"
    ends = days.select("day").union(holidays.select("day")).agg(F.date_sub(F.min("day"), 7).alias("a"), F.date_add(F.max("day"), 7).alias("b"))
    dates = is_trading_day(ends.select(F.explode(F.sequence("a", "b")).alias("day")), holidays)
    w = Window.orderBy(F.col("day") if not forward else F.col("day").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = dates.select(F.col("day").alias("asked"), F.last(F.when(F.col("open"), F.col("day")), ignorenulls=True).over(w).alias(name))
    return days.join(found, F.col("day") == F.col("asked"), "left").drop("asked")


def holidays_between(holidays: DataFrame, start: str, end: str) -> DataFrame:
    return holidays.where(F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def market_hours(day: Column) -> Column:
    """Struct of the instants at which the market opens and closes that day."""
    at = lambda clock: F.to_utc_timestamp(F.concat_ws(" ", day.cast("string"), F.lit(clock)), ZONE)
    return F.struct(at(OPENS).alias("opens"), at(CLOSES).alias("closes"))
