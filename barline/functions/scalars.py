"""Small Column expressions: intervals, dates, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.schema import INTERVAL_ALIASES, INTERVAL_MINUTES


def _lookup(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def interval_name(text: Column) -> Column:
    """The interval of a name or alias, in any case; null for others."""
    key = F.lower(F.trim(text))
    names = _lookup(INTERVAL_ALIASES | {k: k for k in INTERVAL_MINUTES})
    return names[key]


def interval_minutes(text: Column) -> Column:
    return _lookup(INTERVAL_MINUTES)[interval_name(text)]


def date_after(start: Column, unit: Column, n: Column) -> Column:
    """The date n units on: units below a day stay on the date, a month has 30 days; null for other units."""
    days = _lookup({"MINUTE": 0, "HOUR": 0, "DAY": 1, "WEEK": 7, "MONTH": 30})
    return F.date_add(start, days[F.regexp_replace(F.upper(F.trim(unit)), "S$", "")] * n)


def records(spark: SparkSession, lines: list[str], schema: str) -> DataFrame:
    """A frame of JSON records; what doesn't fit the schema is null."""
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    return df.select(F.from_json("line", schema).alias("r")).select("r.*")
