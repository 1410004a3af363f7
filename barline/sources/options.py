"""Option chains: contracts by expiry, strike and kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.schema import ProviderError

KINDS = ("CE", "PE")


def chain(chains: DataFrame) -> DataFrame:
    """Contracts of rows (underlying, expiries array<string>, strikes array<double>): three explodes, no join."""
    df = chains.select("underlying", F.explode("expiries").alias("expiry"), "strikes")
    df = df.select("underlying", "expiry", F.explode("strikes").alias("strike"))
    df = df.select("underlying", "expiry", "strike", F.explode(F.array(*map(F.lit, KINDS))).alias("option_type"))
    return _named(df, F.col("expiry"))


def _named(df: DataFrame, expiry: Column) -> DataFrame:
    symbol = F.concat_ws("_", "underlying", expiry, F.col("strike").cast("string"), "option_type")
    return df.select(symbol.alias("symbol"), "underlying", F.to_date("expiry").alias("expiry"), F.col("strike").cast("double").alias("strike"), "option_type")


def synthetic_chain(spark: SparkSession, underlying: str, strikes: int = 5, today: str | None = None) -> DataFrame:
    """A made-up chain: strikes from 100 on in steps of 10, one expiry thirty days from today."""
    day = F.lit(today).cast("date") if today else F.current_date()
    df = spark.range(strikes).select(F.lit(underlying).alias("underlying"), F.date_format(F.date_add(day, 30), "yyyy-MM-dd").alias("expiry"), (F.col("id") * 10.0 + 100.0).alias("strike"))
    return _named(df.withColumn("option_type", F.explode(F.array(*map(F.lit, KINDS)))), F.col("expiry"))


def chain_or_synthetic(spark: SparkSession, underlying: str, load) -> DataFrame:
    """load(underlying) -> contracts; a made-up chain where it fails."""
    try:
        return load(underlying)
    except (ProviderError, OSError, ValueError):
        return synthetic_chain(spark, underlying)
