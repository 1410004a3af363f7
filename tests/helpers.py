"""Small frames for tests."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F


def bars(spark, closes, symbol="S", highs=None, lows=None, opens=None, start="2024-01-01", volume=1000):
    t0 = datetime.fromisoformat(start)
    rows = [
        (symbol, t0 + timedelta(days=k), float(opens[k] if opens else c), float(highs[k] if highs else c + 1), float(lows[k] if lows else c - 1), float(c), volume)
        for k, c in enumerate(closes)
    ]
    return spark.createDataFrame(rows, "symbol string, datetime timestamp_ntz, open double, high double, low double, close double, volume long")


def signalled(df, buys=(), sells=(), start="2024-01-01"):
    day = F.date_diff(F.col("datetime").cast("date"), F.lit(start).cast("date"))
    return df.withColumn("buy", day.isin(list(buys) or [-1])).withColumn("sell", day.isin(list(sells) or [-1]))


def curve(spark, values, run="r", step=1, start="2023-01-01", held=None):
    t0 = datetime.fromisoformat(start)
    rows = [(run, t0 + timedelta(days=k * step), float(v), float(held[k] if held else 0)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, datetime timestamp_ntz, total_equity double, position_value double")


def column(df, name, order="datetime"):
    return [r[name] for r in df.orderBy(order).collect()]
