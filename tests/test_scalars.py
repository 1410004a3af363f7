from datetime import date

from pyspark.sql import functions as F

from barline.functions import scalars as s


def test_names_and_dates(spark):
    df = spark.createDataFrame([("1D",), (" 5minute ",), ("nope",), (None,)], "x string")
    got = df.select(s.interval_name(F.col("x")), s.interval_minutes(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("day", 1440), ("5minute", 5), (None, None), (None, None)]
    d = spark.createDataFrame([(date(2024, 1, 31), "months", 1), (date(2024, 1, 31), "hour", 9), (date(2024, 1, 31), "Week", 2), (date(2024, 1, 31), "eon", 2)], "d date, u string, n int")
    assert [r[0] for r in d.select(s.date_after(F.col("d"), F.col("u"), F.col("n"))).collect()] == [date(2024, 3, 1), date(2024, 1, 31), date(2024, 2, 14), None]


def test_records(spark):
    rows = s.records(spark, ['{"a": 1, "b": "x"}', '{"a": "bad"}', "broken"], "a int, b string").collect()
    assert [tuple(r) for r in rows] == [(1, "x"), (None, None), (None, None)]
