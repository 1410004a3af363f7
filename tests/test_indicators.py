import math

import pytest

from barline.operators import indicators as ind
from tests.helpers import bars, column


def test_means(spark):
    df = bars(spark, [1, 2, 3, 4, 5])
    assert column(ind.sma(df, 3), "sma_3") == [None, None, 2.0, 3.0, 4.0]
    assert column(ind.ema(bars(spark, [1, 2, 3]), 3), "ema_3") == [1.0, 1.5, 2.25]


def recursion(values, alpha, adjust=False):
    """The means one by one: weights decay over nulls too."""
    out, mean, old, num, den = [], None, 1.0, 0.0, 0.0
    for v in values:
        old, num, den = old * (1 - alpha), num * (1 - alpha), den * (1 - alpha)
        if v is not None:
            num, den = num + v, den + 1
            mean = v if mean is None else (old * mean + alpha * v) / (old + alpha)
            old = 1.0
        out.append((num / den if den else None) if adjust else mean)
    return out


@pytest.mark.parametrize("alpha", [0.999, 2 / 3, 2 / 11, 1 / 14, 0.002, 1.0])
@pytest.mark.parametrize("adjust", [False, True])
def test_means_against_recursion(spark, alpha, adjust):
    """Many blocks, nulls at the start, single ones and a long gap."""
    from pyspark.sql import functions as F

    from barline.functions.ewm import Mean, with_means

    values = [math.sin(k) * 100 + k for k in range(900)]
    for k in (0, 1, 7, 8, 450, *range(600, 700)):
        values[k] = None
    df = bars(spark, [v or 0.0 for v in values]).withColumn("k", F.date_diff(F.col("datetime").cast("date"), F.lit("2024-01-01").cast("date")))
    df = df.withColumn("x", F.when(~F.col("k").isin([k for k, v in enumerate(values) if v is None]), F.col("close")))
    got = column(with_means(df, {"y": Mean("x", alpha, adjust), "z": Mean("x", 0.5)}), "y")
    want = recursion(values, alpha, adjust) if alpha < 1 else recursion(values, 1 - 1e-15)
    for a, b in zip(got, want):
        assert (a is None) == (b is None) and (a is None or abs(a - b) < 1e-7)


def test_rsi(spark):
    up = column(ind.rsi(bars(spark, range(1, 31)), 14), "rsi_14")
    assert all(0 <= x <= 100 for x in up) and up[-1] > 70 and up[0] == 100
    assert column(ind.rsi(bars(spark, [3, 2, 1]), 2), "rsi_2")[1:] == [0.0, 0.0]


def test_macd_bollinger_atr(spark):
    df = bars(spark, [1, 2, 3, 4, 5] * 5)
    r = ind.macd(df).orderBy("datetime").collect()
    assert all(abs(x.macd - x.macd_signal - x.macd_hist) < 1e-12 for x in r)
    b = ind.bollinger_bands(df, 5).orderBy("datetime").collect()
    assert b[3].bb_middle is None and all(x.bb_upper >= x.bb_middle >= x.bb_lower for x in b[4:])
    assert b[4].bb_upper == pytest.approx(3 + 2 * math.sqrt(2.5))
    assert column(ind.atr(bars(spark, [10, 20], highs=[12, 21], lows=[9, 19]), 2), "atr_2") == [3.0, 0.5 * 3 + 0.5 * 11]


def test_returns_volatility_liquidity(spark):
    df = bars(spark, [100, 110, 121])
    assert column(ind.returns(df), "returns_1")[1:] == pytest.approx([0.1, 0.1])
    assert column(ind.returns(bars(spark, [0, 5]), 1), "returns_1") == [None, None]
    v = column(ind.volatility(bars(spark, [100, 110, 99, 120]), 2), "volatility_2")
    assert v[:2] == [None, None] and v[2] == pytest.approx(math.sqrt(2) * 0.1)
    assert column(ind.liquidity(df, 2), "adtv") == [None, 105000.0, 115500.0]


def test_crosses(spark):
    df = bars(spark, [1, 2, 3, 2, 1]).withColumnRenamed("close", "a")
    from pyspark.sql import functions as F

    df = df.withColumn("b", F.when(F.col("datetime") < F.lit("2024-01-04").cast("timestamp_ntz"), 2.0).otherwise(3.0))
    assert column(ind.crossover(df, "a", "b"), "crossover") == [False, False, True, False, False]
    assert column(ind.crossunder(df, "a", "b"), "crossunder") == [False, False, False, True, False]


def test_symbols_are_apart(spark):
    df = bars(spark, [1, 2, 3], "A").union(bars(spark, [10, 20, 30], "B"))
    out = ind.ema(ind.sma(df, 2), 3)
    assert column(out.where("symbol = 'B'"), "sma_2") == [None, 15.0, 25.0]
    assert column(out.where("symbol = 'B'"), "ema_3")[0] == 10.0
