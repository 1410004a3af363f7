from datetime import datetime

import pytest

from barline.operators import metrics as met
from tests.helpers import column, curve


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def trades(spark, rows):
    return spark.createDataFrame([("r", datetime(2024, 1, k + 1), "S", side, 1.0, 1.0, fee, pnl) for k, (side, pnl, fee) in enumerate(rows)], "run_id string, datetime timestamp_ntz, symbol string, side string, price double, quantity double, fee double, pnl double")


def test_equity(spark):
    assert one(met.equity_metrics(curve(spark, [100, 110, 120]))).total_return == pytest.approx(0.2)
    m = one(met.equity_metrics(curve(spark, [100, 110, 90, 120])))
    assert m.max_drawdown == pytest.approx(20 / 110)
    assert column(met.drawdown_series(curve(spark, [100, 110, 90, 120])), "drawdown") == pytest.approx([0, 0, 20 / 110, 0])
    year = [100 + 20 * k / 365 for k in range(366)]
    assert one(met.equity_metrics(curve(spark, year))).cagr == pytest.approx(0.2, abs=1e-4)
    assert one(met.equity_metrics(curve(spark, [100, 110, 121, 133.1]), risk_free=0.0)).sharpe_ratio == 0


def test_equity_details(spark):
    v = [100, 120, 90, 90, 130, 117]
    m = one(met.equity_metrics(curve(spark, v, step=2, held=[0, 1, 1, 0, 1, 1])))
    r = [b / a - 1 for a, b in zip(v, v[1:])]
    mean = sum(r) / 5
    std = (sum((x - mean) ** 2 for x in r) / 4) ** 0.5
    down = [x for x in r if x < 0]
    dmean = sum(down) / 2
    dstd = (sum((x - dmean) ** 2 for x in down)) ** 0.5
    assert m.annualized_volatility == pytest.approx(std * 252**0.5)
    assert m.downside_deviation == pytest.approx(dstd * 252**0.5)
    assert m.sharpe_ratio == pytest.approx((mean - 0.04 / 252) * 252**0.5 / std)
    assert m.sortino_ratio == pytest.approx((mean - 0.04 / 252) * 252**0.5 / m.downside_deviation)
    assert m.annualized_return == pytest.approx(1.17 ** (252 / 6) - 1)
    assert m.max_drawdown_duration_days == 4
    assert m.avg_drawdown == pytest.approx((0 + 0.25 + 0.25 + 0.1) / 4)
    assert m.ulcer_index == pytest.approx(((0.25**2 * 2 + 0.1**2) / 6) ** 0.5)
    assert m.calmar_ratio == pytest.approx((m.cagr - 0.04) / 0.25) and m.recovery_factor == pytest.approx(0.17 / 0.25)
    assert m.value_at_risk_5 == min(r) and m.conditional_value_at_risk_5 == min(r)
    assert m.exposure == pytest.approx(4 / 6)
    m2, m3, m4 = (sum((x - mean) ** k for x in r) / 5 for k in (2, 3, 4))
    assert m.return_skewness == pytest.approx(m3 / m2**1.5) and m.return_kurtosis == pytest.approx(m4 / m2**2 - 3)


def test_degenerate_curves(spark):
    m = one(met.equity_metrics(curve(spark, [100])))
    assert {v for k, v in m.asDict().items() if k != "run_id"} == {0.0}
    m = one(met.equity_metrics(curve(spark, [100, 0, 0])))
    assert m.total_return == -1 and m.cagr == -1 and m.annualized_return == -1
    assert one(met.equity_metrics(curve(spark, [0, 0, 5]))).total_return == 0
    assert met.equity_metrics(curve(spark, [1]).limit(0)).count() == 0


def test_trades(spark):
    t = trades(spark, [("SELL", 10.0, 1.0), ("SELL", -5.0, 1.0), ("SELL", 15.0, 0.5), ("BUY", -1.0, 1.0)])
    m = one(met.trade_metrics(t))
    assert (m.num_trades, m.num_winning_trades, m.num_losing_trades) == (3, 2, 1)
    assert m.win_rate == pytest.approx(2 / 3) and m.profit_factor == 5 and m.total_fees == 3.5 and m.net_profit == 20
    assert m.payoff_ratio == 2.5 and m.trade_expectancy == pytest.approx(2 / 3 * 12.5 - 1 / 3 * 5)
    m = one(met.trade_metrics(trades(spark, [("SELL", 3.0, 0.0)])))
    assert m.profit_factor == m.payoff_ratio == float("inf")
    m = one(met.trade_metrics(trades(spark, [("BUY", -1.0, 1.0)])))
    assert m.num_trades == 0 and m.win_rate == 0 and m.profit_factor == 0


def test_durations_and_streaks(spark):
    t = trades(spark, [("SELL", 1.0, 0.0), ("BUY", 0.0, 0.0), ("SELL", 1.0, 0.0), ("BUY", 0.0, 0.0), ("SELL", -1.0, 0.0), ("SELL", 0.0, 0.0), ("SELL", 2.0, 0.0)])
    assert column(met.trade_durations(t), "days", "closed") == [1, 1, 2, 3]
    d = one(met.duration_metrics(t))
    assert d.avg_trade_duration_days == 1.75 and d.max_trade_duration_days == 3
    s = one(met.streaks(t))
    assert (s.max_consecutive_wins, s.max_consecutive_losses) == (2, 2)


def test_benchmark_by_position(spark):
    b = curve(spark, [100, 101, 103, 102, 106], start="2020-01-01")
    e = curve(spark, [100, 102, 106.04, 103.96])
    m = one(met.benchmark_metrics(e, b.drop("run_id"), risk_free=0.0))
    r, q = [0.02, 106.04 / 102 - 1, 103.96 / 106.04 - 1], [103 / 101 - 1, 102 / 103 - 1, 106 / 102 - 1]
    mr, mq = sum(r) / 3, sum(q) / 3
    beta = sum((x - mr) * (y - mq) for x, y in zip(r, q)) / sum((y - mq) ** 2 for y in q)
    every = [0.01, *q]
    assert m.beta == pytest.approx(beta) and m.alpha == pytest.approx(mr * 252 - beta * sum(every) / 4 * 252)
    assert m.treynor_ratio == pytest.approx(mr * 252 / beta)


def test_months(spark):
    e = curve(spark, [100] * 5 + [110] * 5, step=10)
    rows = met.monthly_returns(e).orderBy("month").collect()
    assert {r.year for r in rows} == {"2023"} and [round(r.ret, 6) for r in rows] == [0.0, 0.1, 0.0, 0.0]
    h = one(met.monthly_heatmap(e))
    assert h.m02 == pytest.approx(0.1) and h.m12 == 0.0


def test_all_metrics(spark):
    e = curve(spark, [100, 90, 110, 120])
    t = trades(spark, [("SELL", 10.0, 0.0), ("SELL", -5.0, 0.0), ("SELL", 15.0, 0.0)])
    m = one(met.all_metrics(e, t))
    assert len(m.asDict()) == 1 + 37 + 4 and m.win_rate == pytest.approx(2 / 3) and m.total_return == pytest.approx(0.2) and m.beta is None
    assert one(met.all_metrics(e, t, e.drop("run_id"))).beta == pytest.approx(1.0)
