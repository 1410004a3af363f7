import pytest
from pyspark.sql import functions as F

from barline.operators import orders as o
from barline.operators.costs import StatutoryCosts, TradingCost, cost_of
from barline.operators.paper import fills_of, paper_trading

FREE = StatutoryCosts(stt_pct_sell=0, stamp_duty_pct_buy=0, transaction_charge_pct=0, sebi_per_crore=0, slippage_pct=0)


def test_statutory_costs(spark):
    c = StatutoryCosts(brokerage_flat=20.0)
    buy, sell = c.parts(100 * 100, "BUY"), c.parts(110 * 100, "SELL")
    assert buy["stamp_duty"] == pytest.approx(1.5) and buy["stt"] == 0 and sell["stt"] == pytest.approx(11) and sell["stamp_duty"] == 0
    assert buy["gst"] == pytest.approx((20 + 0.325) * 0.18) and buy["sebi_charges"] == pytest.approx(0.01)
    df = spark.createDataFrame([(10_000.0, "buy"), (11_000.0, "SELL")], "v double, side string")
    rows = df.select(c.breakdown(F.col("v"), F.col("side")).alias("c")).select("c.*").collect()
    for r, want in zip(rows, (buy, sell)):
        assert r.asDict() == pytest.approx(want)
    assert StatutoryCosts(brokerage_pct=1.0, brokerage_flat=20.0).parts(100, "BUY")["brokerage"] == 20
    x = df.select(c.executed(F.lit(100.0), F.lit(2.0), F.col("side")).alias("x")).select("x.*").collect()
    assert x[0].fill == pytest.approx(100.05) and x[0].cash > x[0].turnover and x[1].cash < x[1].turnover
    assert cost_of("a", [TradingCost(fee_fixed=9), TradingCost("A", fee_fixed=1)]).fee_fixed == 1 and cost_of("b", []).fee(100) == 0


def test_fill_rules(spark):
    bar = {"open": 101.0, "high": 103.0, "low": 98.0, "close": 100.0}
    cases = [
        ("MARKET", "BUY", None, None, 101), ("LIMIT", "BUY", 99.0, None, 99), ("LIMIT", "BUY", 102.0, None, 100), ("LIMIT", "BUY", 97.0, None, None),
        ("LIMIT", "SELL", 102.0, None, 102), ("LIMIT", "SELL", 99.0, None, 100), ("LIMIT", "SELL", 104.0, None, None),
        ("STOP", "BUY", None, 102.0, 102), ("STOP", "BUY", None, 104.0, None), ("STOP", "SELL", None, 99.0, 99), ("STOP", "SELL", None, 97.0, None),
        ("STOP_LIMIT", "BUY", 99.0, 102.0, 99), ("STOP_LIMIT", "BUY", 97.0, 102.0, None), ("STOP_LIMIT", "SELL", 102.0, 99.0, 102), ("STOP_LIMIT", "SELL", 104.0, 99.0, None),
    ]
    df = spark.createDataFrame([(k, *c[:4], *bar.values()) for k, c in enumerate(cases)], "k int, kind string, side string, price double, stop double, open double, high double, low double, close double")
    got = df.withColumn("p", o.fill_price(*(F.col(c) for c in ("kind", "side", "price", "stop", "open", "high", "low", "close")))).orderBy("k").collect()
    assert [r.p for r in got] == [c[4] for c in cases]


def test_first_fill_and_next_open(spark):
    from tests.helpers import bars

    b = bars(spark, [100, 100, 95], highs=[101, 100, 96], lows=[98, 98, 94], opens=[100, 99, 96])
    orders = spark.createDataFrame([(1, "S", "BUY", "LIMIT", 1.0, 97.0, None), (2, "S", "BUY", "MARKET", 1.0, None, None), (3, "S", "SELL", "LIMIT", 1.0, 500.0, None)], "order_id int, symbol string, side string, kind string, quantity double, price double, stop_price double").withColumn("created", F.lit("2024-01-01").cast("timestamp_ntz"))
    got = {r.order_id: r for r in o.first_fills(orders, b, FREE).collect()}
    assert got[1].fill_price == 95 and got[1].filled_at.day == 3 and got[2].fill_price == 99 and got[3].fill_price is None
    late = orders.withColumn("cancelled", F.lit("2024-01-03").cast("timestamp_ntz"))
    assert {r.order_id: r.fill_price for r in o.first_fills(late, b, FREE).collect()} == {1: None, 2: 99.0, 3: None}
    s = b.withColumn("side", F.when(F.col("datetime") == F.lit("2024-01-01").cast("timestamp_ntz"), "BUY"))
    assert [(r.fill_price, r.filled_at.day) for r in o.next_open_fills(s, FREE).collect()] == [(99.0, 2)]


def test_checks(spark):
    df = spark.createDataFrame([("SELL", 5.0, "CNC", 0.0), ("BUY", 0.0, "CNC", 0.0), ("BUY", 99999.0, "xyz", 0.0), ("SELL", 5.0, "cnc", 5.0)], "side string, quantity double, product string, position double")
    got = [(r.allowed, len(r.reasons)) for r in o.check_orders(df).collect()]
    assert got == [(False, 1), (False, 1), (False, 2), (True, 0)]
    assert "long-only" in o.check_orders(df).first().reasons[0]
    loss = spark.createDataFrame([(100.0, 96.0), (100.0, 94.0), (0.0, -5.0)], "a double, b double")
    assert [r[0] for r in loss.select(o.daily_loss_allowed(F.col("a"), F.col("b"), 5.0)).collect()] == [True, False, True]


def test_ledger(spark):
    fills = spark.createDataFrame([("x", "R", 1, "BUY", 10.0, 2500.0, 50.0), ("x", "R", 2, "SELL", 5.0, 2600.0, 25.0), ("x", "R", 3, "SELL", 50.0, 2600.0, None), ("y", "R", 1, "BUY", 1.0, 1.0, 0.0), ("y", "R", 2, "BUY", 3.0, 5.0, 0.0)], "account string, symbol string, seq long, side string, quantity double, price double, fees double")
    x = {(r.account, r.seq): r for r in o.ledger(fills).collect()}
    assert x["x", 1].cash == -25_050 and x["x", 2].realized_pnl == 500 and x["x", 2].position == 5
    assert x["x", 3].position == 0 and x["x", 3].average_cost == 0 and x["x", 3].realized_pnl == 1000
    assert x["y", 2].average_cost == 4
    prices = spark.createDataFrame([("R", 6.0)], "symbol string, price double")
    p = {r.account: r for r in o.positions(fills, prices).collect()}
    assert p["y"].unrealized_pnl == 8 and p["y"].market_value == 24 and p["x"].unrealized_pnl == 0
    a = {r.account: r for r in o.accounts(fills, prices, 100_000.0).collect()}
    assert a["y"].total_value == 100_000 - 16 + 24 and a["y"].total_pnl == 8


def test_paper(spark):
    rows = [
        ("a", 1, "order", "1", "S", "BUY", "MARKET", 10.0, None, "CNC"), ("a", 2, "order", "2", "S", "BUY", "LIMIT", 5.0, 95.0, "MIS"), ("a", 3, "price", None, "S", None, None, None, 100.0, None),
        ("a", 4, "order", "3", "S", "SELL", "MARKET", 11.0, None, "CNC"), ("a", 5, "order", "4", "S", "SELL", "STOP", 1.0, 90.0, "CNC"), ("a", 6, "price", None, "T", None, None, None, 1.0, None),
        ("a", 7, "price", None, "S", None, None, None, 94.0, None), ("a", 8, "cancel", "4", None, None, None, None, None, None), ("a", 9, "order", "5", "S", "SELL", "MARKET", 15.0, None, "CNC"), ("a", 10, "price", None, "S", None, None, None, 110.0, None),
    ]
    events = spark.createDataFrame(rows, "account string, seq long, kind string, order_id string, symbol string, side string, order_type string, quantity double, price double, product string")
    out = paper_trading(events, FREE)
    got = {r.order_id: r for r in out.collect()}
    assert {k: r.status for k, r in got.items()} == {"1": "COMPLETE", "2": "COMPLETE", "3": "REJECTED", "4": "CANCELLED", "5": "COMPLETE"}
    assert got["1"].fill_price == 100 and got["2"].fill_price == 95 and got["5"].realized == pytest.approx(15 * 110 - 1475)
    assert "long-only" in got["3"].message
    last = o.positions(fills_of(out)).collect()[0]
    assert last.position == 0 and last.realized_pnl == pytest.approx(175)
