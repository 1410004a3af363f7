import pytest
from pyspark.sql import functions as F

from barline.operators.costs import StatutoryCosts, TradingCost
from barline.plans import closed_form, simulate as sim, sweep
from barline.plans.rules import Cooldown, CooldownState, Exit, PositionSize, Scaling
from barline.plans.strategy import MovingAverageCross, PipelineStrategy, Strategy
from barline.schema import StrategyError
from tests.helpers import bars, signalled


def run(kind, df, capital=10_000.0, **rules):
    rules = sim.Rules(**rules)
    f = sim.simulate_portfolio if kind == "portfolio" else sim.simulate_single
    rows = f(df, rules, capital)
    s = sim.summary(rows, capital).collect()[0]
    return s, sim.trades_of(rows).orderBy("datetime", "side").collect(), sim.equity_of(rows).orderBy("datetime").collect()


BOTH = pytest.mark.parametrize("kind", ["portfolio", "single"])


@BOTH
def test_hold(spark, kind):
    s, t, e = run(kind, signalled(bars(spark, [100, 101, 102, 104, 110]), {0}, {4}))
    assert s.total_return == pytest.approx(0.10) and s.num_trades == 1 and len(e) == 5 and [x.reason for x in t] == ["buy_signal", "sell_signal"]


def test_costs(spark):
    cost = (TradingCost("S", 0.1, 0.05),)
    s, _, _ = run("portfolio", signalled(bars(spark, [100, 110]), {0}, {1}), costs=cost)
    q = (10_000 - 10) / 100.05
    gross = q * 110 * 0.9995
    assert s.total_return == pytest.approx((gross - gross * 0.001 - 10_000) / 10_000)
    s, t, _ = run("single", signalled(bars(spark, [100, 110]), {0}, {1}), costs=cost)
    assert not t and s.total_return == 0  # the amount and its fee don't fit in cash
    s, t, _ = run("single", signalled(bars(spark, [100, 110]), {0}, {1}), costs=cost, sizes=(PositionSize("S", fixed_amount=5000),))
    gross = 5000 / 100.05 * 110 * 0.9995
    assert s.total_return == pytest.approx((gross - gross * 0.001 - 5000 - 5) / 10_000)


@BOTH
def test_fixed_stop(spark, kind):
    df = signalled(bars(spark, [100, 90, 90], highs=[101, 91, 91], lows=[99, 89, 89]), {0})
    s, t, _ = run(kind, df, stops=(Exit("S", 5.0),))
    # The portfolio simulator exits at the worse of close and stop, the single one at the stop.
    assert (s.total_return, t[-1].price) == ((pytest.approx(-0.10), 90) if kind == "portfolio" else (pytest.approx(-0.05), 95))
    assert t[-1].reason == "stop_loss"


def test_targets(spark):
    df = signalled(bars(spark, [100, 105], highs=[101, 105], lows=[99, 100]), {0})
    s, t, _ = run("portfolio", df, targets=(Exit("S", 5.0),))
    assert s.total_return == pytest.approx(0.05) and (t[-1].reason, t[-1].price) == ("take_profit", 105)
    # trailing: armed by the high at 120, then follows highs down
    df = signalled(bars(spark, [100, 119, 118], highs=[101, 120, 118], lows=[99, 117, 115]), {0})
    s, t, _ = run("portfolio", df, targets=(Exit("S", 10.0, trailing=True),))
    assert t[-1].reason == "take_profit" and t[-1].price == 119


@BOTH
def test_trailing_stop(spark, kind):
    df = signalled(bars(spark, [100, 120, 110], highs=[101, 120, 115], lows=[99, 119, 90]), {0})
    s, t, _ = run(kind, df, stops=(Exit("S", 5.0, trailing=True),))
    assert t[-1].reason == "stop_loss" and t[-1].price == pytest.approx(110 if kind == "portfolio" else 114)


@BOTH
def test_trend_and_cooldown(spark, kind):
    df = signalled(bars(spark, [100 + k for k in range(60)]), set(range(60)))
    s, t, e = run(kind, df, 100_000.0, sizes=(PositionSize("S", fixed_amount=10_000),))
    assert s.num_trades == 1 and s.total_return > 0 and len(e) == 60 and t[-1].reason == "final_close"
    s, t, _ = run(kind, df, 100_000.0, sizes=(PositionSize("S", fixed_amount=10_000),), cooldowns=(Cooldown(5),))
    assert s.num_trades == 1


def test_cooldown_blocks_reentry(spark):
    df = signalled(bars(spark, [100] * 10), set(range(10)), {1, 6})
    _, t, e = run("portfolio", df, cooldowns=(Cooldown(3, trigger="sell", blocks="buy"),))
    assert [str(x.datetime)[8:10] for x in t if x.side == "BUY"] == ["01", "05", "10"]
    _, t, e = run("single", df, cooldowns=(Cooldown(4, "S", trigger="buy"),))
    assert [str(x.datetime)[8:10] for x in t if x.side == "BUY"] == ["01", "05", "09"]
    assert len(e) < 10  # bars that a cooldown skips have no equity row


def test_scaling(spark):
    df = signalled(bars(spark, [100, 100, 100, 100, 100, 100]), {0}).withColumn("scale_in", F.col("datetime") <= F.lit("2024-01-04").cast("timestamp_ntz")).withColumn("scale_out", F.col("datetime") == F.lit("2024-01-05").cast("timestamp_ntz"))
    rule = Scaling("S", max_entries=3, scale_in=(50.0, 20.0), scale_out=(25.0,), max_position_percentage=90.0)
    _, t, e = run("portfolio", df, sizes=(PositionSize("S", 40.0),), scaling=(rule,))
    assert [(x.reason, round(x.quantity, 6)) for x in sorted(t, key=lambda x: (x.datetime, x.reason))] == [("buy_signal", 40.0), ("scale_in", 20.0), ("scale_in", 8.0), ("scale_out", 17.0), ("final_close", 51.0)]
    assert e[-1].total_equity == pytest.approx(10_000)


def test_shared_cash_and_calendar(spark):
    a = signalled(bars(spark, [100 + 0.2 * k for k in range(60)], "A"), {0}, {59})
    b = signalled(bars(spark, [200 - 0.1 * k for k in range(58)], "B", start="2024-01-03"), {0, 2}, {59})
    half = tuple(PositionSize(s, 50.0) for s in "AB")
    s, t, e = run("portfolio", a.union(b), sizes=half, symbols=("A", "B"))
    assert {x.symbol for x in t} == {"A", "B"} and len(e) == 60
    assert all(abs(x.cash + x.position_value - x.total_equity) < 1e-9 and x.cash >= -1e-9 for x in e)
    s, t, e = run("portfolio", a.union(b), symbols=("B", "A"))
    assert [x.symbol for x in t if x.side == "BUY"] == ["A"]  # B has no signal on its bars before the 3rd; A takes all


def test_fixed_sizing(spark):
    df = signalled(bars(spark, [100, 200, 200, 100]), {0, 2}, {1})
    sized = sim.Rules(sizes=(PositionSize("S", 50.0),))
    grown = sim.trades_of(sim.simulate_portfolio(df, sized, 10_000.0)).where("side = 'BUY'").orderBy("datetime").collect()
    fixed = sim.trades_of(sim.simulate_portfolio(df, sized, 10_000.0, dynamic=False)).where("side = 'BUY'").orderBy("datetime").collect()
    assert [x.price * x.quantity for x in grown] == pytest.approx([5000, 7500]) and [x.price * x.quantity for x in fixed] == pytest.approx([5000, 5000])


def test_orders_fill_next_open(spark):
    df = signalled(bars(spark, [100, 100, 100, 110, 110], opens=[100, 101, 100, 109, 110]), {0}, {2})
    free = StatutoryCosts(stt_pct_sell=0, stamp_duty_pct_buy=0, transaction_charge_pct=0, sebi_per_crore=0, slippage_pct=0)
    rows = sim.simulate_orders(df, 10_000.0, free)
    t = sim.trades_of(rows).orderBy("datetime").collect()
    assert [(x.side, x.price, x.quantity) for x in t] == [("BUY", 101, 100), ("SELL", 109, 100)] and t[1].pnl == 800
    e = sim.equity_of(rows).orderBy("datetime").collect()
    assert e[1].cash == -100 and e[-1].total_equity == 10_800
    assert sim.trades_of(sim.simulate_orders(signalled(bars(spark, [1, 2]), (), {0}))).count() == 0
    s = sim.curve_summary(rows).collect()[0]
    assert s.total_return == pytest.approx(0.08) and s.num_trades == 1 and s.win_rate == 1
    r = sim.run_records(MovingAverageCross(2, 3), rows, 10_000.0).collect()[0]
    assert r.symbols == ["S"] and '"fast": "2"' in r.parameters


def test_simulators_agree_with_closed_form(spark):
    import math

    df = bars(spark, [100 + 10 * math.sin(k / 5) + k / 10 for k in range(150)])
    s = MovingAverageCross(3, 9).signals(df)
    want = [r.total_equity for r in closed_form.equity_curve(s).orderBy("datetime").collect()]
    for f in (sim.simulate_portfolio, sim.simulate_single):
        assert [r.total_equity for r in sim.equity_of(f(s)).orderBy("datetime").collect()] == pytest.approx(want)
    costly = closed_form.equity_curve(s, cost=0.001).orderBy(F.desc("datetime")).first().total_equity
    assert costly < want[-1]


def test_strategies(spark):
    with pytest.raises(StrategyError):
        Strategy(time_unit="MINUTE", every=5, intervals=("15m",))
    with pytest.raises(StrategyError):
        Strategy(nonsense=1)
    with pytest.raises(StrategyError):
        PositionSize("S").amount(1.0)
    with pytest.raises(ValueError):
        Cooldown(-1)
    s = MovingAverageCross(2, 4, symbols=("S",), stop_losses=(Exit("S", 5.0),))
    assert s.parameters()["fast"] == "2" and "stop_losses" not in s.parameters() and s.strategy_id == "MovingAverageCross"
    rows = sim.backtest(s, bars(spark, [5, 4, 3, 2, 3, 4, 5, 6, 7, 8]), start="2024-01-02", end="2024-01-09")
    assert sim.trades_of(rows).where("side = 'BUY'").count() == 1 and sim.equity_of(rows).count() == 8

    from tests.test_factors import Momentum, panel

    p = panel(spark)
    assert sim.summary(sim.backtest(PipelineStrategy(Momentum, "rank", 2, descending=True), p)).collect()[0].total_return > 0


def test_cooldown_state():
    s = CooldownState()
    s.record("A", "buy", 3)
    assert s.blocks((Cooldown(2),), "buy", "B", 4) and not s.blocks((Cooldown(2),), "buy", "B", 5)
    assert not s.blocks((Cooldown(9, "B"),), "buy", "A", 4) and not s.blocks((Cooldown(9, trigger="sell"),), "buy", "A", 4)
    assert not s.blocks((Cooldown(9, blocks="sell"),), "buy", "A", 4)


def test_sweep(spark):
    grid = sweep.ParameterGrid({"fast": [2, 3], "slow": [5, 8]})
    assert len(grid) == 4 and list(grid)[1] == {"fast": 2, "slow": 8} and grid.frame(spark).count() == 4
    import math

    df = bars(spark, [100 + 10 * math.sin(k / 3) for k in range(80)])
    one_by_one = sweep.sweep(df, grid, lambda p, q: closed_form.moving_average_cross(p, q["fast"], q["slow"]))
    want = {r.run_id: r.e / 100_000 - 1 for r in one_by_one.groupBy("run_id").agg(F.max_by("total_equity", "datetime").alias("e")).collect()}
    got = sweep.cross_sweep(df, [2, 3], [5, 8])
    assert {r.run_id: pytest.approx(r.total_return) for r in got.collect()} == want
    assert sweep.best(got, "total_return").collect()[0].run_id == max(want, key=want.get)
    out = sweep.try_sweep(df, sweep.ParameterGrid({"x": [1, 0]}), lambda p, q: {"y": 1 / q["x"]})
    assert out[0]["result"] == {"y": 1.0} and out[1]["error"].startswith("ZeroDivisionError")
