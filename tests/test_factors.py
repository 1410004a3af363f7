import pytest
from pyspark.sql import functions as F

from barline.plans import factors as f
from barline.plans.pipeline import Pipeline, last_date_top, rank_signals, run_pipeline
from tests.helpers import bars


def panel(spark, n_bars=10, n_symbols=4):
    out = None
    for j in range(n_symbols):
        b = bars(spark, [100 + (i + 1) * (j + 1) for i in range(n_bars)], f"SYM{j}", volume=1000 * (j + 1))
        out = b if out is None else out.union(b)
    return out


def test_warm_up_nulls(spark):
    out = f.evaluate(panel(spark, n_symbols=2), {"r": f.returns(2), "s": f.sma(3)})
    assert out.where("r IS NULL").count() == 4 and out.where("s IS NULL").count() == 4


def test_cross_section(spark):
    r = f.returns(2)
    out = f.evaluate(panel(spark, n_symbols=5), {"z": r.zscore(), "top": r.top(3), "rank": r.rank(), "d": (r * 2) - r - r, "c": 1 / (r - r)})
    rows = out.where("z IS NOT NULL").groupBy("datetime").agg(F.abs(F.avg("z")).alias("m"), F.count_if("top").alias("n"), F.sort_array(F.collect_list("rank")).alias("ranks")).collect()
    assert rows and all(x.m < 1e-9 and x.n == 3 and x.ranks == [1.0, 2.0, 3.0, 4.0, 5.0] for x in rows)
    assert out.where("d IS NOT NULL AND d <> 0").count() == 0 and out.where("c IS NOT NULL").count() == 0


def test_masks_groups_quantiles(spark):
    r, adv = f.returns(1), f.average_dollar_volume(1)
    groups = {"sym0": "A", "SYM1": "A", "SYM2": "B"}
    out = f.evaluate(panel(spark), {"m": r.rank(mask=adv.top(2)), "g": r.demean(groups=groups), "w": r.winsorize(0.34, 0.66), "l": f.static_per_symbol(groups), "b": ~adv.bottom(1) & adv.top(4)})
    day = {x.symbol: x for x in out.where("datetime = timestamp_ntz '2024-01-05'").collect()}
    assert [day[f"SYM{k}"].m is None for k in range(4)] == [True, True, False, False]
    assert day["SYM0"].g == pytest.approx(-day["SYM1"].g) and day["SYM2"].g == pytest.approx(0) and day["SYM3"].l is None
    assert day["SYM0"].w == day["SYM1"].w and day["SYM3"].w == day["SYM2"].w
    assert [day[f"SYM{k}"].b for k in range(4)] == [False, True, True, True]


def test_null_prices_are_carried(spark):
    df = bars(spark, [100, 100, 110]).withColumn("close", F.when(F.col("datetime") != F.lit("2024-01-02").cast("timestamp_ntz"), F.col("close")))
    rows = f.evaluate(df, {"r": f.returns(1)}).orderBy("datetime").collect()
    assert [x.r for x in rows] == [None, 0.0, pytest.approx(0.1)]


def test_shared_nodes_and_plan(spark):
    a, b = f.returns(5).zscore(), f.returns(5).zscore()
    assert a == b and hash(a) == hash(b) and a != f.returns(4).zscore()
    nodes = {f"x{k}": f.sma(k + 2).rank() + f.returns(k + 1).zscore() for k in range(4)}
    plan = f.evaluate(panel(spark), nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # by symbol, by time
    assert f.returns(5).zscore(mask=f.average_dollar_volume(3).top(2)).required_columns() == ["close", "volume"]
    assert f.returns(5).zscore(mask=f.average_dollar_volume(9).top(2)).required_window() == 9


def test_errors():
    with pytest.raises(ValueError):
        f.sma(0)
    with pytest.raises(ValueError):
        f.latest().winsorize(0.9, 0.1)
    with pytest.raises(TypeError):
        f.latest() + "x"
    with pytest.raises(TypeError):

        class Empty(Pipeline):
            pass

    with pytest.raises(TypeError):

        class Wrong(Pipeline):
            x = f.latest()
            universe = f.latest()


class Base(Pipeline):
    close = f.latest()
    _hidden = f.latest()


class Momentum(Base):
    ret = f.returns(1)
    rank = f.returns(1).rank()
    universe = f.average_dollar_volume(1).top(3)


def test_pipeline(spark):
    assert list(Momentum.columns()) == ["close", "ret", "rank"]
    out = run_pipeline(panel(spark), Momentum, "2024-01-03", "2024-01-05")
    assert out.columns == ["datetime", "symbol", "close", "ret", "rank"] and out.count() == 9
    assert out.where("ret IS NULL").count() == 3  # dates come before windows
    assert run_pipeline(panel(spark), Momentum, "2024-01-03", "2024-01-05", warm_up=True).where("ret IS NULL").count() == 0
    upper = panel(spark).withColumnsRenamed({c: c.title() for c in panel(spark).columns})
    assert run_pipeline(upper, Momentum).count() == run_pipeline(panel(spark), Momentum).count()


def test_rank_bridge(spark):
    p = panel(spark)
    ranked = run_pipeline(p, Momentum)
    day = "datetime = timestamp_ntz '2024-01-05'"
    assert [r.symbol for r in rank_signals(p, ranked, "rank").where(day).where("buy").collect()] == []  # the lowest rank is outside of the universe
    s = rank_signals(p, ranked, "rank", 2)
    assert s.where("buy = sell").count() == 0 and s.count() == p.count()
    assert [r.symbol for r in rank_signals(p, ranked, "rank", 1, descending=True).where(day).where("buy").collect()] == ["SYM3"]
    assert [r.symbol for r in last_date_top(ranked, "rank", 2).collect()] == ["SYM1", "SYM2"]
