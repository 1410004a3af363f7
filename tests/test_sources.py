import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barline.operators import calendar as cal
from barline.schema import Interval, ProviderError, SymbolNotFound, TimeUnit, UnsupportedInterval
from barline.sources import options, panels, providers as p, store
from tests.helpers import bars, column


def test_names():
    assert Interval.of("1D") is Interval.DAY and Interval.of("1h").minutes == 60 and Interval.of(Interval.WEEK).minutes == 10080
    assert Interval.MINUTE_5.is_intraday and not Interval.DAY.is_intraday
    with pytest.raises(UnsupportedInterval):
        Interval.of("7m")
    assert TimeUnit.of("days") is TimeUnit.DAY and TimeUnit.MONTH.after(date(2024, 1, 1), 2) == date(2024, 3, 1) and TimeUnit.HOUR.after(date(2024, 1, 1), 5) == date(2024, 1, 1)


def test_panels(spark):
    a = bars(spark, [1, 2, 3], "x").drop("symbol").withColumnRenamed("close", "Close")
    b = bars(spark, [5], "y", start="2024-01-02").drop("symbol").withColumn("extra", F.lit(7))
    out = panels.union({"aaa_day": a, "bbb": b})
    assert out.columns[:2] == ["datetime", "symbol"] and sorted((r.symbol, r.extra) for r in out.collect()) == [("AAA", None)] * 3 + [("BBB", 7)]
    d = panels.densify(bars(spark, [1, 2, 3], "A").union(bars(spark, [5], "B", start="2024-01-02")))
    assert column(d.where("symbol = 'B'"), "close") == [5.0, 5.0, 5.0] and column(d.where("symbol = 'B'"), "observed") == [False, True, False]
    d = panels.densify(bars(spark, [1, 2, 3], "A").union(bars(spark, [5], "B", start="2024-01-02")), backward=False)
    assert column(d.where("symbol = 'B'"), "close") == [None, 5.0, 5.0]
    assert panels.between(bars(spark, [1, 2, 3]), "2024-01-02", "2024-01-03").count() == 2
    assert panels.latest_bars(bars(spark, [1, 2, 3])).first().close == 3


def test_candles_and_instruments(spark):
    payload = json.dumps([["2024-08-05T09:15:00+05:30", 100, 106, 99, 104, 1000, 0], ["2024-08-06T09:15:00+05:30", 104.5, 107, 103, 105, None, 0]])
    rows = p.candles(spark.createDataFrame([("S", payload)], "symbol string, candles string")).orderBy("datetime").collect()
    assert [r.close for r in rows] == [104, 105] and rows[0].datetime == datetime(2024, 8, 5, 9, 15) and rows[1].volume == 0
    raw = spark.createDataFrame([("reliance", "NSE_EQ", "EQ", "NSE_EQ|INE002A01018"), ("fut", "NSE_FO", "FUT", "k")], "trading_symbol string, segment string, instrument_type string, instrument_key string")
    master = p.instruments(raw, "NSE_EQ")
    asked = spark.createDataFrame([("Reliance",)], "symbol string")
    assert p.resolve(asked, master).first().instrument_key == "NSE_EQ|INE002A01018"
    with pytest.raises(Exception, match="unknown symbol"):
        p.resolve(spark.createDataFrame([("none",)], "symbol string"), master).collect()
    s = spark.createDataFrame([("abc", "NSE"), ("abc", "BSE"), ("abc.ns", "BSE")], "s string, e string")
    assert [r[0] for r in s.select(p.suffixed(F.col("s"), F.col("e"))).collect()] == ["ABC.NS", "ABC.BO", "ABC.NS"]


def test_chunks_and_ranges(spark):
    rows = p.chunks(spark, "2024-01-01", "2024-03-15", "1m").orderBy("chunk_no").collect()
    assert len(rows) == 3 and rows[0].chunk_end == rows[1].chunk_start and rows[-1].chunk_end == date(2024, 3, 15)
    assert p.chunks(spark, "2000-01-01", "2024-01-01", "day").count() == 3
    assert p.chunks(spark, "2024-01-01", "2024-01-01", "day").count() == 1
    assert p.date_range(None, date(2024, 2, 29)) == (date(2019, 2, 28), date(2024, 2, 29))
    with pytest.raises(ProviderError):
        p.date_range(date(2024, 2, 1), date(2024, 1, 1))


def test_providers(spark, tmp_path):
    bars(spark, [1, 2, 3], "ABC").withColumn("interval", F.lit("day")).write.partitionBy("interval").parquet(str(tmp_path / "bars"))
    files = p.FileProvider(spark, str(tmp_path / "bars"))
    assert files.bars("abc", "1d", date(2024, 1, 2), date(2024, 1, 3)).count() == 2
    with pytest.raises(ProviderError):
        files.bars("abc", "week", date(2024, 1, 1), date(2024, 1, 3))

    class Daily(p.Provider):
        intervals = (Interval.DAY,)

        def bars(self, symbol, interval, start=None, end=None, exchange="NSE"):
            self.checked(interval)
            return bars(spark, [9], symbol)

        def instrument(self, symbol, exchange="NSE"):
            raise SymbolNotFound(symbol)

    chain = p.ChainedProvider(files, Daily())
    assert chain.bars("other", "day").first().close == 9
    with pytest.raises(ProviderError):
        chain.bars("other", "1m")
    with pytest.raises(ProviderError):
        chain.instrument("other")
    assert [r.close for r in p.prefer(bars(spark, [1]), bars(spark, [7, 8])).orderBy("datetime").collect()] == [1.0, 8.0]


def test_candle_source(spark, tmp_path):
    rows = [[f"2024-01-{k:02d}T10:00:00+05:30", k, k + 1, k - 1, k, 10, 0] for k in range(1, 32)]
    (tmp_path / "ABC.json").write_text(json.dumps(rows))
    spark.dataSource.register(p.CandleSource)
    df = spark.read.format("candles").options(path=str(tmp_path), symbol="abc", start="2024-01-02", end="2024-01-20", chunk_days="7").load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 19 and df.agg(F.sum("close")).first()[0] == sum(range(2, 21))


def test_options(spark):
    df = spark.createDataFrame([("NIFTY", ["2024-08-29", "2024-09-26"], [100.0, 110.0])], "underlying string, expiries array<string>, strikes array<double>")
    got = options.chain(df).collect()
    assert len(got) == 8 and {r.option_type for r in got} == {"CE", "PE"} and got[0].symbol == "NIFTY_2024-08-29_100.0_CE"

    def fails(_):
        raise ProviderError("down")

    made = options.chain_or_synthetic(spark, "X", fails).collect()
    assert len(made) == 10 and {r.strike for r in made} == {100.0, 110.0, 120.0, 130.0, 140.0}


def test_calendar(spark):
    hol = spark.createDataFrame([(date(2024, 8, 15),)], "day date")
    days = spark.createDataFrame([(date(2024, 8, d),) for d in (3, 4, 6, 15)], "day date")
    assert [r.open for r in cal.is_trading_day(days, hol).orderBy("day").collect()] == [False, False, True, False]
    nxt = {r.day.day: r.next_day for r in cal.nearest_trading_day(days, hol).collect()}
    assert nxt == {3: date(2024, 8, 5), 4: date(2024, 8, 5), 6: date(2024, 8, 6), 15: date(2024, 8, 16)}
    before = {r.day.day: r.previous_day for r in cal.nearest_trading_day(days, hol, forward=False).collect()}
    assert before[15] == date(2024, 8, 14) and before[4] == date(2024, 8, 2)
    assert cal.trading_days_between(spark, "2024-08-12", "2024-08-16", hol).count() == 4
    assert cal.trading_days_between(spark, "2024-08-12", "2024-08-16", hol, inclusive=False).count() == 2
    assert cal.holidays_between(hol, "2024-08-01", "2024-08-31").count() == 1
    h = spark.range(1).select(cal.market_hours(F.lit("2024-08-06").cast("date")).alias("h")).select("h.*").first()
    assert (h.opens.hour, h.opens.minute, h.closes.hour) == (3, 45, 10)


def test_nearest_trading_day_far_away(spark):
    """All days of three years are holidays; so is the day asked for first."""
    off = [date(2021, 1, 1) + timedelta(days=k) for k in range(1095)]
    hol = spark.createDataFrame([(d,) for d in off], "day date")
    days = spark.createDataFrame([(d,) for d in (off[0], off[500], off[500], off[-1], None)], "day date")
    assert [r.next_day for r in cal.nearest_trading_day(days, hol).orderBy("day").collect()] == [None] + 4 * [date(2024, 1, 1)]
    assert [r.previous_day for r in cal.nearest_trading_day(days, hol, forward=False).orderBy("day").collect()] == [None] + 4 * [date(2020, 12, 31)]
    assert cal.nearest_trading_day(days.limit(0), hol.limit(0)).count() == 0


def test_cache_and_content(spark, tmp_path):
    c = store.BarCache(spark, str(tmp_path / "cache"))
    key = ("files", "abc", "day", "2024-01-01", "2024-01-31")
    assert c.get(*key) is None
    c.put(bars(spark, [1, 2]), *key)
    assert c.get("files", "ABC", *key[2:]).count() == 2 and c.has(*key)
    c.clear()
    assert not c.has(*key)
    s = store.ContentStore(spark, str(tmp_path / "content"))
    one = s.put(bars(spark, [1, 2, 3]))
    assert s.put(bars(spark, [1, 2, 3]).repartition(3).orderBy("close", ascending=False)) == one
    assert s.put(bars(spark, [1, 2, 4])) != one and s.put(bars(spark, [1, 2, 3]), "other") != one
    assert s.get(one).count() == 3 and s.get("0" * 64) is None


def test_bundle_index_ranks_audit(spark, tmp_path):
    e = spark.createDataFrame([(k, 100.0 + k) for k in range(3)], "k int, equity double")
    path = store.save_bundle(str(tmp_path / "run"), {"total_return": 0.05}, e, e.limit(1), {"note": "x"})
    assert path.endswith(".bundle")
    assert "trades" not in store.load_bundle(spark, path, summary_only=True) and store.load_bundle(spark, path, True)["trades_path"] == "trades"
    full = store.load_bundle(spark, path)
    assert full["summary"]["total_return"] == 0.05 and full["equity_curve"].count() == 3 and full["extra"] == {"note": "x"}
    ix = store.RunIndex(spark, str(tmp_path / "runs"))
    fields = "backtest_id string, strategy_id string, symbols array<string>, total_return double, max_drawdown double, num_trades long, parameters string"
    ix.insert(spark.createDataFrame([("a", "s", ["X"], 0.1, 0.0, 1, "{}"), (None, "s", ["X"], 0.3, 0.0, 1, "{}"), (None, "t", ["X"], 0.2, 0.0, 1, "{}")], fields).coalesce(1))
    ix.insert(spark.createDataFrame([("a", "s", ["X"], 0.5, 0.0, 1, "{}")], fields))
    assert ix.query("s", 0.4).collect()[0].total_return == 0.5 and ix.query("s").count() == 2
    r = store.RankIndex(spark, str(tmp_path / "ranks"))
    put = lambda rows: r.put(spark.createDataFrame([("2024-01-01", "mom", *x) for x in rows], "date string, factor_name string, symbol string, value double"))
    put([("Z", 9.0)])
    put([("A", 0.3), ("B", 0.1), ("C", 0.2), ("D", None)])
    assert [x.symbol for x in r.top("2024-01-01", "mom", 2).collect()] == ["A", "C"]
    assert [x.rank for x in r.top("2024-01-01", "mom", 9).collect()] == [1, 2, 3, 4] and r.exists("2024-01-01", "mom") and not r.exists("2024-01-02", "mom")
    log = store.AuditLog(spark, str(tmp_path / "audit"))
    log.append("chat", {"Token": "t", "deep": [{"password": "p", "x": 1}]}, "s1")
    log.append("other", {}, "s2")
    got = log.query("chat").collect()
    assert len(got) == 1 and json.loads(got[0].detail) == {"Token": "[REDACTED]", "deep": [{"password": "[REDACTED]", "x": 1}]}
    assert [x.action for x in log.query(limit=1).collect()] == ["other"]


def test_report(spark, tmp_path):
    from barline.operators.report import Report
    from tests.helpers import curve

    e = curve(spark, [100 + k % 7 for k in range(100)])
    t = spark.createDataFrame([("r", datetime(2023, 1, d), "S", side, 1.0, 1.0, 0.0, pnl, "x") for d, side, pnl in ((2, "BUY", 0.0), (5, "SELL", 3.0), (8, "BUY", 0.0), (9, "SELL", -1.0))], store.TRADES)
    r = Report("r", e, t, "A <title>")
    d = r.to_dict()
    assert d["metrics"]["num_trades"] == 2 and len(d["equity_curve"]) == 100 and d["monthly_heatmap"] and d["drawdown"] and len(d["trades"]) == 4
    assert "## Metrics" in r.to_markdown() and "&lt;title&gt;" in r.to_html() and "polyline" in r.to_html()
    assert json.loads(r.to_json())["run_id"] == "r"
    assert "120.0" in Report._line([5.0, 5.0])  # a flat curve
    r.save(str(tmp_path / "out.md"))
    assert (tmp_path / "out.md").read_text().startswith("# A")


def test_report_is_whole(spark):
    from barline.operators.report import Report
    from tests.helpers import curve

    e = curve(spark, [100.0 + k for k in range(2501)] + [1.0])
    t = spark.createDataFrame([("r", datetime(2023, 1, 1) + timedelta(days=k), f"S{k}", "BUY", 1.0, 1.0, 0.0, 0.0, "x") for k in range(25)], store.TRADES)
    r = Report("r", e, t)
    d = json.loads(r.to_json())
    assert len(d["equity_curve"]) == len(d["drawdown"]) == 2502 and d["equity_curve"][-1]["total_equity"] == 1.0 and len(d["trades"]) == 25
    assert "S24" in r.to_html() and r.to_html().count(",") < 4500  # the lines are thinned
    text = r.to_markdown()
    assert "S19" in text and "S20" not in text and "_Showing first 20 of 25 trades._" in text
