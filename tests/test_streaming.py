from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from barline.plans import tools
from barline.streaming.bars import bar_stream
from barline.streaming.live import LiveRunner, cross_signals, market_open
from tests.helpers import bars

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drain(df, spark, tmp_path, mode="append"):
    q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table("out")


def test_bars_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(EVENTS)
    (tmp_path / "in").mkdir()
    events.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    make = lambda df: bar_stream(df, "event_type", "ts", "value", "1 day", tie="event_id")
    want = {tuple(r) for r in make(events).collect()}
    got = {tuple(r) for r in drain(make(stream), spark, tmp_path).collect()}
    last = max(r[1] for r in want)
    assert got <= want and {r for r in want if r[1] < last} == got  # the last day's windows are still open


def test_cross_signals_over_batches(spark, tmp_path):
    closes = [10, 9, 8, 7, 6, 7, 9, 12, 14, 10, 6, 3, 2, 9, 15, 20]
    df = bars(spark, closes).withColumn("datetime", F.col("datetime").cast("timestamp"))
    (tmp_path / "in").mkdir()
    for k in range(4):  # four files, one micro-batch each; the third repeats bars already seen
        df.where(F.dayofmonth("datetime").between(4 * k + (1 if k != 2 else -1), 4 * k + 4)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.datetime: r.signal for r in drain(cross_signals(stream, 2, 4), spark, tmp_path).collect()}
    assert got and len(got) == len(closes) - 4
    for n in range(5, len(closes) + 1):
        upto = bars(spark, closes[:n])
        want = tools.last_signal(upto, 2, 4).first()
        assert got[want.datetime] == want.signal


def test_cross_signals_round_as_the_batch(spark, tmp_path):
    """Both means of the last bar are equal but for roundings."""
    closes = [47.49, 23.55, 1.71, 54.1, 41.61, 28.89, 17.4, 64.49, 26.54, 33.62, 7.81]
    df = bars(spark, closes).withColumn("datetime", F.col("datetime").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = drain(cross_signals(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))), spark, tmp_path).collect()
    want = tools.last_signal(bars(spark, closes)).first()
    assert [(r.signal, r.fast, r.slow) for r in got] == [(want.signal, want.fast, want.slow)]


def test_cross_signals_of_one_time(spark, tmp_path):
    """Ticks of one time are all kept, over batches, too; a tick that comes again is not."""
    t0 = datetime(2024, 1, 1, 4)
    ticks = [(k, "S", t0 + timedelta(minutes=k // 3), float(c)) for k, c in enumerate([5, 4, 3, 4, 6, 3, 2, 6, 9, 2, 1, 8])]
    schema = "id long, symbol string, datetime timestamp, close double"
    for part in (ticks[4::-1], ticks[:4:-1] + ticks[3:5]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(cross_signals(stream, 1, 2, tie="id"), spark, tmp_path).collect()
    assert sorted((r.datetime, r.price) for r in got) == sorted(t[2:] for t in ticks[2:])
    assert [r.signal for r in got] == ["HOLD", "BUY", "HOLD", "SELL", "HOLD", "BUY", "HOLD", "SELL", "HOLD", "BUY"]


def test_order_cap(spark):
    closes = [5, 4, 3, 4, 6, 3, 2, 6, 9, 2, 1, 8, 9]
    t0 = datetime(2024, 1, 1, 4)
    df = spark.createDataFrame([("S", t0 + timedelta(minutes=k), float(c)) for k, c in enumerate(closes)], "symbol string, datetime timestamp, close double")
    import tempfile

    folder = tempfile.mkdtemp()
    df.write.mode("overwrite").parquet(f"{folder}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{folder}/in")
    q = cross_signals(stream, 1, 2, most_orders=2).writeStream.format("memory").queryName("capped").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("capped").where("signal <> 'HOLD'").orderBy("datetime").collect()
    assert len(rows) > 2 and [r.accepted for r in rows] == [True, True] + [False] * (len(rows) - 2)


def test_market_hours_and_runner(spark):
    zone = ZoneInfo("Asia/Kolkata")
    at = lambda *x: datetime(*x, tzinfo=zone)
    assert market_open(at(2024, 8, 6, 10)) and not market_open(at(2024, 8, 6, 16)) and not market_open(at(2024, 8, 3, 10))
    assert not market_open(at(2024, 8, 15, 10), frozenset({at(2024, 8, 15).date()}))
    placed = []

    def signal(symbol, bar):
        if symbol == "BAD":
            raise ValueError("no")
        return "BUY" if bar["close"] > 1 else None

    run = LiveRunner(["S", "BAD"], signal, placed.append, most_orders=2, clock=lambda: at(2024, 8, 6, 10))
    b = bars(spark, [1, 2]).union(bars(spark, [5], "BAD")).union(bars(spark, [5], "OTHER"))
    for k in range(3):
        run.batch(b, k)
    assert len(placed) == 2 and placed[0]["price"] == 2 and len(run.failed) == 3
    closed = LiveRunner(["S"], signal, placed.append, clock=lambda: at(2024, 8, 6, 20))
    closed.batch(b)
    assert len(placed) == 2


def test_live_runner_restarts(spark, tmp_path):
    placed, folder, day = [], str(tmp_path / "orders"), [6]
    now = lambda: datetime(2024, 8, day[0], 10, tzinfo=ZoneInfo("Asia/Kolkata"))
    new = lambda: LiveRunner(["S", "T"], lambda symbol, bar: "BUY", placed.append, most_orders=2, clock=now, journal=folder)
    b = bars(spark, [1, 2]).union(bars(spark, [5], "T"))
    first = new()
    first.batch(b.where("symbol = 'S'"))
    again = new()
    for k in range(3):
        again.batch(b, k)
    assert [o["symbol"] for o in placed] == ["S", "S", "T", "T"] and not again.failed
    day[0] = 7
    again.batch(b)
    assert len(placed) == 6


def test_tools(spark):
    from tests.test_factors import panel

    p = panel(spark)
    assert tools.bars_summary(p).where("symbol = 'SYM0'").first().rows == 10
    assert [r.symbol for r in tools.rank_symbols(p, 2, 2).collect()] == ["SYM0", "SYM1"]
    assert [r.symbol for r in tools.rank_symbols(p, 2, 1, descending=True).collect()] == ["SYM3"]
    assert tools.ema_backtest(bars(spark, [5, 4, 3, 4, 5, 6, 7, 6, 5]), 2, 3).count() == 1
