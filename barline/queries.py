"""Registered queries of the analytics engine, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline import oracles
from barline.functions import scalars
from barline.functions.windows import by_symbol, cumulative, elapsed_days, filled
from barline.operators import calendar as cal
from barline.operators import indicators as ind
from barline.operators import metrics as met
from barline.operators import orders as ords
from barline.operators.costs import StatutoryCosts, TradingCost
from barline.operators.paper import paper_trading
from barline.plans import closed_form, factors, simulate, sweep, tools
from barline.plans.pipeline import Pipeline, last_date_top, rank_signals, run_pipeline
from barline.plans.rules import Cooldown, Exit, PositionSize, Scaling
from barline.plans.strategy import MovingAverageCross
from barline.session import work_folder
from barline.sources import options, panels, providers, store
from barline.streaming.bars import bar_stream
from barline.streaming.live import cross_signals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_BARS = """bars AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS datetime, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
    min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume
  FROM orders GROUP BY 1, 2)"""
_W = "(PARTITION BY symbol ORDER BY datetime)"
_CUM = "(PARTITION BY symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"


def _rows(n: int) -> str:
    return f"(PARTITION BY symbol ORDER BY datetime ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _full(value: str, n: int, of: str = "close") -> str:
    return f"CASE WHEN count({of}) OVER {_rows(n)} = {n} THEN {value} END"


def _ewm(x: str, alpha: float) -> str:
    return f"list_reduce(list({x}) OVER {_CUM}, lambda acc, v: acc * {1 - alpha!r}::DOUBLE + v * {alpha!r}::DOUBLE)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), n) for c, n in digits.items()})


# --- indicators --------------------------------------------------------------------------------------


@query("sma", f"WITH {_BARS} SELECT symbol, datetime, round({_full('avg(close) OVER ' + _rows(5), 5)}, 3) AS sma_5 FROM bars")
def sma(spark, d):
    return rounded(ind.sma(panels.order_bars(spark, d), 5).select("symbol", "datetime", "sma_5"), sma_5=3)


@query("ema", f"WITH {_BARS} SELECT symbol, datetime, round({_ewm('close', 2 / 11)}, 2) AS ema_10 FROM bars")
def ema(spark, d):
    return rounded(ind.ema(panels.order_bars(spark, d), 10).select("symbol", "datetime", "ema_10"), ema_10=2)


@query(
    "ema_adjusted",
    f"""WITH {_BARS}, x AS (SELECT *, list_reduce(list(close) OVER {_CUM}, lambda acc, v: acc * {1 - 2 / 11!r}::DOUBLE + v) AS num, row_number() OVER {_W} AS n FROM bars)
    SELECT symbol, datetime, round(num / ((1 - pow({1 - 2 / 11!r}::DOUBLE, n)) / {2 / 11!r}::DOUBLE), 2) AS ema FROM x""",
)
def ema_adjusted(spark, d):
    return rounded(factors.evaluate(panels.order_bars(spark, d).select("symbol", "datetime", "close"), {"ema": factors.ema(10)}).drop("close"), ema=2)


@query(
    "rsi",
    f"""WITH {_BARS}, c AS (SELECT *, close - lag(close) OVER {_W} AS ch FROM bars),
    g AS (SELECT symbol, datetime, CASE WHEN ch > 0 THEN ch ELSE 0.0 END AS gain, CASE WHEN ch < 0 THEN -ch ELSE 0.0 END AS loss FROM c),
    e AS (SELECT symbol, datetime, {_ewm('gain', 1 / 14)} AS up, {_ewm('loss', 1 / 14)} AS down FROM g)
    SELECT symbol, datetime, round(CASE WHEN down = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + up / down) END, 6) AS rsi_14 FROM e""",
)
def rsi(spark, d):
    return rounded(ind.rsi(panels.order_bars(spark, d)).select("symbol", "datetime", "rsi_14"), rsi_14=6)


@query(
    "macd",
    f"""WITH {_BARS}, m AS (SELECT symbol, datetime, {_ewm('close', 2 / 13)} - {_ewm('close', 2 / 27)} AS macd FROM bars),
    s AS (SELECT *, {_ewm('macd', 2 / 10)} AS sig FROM m)
    SELECT symbol, datetime, round(macd, 2) AS macd, round(sig, 2) AS macd_signal, round(macd - sig, 2) AS macd_hist FROM s""",
)
def macd(spark, d):
    return rounded(ind.macd(panels.order_bars(spark, d)).select("symbol", "datetime", "macd", "macd_signal", "macd_hist"), macd=2, macd_signal=2, macd_hist=2)


@query(
    "bollinger",
    f"""WITH {_BARS}, x AS (SELECT symbol, datetime, {_full('avg(close) OVER ' + _rows(20), 20)} AS m, {_full('stddev_samp(close) OVER ' + _rows(20), 20)} AS s FROM bars)
    SELECT symbol, datetime, round(m, 4) AS bb_middle, round(m + 2 * s, 2) AS bb_upper, round(m - 2 * s, 2) AS bb_lower FROM x""",
)
def bollinger(spark, d):
    return rounded(ind.bollinger_bands(panels.order_bars(spark, d)).select("symbol", "datetime", "bb_middle", "bb_upper", "bb_lower"), bb_middle=4, bb_upper=2, bb_lower=2)


@query(
    "atr",
    f"""WITH {_BARS}, t AS (SELECT *, lag(close) OVER {_W} AS p FROM bars),
    r AS (SELECT symbol, datetime, greatest(high - low, abs(high - p), abs(low - p)) AS tr FROM t)
    SELECT symbol, datetime, round({_ewm('tr', 1 / 14)}, 2) AS atr_14 FROM r""",
)
def atr(spark, d):
    return rounded(ind.atr(panels.order_bars(spark, d)).select("symbol", "datetime", "atr_14"), atr_14=2)


@query("returns", f"WITH {_BARS} SELECT symbol, datetime, round(close / nullif(lag(close, 3) OVER {_W}, 0) - 1, 6) AS returns_3 FROM bars")
def returns(spark, d):
    return rounded(ind.returns(panels.order_bars(spark, d), 3).select("symbol", "datetime", "returns_3"), returns_3=6)


@query(
    "volatility",
    f"""WITH {_BARS}, r AS (SELECT symbol, datetime, close / nullif(lag(close) OVER {_W}, 0) - 1 AS ret FROM bars)
    SELECT symbol, datetime, round({_full('stddev_samp(ret) OVER ' + _rows(20), 20, 'ret')}, 6) AS volatility_20 FROM r""",
)
def volatility(spark, d):
    return rounded(ind.volatility(panels.order_bars(spark, d)).select("symbol", "datetime", "volatility_20"), volatility_20=6)


_MEANS = f"""{_BARS}, ma AS (SELECT *, {_full('avg(close) OVER ' + _rows(5), 5)} AS fast, {_full('avg(close) OVER ' + _rows(20), 20)} AS slow FROM bars)"""
_SIGNALS = f"""{_MEANS}, sig AS (SELECT *, coalesce(fast > slow AND lag(fast) OVER {_W} <= lag(slow) OVER {_W}, false) AS buy,
    coalesce(fast < slow AND lag(fast) OVER {_W} >= lag(slow) OVER {_W}, false) AS sell FROM ma)"""
_POSITIONS = f"""{_SIGNALS}, pos AS (SELECT *, coalesce(last_value(CASE WHEN buy THEN 1 WHEN sell THEN 0 END IGNORE NULLS) OVER {_CUM}, 0) AS position FROM sig)"""
_EQUITY = f"""{_POSITIONS}, st AS (SELECT *, CASE WHEN coalesce(lag(position) OVER {_W}, 0) = 1 THEN ln(close / lag(close) OVER {_W}) ELSE 0.0 END AS step FROM pos),
    eq AS (SELECT *, sum(step) OVER {_CUM} AS growth FROM st)"""


def _signals(spark, d):
    return MovingAverageCross(5, 20).signals(panels.order_bars(spark, d))


@query("crossover", f"WITH {_SIGNALS} SELECT symbol, datetime, buy AS crossover FROM sig")
def crossover(spark, d):
    df = ind.sma(ind.sma(panels.order_bars(spark, d), 5, result="fast"), 20, result="slow")
    return ind.crossover(df, "fast", "slow").select("symbol", "datetime", "crossover")


@query("crossunder", f"WITH {_SIGNALS} SELECT symbol, datetime, sell AS crossunder FROM sig")
def crossunder(spark, d):
    df = ind.sma(ind.sma(panels.order_bars(spark, d), 5, result="fast"), 20, result="slow")
    return ind.crossunder(df, "fast", "slow").select("symbol", "datetime", "crossunder")


@query("adtv", f"WITH {_BARS} SELECT symbol, datetime, round({_full('avg(close * volume) OVER ' + _rows(20), 20)}, 4) AS adtv FROM bars")
def adtv(spark, d):
    return rounded(ind.liquidity(panels.order_bars(spark, d)).select("symbol", "datetime", "adtv"), adtv=4)


# --- panels, sources ---------------------------------------------------------------------------------


@query(
    "ffill_calendar",
    f"""WITH {_BARS}, grid AS (SELECT * FROM (SELECT DISTINCT datetime FROM bars), (SELECT DISTINCT symbol FROM bars)),
    j AS (SELECT g.symbol, g.datetime, b.close, b.volume FROM grid g LEFT JOIN bars b ON g.symbol = b.symbol AND g.datetime = b.datetime)
    SELECT symbol, datetime, coalesce(last_value(close IGNORE NULLS) OVER {_CUM}, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY datetime ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close,
      CAST(coalesce(volume, 0) AS BIGINT) AS volume, close IS NOT NULL AS observed FROM j""",
)
def ffill_calendar(spark, d):
    return panels.densify(panels.order_bars(spark, d)).select("symbol", "datetime", "close", "volume", "observed")


@query(
    "panel_union",
    """SELECT 'ORDERS' AS symbol, o_orderdate AS datetime, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS BIGINT) AS volume FROM orders GROUP BY 2
    UNION ALL SELECT 'EVENTS', date_trunc('hour', ts), arg_max(value, row(ts, event_id)), NULL FROM events GROUP BY 2""",
)
def panel_union(spark, d):
    orders = panels.table(spark, d, "orders").withColumn("all", F.lit("x")).withColumn("datetime", F.col("o_orderdate"))
    a = panels.resample(orders, "all", "datetime", "o_totalprice", "day", ["o_orderkey"])
    b = panels.resample(panels.table(spark, d, "events").withColumn("all", F.lit("x")), "all", "ts", "value", "hour", ["event_id"])
    return panels.union({"orders_day": a.select("datetime", "close", "volume"), "events": b.select(F.col("datetime").alias("Datetime"), F.col("close").alias("Close"))}).select("symbol", "datetime", "close", "volume")


@query("resample_events", "SELECT event_type AS symbol, date_trunc('hour', ts) AS datetime, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def resample_events(spark, d):
    return panels.event_bars(spark, d, "hour")


@query("resample_events_day", "SELECT event_type AS symbol, date_trunc('day', ts) AS datetime, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2")
def resample_events_day(spark, d):
    """The streaming operator on a batch: the same plan as on a stream."""
    bars = bar_stream(panels.table(spark, d, "events"), "event_type", "ts", "value", "1 day", tie="event_id")
    return bars.withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query("latest_bar", f"WITH {_BARS} SELECT symbol, max(datetime) AS datetime, arg_max(open, datetime) AS open, arg_max(high, datetime) AS high, arg_max(low, datetime) AS low, arg_max(close, datetime) AS close, arg_max(volume, datetime) AS volume FROM bars GROUP BY symbol")
def latest_bar(spark, d):
    return panels.latest_bars(panels.order_bars(spark, d))


@query("time_range", f"WITH {_BARS} SELECT symbol, datetime, close FROM bars WHERE datetime >= TIMESTAMP '1996-01-01' AND datetime <= TIMESTAMP '1996-06-30 23:59:59.999999'")
def time_range(spark, d):
    return panels.between(panels.order_bars(spark, d), "1996-01-01", "1996-06-30").select("symbol", "datetime", "close")


@query(
    "dedup_keep_first",
    """WITH x AS (SELECT 'S' || l_suppkey AS symbol, l_shipdate AS datetime, l_extendedprice AS price, l_orderkey AS chunk, l_linenumber AS line, l_partkey AS part FROM lineitem)
    SELECT symbol, datetime, min(row(chunk, line, part, price)).chunk AS chunk, round(min(row(chunk, line, part, price)).price, 2) AS price FROM (SELECT symbol, datetime, chunk, line, part, price FROM x) GROUP BY 1, 2""",
)
def dedup_keep_first(spark, d):
    rows = panels.table(spark, d, "lineitem").select(F.concat(F.lit("S"), "l_suppkey").alias("symbol"), F.col("l_shipdate").alias("datetime"), F.round("l_extendedprice", 2).alias("price"), F.col("l_orderkey").alias("chunk"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").alias("k"))
    return providers.keep_first(rows, "k").select("symbol", "datetime", "chunk", "price")


SQL["dedup_keep_first"] = """SELECT symbol, datetime, chunk, price FROM (
  SELECT 'S' || l_suppkey AS symbol, l_shipdate AS datetime, l_orderkey AS chunk, round(l_extendedprice, 2) AS price,
    row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem) WHERE k = 1"""


@query(
    "date_chunks",
    """WITH s AS (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-08-06', INTERVAL 30 DAY))::DATE AS chunk_start),
    e AS (SELECT row_number() OVER (ORDER BY chunk_start) - 1 AS chunk_no, chunk_start, coalesce(lead(chunk_start) OVER (ORDER BY chunk_start), DATE '2024-08-06') AS chunk_end FROM s)
    SELECT chunk_no, chunk_start, chunk_end FROM e WHERE chunk_start < chunk_end""",
)
def date_chunks(spark, d):
    return providers.chunks(spark, "2024-01-01", "2024-08-06", "1m").withColumn("chunk_no", F.col("chunk_no").cast("long"))


@query("instrument_lookup", "SELECT p.p_partkey, upper(p.p_brand) AS symbol, CASE WHEN n.k IS NULL THEN NULL ELSE 'KEY|' || n.k END AS instrument_key FROM part p LEFT JOIN (SELECT upper(p_brand) AS symbol, min(p_partkey) AS k FROM part WHERE p_size <= 25 GROUP BY 1) n ON upper(p.p_brand) = n.symbol")
def instrument_lookup(spark, d):
    part = panels.table(spark, d, "part")
    raw = part.where("p_size <= 25").groupBy(F.col("p_brand").alias("trading_symbol")).agg(F.min("p_partkey").alias("k")).select("trading_symbol", F.lit("X_EQ").alias("segment"), F.lit("EQ").alias("instrument_type"), F.concat(F.lit("KEY|"), "k").alias("instrument_key"))
    return providers.resolve(part.select("p_partkey", F.col("p_brand").alias("symbol")), providers.instruments(raw, "X_EQ"), strict=False).select("p_partkey", "symbol", "instrument_key")


@query("symbol_suffix", "SELECT c_custkey, upper(c_mktsegment) || CASE WHEN c_nationkey % 2 = 0 THEN '.BO' ELSE '.NS' END AS ticker FROM customer")
def symbol_suffix(spark, d):
    return panels.table(spark, d, "customer").select("c_custkey", providers.suffixed(F.col("c_mktsegment"), F.when(F.col("c_nationkey") % 2 == 0, "BSE").otherwise("NSE")).alias("ticker"))


@query(
    "provider_fallback",
    f"""WITH {_BARS}, hot AS (SELECT symbol, datetime, close FROM bars WHERE volume > 1), cold AS (SELECT symbol, datetime, open AS close FROM bars)
    SELECT c.symbol, c.datetime, coalesce(h.close, c.close) AS close FROM cold c LEFT JOIN hot h ON c.symbol = h.symbol AND c.datetime = h.datetime""",
)
def provider_fallback(spark, d):
    bars = panels.order_bars(spark, d)
    return providers.prefer(bars.where("volume > 1").select("symbol", "datetime", "close"), bars.select("symbol", "datetime", F.col("open").alias("close")))


@query(
    "candle_rows",
    "SELECT event_type AS symbol, date_trunc('second', ts) AS datetime, round(value, 4) AS open, round(round(value, 4) + 1, 4) AS high, round(round(value, 4) - 1, 4) AS low, round(value, 4) AS close, user_id AS volume FROM events",
)
def candle_rows(spark, d):
    e = panels.table(spark, d, "events")
    v = F.round("value", 4)
    candle = F.array(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30")), *(x.cast("string") for x in (v, F.round(v + 1, 4), F.round(v - 1, 4), v, F.col("user_id"), F.lit(0))))
    return providers.candles(e.select(F.col("event_type").alias("symbol"), F.to_json(F.array(candle)).alias("candles")))


@query("option_chain", "SELECT 'R' || r_regionkey || '_' || e || '_' || k || '_' || o AS symbol, 'R' || r_regionkey AS underlying, CAST(e AS DATE) AS expiry, k AS strike, o AS option_type FROM region, (SELECT unnest(['2024-08-29', '2024-09-26']) AS e), (SELECT unnest([100.0, 110.0, 120.5])::DOUBLE AS k), (SELECT unnest(['CE', 'PE']) AS o)")
def option_chain(spark, d):
    r = panels.table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("underlying"), F.array(F.lit("2024-08-29"), F.lit("2024-09-26")).alias("expiries"), F.array(F.lit(100.0), F.lit(110.0), F.lit(120.5)).alias("strikes"))
    return options.chain(r)


@query("synthetic_chain", "SELECT 'NIFTY_2024-09-05_' || k || '_' || o AS symbol, 'NIFTY' AS underlying, DATE '2024-09-05' AS expiry, k AS strike, o AS option_type FROM (SELECT (100 + 10 * unnest(range(5)))::DOUBLE AS k), (SELECT unnest(['CE', 'PE']) AS o)")
def synthetic_chain(spark, d):
    return options.synthetic_chain(spark, "NIFTY", 5, "2024-08-06")


# --- calendar ----------------------------------------------------------------------------------------

_HOLIDAYS = "hol AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_totalprice > 490000)"


def _holidays(spark, d):
    return panels.table(spark, d, "orders").where("o_totalprice > 490000").select(F.col("o_orderdate").cast("date").alias("day")).distinct()


@query("trading_days", f"WITH {_HOLIDAYS}, days AS (SELECT unnest(generate_series(DATE '1996-01-01', DATE '1996-12-31', INTERVAL 1 DAY))::DATE AS day) SELECT day FROM days WHERE isodow(day) < 6 AND day NOT IN (SELECT day FROM hol)")
def trading_days(spark, d):
    return cal.trading_days_between(spark, "1996-01-01", "1996-12-31", _holidays(spark, d))


_NEXT = f"""WITH {_HOLIDAYS}, asked AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders),
    open AS (SELECT d FROM (SELECT unnest(generate_series(DATE '1990-01-01', DATE '2030-12-31', INTERVAL 1 DAY))::DATE AS d) WHERE isodow(d) < 6 AND d NOT IN (SELECT day FROM hol))
    SELECT day, (SELECT {{0}}(d) FROM open WHERE {{1}}) AS {{2}} FROM asked"""


@query("next_trading_day", _NEXT.format("min", "d >= day AND d <= day + 30", "next_day"))
def next_trading_day(spark, d):
    days = panels.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return cal.nearest_trading_day(days, _holidays(spark, d))


@query("previous_trading_day", _NEXT.format("max", "d <= day AND d >= day - 30", "previous_day"))
def previous_trading_day(spark, d):
    days = panels.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return cal.nearest_trading_day(days, _holidays(spark, d), forward=False)


@query("market_status", f"WITH {_HOLIDAYS}, days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, isodow(day) < 6 AND day NOT IN (SELECT day FROM hol) AS open, CAST(day AS TIMESTAMP) + INTERVAL 225 MINUTE AS opens, CAST(day AS TIMESTAMP) + INTERVAL 600 MINUTE AS closes FROM days")
def market_status(spark, d):
    days = panels.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    h = cal.market_hours(F.col("day"))
    return cal.is_trading_day(days, _holidays(spark, d)).select("day", "open", h["opens"].cast("timestamp_ntz").alias("opens"), h["closes"].cast("timestamp_ntz").alias("closes"))


@query("holidays", f"WITH {_HOLIDAYS} SELECT day FROM hol WHERE day BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def holidays(spark, d):
    return cal.holidays_between(_holidays(spark, d), "1995-01-01", "1995-12-31")


# --- factors and pipelines ---------------------------------------------------------------------------

_GROUPS = {"1-URGENT": "fast", "2-HIGH": "fast", "3-MEDIUM": "slow", "4-NOT SPECIFIED": "slow"}
_LABEL = "CASE symbol WHEN '1-URGENT' THEN 'fast' WHEN '2-HIGH' THEN 'fast' WHEN '3-MEDIUM' THEN 'slow' WHEN '4-NOT SPECIFIED' THEN 'slow' END"
_FACTORS = f"""{_BARS}, f AS (SELECT *, close / nullif(lag(close, 5) OVER {_W}, 0) - 1 AS ret, {_full('avg(close) OVER ' + _rows(5), 5)} AS sma5, {_full('avg(close * volume) OVER ' + _rows(5), 5)} AS adv, {_LABEL} AS label FROM bars)"""
_RET = factors.returns(5)


def _one(spark, d, **nodes):
    bars = panels.order_bars(spark, d)
    out = factors.evaluate(bars, nodes)
    return out.select("symbol", "datetime", *nodes)


def _rank(x: str, order: str = "ASC", mask: str = "true") -> str:
    masked = f"CASE WHEN {mask} THEN {x} END"
    return f"CASE WHEN ({masked}) IS NOT NULL THEN row_number() OVER (PARTITION BY datetime ORDER BY {masked} {order} NULLS LAST, symbol) END"


@query("factor_returns", f"WITH {_FACTORS} SELECT symbol, datetime, round(ret, 6) AS ret FROM f")
def factor_returns(spark, d):
    return rounded(_one(spark, d, ret=_RET), ret=6)


@query("factor_sma", f"WITH {_FACTORS} SELECT symbol, datetime, round(sma5, 3) AS sma FROM f")
def factor_sma(spark, d):
    return rounded(_one(spark, d, sma=factors.sma(5)), sma=3)


@query("factor_ema", SQL["ema_adjusted"])
def factor_ema(spark, d):
    return rounded(_one(spark, d, ema=factors.ema(10)), ema=2)


@query("factor_adv", f"WITH {_FACTORS} SELECT symbol, datetime, round(adv, 2) AS adv FROM f")
def factor_adv(spark, d):
    return rounded(_one(spark, d, adv=factors.average_dollar_volume(5)), adv=2)


@query("factor_latest", f"WITH {_BARS} SELECT symbol, datetime, close AS latest FROM bars")
def factor_latest(spark, d):
    return _one(spark, d, latest=factors.latest("close"))


@query("factor_static_group", f"WITH {_FACTORS} SELECT symbol, datetime, label FROM f")
def factor_static_group(spark, d):
    return _one(spark, d, label=factors.static_per_symbol(_GROUPS))


@query("rank", f"WITH {_FACTORS} SELECT symbol, datetime, CAST({_rank('ret')} AS DOUBLE) AS rank FROM f")
def rank(spark, d):
    return _one(spark, d, rank=_RET.rank())


_TOP3 = "(SELECT symbol, datetime, coalesce(" + _rank("adv", "DESC") + " <= 3, false) AS m FROM f)"


@query("rank_masked", f"WITH {_FACTORS}, t AS {_TOP3}, j AS (SELECT f.*, t.m FROM f JOIN t USING (symbol, datetime)) SELECT symbol, datetime, CAST({_rank('ret', mask='m')} AS DOUBLE) AS rank FROM j")
def rank_masked(spark, d):
    return _one(spark, d, rank=_RET.rank(mask=factors.average_dollar_volume(5).top(3)))


@query("zscore", f"WITH {_FACTORS} SELECT symbol, datetime, round((ret - avg(ret) OVER (PARTITION BY datetime)) / nullif(stddev_samp(ret) OVER (PARTITION BY datetime), 0), 5) AS z FROM f")
def zscore(spark, d):
    return rounded(_one(spark, d, z=_RET.zscore()), z=5)


@query("zscore_grouped", f"WITH {_FACTORS} SELECT symbol, datetime, round((ret - avg(ret) OVER (PARTITION BY datetime, label)) / nullif(stddev_samp(ret) OVER (PARTITION BY datetime, label), 0), 5) AS z FROM f")
def zscore_grouped(spark, d):
    return rounded(_one(spark, d, z=_RET.zscore(groups=_GROUPS)), z=5)


@query("demean", f"WITH {_FACTORS} SELECT symbol, datetime, round(ret - avg(ret) OVER (PARTITION BY datetime, label), 6) AS x FROM f")
def demean(spark, d):
    return rounded(_one(spark, d, x=_RET.demean(groups=_GROUPS)), x=6)


@query(
    "winsorize",
    f"""WITH {_FACTORS}, s AS (SELECT *, list_sort(list(ret) FILTER (WHERE ret IS NOT NULL) OVER (PARTITION BY datetime)) AS l FROM f)
    SELECT symbol, datetime, round(CASE WHEN ret IS NOT NULL THEN greatest(least(ret, l[round((len(l) - 1) * 0.8::DOUBLE)::INT + 1]), l[round((len(l) - 1) * 0.2::DOUBLE)::INT + 1]) END, 6) AS x FROM s""",
)
def winsorize(spark, d):
    return rounded(_one(spark, d, x=_RET.winsorize(0.2, 0.8)), x=6)


@query("top_n", f"WITH {_FACTORS} SELECT symbol, datetime, coalesce({_rank('ret', 'DESC')} <= 2, false) AS chosen FROM f")
def top_n(spark, d):
    return _one(spark, d, chosen=_RET.top(2))


@query("bottom_n", f"WITH {_FACTORS} SELECT symbol, datetime, coalesce({_rank('ret')} <= 2, false) AS chosen FROM f")
def bottom_n(spark, d):
    return _one(spark, d, chosen=_RET.bottom(2))


@query("filter_and_or_not", f"WITH {_FACTORS} SELECT symbol, datetime, (coalesce({_rank('ret', 'DESC')} <= 2, false) AND NOT coalesce({_rank('adv')} <= 1, false)) OR coalesce({_rank('sma5')} <= 1, false) AS chosen FROM f")
def filter_and_or_not(spark, d):
    return _one(spark, d, chosen=(_RET.top(2) & ~factors.average_dollar_volume(5).bottom(1)) | factors.sma(5).bottom(1))


@query("factor_arith", f"WITH {_FACTORS} SELECT symbol, datetime, round(-ret * 2 + 1, 6) AS a, round(3 - ret / nullif(sma5, 0), 6) AS b, round(1 / nullif(ret, 0), 3) AS c FROM f")
def factor_arith(spark, d):
    return rounded(_one(spark, d, a=-_RET * 2 + 1, b=3 - _RET / factors.sma(5), c=1 / _RET), a=6, b=6, c=3)


class Momentum(Pipeline):
    ret = _RET
    z = _RET.zscore()
    rank = _RET.rank(mask=factors.average_dollar_volume(5).top(3))
    universe = factors.average_dollar_volume(5).top(3)


@query(
    "pipeline_universe",
    f"""WITH {_FACTORS.replace('FROM orders GROUP', "FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01' AND o_orderdate <= TIMESTAMP '1996-12-31 23:59:59.999999' GROUP")}, t AS {_TOP3}, j AS (SELECT f.*, t.m FROM f JOIN t USING (symbol, datetime)),
    o AS (SELECT datetime, symbol, m, round(ret, 6) AS ret, round((ret - avg(ret) OVER (PARTITION BY datetime)) / nullif(stddev_samp(ret) OVER (PARTITION BY datetime), 0), 5) AS z, CAST({_rank('ret', mask='m')} AS DOUBLE) AS rank FROM j)
    SELECT datetime, symbol, ret, z, rank FROM o WHERE m""",
)
def pipeline_universe(spark, d):
    return rounded(run_pipeline(panels.order_bars(spark, d), Momentum, "1995-06-01", "1996-12-31"), ret=6, z=5)


_RANKED = f"""{_FACTORS}, t AS {_TOP3}, j AS (SELECT f.*, t.m FROM f JOIN t USING (symbol, datetime)), o AS (SELECT *, {_rank('ret', mask='m')} AS rank FROM j)"""


@query("rank_signals", f"WITH {_RANKED} SELECT symbol, datetime, coalesce(m AND rank < 2, false) AS buy, NOT coalesce(m AND rank < 2, false) AS sell FROM o")
def rank_signals_query(spark, d):
    bars = panels.order_bars(spark, d)
    return rank_signals(bars, run_pipeline(bars, Momentum), "rank", 1).select("symbol", "datetime", "buy", "sell")


@query("last_date_top_n", f"WITH {_FACTORS}, o AS (SELECT symbol, datetime, {_rank('ret')} AS rank, round(ret, 6) AS ret FROM f) SELECT symbol, datetime, CAST(rank AS DOUBLE) AS rank, ret FROM o WHERE rank IS NOT NULL AND datetime = (SELECT max(datetime) FROM o WHERE rank IS NOT NULL) ORDER BY rank LIMIT 3")
def last_date_top_n(spark, d):
    df = rounded(_one(spark, d, ret=_RET, rank=_RET.rank()), ret=6)
    return last_date_top(df.where("rank IS NOT NULL"), "rank", 3)


@query(
    "supplier_momentum",
    f"""WITH x AS (SELECT 'S' || l_suppkey AS symbol, l_shipdate AS datetime, l_extendedprice / l_quantity AS p,
      row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_extendedprice / l_quantity DESC) AS k FROM lineitem),
    bars AS (SELECT symbol, datetime, p AS close FROM x WHERE k = 1), f AS (SELECT *, close / nullif(lag(close, 5) OVER {_W}, 0) - 1 AS ret FROM bars),
    r AS (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY ret DESC, symbol) AS k FROM f WHERE ret IS NOT NULL)
    SELECT symbol, datetime, round(ret, 6) AS ret, k AS place FROM r WHERE k <= 3""",
)
def supplier_momentum(spark, d):
    df = factors.evaluate(panels.supplier_bars(spark, d).select("symbol", "datetime", "close"), {"ret": _RET})
    w = Window.partitionBy("datetime").orderBy(F.desc("ret"), "symbol")
    return rounded(df.where("ret IS NOT NULL").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("symbol", "datetime", "ret", "place"), ret=6)


# --- closed-form backtests and metrics ---------------------------------------------------------------


@query("ma_cross_backtest", f"WITH {_EQUITY} SELECT symbol, datetime, buy, sell, position, round(ln(100000::DOUBLE) + growth, 6) AS log_equity, round(1 - exp(growth - max(growth) OVER {_CUM}), 6) AS drawdown FROM eq")
def ma_cross_backtest(spark, d):
    df = closed_form.moving_average_cross(panels.order_bars(spark, d))
    peak = F.max("total_equity").over(cumulative(by_symbol()))
    return df.select("symbol", "datetime", "buy", "sell", "position", F.round(F.ln("total_equity"), 6).alias("log_equity"), F.round(1.0 - F.col("total_equity") / peak, 6).alias("drawdown"))


_TRADES = f"""{_POSITIONS}, ch AS (SELECT *, CASE WHEN position > coalesce(lag(position) OVER {_W}, 0) THEN 'BUY' WHEN position < coalesce(lag(position) OVER {_W}, 0) THEN 'SELL' END AS side FROM pos),
    en AS (SELECT *, last_value(CASE WHEN side = 'BUY' THEN close END IGNORE NULLS) OVER {_CUM} AS entry FROM ch),
    tr AS (SELECT symbol AS run_id, datetime, side, close AS price, CASE WHEN side = 'SELL' THEN close - entry ELSE 0.0 END AS pnl FROM en WHERE side IS NOT NULL)"""


def _trades(spark, d):
    return closed_form.trades(_signals(spark, d))


@query("trades_roundtrip", f"WITH {_TRADES} SELECT run_id, datetime, side, price, round(pnl, 2) AS pnl FROM tr")
def trades_roundtrip(spark, d):
    return rounded(_trades(spark, d).select("run_id", "datetime", "side", "price", "pnl"), pnl=2)


def _curve(spark, d):
    """A symbol is a run, its close the equity; it holds a position where a bar has more than one order."""
    b = panels.order_bars(spark, d)
    return b.select(F.col("symbol").alias("run_id"), "datetime", F.col("close").alias("total_equity"), F.when(F.col("volume") > 1, F.col("close")).otherwise(0.0).alias("position_value"))


_RUN = "(PARTITION BY run_id ORDER BY datetime)"
_CURVE = f"""{_BARS}, e AS (SELECT symbol AS run_id, datetime, close AS v, CASE WHEN volume > 1 THEN close ELSE 0.0 END AS pv FROM bars),
    c0 AS (SELECT *, v / nullif(lag(v) OVER {_RUN}, 0) - 1 AS r, max(v) OVER (PARTITION BY run_id ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS peak,
      max(v) OVER (PARTITION BY run_id ORDER BY datetime ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
    c AS (SELECT *, CASE WHEN peak = 0 THEN 0.0 ELSE (peak - v) / peak END AS dd, last_value(CASE WHEN v >= peak THEN datetime END IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS pt FROM c0)"""


@query("drawdown_series", f"WITH {_CURVE} SELECT run_id, datetime, round(dd, 6) AS drawdown FROM c")
def drawdown_series(spark, d):
    return rounded(met.drawdown_series(_curve(spark, d)), drawdown=6)


_DAYS = "CAST(floor((epoch_us({1}) - epoch_us({0})) / 86400000000.0) AS BIGINT)"
_METRICS = f"""{_CURVE}, a AS (SELECT run_id, count(*) AS n, count(r) AS nr, arg_min(v, datetime) AS f, arg_max(v, datetime) AS l, greatest({_DAYS.format('min(datetime)', 'max(datetime)')}, 1) AS days,
      avg(r) AS m, stddev_samp(r) AS s, stddev_samp(r) FILTER (WHERE r < 0) AS ds, count(*) FILTER (WHERE r < 0) AS nd, max(dd) AS mdd, max({_DAYS.format('pt', 'datetime')}) AS long,
      avg(dd) FILTER (WHERE before IS NULL OR v <= before) AS add_, avg(dd * dd) AS dd2, list_sort(list(r) FILTER (WHERE r IS NOT NULL)) AS rs, avg(CASE WHEN pv > 0 THEN 1.0 ELSE 0.0 END) AS ex,
      avg(r * r) AS r2, avg(r * r * r) AS r3, avg(r * r * r * r) AS r4 FROM c GROUP BY run_id),
    b AS (SELECT *, l / f - 1 AS tr, pow(l / f, 365.0 / days) - 1 AS cagr, coalesce(ds, 0) * sqrt(252.0) AS down, rs[CAST(floor((len(rs) - 1) * 0.05::DOUBLE) AS INT) + 1] AS var5 FROM a)"""


@query(
    "metrics_equity",
    f"""WITH {_METRICS} SELECT run_id, round(tr, 6) AS total_return, round(cagr, 6) AS cagr, round(pow(1 + tr, 252.0 / n) - 1, 6) AS annualized_return, round(s * sqrt(252.0), 5) AS annualized_volatility,
      round(down, 6) AS downside_deviation, round((m - 0.04 / 252) * sqrt(252.0) / s, 6) AS sharpe_ratio, round((m - 0.04 / 252) * sqrt(252.0) / down, 6) AS sortino_ratio, round(mdd, 6) AS max_drawdown,
      long AS max_drawdown_duration_days, round(add_, 6) AS avg_drawdown, round(sqrt(dd2), 6) AS ulcer_index, round((cagr - 0.04) / mdd, 6) AS calmar_ratio, round(tr / mdd, 6) AS recovery_factor,
      round(m, 5) AS average_daily_return, round(s, 5) AS daily_return_std, round(var5, 6) AS value_at_risk_5, round(list_avg(list_filter(rs, lambda x: x <= var5)), 6) AS conditional_value_at_risk_5, round(ex, 6) AS exposure FROM b""",
)
def metrics_equity(spark, d):
    df = met.equity_metrics(_curve(spark, d)).drop("return_skewness", "return_kurtosis")
    digits = {c: 6 for c, t in df.dtypes if t == "double"} | {"annualized_volatility": 5, "average_daily_return": 5, "daily_return_std": 5}
    return rounded(df, **digits)


@query(
    "skew_kurt",
    f"""WITH {_METRICS}, q AS (SELECT run_id, m, r2 - m * m AS v2, r3 - 3 * m * r2 + 2 * m * m * m AS v3, r4 - 4 * m * r3 + 6 * m * m * r2 - 3 * m * m * m * m AS v4 FROM b)
    SELECT run_id, round(v3 / pow(v2, 1.5), 4) AS return_skewness, round(v4 / (v2 * v2) - 3, 4) AS return_kurtosis FROM q""",
)
def skew_kurt(spark, d):
    return rounded(met.equity_metrics(_curve(spark, d)).select("run_id", "return_skewness", "return_kurtosis"), return_skewness=4, return_kurtosis=4)


@query("var_cvar", f"WITH {_METRICS} SELECT run_id, round(var5, 6) AS value_at_risk_5, round(list_avg(list_filter(rs, lambda x: x <= var5)), 6) AS conditional_value_at_risk_5 FROM b")
def var_cvar(spark, d):
    return rounded(met.equity_metrics(_curve(spark, d)).select("run_id", "value_at_risk_5", "conditional_value_at_risk_5"), value_at_risk_5=6, conditional_value_at_risk_5=6)


@query("exposure", f"WITH {_METRICS} SELECT run_id, round(ex, 6) AS exposure FROM b")
def exposure(spark, d):
    return rounded(met.equity_metrics(_curve(spark, d)).select("run_id", "exposure"), exposure=6)


@query(
    "metrics_trades",
    f"""WITH {_TRADES}, s AS (SELECT run_id, count(*) FILTER (WHERE side = 'SELL') AS n, count(*) FILTER (WHERE side = 'SELL' AND pnl > 0) AS w, count(*) FILTER (WHERE side = 'SELL' AND pnl <= 0) AS l,
      coalesce(sum(pnl) FILTER (WHERE side = 'SELL' AND pnl > 0), 0) AS gp, coalesce(sum(pnl) FILTER (WHERE side = 'SELL' AND pnl <= 0), 0) AS gl, coalesce(avg(pnl) FILTER (WHERE side = 'SELL'), 0) AS av,
      coalesce(avg(pnl) FILTER (WHERE side = 'SELL' AND pnl > 0), 0) AS aw, coalesce(avg(pnl) FILTER (WHERE side = 'SELL' AND pnl <= 0), 0) AS al FROM tr GROUP BY run_id)
    SELECT run_id, round(w / n, 6) AS win_rate, n AS num_trades, w AS num_winning_trades, l AS num_losing_trades, round(gp, 2) AS gross_profit, round(gl, 2) AS gross_loss, round(gp + gl, 2) AS net_profit, 0.0::DOUBLE AS total_fees,
      round(CASE WHEN gl <> 0 THEN gp / abs(gl) WHEN gp > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS profit_factor, round(av, 2) AS avg_trade_return, round(aw, 2) AS avg_winning_trade, round(al, 2) AS avg_losing_trade,
      round(CASE WHEN al <> 0 THEN aw / abs(al) WHEN aw > 0 THEN 'inf'::DOUBLE ELSE 0 END, 6) AS payoff_ratio, round(w / n * aw - l / n * abs(al), 2) AS trade_expectancy FROM s""",
)
def metrics_trades(spark, d):
    df = met.trade_metrics(_trades(spark, d))
    money = {c: 2 for c in ("gross_profit", "gross_loss", "net_profit", "avg_trade_return", "avg_winning_trade", "avg_losing_trade", "trade_expectancy")}
    return rounded(df, win_rate=6, profit_factor=6, payoff_ratio=6, **money)


@query(
    "trade_metrics_lines",
    """WITH t AS (SELECT 'S' || l_suppkey AS run_id, CASE WHEN l_returnflag = 'R' THEN 'BUY' ELSE 'SELL' END AS side, l_tax AS fee, l_extendedprice * (l_discount - 0.05::DOUBLE) AS pnl FROM lineitem)
    SELECT run_id, count(*) FILTER (WHERE side = 'SELL') AS num_trades, count(*) FILTER (WHERE side = 'SELL' AND pnl > 0) AS num_winning_trades, count(*) FILTER (WHERE side = 'SELL' AND pnl <= 0) AS num_losing_trades, round(sum(fee), 4) AS total_fees, round(coalesce(sum(pnl) FILTER (WHERE side = 'SELL'), 0), 4) AS net_profit FROM t GROUP BY 1""",
)
def trade_metrics_lines(spark, d):
    line = panels.table(spark, d, "lineitem")
    t = line.select(F.concat(F.lit("S"), "l_suppkey").alias("run_id"), F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL").alias("side"), F.col("l_tax").alias("fee"), (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("pnl"))
    return rounded(met.trade_metrics(t).select("run_id", "num_trades", "num_winning_trades", "num_losing_trades", "total_fees", "net_profit"), total_fees=4, net_profit=4)


@query(
    "trade_durations_asof",
    f"""WITH {_TRADES}, p AS (SELECT s.run_id, s.datetime AS closed, max(b.datetime) AS opened FROM tr s JOIN tr b ON s.run_id = b.run_id AND s.side = 'SELL' AND b.side = 'BUY' AND b.datetime <= s.datetime GROUP BY 1, 2)
    SELECT run_id, opened, closed, {_DAYS.format('opened', 'closed')} AS days FROM p""",
)
def trade_durations_asof(spark, d):
    return met.trade_durations(_trades(spark, d)).select("run_id", "opened", "closed", "days")


@query("duration_metrics", f"WITH {_TRADES}, p AS (SELECT s.run_id, s.datetime AS closed, max(b.datetime) AS opened FROM tr s JOIN tr b ON s.run_id = b.run_id AND s.side = 'SELL' AND b.side = 'BUY' AND b.datetime <= s.datetime GROUP BY 1, 2) SELECT run_id, round(avg({_DAYS.format('opened', 'closed')}), 6) AS avg_trade_duration_days, max({_DAYS.format('opened', 'closed')}) AS max_trade_duration_days FROM p GROUP BY 1")
def duration_metrics(spark, d):
    return rounded(met.duration_metrics(_trades(spark, d)), avg_trade_duration_days=6)


@query(
    "streaks",
    f"""WITH {_TRADES}, s AS (SELECT run_id, datetime, pnl > 0 AS won FROM tr WHERE side = 'SELL'),
    i AS (SELECT run_id, won, row_number() OVER {_RUN} - row_number() OVER (PARTITION BY run_id, won ORDER BY datetime) AS k FROM s), g AS (SELECT run_id, won, count(*) AS n FROM i GROUP BY run_id, won, k)
    SELECT run_id, coalesce(max(n) FILTER (WHERE won), 0) AS max_consecutive_wins, coalesce(max(n) FILTER (WHERE NOT won), 0) AS max_consecutive_losses FROM g GROUP BY run_id""",
)
def streaks(spark, d):
    return met.streaks(_trades(spark, d))


@query(
    "beta_alpha",
    f"""WITH {_CURVE}, o AS (SELECT run_id, r, row_number() OVER (PARTITION BY run_id ORDER BY datetime DESC) AS k FROM c WHERE r IS NOT NULL),
    b AS (SELECT r AS b, k FROM o WHERE run_id = '5-LOW'), p AS (SELECT run_id, covar_samp(r, b) / nullif(var_samp(b), 0) AS beta, avg(r - b) * sqrt(252.0) / nullif(stddev_samp(r - b), 0) AS ir FROM o JOIN b USING (k) GROUP BY 1),
    m AS (SELECT run_id, avg(r) * 252 - 0.04 AS y FROM o GROUP BY 1)
    SELECT run_id, round(beta, 5) AS beta, round(y - beta * (SELECT y FROM m WHERE run_id = '5-LOW'), 4) AS alpha, round(coalesce(ir, 0), 5) AS information_ratio, round(y / nullif(beta, 0), 2) AS treynor_ratio FROM p JOIN m USING (run_id) WHERE run_id <> '5-LOW'""",
)
def beta_alpha(spark, d):
    e = _curve(spark, d)
    df = met.benchmark_metrics(e.where("run_id <> '5-LOW'"), e.where("run_id = '5-LOW'"))
    return rounded(df, beta=5, alpha=4, information_ratio=5, treynor_ratio=2)


@query(
    "all_metrics",
    f"""SELECT * EXCLUDE (downside_deviation) FROM ({SQL['metrics_equity']}) JOIN ({SQL['skew_kurt']}) USING (run_id) JOIN ({SQL['metrics_trades']}) USING (run_id) JOIN ({SQL['duration_metrics']}) USING (run_id)
    JOIN ({SQL['streaks']}) USING (run_id) JOIN ({SQL['beta_alpha']}) USING (run_id)""",
)
def all_metrics(spark, d):
    """Every metric of each run but the benchmark, in one wide row."""
    e, t = _curve(spark, d), _trades(spark, d)
    ours = F.col("run_id") != "5-LOW"
    df = met.all_metrics(e.where(ours), t.where(ours), e.where(~ours))
    fives = ("annualized_volatility", "average_daily_return", "daily_return_std", "beta", "information_ratio")
    money = ("gross_profit", "gross_loss", "net_profit", "avg_trade_return", "avg_winning_trade", "avg_losing_trade", "trade_expectancy", "treynor_ratio")
    digits = {c: 6 for c, kind in df.dtypes if kind == "double"} | dict.fromkeys(fives, 5) | dict.fromkeys(money, 2) | {"return_skewness": 4, "return_kurtosis": 4, "alpha": 4}
    return rounded(df, **digits)


_MONTHS = f"{_BARS}, mo AS (SELECT symbol AS run_id, strftime(datetime, '%Y') AS year, strftime(datetime, '%m') AS month, (arg_max(close, datetime) - arg_min(close, datetime)) / nullif(arg_min(close, datetime), 0) AS ret FROM bars GROUP BY 1, 2, 3)"


@query("monthly_returns", f"WITH {_MONTHS} SELECT run_id, year, month, round(ret, 6) AS ret FROM mo")
def monthly_returns(spark, d):
    return rounded(met.monthly_returns(_curve(spark, d)), ret=6)


@query("monthly_heatmap", f"WITH {_MONTHS} SELECT run_id, year, " + ", ".join(f"round(coalesce(max(ret) FILTER (WHERE month = '{k:02d}'), 0), 6) AS m{k:02d}" for k in range(1, 13)) + " FROM mo GROUP BY 1, 2")
def monthly_heatmap(spark, d):
    return rounded(met.monthly_heatmap(_curve(spark, d)), **{f"m{k:02d}": 6 for k in range(1, 13)})


# --- costs, orders, ledger ---------------------------------------------------------------------------


@query(
    "costs_breakdown",
    """WITH t AS (SELECT o_orderkey, o_totalprice AS v, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side FROM orders), p AS (SELECT *, greatest(20.0::DOUBLE, v * 0.0005::DOUBLE) AS brokerage, CASE WHEN side = 'SELL' THEN v * 0.001::DOUBLE ELSE 0.0 END AS stt,
      CASE WHEN side = 'BUY' THEN v * 0.00015::DOUBLE ELSE 0.0 END AS stamp, v * 0.0000325::DOUBLE AS x, v * 0.000001::DOUBLE AS sebi FROM t)
    SELECT o_orderkey, side, round(brokerage, 6) AS brokerage, round(stt, 5) AS stt, round(stamp, 7) AS stamp_duty, round(x, 9) AS transaction_charges, round(sebi, 8) AS sebi_charges, round((brokerage + x) * 0.18::DOUBLE, 11) AS gst, round(brokerage + stt + stamp + x + sebi + (brokerage + x) * 0.18::DOUBLE, 11) AS total FROM p""",
)
def costs_breakdown(spark, d):
    o = panels.table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.when(F.col("o_orderkey") % 2 == 0, "BUY").otherwise("SELL").alias("side"))
    df = o.select("o_orderkey", "side", StatutoryCosts(brokerage_pct=0.05, brokerage_flat=20.0).breakdown(F.col("o_totalprice"), F.col("side")).alias("c")).select("o_orderkey", "side", "c.*")
    return rounded(df, brokerage=6, stt=5, stamp_duty=7, transaction_charges=9, sebi_charges=8, gst=11, total=11)


_ORDERS = """od AS (SELECT o_orderkey AS order_id, ['MARKET', 'LIMIT', 'STOP', 'STOP_LIMIT'][CAST(o_orderkey % 4 + 1 AS INT)] AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice * 0.99 AS price, o_totalprice * 1.01 AS stop_price, o_orderpriority AS symbol, o_orderdate AS created FROM orders)"""


def _order_table(spark, d):
    kinds = F.element_at(F.array(*map(F.lit, ("MARKET", "LIMIT", "STOP", "STOP_LIMIT"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = panels.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("symbol"), F.when(F.col("o_orderkey") % 3 == 0, "SELL").otherwise("BUY").alias("side"), kinds.alias("kind"), F.lit(1.0).alias("quantity"), (F.col("o_totalprice") * 0.99).alias("price"), (F.col("o_totalprice") * 1.01).alias("stop_price"), F.col("o_orderdate").alias("created"))


@query(
    "order_fills",
    f"""WITH {_BARS}, {_ORDERS}, nb AS (SELECT *, lead(datetime) OVER {_W} AS nd, lead(open) OVER {_W} AS o, lead(high) OVER {_W} AS h, lead(low) OVER {_W} AS l, lead(close) OVER {_W} AS c FROM bars),
    j AS (SELECT od.*, o, h, l, c, CASE WHEN side = 'BUY' THEN l <= price ELSE h >= price END AS lim, CASE WHEN side = 'BUY' THEN h >= stop_price ELSE l <= stop_price END AS stp FROM od JOIN nb ON od.symbol = nb.symbol AND od.created = nb.datetime)
    SELECT order_id, kind, side, round(CASE WHEN kind = 'MARKET' THEN o WHEN kind = 'LIMIT' AND lim THEN CASE WHEN side = 'BUY' THEN least(price, c) ELSE greatest(price, c) END WHEN kind = 'STOP' AND stp THEN stop_price WHEN kind = 'STOP_LIMIT' AND stp AND lim THEN price END, 5) AS raw FROM j""",
)
def order_fills(spark, d):
    """Each order against the next bar only."""
    w = by_symbol()
    nxt = panels.order_bars(spark, d).select("symbol", F.col("datetime").alias("created"), *(F.lead(c).over(w).alias(f"n_{c}") for c in ("open", "high", "low", "close")))
    df = _order_table(spark, d).join(nxt, ["symbol", "created"])
    raw = ords.fill_price(F.col("kind"), F.col("side"), F.col("price"), F.col("stop_price"), F.col("n_open"), F.col("n_high"), F.col("n_low"), F.col("n_close"))
    return df.select("order_id", "kind", "side", F.round(raw, 5).alias("raw"))


@query(
    "first_fills",
    f"""WITH {_BARS}, {_ORDERS}, j AS (SELECT od.*, b.datetime AS ts, open AS o, high AS h, low AS l, close AS c, CASE WHEN side = 'BUY' THEN low <= price ELSE high >= price END AS lim, CASE WHEN side = 'BUY' THEN high >= stop_price ELSE low <= stop_price END AS stp FROM od JOIN bars b ON od.symbol = b.symbol AND b.datetime > od.created),
    r AS (SELECT *, CASE WHEN kind = 'MARKET' THEN o WHEN kind = 'LIMIT' AND lim THEN CASE WHEN side = 'BUY' THEN least(price, c) ELSE greatest(price, c) END WHEN kind = 'STOP' AND stp THEN stop_price WHEN kind = 'STOP_LIMIT' AND stp AND lim THEN price END AS raw FROM j),
    g AS (SELECT order_id, min(ts) AS filled_at, arg_min(raw, ts) AS raw FROM r WHERE raw IS NOT NULL GROUP BY 1)
    SELECT od.order_id, filled_at, round(raw * CASE WHEN side = 'BUY' THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END, 8) AS fill_price FROM od LEFT JOIN g USING (order_id)""",
)
def first_fills(spark, d):
    return rounded(ords.first_fills(_order_table(spark, d), panels.order_bars(spark, d)).select("order_id", "filled_at", "fill_price"), fill_price=8)


@query(
    "risk_checks",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity - 2 AS q, CASE WHEN l_returnflag = 'R' THEN 'BUY' ELSE 'SELL' END AS side, CASE WHEN l_linestatus = 'O' THEN 'CNC' ELSE 'NRML' END AS product, 20.0 AS pos FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, CAST((q <= 0)::INT + (q > 40)::INT + (product <> 'CNC')::INT + (side = 'SELL' AND q > pos)::INT AS BIGINT) AS n_reasons, NOT (q <= 0 OR q > 40 OR product <> 'CNC' OR (side = 'SELL' AND q > pos)) AS allowed FROM x""",
)
def risk_checks(spark, d):
    line = panels.table(spark, d, "lineitem")
    o = line.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") - 2).alias("quantity"), F.when(F.col("l_returnflag") == "R", "BUY").otherwise("SELL").alias("side"), F.when(F.col("l_linestatus") == "O", "CNC").otherwise("NRML").alias("product"), F.lit(20.0).alias("position"))
    return ords.check_orders(o, 40.0).select("l_orderkey", "l_linenumber", "l_partkey", F.size("reasons").cast("long").alias("n_reasons"), "allowed")


_FILLS = "SELECT o_orderpriority AS symbol, CAST(o_custkey % 20 AS VARCHAR) AS account, o_orderkey AS seq, CASE WHEN o_orderkey % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, o_totalprice AS p, o_orderkey % 7 + 1.0::DOUBLE AS q FROM orders"


def _fills(spark, d):
    """Buys and sells; some sell more than is held."""
    o = panels.table(spark, d, "orders")
    side = F.when(F.col("o_orderkey") % 3 == 0, "SELL").otherwise("BUY")
    return o.select((F.col("o_custkey") % 20).cast("string").alias("account"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("seq"), side.alias("side"), (F.col("o_orderkey") % 7 + 1.0).alias("quantity"), F.col("o_totalprice").alias("price"), F.lit(5.0).alias("fees"))


@query("ledger_positions", f"WITH RECURSIVE {oracles.ledger(_FILLS)} SELECT account, symbol, position, round(average_cost, 2) AS average_cost, round(realized_pnl, 0) AS realized_pnl, round(cash, 0) AS cash, round(fees, 2) AS fees FROM states")
def ledger_positions(spark, d):
    return rounded(ords.positions(_fills(spark, d)).select("account", "symbol", "position", "average_cost", "realized_pnl", "cash", "fees"), average_cost=2, realized_pnl=0, cash=0, fees=2)


@query(
    "account_totals",
    f"""WITH RECURSIVE {_BARS}, {oracles.ledger(_FILLS)}, px AS (SELECT symbol, arg_max(close, datetime) AS price FROM bars GROUP BY 1),
    a AS (SELECT account, sum(cash) + 1000000 AS cash, sum(position * price) AS held, sum(realized_pnl) AS realized, sum(position * (price - average_cost)) AS unrealized, sum(fees) AS fees FROM states JOIN px USING (symbol) GROUP BY 1)
    SELECT account, round(cash, 0) AS cash, round(cash + held, 0) AS total_value, round(realized, 0) AS realized_pnl, round(unrealized, 0) AS unrealized_pnl, round(fees, 2) AS fees, round(realized + unrealized - fees, 0) AS total_pnl FROM a""",
)
def account_totals(spark, d):
    prices = panels.latest_bars(panels.order_bars(spark, d)).select("symbol", F.col("close").alias("price"))
    return rounded(ords.accounts(_fills(spark, d), prices, 1_000_000.0), cash=0, total_value=0, realized_pnl=0, unrealized_pnl=0, fees=2, total_pnl=0)


# --- sweeps, store, tools ----------------------------------------------------------------------------

_FAST, _SLOW = [3, 5, 8], [15, 20, 30]


def _sweep_sql() -> str:
    ks = sorted({*_FAST, *_SLOW})
    means = ", ".join(f"{_full(f'avg(close) OVER {_rows(k)}', k)} AS m{k}" for k in ks)
    runs = " UNION ALL ".join(f"SELECT 'fast={a},slow={b}' AS run_id, symbol, datetime, close, m{a} AS x, m{b} AS y FROM ma" for a in _FAST for b in _SLOW)
    w, cum = "(PARTITION BY run_id, symbol ORDER BY datetime)", "(PARTITION BY run_id, symbol ORDER BY datetime ROWS UNBOUNDED PRECEDING)"
    return f"""{_BARS}, ma AS (SELECT *, {means} FROM bars), u AS ({runs}), s AS (SELECT *, CASE WHEN x > y AND lag(x) OVER {w} <= lag(y) OVER {w} THEN 1 WHEN x < y AND lag(x) OVER {w} >= lag(y) OVER {w} THEN 0 END AS mark FROM u),
    p AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER {cum}, 0) AS position FROM s), t AS (SELECT *, CASE WHEN coalesce(lag(position) OVER {w}, 0) = 1 THEN ln(close / lag(close) OVER {w}) ELSE 0.0 END AS step FROM p),
    g AS (SELECT *, sum(step) OVER {cum} AS growth FROM t), dd AS (SELECT *, 1 - exp(growth - max(growth) OVER {cum}) AS dd FROM g),
    res AS (SELECT run_id, symbol, arg_max(growth, datetime) AS growth, max(dd) AS max_drawdown FROM dd GROUP BY 1, 2)"""


@query("sweep_all", f"WITH {_sweep_sql()} SELECT run_id, symbol, round(growth, 6) AS growth, round(max_drawdown, 6) AS max_drawdown FROM res")
def sweep_all(spark, d):
    df = sweep.cross_sweep(panels.order_bars(spark, d), _FAST, _SLOW)
    return df.select("run_id", "symbol", F.round("log_growth", 6).alias("growth"), F.round("max_drawdown", 6).alias("max_drawdown"))


@query("sweep_best", f"WITH {_sweep_sql()} SELECT symbol, run_id, round(growth, 6) AS growth FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY growth DESC, run_id) AS k FROM res) WHERE k = 1")
def sweep_best(spark, d):
    df = sweep.best(sweep.cross_sweep(panels.order_bars(spark, d), _FAST, _SLOW), "log_growth", by=["symbol"])
    return df.select("symbol", "run_id", F.round("log_growth", 6).alias("growth"))


@query("rank_index_top", f"WITH {_FACTORS}, l AS (SELECT symbol, ret, strftime(datetime, '%Y-%m-%d') AS date FROM f), r AS (SELECT date, symbol, round(ret, 6) AS value, row_number() OVER (PARTITION BY date ORDER BY ret DESC NULLS LAST, symbol) AS rank FROM l) SELECT date, symbol, value, rank FROM r WHERE rank <= 2")
def rank_index_top(spark, d):
    v = _one(spark, d, value=_RET).select(F.date_format("datetime", "yyyy-MM-dd").alias("date"), F.lit("ret").alias("factor_name"), "symbol", "value")
    df = store.ranked(v).where("rank <= 2")
    return df.select("date", "symbol", F.round("value", 6).alias("value"), F.col("rank").cast("long").alias("rank"))


@query("run_query", "SELECT o_custkey AS strategy, o_orderkey AS run, o_totalprice AS total_return FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_totalprice >= 1000")
def run_query(spark, d):
    o = panels.table(spark, d, "orders")
    low = o.agg(F.min("o_custkey")).first()[0]
    runs = o.select(F.col("o_custkey").alias("strategy_id"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("total_return"), F.col("o_orderdate").alias("created_at"))
    return store.query_runs(runs, low, 1000.0).select(F.col("strategy_id").alias("strategy"), "run", "total_return")


@query("index_upsert", "SELECT o_custkey AS backtest_id, max(row(o_orderdate, o_orderkey)).k AS last_run FROM (SELECT o_custkey, o_orderdate, o_orderkey AS k FROM orders) GROUP BY 1")
def index_upsert(spark, d):
    o = panels.table(spark, d, "orders").select(F.col("o_custkey").alias("backtest_id"), F.struct("o_orderdate", "o_orderkey").alias("at"), F.col("o_orderkey").alias("last_run"))
    return store.latest_wins(o, "backtest_id", "at").select("backtest_id", "last_run")


SQL["index_upsert"] = "SELECT backtest_id, last_run FROM (SELECT o_custkey AS backtest_id, o_orderkey AS last_run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1"


@query("bars_summary", f"WITH {_BARS} SELECT symbol, count(*) AS rows, min(datetime) AS first, max(datetime) AS last, min(low) AS low, max(high) AS high FROM bars GROUP BY 1")
def bars_summary(spark, d):
    return tools.bars_summary(panels.order_bars(spark, d))


@query("last_signal", f"WITH {_BARS}, ma AS (SELECT *, {_full('avg(close) OVER ' + _rows(5), 5)} AS fast, {_full('avg(close) OVER ' + _rows(10), 10)} AS slow FROM bars), s AS (SELECT *, lag(fast) OVER {_W} AS f0, lag(slow) OVER {_W} AS s0, row_number() OVER (PARTITION BY symbol ORDER BY datetime DESC) AS k FROM ma) SELECT symbol, datetime, CASE WHEN fast > slow AND f0 <= s0 THEN 'BUY' WHEN fast < slow AND f0 >= s0 THEN 'SELL' ELSE 'HOLD' END AS signal, round(fast, 3) AS fast, round(slow, 3) AS slow, close AS price FROM s WHERE k = 1 AND slow IS NOT NULL")
def last_signal(spark, d):
    return rounded(tools.last_signal(panels.order_bars(spark, d)), fast=3, slow=3)


@query("key_metrics", f"SELECT run_id, total_return, cagr, annualized_volatility, sharpe_ratio, max_drawdown FROM ({SQL['metrics_equity']})")
def key_metrics(spark, d):
    return rounded(tools.key_metrics(_curve(spark, d)), total_return=6, cagr=6, annualized_volatility=5, sharpe_ratio=6, max_drawdown=6)


@query("rank_symbols", f"WITH {_FACTORS}, o AS (SELECT symbol, datetime, latest, ret, {_rank('ret', 'DESC')} AS rank FROM (SELECT f.symbol, f.datetime, f.ret, bars.close AS latest FROM f JOIN bars USING (symbol, datetime))) SELECT symbol, datetime, latest, round(ret, 6) AS returns, CAST(rank AS DOUBLE) AS rank FROM o WHERE rank IS NOT NULL AND datetime = (SELECT max(datetime) FROM o WHERE rank IS NOT NULL) ORDER BY rank LIMIT 2")
def rank_symbols(spark, d):
    """The two strongest symbols at the last time."""
    return rounded(tools.rank_symbols(panels.order_bars(spark, d), n=2, descending=True), returns=6)


@query("redact_props", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '[REDACTED]' ELSE 'v' || user_id END AS value FROM events")
def redact_props(spark, d):
    e = panels.table(spark, d, "events").select("event_id", F.create_map(F.when(F.col("event_id") % 3 == 0, "Token").otherwise("name"), F.concat(F.lit("v"), "user_id")).alias("m"))
    return e.select("event_id", F.element_at(F.map_values(store.redacted_map(F.col("m"))), 1).alias("value"))


@query("ffill_values", f"WITH {_BARS}, x AS (SELECT symbol, datetime, CASE WHEN volume > 1 THEN close END AS c FROM bars) SELECT symbol, datetime, last_value(c IGNORE NULLS) OVER {_CUM} AS c FROM x")
def ffill_values(spark, d):
    x = panels.order_bars(spark, d).select("symbol", "datetime", F.when(F.col("volume") > 1, F.col("close")).alias("c"))
    return x.withColumn("c", filled(F.col("c"), by_symbol(), backward=False))


@query("interval_minutes", "SELECT p_partkey, x AS given, CASE x WHEN '1D' THEN 1440 WHEN ' 5m' THEN 5 WHEN '1wk' THEN 10080 WHEN 'Month' THEN 43200 END AS minutes FROM (SELECT p_partkey, ['1D', ' 5m', '1wk', 'Month', '7m'][p_size % 5 + 1] AS x FROM part)")
def interval_minutes_query(spark, d):
    given = F.element_at(F.array(*map(F.lit, ("1D", " 5m", "1wk", "Month", "7m"))), F.col("p_size") % 5 + 1)
    return panels.table(spark, d, "part").select("p_partkey", given.alias("given")).withColumn("minutes", scalars.interval_minutes(F.col("given")))


@query("date_after", "SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 WHEN 3 THEN 7 ELSE 30 END * (o_custkey % 4) AS INT) AS due FROM orders")
def date_after_query(spark, d):
    unit = F.element_at(F.array(*map(F.lit, ("minutes", "HOUR", "day", "Weeks", "MONTH"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return panels.table(spark, d, "orders").select("o_orderkey", scalars.date_after(F.col("o_orderdate").cast("date"), unit, (F.col("o_custkey") % 4).cast("int")).alias("due"))


@query("elapsed_days", "SELECT o_orderkey, CAST(floor((epoch_us(TIMESTAMP '1998-01-01 12:00:00') - epoch_us(o_orderdate)) / 86400000000.0) AS BIGINT) AS days FROM orders")
def elapsed_days_query(spark, d):
    return panels.table(spark, d, "orders").select("o_orderkey", elapsed_days(F.col("o_orderdate"), F.lit("1998-01-01 12:00:00").cast("timestamp_ntz")).alias("days"))


@query("latest_close", f"WITH {_BARS} SELECT symbol, arg_max(close, datetime) AS close FROM bars WHERE symbol IN ('1-URGENT', '5-LOW', 'NONE') GROUP BY 1")
def latest_close(spark, d):
    return panels.latest_bars(panels.order_bars(spark, d).where(F.col("symbol").isin("1-URGENT", "5-LOW", "NONE"))).select("symbol", "close")


@query("next_open_fills", f"WITH {_SIGNALS}, n AS (SELECT *, lead(open) OVER {_W} AS o, lead(datetime) OVER {_W} AS filled_at, CASE WHEN buy THEN 'BUY' WHEN sell THEN 'SELL' END AS side FROM sig) SELECT symbol, datetime, side, filled_at, round(o * CASE WHEN side = 'BUY' THEN 1.0005::DOUBLE ELSE 0.9995::DOUBLE END, 6) AS fill_price FROM n WHERE side IS NOT NULL AND o IS NOT NULL")
def next_open_fills(spark, d):
    s = _signals(spark, d).withColumn("side", F.when(F.col("buy"), "BUY").when(F.col("sell"), "SELL"))
    return rounded(ords.next_open_fills(s).drop("fees"), fill_price=6)


# --- streams, drained with availableNow ---------------------------------------------------------------


def _stream(spark, d):
    schema = panels.table(spark, d, "events").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")  # a pattern takes files and folders


def _drained(df: DataFrame) -> DataFrame:
    """All rows of a stream, through files in the shared folder."""
    path = f"{work_folder(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    running = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


@query("streaming_bars", SQL["resample_events_day"] + " HAVING date_trunc('day', ts) + INTERVAL 25 HOUR <= (SELECT max(ts) FROM events)")
def streaming_bars(spark, d):
    """Closed daily bars of the stream: those that the watermark, an hour behind the newest tick, has passed."""
    bars = bar_stream(_stream(spark, d), "event_type", "ts", "value", "1 day", "1 hour", tie="event_id")
    return _drained(bars).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))


@query(
    "streaming_crossover",
    f"""WITH e AS (SELECT event_type AS symbol, ts AS datetime, value AS close FROM events), m AS (SELECT *, avg(close) OVER {_rows(5)} AS fast, avg(close) OVER {_rows(10)} AS slow, row_number() OVER {_W} AS n FROM e),
    x AS (SELECT *, CASE WHEN lag(fast) OVER {_W} <= lag(slow) OVER {_W} AND fast > slow THEN 'BUY' WHEN lag(fast) OVER {_W} >= lag(slow) OVER {_W} AND fast < slow THEN 'SELL' ELSE 'HOLD' END AS signal FROM m),
    y AS (SELECT *, count(*) FILTER (WHERE signal <> 'HOLD') OVER (PARTITION BY symbol, date_trunc('day', datetime) ORDER BY datetime) AS orders FROM x WHERE n > 10)
    SELECT symbol, datetime, signal, round(close, 6) AS price, signal <> 'HOLD' AND orders <= 5 AS accepted FROM y""",
)
def streaming_crossover(spark, d):
    ticks = _stream(spark, d).select(F.col("event_type").alias("symbol"), F.col("ts").alias("datetime"), F.col("value").alias("close"), "event_id")
    out = _drained(cross_signals(ticks, 5, 10, 5, tie="event_id")).withColumn("datetime", F.col("datetime").cast("timestamp_ntz"))
    return out.select("symbol", "datetime", "signal", F.round("price", 6).alias("price"), "accepted")


# --- simulators; their SQL is a recursion over steps (barline.oracles) -----------------------------------

_FOUR = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
_STATES = {"price": 8, "quantity": 7, "fee": 5, "pnl": 5, "cash": 5, "position_value": 5, "total_equity": 5}
_STATE_COLUMNS = ", ".join(["run_id", "kind", "datetime", "symbol", "side", "reason", *(f"round({c}, {n}) AS {c}" for c, n in _STATES.items())])


def _rules() -> simulate.Rules:
    return simulate.Rules(
        symbols=_FOUR,
        sizes=tuple(PositionSize(s, percentage_of_portfolio=2.0) for s in _FOUR),
        stops=(Exit("1-URGENT", 20.0), Exit("2-HIGH", 30.0, trailing=True)),
        targets=(Exit("3-MEDIUM", 40.0), Exit("1-URGENT", 60.0, trailing=True)),
        scaling=(Scaling("4-NOT SPECIFIED", 3, (50.0, 25.0), (50.0,), 2.8, 2),),
        cooldowns=(Cooldown(5, "1-URGENT"),),
        costs=(TradingCost("3-MEDIUM", 0.1, 0.05),),
    )


_PORTFOLIO = oracles.portfolio(_SIGNALS, _FOUR, 2.0, 2.8, {"1-URGENT": 20.0, "2-HIGH": 30.0}, ("2-HIGH",), {"3-MEDIUM": 40.0, "1-URGENT": 60.0}, ("1-URGENT",), "4-NOT SPECIFIED", {"3-MEDIUM": 0.1}, {"3-MEDIUM": 0.05}, "1-URGENT")


def _simulated(spark, d):
    signals = _signals(spark, d).where(F.col("symbol").isin(*_FOUR))
    return simulate.simulate_portfolio(signals.withColumn("scale_in", F.col("volume") % 3 == 0).withColumn("scale_out", (F.col("volume") % 5 == 0) & (F.col("volume") % 3 != 0)), _rules())


@query("vector_backtest_rules", f"WITH RECURSIVE {_PORTFOLIO} SELECT {_STATE_COLUMNS} FROM (SELECT 'run' AS run_id, * FROM rows)")
def vector_backtest_rules(spark, d):
    """Four symbols that share cash, with fixed and trailing stops and targets, scaling, cooldowns and costs."""
    return rounded(_simulated(spark, d), **_STATES)


@query(
    "vector_backtest_summary",
    f"""WITH RECURSIVE {_PORTFOLIO}, e AS (SELECT *, max(total_equity) OVER (ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS top FROM rows WHERE kind = 'equity'), t AS (SELECT * FROM rows WHERE side = 'SELL')
    SELECT 'run' AS run_id, round(((SELECT arg_max(cash, datetime) FROM e) + coalesce((SELECT sum(price * quantity - fee) FROM t WHERE reason = 'final_close'), 0) - 100000) / 100000, 6) AS total_return, round((SELECT max((top - total_equity) / top) FROM e), 6) AS max_drawdown,
      (SELECT count(*) FROM t) AS num_trades, round((SELECT count(*) FILTER (WHERE pnl > 0) / count(*) FROM t), 6) AS win_rate""",
)
def vector_backtest_summary(spark, d):
    return rounded(simulate.summary(_simulated(spark, d)), total_return=6, max_drawdown=6, win_rate=6)


@query("single_backtest", f"WITH RECURSIVE {oracles.single(_SIGNALS, {'1-URGENT': 25.0, '2-HIGH': 20.0}, ('2-HIGH',), {'3-MEDIUM': 30.0}, {'3-MEDIUM': 90.0}, {'3-MEDIUM': 0.1}, {'3-MEDIUM': 0.05}, '5-LOW')} SELECT {_STATE_COLUMNS} FROM rows")
def single_backtest(spark, d):
    rules = simulate.Rules(stops=(Exit("1-URGENT", 25.0), Exit("2-HIGH", 20.0, trailing=True)), targets=(Exit("3-MEDIUM", 30.0),), sizes=(PositionSize("3-MEDIUM", percentage_of_portfolio=90.0),), costs=(TradingCost("3-MEDIUM", 0.1, 0.05),), cooldowns=(Cooldown(4, "5-LOW", trigger="buy", blocks="buy"),))
    return rounded(simulate.simulate_single(_signals(spark, d).withColumn("run_id", F.col("symbol")), rules), **_STATES)


_FIVE = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("event_backtest", f"WITH RECURSIVE {oracles.orders(_SIGNALS, _FIVE)} SELECT {_STATE_COLUMNS} FROM (SELECT 'run' AS run_id, * FROM rows)")
def event_backtest(spark, d):
    """Five symbols that share cash."""
    return rounded(simulate.simulate_orders(_signals(spark, d)), **_STATES)


# A simulated run without rules has a closed form: all in at a buy, all out at a sell, one run per symbol.
@query("vector_backtest_closed", f"WITH {_EQUITY} SELECT symbol AS run_id, datetime, round(ln(100000::DOUBLE) + growth, 5) AS log_equity FROM eq")
def vector_backtest_closed(spark, d):
    signals = _signals(spark, d).withColumn("run_id", F.col("symbol"))
    equity = simulate.equity_of(simulate.simulate_portfolio(signals)).join(signals.select("run_id", "datetime"), ["run_id", "datetime"])
    return equity.select("run_id", "datetime", F.round(F.ln("total_equity"), 5).alias("log_equity"))


_EVENTS = """SELECT CAST(user_id % 10 AS VARCHAR) AS account, event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'order' WHEN 3 THEN 'cancel' ELSE 'price' END AS kind, CAST(CASE WHEN event_id % 4 = 3 THEN event_id - 3 ELSE event_id END AS VARCHAR) AS order_id, event_type AS symbol,
    CASE WHEN event_id % 3 = 0 THEN 'SELL' ELSE 'BUY' END AS side, CASE WHEN event_id % 8 = 0 THEN 'MARKET' ELSE 'LIMIT' END AS order_type, user_id % 5 + 1.0::DOUBLE AS quantity, value AS price FROM events"""


@query(
    "paper_ledger",
    f"""WITH RECURSIVE {oracles.paper(_EVENTS)} SELECT account, order_id, symbol, side, order_type, quantity, status, message, CAST(filled_at AS DOUBLE) AS fill_seq, round(fill, 7) AS fill_price, round(fee, 6) AS fees, round(realized, 6) AS realized FROM rows""",
)
def paper_ledger(spark, d):
    e = panels.table(spark, d, "events")
    kind = F.when(F.col("event_id") % 4 == 0, "order").when(F.col("event_id") % 4 == 3, "cancel").otherwise("price")
    events = e.select(
        (F.col("user_id") % 10).cast("string").alias("account"), F.col("event_id").alias("seq"), kind.alias("kind"), F.when(F.col("event_id") % 4 == 3, F.col("event_id") - 3).otherwise(F.col("event_id")).cast("string").alias("order_id"), F.col("event_type").alias("symbol"),
        F.when(F.col("event_id") % 3 == 0, "SELL").otherwise("BUY").alias("side"), F.when(F.col("event_id") % 8 == 0, "MARKET").otherwise("LIMIT").alias("order_type"), (F.col("user_id") % 5 + 1.0).alias("quantity"), F.col("value").alias("price"), F.lit("CNC").alias("product"),
    )
    return rounded(paper_trading(events).withColumn("fill_seq", F.col("fill_seq").cast("double")), fill_price=7, fees=6, realized=6)


# --- stores: written and read back ---------------------------------------------------------------------


def _store_folder(spark) -> str:
    return f"{work_folder(spark)}/store-{uuid.uuid4().hex}"


@query("bundle_round_trip", f"WITH {_EQUITY} SELECT symbol AS run_id, datetime, round(ln(100000::DOUBLE) + growth, 6) AS log_equity FROM eq")
def bundle_round_trip(spark, d):
    """Equity curves and trades saved as a bundle and read back."""
    signals = _signals(spark, d)
    equity = closed_form.equity_curve(signals).select(F.col("symbol").alias("run_id"), "datetime", "total_equity")
    path = store.save_bundle(f"{_store_folder(spark)}/run", {"kind": "curves"}, equity, closed_form.trades(signals))
    return store.load_bundle(spark, path)["equity_curve"].select("run_id", "datetime", F.round(F.ln("total_equity"), 6).alias("log_equity"))


@query("bar_cache_round_trip", f"WITH {_BARS} SELECT symbol, datetime, open, high, low, close, CAST(volume AS BIGINT) AS volume FROM bars")
def bar_cache_round_trip(spark, d):
    """Bars put into the cache and read from it."""
    cache, key = store.BarCache(spark, _store_folder(spark)), ("orders", "ALL", "1day", "1995-01-01", "2001-12-31")
    cache.put(panels.order_bars(spark, d), *key)
    return cache.get(*key).select("symbol", "datetime", "open", "high", "low", "close", F.col("volume").cast("long").alias("volume"))


@query("content_store_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def content_store_round_trip(spark, d):
    """A table put twice under the digest of its content, and read by it."""
    kept, nations = store.ContentStore(spark, _store_folder(spark)), panels.table(spark, d, "nation")
    first, again = kept.put(nations), kept.put(nations.repartition(3, "n_name"))
    assert first == again
    return kept.get(again).select("n_nationkey", "n_name", "n_regionkey")


@query("rank_snapshot_replaced", f"WITH {_FACTORS}, l AS (SELECT symbol, ret FROM f WHERE datetime = (SELECT max(datetime) FROM f)), r AS (SELECT symbol, round(ret, 6) AS value, row_number() OVER (ORDER BY ret DESC NULLS LAST, symbol) AS rank FROM l) SELECT symbol, value, rank FROM r WHERE rank <= 3")
def rank_snapshot_replaced(spark, d):
    """A snapshot of the last date's factor put over another one, and its top rows."""
    index = store.RankIndex(spark, _store_folder(spark))
    v = _one(spark, d, value=_RET).select(F.lit("last").alias("date"), "datetime", F.lit("ret").alias("factor_name"), "symbol", "value")
    v = v.where(F.col("datetime") == v.agg(F.max("datetime")).first()[0]).drop("datetime")
    index.put(v.withColumn("value", -F.col("value")))
    index.put(v)
    return index.top("last", "ret", 3).select("symbol", F.round("value", 6).alias("value"), F.col("rank").cast("long").alias("rank"))


@query(
    "audit_log",
    """SELECT * FROM (VALUES ('s1', 'order', '{"api_key": "[REDACTED]", "quantity": 3}', sha256('{"api_key": "k", "quantity": 3}')),
      ('s2', 'order', '{"legs": [{"password": "[REDACTED]", "x": 1}]}', sha256('{"legs": [{"password": "p", "x": 1}]}'))) t(session_id, action, detail, detail_sha256)""",
)
def audit_log(spark, d):
    """Actions appended, one and many at a time, and read by their name; secrets are redacted at any depth."""
    log = store.AuditLog(spark, _store_folder(spark))
    log.append("order", {"quantity": 3, "api_key": "k"}, "s1")
    log.extend([("chat", {"token": "t"}, "s1"), ("order", {"legs": [{"password": "p", "x": 1}]}, "s2")])
    return log.query("order").select("session_id", "action", "detail", "detail_sha256")


# --- dates as text, and whole numbers with nulls as doubles: types that every client reads alike --------

_AS = {
    "date_chunks": {"chunk_start": "string", "chunk_end": "string"},
    "trading_days": {"day": "string"},
    "next_trading_day": {"day": "string", "next_day": "string"},
    "previous_trading_day": {"day": "string", "previous_day": "string"},
    "market_status": {"day": "string"},
    "holidays": {"day": "string"},
    "option_chain": {"expiry": "string"},
    "synthetic_chain": {"expiry": "string"},
    "date_after": {"due": "string"},
    "interval_minutes": {"minutes": "double"},
    "panel_union": {"volume": "double"},
}


def _cast(make, types: dict[str, str]):
    return lambda spark, d: (df := make(spark, d)).withColumns({c: df[c].cast(t) for c, t in types.items()})


for _name, _types in _AS.items():
    QUERIES[_name] = _cast(QUERIES[_name], _types)
    _casts = ", ".join(f"CAST({c} AS {'VARCHAR' if t == 'string' else 'DOUBLE'}) AS {c}" for c, t in _types.items())
    SQL[_name] = f"SELECT * REPLACE ({_casts}) FROM ({SQL[_name]}) q"
