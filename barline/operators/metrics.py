"""Metrics of equity curves (run_id, datetime, total_equity, position_value) and trades (run_id, datetime,
side, pnl, fee, ...): all runs at once, one row for each run.

Curve columns that need order (returns, peaks) come from one window per run; everything else is one
group-by. Trade figures look at SELL rows. Defined results: runs without enough rows get 0, as each figure
says; a division by a loss of zero is infinite where there is a profit, otherwise 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import cumulative, elapsed_days, ratio

YEAR = 252
RISK_FREE = 0.04
EQUITY_METRICS = (
    "total_return", "cagr", "annualized_return", "annualized_volatility", "sharpe_ratio", "sortino_ratio", "max_drawdown",
    "max_drawdown_duration_days", "avg_drawdown", "ulcer_index", "calmar_ratio", "recovery_factor", "average_daily_return",
    "daily_return_std", "return_skewness", "return_kurtosis", "value_at_risk_5", "conditional_value_at_risk_5", "exposure",
)
TRADE_METRICS = (
    "win_rate", "num_trades", "num_winning_trades", "num_losing_trades", "gross_profit", "gross_loss", "net_profit", "total_fees",
    "profit_factor", "avg_trade_return", "avg_winning_trade", "avg_losing_trade", "payoff_ratio", "trade_expectancy",
)
BENCHMARK_METRICS = ("beta", "alpha", "information_ratio", "treynor_ratio")


def _run() -> Window:
    return Window.partitionBy("run_id").orderBy("datetime")


def curve(equity: DataFrame) -> DataFrame:
    """Adds ret (change to the bar before), peak (maximum so far), drawdown (share below it, 0 without a peak),
    peak_before and peak_time (last bar at its peak)."""
    w = _run()
    v = F.col("total_equity")
    df = equity.select("*", (ratio(v, F.lag(v).over(w)) - 1.0).alias("ret"), F.max(v).over(cumulative(w)).alias("peak"), F.max(v).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("peak_before"))
    df = df.withColumn("drawdown", F.when(F.col("peak") == 0, 0.0).otherwise((F.col("peak") - v) / F.col("peak")))
    return df.withColumn("peak_time", F.last(F.when(v >= F.col("peak"), F.col("datetime")), ignorenulls=True).over(cumulative(w)))


def drawdown_series(equity: DataFrame) -> DataFrame:
    return curve(equity).select("run_id", "datetime", "drawdown")


def equity_metrics(equity: DataFrame, risk_free: float = RISK_FREE, level: float = 0.05) -> DataFrame:
    """One row per run with EQUITY_METRICS and downside_deviation. The value at risk is the return at place
    floor((n - 1) * level) of a run's returns in order, found by a second order within the same partitions; no
    run's returns are gathered."""
    has_position = "position_value" in equity.columns
    r, daily = F.col("ret"), risk_free / YEAR
    v = F.col("total_equity")
    below = F.when(F.col("peak_before").isNull() | (v <= F.col("peak_before")), F.col("drawdown"))
    of_run = Window.partitionBy("run_id")
    ranked = curve(equity).withColumn("place", F.row_number().over(of_run.orderBy(r.asc_nulls_last()))).withColumn("known", F.count(r).over(of_run))
    ranked = ranked.withColumn("var", F.max(F.when(F.col("place") == F.floor((F.col("known") - 1) * F.lit(level)) + 1, r)).over(of_run))
    df = (
        ranked.groupBy("run_id").agg(
            F.count("*").alias("n"), F.count(r).alias("nr"),
            F.min_by(v, "datetime").alias("first"), F.max_by(v, "datetime").alias("last"),
            F.min("datetime").alias("t0"), F.max("datetime").alias("t1"),
            F.avg(r).alias("mean"), F.stddev_samp(r).alias("std"),
            F.stddev_samp(F.when(r < 0, r)).alias("down"), F.count(F.when(r < 0, r)).alias("n_down"),
            F.max("drawdown").alias("max_drawdown"), F.max(elapsed_days(F.col("peak_time"), F.col("datetime"))).alias("long"),
            F.avg(below).alias("avg_dd"), F.avg(F.when(F.col("peak") != 0, F.col("drawdown") * F.col("drawdown"))).alias("dd2"),
            F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt"), F.max("var").alias("var"), F.avg(F.when(r <= F.col("var"), r)).alias("tail"),
            (F.avg(F.when(F.col("position_value") > 0, 1.0).otherwise(0.0)) if has_position else F.lit(0.0)).alias("exposure"),
        )
    )
    nonzero = lambda ok, x: F.when(ok, x).otherwise(0.0)
    n, first, last = F.col("n"), F.col("first"), F.col("last")
    days = F.greatest(elapsed_days(F.col("t0"), F.col("t1")), F.lit(1))
    growth = ratio(last, first)
    df = df.withColumn("total_return", nonzero(first != 0, ratio(last, first) - 1.0))
    df = df.withColumn("cagr", F.when((n < 2) | (first <= 0), 0.0).when(growth <= 0, -1.0).otherwise(F.pow(growth, F.lit(365.0) / days) - 1.0))
    one = 1.0 + F.col("total_return")
    df = df.withColumn("annualized_return", F.when(n < 2, 0.0).when(one <= 0, -1.0).otherwise(F.pow(one, F.lit(float(YEAR)) / n) - 1.0))
    std, many = F.coalesce("std", F.lit(0.0)), F.col("nr") >= 2
    df = df.withColumn("annualized_volatility", nonzero(many, std * F.sqrt(F.lit(float(YEAR)))))
    df = df.withColumn("downside_deviation", nonzero(F.col("n_down") >= 2, F.coalesce("down", F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))))
    excess = (F.col("mean") - daily) * F.sqrt(F.lit(float(YEAR)))
    df = df.withColumn("sharpe_ratio", nonzero(many & (std >= 1e-12), ratio(excess, std)))
    df = df.withColumn("sortino_ratio", nonzero(F.col("downside_deviation") >= 1e-12, ratio(excess, F.col("downside_deviation"))))
    worst = F.col("max_drawdown")
    df = df.withColumn("calmar_ratio", nonzero(worst > 0, ratio(F.col("cagr") - risk_free, worst))).withColumn("recovery_factor", nonzero(worst > 0, ratio(F.col("total_return"), worst)))
    some = F.col("nr") > 0
    df = df.withColumn("value_at_risk_5", nonzero(some, F.col("var"))).withColumn("conditional_value_at_risk_5", nonzero(some, F.col("tail")))
    return df.select(
        "run_id", "total_return", "cagr", "annualized_return", "annualized_volatility", "downside_deviation", "sharpe_ratio", "sortino_ratio", "max_drawdown",
        F.coalesce("long", F.lit(0)).cast("long").alias("max_drawdown_duration_days"), F.coalesce("avg_dd", F.lit(0.0)).alias("avg_drawdown"), F.sqrt(F.coalesce("dd2", F.lit(0.0))).alias("ulcer_index"),
        "calmar_ratio", "recovery_factor", F.coalesce("mean", F.lit(0.0)).alias("average_daily_return"), std.alias("daily_return_std"),
        F.when(F.col("nr") >= 3, F.col("skew")).otherwise(0.0).alias("return_skewness"), F.when(F.col("nr") >= 4, F.col("kurt")).otherwise(0.0).alias("return_kurtosis"),
        "value_at_risk_5", "conditional_value_at_risk_5", "exposure",
    )


def trade_metrics(trades: DataFrame) -> DataFrame:
    """One row per run with TRADE_METRICS. Fees count on all rows, everything else on SELL rows."""
    sell, pnl = F.col("side") == "SELL", F.col("pnl")
    won, lost = sell & (pnl > 0), sell & (pnl <= 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = trades.groupBy("run_id").agg(
        F.count_if(sell).alias("num_trades"), F.count_if(won).alias("num_winning_trades"), F.count_if(lost).alias("num_losing_trades"),
        zero(F.sum(F.when(won, pnl))).alias("gross_profit"), zero(F.sum(F.when(lost, pnl))).alias("gross_loss"), zero(F.sum(F.when(sell, pnl))).alias("net_profit"),
        zero(F.sum("fee")).alias("total_fees"), zero(F.avg(F.when(sell, pnl))).alias("avg_trade_return"),
        zero(F.avg(F.when(won, pnl))).alias("avg_winning_trade"), zero(F.avg(F.when(lost, pnl))).alias("avg_losing_trade"),
    )
    df = df.withColumn("win_rate", zero(ratio(F.col("num_winning_trades").cast("double"), F.col("num_trades"))))
    against = lambda a, b: F.when(F.col(b) != 0, ratio(F.col(a), F.abs(F.col(b)))).when(F.col(a) > 0, F.lit(float("inf"))).otherwise(0.0)
    df = df.withColumn("profit_factor", against("gross_profit", "gross_loss")).withColumn("payoff_ratio", against("avg_winning_trade", "avg_losing_trade"))
    losing = zero(ratio(F.col("num_losing_trades").cast("double"), F.col("num_trades")))
    df = df.withColumn("trade_expectancy", F.col("win_rate") * F.col("avg_winning_trade") - losing * F.abs("avg_losing_trade"))
    return df.select("run_id", *TRADE_METRICS)


def trade_durations(trades: DataFrame, by_symbol: bool = False) -> DataFrame:
    """As-of pairs: each SELL with the latest BUY at or before it (of any symbol, unless by_symbol), and the
    whole days between. SELLs before any BUY go; one BUY may serve several SELLs."""
    keys = ["run_id", "symbol"] if by_symbol else ["run_id"]
    buy_first = F.when(F.col("side") == "BUY", 0).otherwise(1)
    w = cumulative(Window.partitionBy(*keys).orderBy("datetime", buy_first))
    opened = F.last(F.when(F.col("side") == "BUY", F.col("datetime")), ignorenulls=True).over(w)
    pairs = trades.withColumn("opened", opened).where((F.col("side") == "SELL") & F.col("opened").isNotNull())
    return pairs.select("run_id", "symbol", "opened", F.col("datetime").alias("closed"), elapsed_days(F.col("opened"), F.col("datetime")).alias("days"))


def duration_metrics(trades: DataFrame, by_symbol: bool = False) -> DataFrame:
    found = trade_durations(trades, by_symbol).groupBy("run_id").agg(F.avg("days").alias("a"), F.max("days").alias("m"))
    runs = trades.select("run_id").distinct()
    return runs.join(found, "run_id", "left").select("run_id", F.coalesce("a", F.lit(0.0)).alias("avg_trade_duration_days"), F.coalesce("m", F.lit(0)).cast("long").alias("max_trade_duration_days"))


def streaks(trades: DataFrame) -> DataFrame:
    """max_consecutive_wins and max_consecutive_losses of SELL rows in time order (gaps and islands)."""
    order = [c for c in ("datetime", "symbol") if c in trades.columns]
    w = Window.partitionBy("run_id").orderBy(*order)
    sells = trades.where("side = 'SELL'").withColumn("won", F.coalesce(F.col("pnl") > 0, F.lit(False)))
    islands = sells.select("run_id", "won", (F.row_number().over(w) - F.row_number().over(Window.partitionBy("run_id", "won").orderBy(*order))).alias("island"))
    runs = islands.groupBy("run_id", "won", "island").agg(F.count("*").alias("n")).groupBy("run_id")
    best = runs.agg(F.max(F.when(F.col("won"), F.col("n"))).alias("w"), F.max(F.when(~F.col("won"), F.col("n"))).alias("l"))
    return trades.select("run_id").distinct().join(best, "run_id", "left").select("run_id", F.coalesce("w", F.lit(0)).cast("long").alias("max_consecutive_wins"), F.coalesce("l", F.lit(0)).cast("long").alias("max_consecutive_losses"))


def _returns(equity: DataFrame) -> DataFrame:
    return curve(equity).where("ret IS NOT NULL").select("run_id", "datetime", "ret")


def benchmark_metrics(equity: DataFrame, benchmark: DataFrame, risk_free: float = RISK_FREE) -> DataFrame:
    """beta, alpha, information_ratio and treynor_ratio of each run against one benchmark curve (datetime,
    total_equity). Returns are aligned by position from the end; the means in alpha are those of the whole
    series."""
    back = Window.partitionBy("run_id").orderBy(F.desc("datetime"))
    ours = _returns(equity).withColumn("k", F.row_number().over(back))
    theirs = _returns(benchmark.select(F.lit("").alias("run_id"), "datetime", "total_equity")).withColumn("k", F.row_number().over(back))
    pairs = ours.join(theirs.select("k", F.col("ret").alias("b")), "k").groupBy("run_id").agg(F.covar_samp("ret", "b").alias("cov"), F.var_samp("b").alias("var"), F.avg(F.col("ret") - F.col("b")).alias("diff"), F.stddev_samp(F.col("ret") - F.col("b")).alias("sd"))
    means = ours.groupBy("run_id").agg(F.avg("ret").alias("mean"))
    other = theirs.agg(F.avg("ret").alias("other"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = means.join(pairs, "run_id", "left").crossJoin(other)  # one row: the benchmark's mean
    df = df.withColumn("beta", zero(ratio(F.col("cov"), F.col("var"))))
    yearly = F.col("mean") * float(YEAR) - risk_free
    return df.select(
        "run_id", "beta", (yearly - F.col("beta") * (zero(F.col("other")) * float(YEAR) - risk_free)).alias("alpha"),
        zero(ratio(F.col("diff") * F.sqrt(F.lit(float(YEAR))), F.col("sd"))).alias("information_ratio"), zero(ratio(yearly, F.col("beta"))).alias("treynor_ratio"),
    )


def monthly_returns(equity: DataFrame) -> DataFrame:
    """Return within each month, from its first to its last bar."""
    month = equity.groupBy("run_id", F.date_format("datetime", "yyyy").alias("year"), F.date_format("datetime", "MM").alias("month"))
    first, last = F.min_by("total_equity", "datetime"), F.max_by("total_equity", "datetime")
    return month.agg(ratio(last - first, first).alias("ret"))


def monthly_heatmap(equity: DataFrame, months: list[str] | None = None) -> DataFrame:
    """One row per run and year, one column per month (m01 ... m12), 0 where there is none."""
    names = months or [f"{k:02d}" for k in range(1, 13)]
    wide = monthly_returns(equity).groupBy("run_id", "year").pivot("month", names).agg(F.first("ret"))
    return wide.select("run_id", "year", *(F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(f"m{m}") for m in names))


def all_metrics(equity: DataFrame, trades: DataFrame, benchmark: DataFrame | None = None, risk_free: float = RISK_FREE) -> DataFrame:
    """One wide row per run: the equity, trade, duration, streak and benchmark metrics (null without one)."""
    df = equity_metrics(equity, risk_free).drop("downside_deviation")
    for other in (trade_metrics(trades), duration_metrics(trades), streaks(trades)):
        df = df.join(other, "run_id", "left").na.fill(0, [c for c in other.columns if c != "run_id"])
    if benchmark is None:
        return df.select("*", *(F.lit(None).cast("double").alias(c) for c in BENCHMARK_METRICS))
    return df.join(benchmark_metrics(equity, benchmark, risk_free), "run_id", "left")
