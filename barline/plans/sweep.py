"""Parameter sweeps: a grid, all its runs in one plan, and the best of them."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barline.functions.windows import by_symbol, cumulative, ratio
from barline.plans.simulate import Rules, simulate_dense
from barline.sources.panels import PRICES, densify


class ParameterGrid:
    """All combinations of the axes, in their order."""

    def __init__(self, axes: dict[str, list]):
        self.axes = {k: list(v) for k, v in axes.items()}

    def __len__(self) -> int:
        n = 1
        for v in self.axes.values():
            n *= len(v)
        return n

    def __iter__(self) -> Iterator[dict]:
        return (dict(zip(self.axes, x, strict=True)) for x in itertools.product(*self.axes.values()))

    def frame(self, spark: SparkSession) -> DataFrame:
        """run_id and a column for each axis. Made of the axes alone: as large as the grid, not as any data."""
        rows = [(",".join(f"{k}={v}" for k, v in p.items()), *p.values()) for p in self]
        return spark.createDataFrame(rows, ["run_id", *self.axes])


def sweep(panel: DataFrame, grid: ParameterGrid, run: Callable[[DataFrame, dict], DataFrame]) -> DataFrame:
    """The union of run(panel, parameters) over the grid, each with its run_id: any function, one lazy plan, which
    grows with the grid. `cross_sweep` and `simulated_sweep` plan a grid of moving averages once for all runs."""
    parts = [run(panel, p).withColumn("run_id", F.lit(",".join(f"{k}={v}" for k, v in p.items()))) for p in grid]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def try_sweep(panel: DataFrame, grid: ParameterGrid, run: Callable[[DataFrame, dict], dict]) -> list[dict]:
    """One result a combination: parameters and result, or parameters and error."""
    out = []
    for p in grid:
        try:
            out.append({"parameters": p, "result": run(panel, p)})
        except Exception as e:  # noqa: BLE001  a failed combination is a result
            out.append({"parameters": p, "error": f"{type(e).__name__}: {e}"})
    return out


def cross_marks(panel: DataFrame, fasts: list[int], slows: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """symbol, datetime, the columns `keep` and marks: for each pair fast < slow 1 where the fast mean rises above
    the slow one, -1 where it falls below, otherwise 0.

    One shuffle: each mean is computed once, whatever the number of pairs, and marks are worked out on arrays of
    signs within the bar, so that no pair has a row of its own yet."""
    w = by_symbol()
    sizes = sorted({*fasts, *slows})
    pairs = F.array(*(F.struct(F.lit(sizes.index(a)).alias("a"), F.lit(sizes.index(b)).alias("b")) for a, b in _pairs(fasts, slows)))
    mean = lambda k: F.when(F.col("n") >= k, F.avg("close").over(w.rowsBetween(1 - k, 0)))
    df = panel.select("symbol", "datetime", "close", *keep, F.row_number().over(w).alias("n"))
    df = df.select("symbol", "datetime", *keep, F.array(*map(mean, sizes)).alias("m"))
    df = df.withColumn("m", F.transform(pairs, lambda p: F.sign(F.get("m", p["a"]) - F.get("m", p["b"])).cast("tinyint")))
    df = df.withColumn("m0", F.lag("m").over(w))
    crossed = F.zip_with("m", "m0", lambda now, was: F.when((now != 0) & (was != now), now).otherwise(F.lit(0).cast("tinyint")))
    return df.select("symbol", "datetime", *keep, crossed.alias("marks"))


def _pairs(fasts: list[int], slows: list[int]) -> list[tuple[int, int]]:
    return [(a, b) for a in fasts for b in slows if a < b]


def _named(run: Column, fasts: list[int], slows: list[int]) -> list[Column]:
    """run_id, fast and slow of a pair's number."""
    pairs = _pairs(fasts, slows)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), run + 1)
    return [of([f"fast={a},slow={b}" for a, b in pairs]).alias("run_id"), of([a for a, _ in pairs]).alias("fast"), of([b for _, b in pairs]).alias("slow")]


def cross_sweep(panel: DataFrame, fasts: list[int], slows: list[int]) -> DataFrame:
    """Moving-average crosses of all pairs fast < slow at once: log_growth, total_return and max_drawdown by run
    and symbol, signals only. Two shuffles: one by symbol for the means, one by run and symbol for positions,
    equity and drawdowns."""
    before = F.lag("close").over(by_symbol())
    bars = panel.select("symbol", "datetime", "close", F.ln(ratio(F.col("close"), before)).alias("change"))
    df = cross_marks(bars, fasts, slows, ("change",)).select("symbol", "datetime", "change", F.posexplode("marks").alias("run", "mark"))
    df = df.repartition(int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions")), "run", "symbol")  # small rows, much work: not joined by size
    r = Window.partitionBy("run", "symbol").orderBy("datetime")
    held = F.last(F.when(F.col("mark") != 0, F.col("mark")), ignorenulls=True).over(r.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("step", F.when(held == 1, F.col("change")).otherwise(0.0))
    df = df.withColumn("growth", F.sum("step").over(cumulative(r)))
    df = df.withColumn("drawdown", 1.0 - F.exp(F.col("growth") - F.max("growth").over(cumulative(r))))
    out = df.groupBy("run", "symbol").agg(F.max_by("growth", "datetime").alias("log_growth"), F.max("drawdown").alias("max_drawdown"))
    return out.select(*_named(F.col("run"), fasts, slows), "symbol", "log_growth", "max_drawdown").withColumn("total_return", F.expm1("log_growth"))


def simulated_sweep(panel: DataFrame, fasts: list[int], slows: list[int], rules: Rules = Rules(), capital: float = 100_000.0, dynamic: bool = True) -> DataFrame:
    """The same grid through the portfolio simulator, with its rules, trades, costs and equity rows: tagged rows
    by run_id (see barline.plans.simulate). The panel is put on its calendar once; only then bars are exploded
    into runs, each of which is simulated on its own."""
    marks = cross_marks(panel, fasts, slows).withColumnsRenamed({"symbol": "_symbol", "datetime": "_datetime"})
    dense = densify(panel.select("symbol", "datetime", *PRICES))
    on = F.col("symbol").eqNullSafe(F.col("_symbol")) & (F.col("datetime") == F.col("_datetime"))
    none = F.array_repeat(F.lit(0).cast("tinyint"), len(_pairs(fasts, slows)))
    df = dense.join(marks, on, "left").select("symbol", "datetime", *PRICES, F.posexplode(F.coalesce("marks", none)).alias("run", "mark"))
    up = F.col("mark") == 1
    signals = df.select(_named(F.col("run"), fasts, slows)[0], "symbol", "datetime", *PRICES, up.alias("buy"), (F.col("mark") == -1).alias("sell"), up.alias("scale_in"), F.lit(False).alias("scale_out"))
    return simulate_dense(signals, rules, capital, dynamic)


def best(results: DataFrame, metric: str, maximize: bool = True, by: list[str] | None = None, first: str = "run_id") -> DataFrame:
    """The result with the best metric (of each group); nulls lose, of equals the first by `first` wins. Without
    groups each task sends its own best row only."""
    x: Column = F.col(metric)
    order = [x.desc_nulls_last() if maximize else x.asc_nulls_last(), F.col(first)]
    known = results.where(x.isNotNull())
    if not by:
        return known.orderBy(*order).limit(1)
    return known.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__k = 1").drop("__k")
