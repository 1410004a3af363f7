"""Declarative pipelines: a class whose attributes are factors, an optional universe filter, one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.plans.factors import Factor, Filter, Node, evaluate
from barline.sources.panels import between, normalise


class Pipeline:
    """Class attributes that are factors become columns, in order of definition along the class hierarchy;
    names that begin with _ are left out. `universe`, a filter, selects rows of the result."""

    universe: Filter | None = None
    _columns: dict[str, Factor] = {}

    def __init_subclass__(cls, **kwargs) -> None:
        super().__init_subclass__(**kwargs)
        cls._columns = {}
        for base in reversed(cls.__mro__):
            for name, x in vars(base).items():
                if isinstance(x, Factor) and not name.startswith("_"):
                    cls._columns[name] = x
        if cls.universe is not None and not isinstance(cls.universe, Filter):
            raise TypeError("universe is to be a filter")
        if not cls._columns:
            raise TypeError(f"{cls.__name__} has no factor")

    @classmethod
    def columns(cls) -> dict[str, Factor]:
        return dict(cls._columns)

    @classmethod
    def required_columns(cls) -> list[str]:
        nodes = [*cls._columns.values(), *([cls.universe] if cls.universe else [])]
        return sorted({c for x in nodes for c in x.required_columns()})

    @classmethod
    def required_window(cls) -> int:
        nodes = [*cls._columns.values(), *([cls.universe] if cls.universe else [])]
        return max(x.required_window() for x in nodes)


def run_pipeline(panel: DataFrame, pipeline: type[Pipeline], start: str | None = None, end: str | None = None, warm_up: bool = False) -> DataFrame:
    """(datetime, symbol, columns). Dates bound the panel before any window; with warm_up they bound only the
    result. The universe selects rows of the result; masks given to factors act inside them."""
    panel = normalise(panel)
    if not warm_up:
        panel = between(panel, start, end)
    nodes: dict[str, Node] = pipeline.columns()
    if pipeline.universe is not None:
        nodes["__universe"] = pipeline.universe
    needed = [c for c in panel.columns if c in {"datetime", "symbol", *pipeline.required_columns()}]
    out = evaluate(panel.select(*needed), nodes)
    if warm_up:
        out = between(out, start, end)
    if pipeline.universe is not None:
        out = out.where("__universe")
    return out.select("datetime", "symbol", *pipeline.columns())


def rank_signals(bars: DataFrame, ranked: DataFrame, rank_column: str, top_n: int = 1, descending: bool = False) -> DataFrame:
    """Adds buy (rank at most top_n) and sell (not buy) to bars. Ranks ascend from the smallest value; with
    descending, the largest values of each time are bought."""
    r = F.col("__rank")
    ranked = ranked.select("symbol", "datetime", F.col(rank_column).alias("__rank"))
    if descending:
        from pyspark.sql import Window

        w = Window.partitionBy("datetime").orderBy(r.desc_nulls_last(), "symbol")
        ranked = ranked.select("symbol", "datetime", F.when(r.isNotNull(), F.row_number().over(w)).alias("__rank"))
    joined = bars.join(ranked, ["symbol", "datetime"], "left").withColumn("buy", F.coalesce(r < top_n + 1, F.lit(False)))
    return joined.withColumn("sell", ~F.col("buy")).drop("__rank")


def last_date_top(ranked: DataFrame, column: str, n: int) -> DataFrame:
    """The n rows with the smallest values at the last time."""
    last = ranked.agg(F.max("datetime").alias("__last"))
    at = ranked.join(F.broadcast(last), F.col("datetime") == F.col("__last")).drop("__last")  # one row
    return at.orderBy(F.col(column).asc_nulls_last(), "symbol").limit(n)
