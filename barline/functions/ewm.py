"""Exponentially weighted means in linear time, by windows alone.

The mean is the recursion y = (1 - a) * y_before + a * x. With a clock T that advances by -ln(1 - a) a row, it
is a sum of a * x * exp(T_then - T_now). A running sum of a * x * exp(T) would overflow, so the clock is cut
into blocks of BLOCK: inside a block the running sum stays below exp(BLOCK), and what older blocks hand on
is the value at the last row of the block before, decayed. Handing on is done twice, as older blocks weigh
less than exp(-2 * BLOCK), below a double's rounding, after that.

All windows are by the same keys in time order (a second sort is by block within the keys), so several
means of a table cost one shuffle; each costs a few passes over sorted rows, whatever its period. Nothing is
gathered: no arrays, no Python, no limit on a key's rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.windows import cumulative

BLOCK = 18.0


def span_alpha(period: int) -> float:
    return 2.0 / (period + 1)


@dataclass(frozen=True)
class Mean:
    """The mean of a column. adjust: weights 1, 1 - alpha, ... of the rows there are, divided by their sum;
    otherwise recursive, starting with the first value. A null keeps its place in time and has the mean so
    far as its own; null before the first value."""

    column: str
    alpha: float
    adjust: bool = False


def _decayed(df: DataFrame, keys: list[str], order: str, parts: dict[str, Column], clock: Column, tag: str) -> DataFrame:
    """Adds, by name, sums of parts decayed by the clock (a Column: how far it is at each row)."""
    t, b, held = f"{tag}t", f"{tag}b", f"{tag}h"
    df = df.withColumn(t, clock).withColumn(b, F.floor(F.col(t) / BLOCK))
    inner = cumulative(Window.partitionBy(*keys, b).orderBy(order))
    grown = F.exp(F.col(t) - F.col(b) * BLOCK)
    df = df.select("*", *(F.sum(x * grown).over(inner).alias(f"{n}_s") for n, x in parts.items()))
    df = df.select("*", *((F.col(f"{n}_s") / grown).alias(f"{n}_0") for n in parts))
    blocks_before = Window.partitionBy(*keys).orderBy(b).rangeBetween(Window.unboundedPreceding, -1)
    for k in (0, 1):
        last = F.max_by(F.struct(F.col(t).alias("t"), *(F.col(f"{n}_{k}").alias(n) for n in parts)), order)
        df = df.withColumn(held, last.over(blocks_before))
        gone = F.exp(F.col(f"{held}.t") - F.col(t))
        df = df.select("*", *(F.coalesce(F.col(f"{n}_0") + F.col(f"{held}.{n}") * gone, F.col(f"{n}_0")).alias(f"{n}_{k + 1}") for n in parts)).drop(held)
    df = df.withColumns({n: F.col(f"{n}_2") for n in parts})
    return df.drop(t, b, *(f"{n}_{x}" for n in parts for x in ("s", "0", "1", "2")))


def with_means(df: DataFrame, means: dict[str, Mean], keys: list[str] | None = None, order: str = "datetime") -> DataFrame:
    """df with a column for each named mean, by keys (symbol) in the order of a column."""
    keys = keys or ["symbol"]
    w = Window.partitionBy(*keys).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    columns = df.columns
    df = df.withColumn("__n", F.row_number().over(w))
    for k, (name, m) in enumerate(means.items()):
        tag, x, alpha = f"__e{k}", F.col(m.column).cast("double"), m.alpha
        if alpha >= 1.0:
            df = df.withColumn(name, F.last(x, ignorenulls=True).over(cumulative(w)))
            continue
        unit = -math.log(1.0 - alpha)
        if m.adjust:
            parts = {f"{tag}x": F.coalesce(x, F.lit(0.0)), f"{tag}w": F.when(x.isNotNull(), 1.0).otherwise(0.0)}
            df = _decayed(df, keys, order, parts, F.col("__n") * unit, tag)
            # At a null both sums have decayed by the same factor, below what two blocks hand on after a long gap.
            at_value = F.when(x.isNotNull(), F.try_divide(f"{tag}x", f"{tag}w"))
            df = df.withColumn(name, F.last(at_value, ignorenulls=True).over(cumulative(w))).drop(*parts)
        else:
            # The newest value's weight is alpha against what is left of the mean's weight since the last value.
            known = F.last(F.when(x.isNotNull(), F.col("__n")), ignorenulls=True).over(before)
            df = df.withColumn(f"{tag}p", known)
            gap = F.exp((F.col("__n") - F.col(f"{tag}p")) * -unit)
            weight = F.when(x.isNull(), 0.0).when(F.isnull(f"{tag}p"), 1.0).otherwise(F.lit(alpha) / (F.lit(alpha) + gap))
            df = df.withColumn(f"{tag}a", weight)
            forgets = -F.log1p(-F.least(F.col(f"{tag}a"), F.lit(1.0 - 1e-16)))  # at most 37, two blocks
            moved = F.when((F.col(f"{tag}a") == 0.0) | F.isnull(f"{tag}p"), 0.0).otherwise(forgets)
            df = df.withColumn(f"{tag}u", F.sum(moved).over(cumulative(w)))
            df = _decayed(df, keys, order, {f"{tag}x": F.col(f"{tag}a") * F.coalesce(x, F.lit(0.0))}, F.col(f"{tag}u"), tag)
            started = x.isNotNull() | F.isnotnull(f"{tag}p")
            df = df.withColumn(name, F.when(started, F.col(f"{tag}x"))).drop(f"{tag}p", f"{tag}a", f"{tag}u", f"{tag}x")
    return df.select(*(f"`{c}`" for c in columns if c not in means), *(f"`{c}`" for c in means))
