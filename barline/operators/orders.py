"""Orders: fills against bars, order checks, and a ledger of fills."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.windows import by_symbol
from barline.operators.costs import StatutoryCosts


def fill_price(kind: Column, side: Column, limit: Column, stop: Column, open_: Column, high: Column, low: Column, close: Column) -> Column:
    """The price, before slippage, at which an order fills within a bar; null if it doesn't.
    MARKET at the open; LIMIT at the limit or a better close; STOP at the stop once it is touched; STOP_LIMIT at
    the limit when the bar touches both."""
    buys = F.upper(side) == "BUY"
    limit_hit, stop_hit = F.when(buys, low <= limit).otherwise(high >= limit), F.when(buys, high >= stop).otherwise(low <= stop)
    kind = F.upper(kind)
    return (
        F.when(kind == "MARKET", open_)
        .when((kind == "LIMIT") & limit_hit, F.when(buys, F.least(limit, close)).otherwise(F.greatest(limit, close)))
        .when((kind == "STOP") & stop_hit, stop)
        .when((kind == "STOP_LIMIT") & stop_hit & limit_hit, limit)
    )


_FIRST = "order_id long, filled_at timestamp_ntz, raw double"


class _Waiting:
    """Open orders of one kind and side, the one that fills first on top of a heap."""

    def __init__(self, by: str, low: bool):
        self.by, self.low, self.heap = by, low, []

    def add(self, o) -> None:
        level = getattr(o, self.by)
        heapq.heappush(self.heap, (-level if self.low else level, o.order_id, o))

    def touched(self, high: float, low: float) -> list:
        """Orders whose level the bar reaches, taken out: levels at or above the low, or at or below the high."""
        out = []
        while self.heap and (-self.heap[0][0] >= low if self.low else self.heap[0][0] <= high):
            out.append(heapq.heappop(self.heap)[2])
        return out


def _first_fills(orders, bars):
    """One symbol: bars in time order against heaps of open orders. An order is looked at when a bar reaches its
    level (a stop-limit order its limit, and it goes back if the stop isn't reached too)."""
    import pandas as pd

    found, market, k = [], [], 0
    waiting = {("LIMIT", "BUY"): _Waiting("price", True), ("LIMIT", "SELL"): _Waiting("price", False), ("STOP", "BUY"): _Waiting("stop_price", False), ("STOP", "SELL"): _Waiting("stop_price", True), ("STOP_LIMIT", "BUY"): _Waiting("price", True), ("STOP_LIMIT", "SELL"): _Waiting("price", False)}
    given = list(orders.sort_values(["created", "order_id"]).itertuples(index=False))
    for bar in bars.sort_values("datetime").itertuples(index=False):
        while k < len(given) and given[k].created < bar.datetime:
            o = given[k]
            k += 1
            if o.kind == "MARKET":
                market.append(o)
            elif (o.kind, o.side) in waiting and getattr(o, waiting[o.kind, o.side].by) == getattr(o, waiting[o.kind, o.side].by):
                waiting[o.kind, o.side].add(o)
        hits, back = [(o, bar.open) for o in market], []
        market = []
        for (kind, side), w in waiting.items():
            for o in w.touched(bar.high, bar.low):
                if kind == "LIMIT":
                    hits.append((o, min(o.price, bar.close) if side == "BUY" else max(o.price, bar.close)))
                elif kind == "STOP":
                    hits.append((o, o.stop_price))
                elif (bar.high >= o.stop_price) if side == "BUY" else (bar.low <= o.stop_price):
                    hits.append((o, o.price))
                else:
                    back.append(o)
        for o in back:
            waiting[o.kind, o.side].add(o)
        found += [(o.order_id, bar.datetime, float(raw)) for o, raw in hits if o.cancelled is pd.NaT or bar.datetime < o.cancelled]
    return pd.DataFrame(found, columns=["order_id", "filled_at", "raw"])


def first_fills(orders: DataFrame, bars: DataFrame, costs: StatutoryCosts | None = None) -> DataFrame:
    """Each order (order_id, symbol, side, kind, quantity, price, stop_price, created, and cancelled if there is
    such a column) with the first later bar, before its cancellation, that fills it; unfilled orders have
    nulls. Orders and bars of a symbol meet in one group and are swept in time order with heaps: no order is
    paired with bars that don't reach it."""
    costs = costs or StatutoryCosts()
    cancelled = F.col("cancelled") if "cancelled" in orders.columns else F.lit(None)
    given = orders.select(F.col("order_id").cast("long").alias("order_id"), "symbol", F.upper("side").alias("side"), F.upper("kind").alias("kind"), F.col("price").cast("double").alias("price"), F.col("stop_price").cast("double").alias("stop_price"), F.col("created").cast("timestamp_ntz").alias("created"), cancelled.cast("timestamp_ntz").alias("cancelled"))
    b = bars.select("symbol", "datetime", "open", "high", "low", "close")
    hit = given.groupBy("symbol").cogroup(b.groupBy("symbol")).applyInPandas(_first_fills, _FIRST).withColumnRenamed("order_id", "__id")
    done = costs.executed(F.col("raw"), F.col("quantity"), F.col("side"))
    df = orders.join(hit, F.col("order_id").cast("long") == F.col("__id"), "left").withColumn("x", F.when(F.col("raw").isNotNull(), done))
    return df.select(*orders.columns, "filled_at", F.col("x.fill").alias("fill_price"), F.col("x.costs").alias("fees"), F.col("x.cash").alias("cash"))


def check_orders(orders: DataFrame, max_quantity: float = 10_000.0, products: tuple[str, ...] = ("CNC",), long_only: bool = True) -> DataFrame:
    """Adds allowed and reasons to orders (side, quantity, product, position)."""
    reasons = [
        F.when(F.col("quantity") <= 0, F.lit("quantity must be positive")),
        F.when(F.col("quantity") > max_quantity, F.lit("quantity above the limit")),
        F.when(~F.upper("product").isin(*products), F.lit("product not allowed")),
    ]
    if long_only:
        reasons.append(F.when((F.upper("side") == "SELL") & (F.col("quantity") > F.col("position")), F.lit("long-only: sells more than held")))
    df = orders.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return df.withColumn("allowed", F.size("reasons") == 0)


def daily_loss_allowed(start_value: Column, value: Column, max_loss_pct: float) -> Column:
    """Whether the day's loss is within the limit; a start of zero or less allows."""
    return F.when(start_value <= 0, F.lit(True)).otherwise((start_value - value) / start_value * 100 <= max_loss_pct)


_LEDGER = "account string, symbol string, seq long, position double, average_cost double, realized_pnl double, fees double, cash double"


def _states(key, fills):
    """One position's states, fill by fill."""
    import pandas as pd

    out, held, cost, realized, fees, cash = [], 0.0, 0.0, 0.0, 0.0, 0.0
    for r in fills.sort_values("seq").itertuples(index=False):
        fee = 0.0 if r.fees is None or r.fees != r.fees else r.fees
        if r.side == "BUY":
            total = held * cost + r.quantity * r.price
            held += r.quantity
            cost = total / held if held > 0 else cost
            cash -= r.quantity * r.price + fee
        else:
            sold = min(r.quantity, held)
            realized += sold * (r.price - cost)
            held -= sold
            cost = cost if held > 0 else 0.0
            cash += r.quantity * r.price - fee
        fees += fee
        out.append((*key, r.seq, held, cost, realized, fees, cash))
    return pd.DataFrame(out, columns=["account", "symbol", "seq", "position", "average_cost", "realized_pnl", "fees", "cash"])


def ledger(fills: DataFrame) -> DataFrame:
    """The state after each fill (account, symbol, seq, side, quantity, price, fees): quantity, average cost,
    realized profit, fees and cash flow of the position so far. A sell beyond what is held realizes only what
    is held. Each state depends on the one before, so a position is one group; groups run in parallel."""
    given = fills.select(F.col("account").cast("string").alias("account"), "symbol", F.col("seq").cast("long").alias("seq"), F.upper("side").alias("side"), *(F.col(c).cast("double").alias(c) for c in ("quantity", "price", "fees")))
    return given.groupBy("account", "symbol").applyInPandas(_states, _LEDGER)


def positions(fills: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """The last state of each position, valued at prices (symbol, price): a missing price values it at 0 and
    leaves its unrealized profit at 0."""
    last = ledger(fills).groupBy("account", "symbol").agg(F.max_by(F.struct("position", "average_cost", "realized_pnl", "fees", "cash"), "seq").alias("s")).select("account", "symbol", "s.*")
    if prices is None:
        return last
    last = last.join(prices.select("symbol", "price"), "symbol", "left")
    return last.withColumn("market_value", F.col("position") * F.coalesce("price", F.lit(0.0))).withColumn("unrealized_pnl", F.when(F.coalesce("price", F.lit(0.0)) != 0, F.col("position") * (F.col("price") - F.col("average_cost"))).otherwise(0.0))


def accounts(fills: DataFrame, prices: DataFrame, initial_cash: float) -> DataFrame:
    """Cash, total value, realized and unrealized profit, fees and their total of each account."""
    df = positions(fills, prices).groupBy("account").agg((F.sum("cash") + initial_cash).alias("cash"), F.sum("market_value").alias("held"), F.sum("realized_pnl").alias("realized_pnl"), F.sum("unrealized_pnl").alias("unrealized_pnl"), F.sum("fees").alias("fees"))
    return df.select("account", "cash", (F.col("cash") + F.col("held")).alias("total_value"), "realized_pnl", "unrealized_pnl", "fees", (F.col("realized_pnl") + F.col("unrealized_pnl") - F.col("fees")).alias("total_pnl"))


def next_open_fills(signals: DataFrame, costs: StatutoryCosts | None = None) -> DataFrame:
    """Market orders placed at a bar's close (column side: BUY, SELL or null) fill at the next bar's open."""
    costs = costs or StatutoryCosts()
    w = by_symbol()
    df = signals.withColumn("raw", F.lead("open").over(w)).withColumn("filled_at", F.lead("datetime").over(w)).where("side IS NOT NULL AND raw IS NOT NULL")
    done = costs.executed(F.col("raw"), F.lit(1.0), F.col("side"))
    return df.select("symbol", "datetime", "side", "filled_at", done["fill"].alias("fill_price"), done["costs"].alias("fees"))
