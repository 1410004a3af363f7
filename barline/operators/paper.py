"""Paper trading: a fold over the events of an account (orders, cancellations, prices).

Events: account, seq, kind (order, cancel, price), order_id, symbol, side, order_type, quantity, price,
product. A placed order is checked against the position so far; a price event fills waiting orders of its
symbol in the order of their placing: MARKET at the price, LIMIT at its limit once the price is as good; STOP and
STOP_LIMIT wait for ever. Limits wait in heaps by symbol, so a price looks at no order that it doesn't reach.
Fills carry slippage and statutory costs. Accounts are independent and run in parallel.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.operators.costs import StatutoryCosts

OUTCOME = "account string, order_id string, symbol string, side string, order_type string, quantity double, status string, message string, fill_seq long, fill_price double, fees double, realized double"
_NAMES = [x.split()[0] for x in OUTCOME.split(", ")]


class _Book:
    """The waiting orders of one symbol: those that any price fills, and limits by side, the nearest on top."""

    def __init__(self):
        self.any: list[tuple[int, dict]] = []
        self.limits: dict[str, list[tuple[float, int, dict]]] = {"BUY": [], "SELL": []}

    def add(self, number: int, order: dict, limit: float | None) -> None:
        if order["order_type"] == "MARKET" or (order["order_type"] == "LIMIT" and (limit is None or limit != limit)):
            self.any.append((number, order))
        elif order["order_type"] == "LIMIT" and order["side"] in self.limits:
            heapq.heappush(self.limits[order["side"]], (-limit if order["side"] == "BUY" else limit, number, order))

    def reached(self, price: float) -> list[tuple[dict, float]]:
        """Open orders that fill at a price, with the price each gets, in the order of their placing."""
        hits = [(number, order, price) for number, order in self.any]
        self.any = []
        for side, sign in (("BUY", -1), ("SELL", 1)):
            heap = self.limits[side]
            while heap and heap[0][0] <= sign * price:
                level, number, order = heapq.heappop(heap)
                hits.append((number, order, sign * level))
        return [(order, raw) for _, order, raw in sorted(hits, key=lambda h: h[0]) if order["status"] == "OPEN"]


def _run(frame: pd.DataFrame, costs: StatutoryCosts, most: float, products: tuple[str, ...]) -> pd.DataFrame:
    held: dict[str, tuple[float, float]] = {}
    books: defaultdict[str, _Book] = defaultdict(_Book)
    done: list[dict] = []
    named: dict[str, dict] = {}
    for e in frame.sort_values("seq").itertuples(index=False):
        if e.kind == "order":
            why = [
                *(["quantity must be positive"] if e.quantity <= 0 else []),
                *(["quantity above the limit"] if e.quantity > most else []),
                *(["product not allowed"] if str(e.product).upper() not in products else []),
                *(["long-only: sells more than held"] if e.side == "SELL" and e.quantity > held.get(e.symbol, (0.0, 0.0))[0] else []),
            ]
            o = dict.fromkeys(_NAMES) | {"account": e.account, "order_id": e.order_id, "symbol": e.symbol, "side": e.side, "order_type": e.order_type, "quantity": e.quantity, "status": "REJECTED" if why else "OPEN", "message": "; ".join(why) or None}
            done.append(o)
            if not why:
                named[e.order_id] = o
                books[e.symbol].add(len(done), o, e.price)
        elif e.kind == "cancel":
            if (o := named.get(e.order_id)) is not None and o["status"] == "OPEN":
                o["status"] = "CANCELLED"
        else:
            for o, raw in books[e.symbol].reached(e.price):
                fill, n = costs.fill(raw, o["side"]), o["quantity"]
                q, avg = held.get(e.symbol, (0.0, 0.0))
                gain = 0.0
                if o["side"] == "BUY":
                    held[e.symbol] = (q + n, (q * avg + n * fill) / (q + n))
                else:
                    gain = min(n, q) * (fill - avg)
                    left = q - min(n, q)
                    held[e.symbol] = (left, avg if left > 0 else 0.0)
                o |= {"status": "COMPLETE", "fill_seq": e.seq, "fill_price": fill, "fees": costs.total(fill * n, o["side"]), "realized": gain}
    out = pd.DataFrame(done, columns=_NAMES)
    out["fill_seq"] = out["fill_seq"].astype("Int64")
    return out


def paper_trading(events: DataFrame, costs: StatutoryCosts = StatutoryCosts(), most: float = 10_000.0, products: tuple[str, ...] = ("CNC", "MIS")) -> DataFrame:
    """One row per order with its status, fill, costs and realized profit (costs apart)."""
    return events.groupBy("account").applyInPandas(lambda f: _run(f, costs, most, products), OUTCOME)


def fills_of(outcome: DataFrame) -> DataFrame:
    """The completed orders as fills for the ledger."""
    return outcome.where("status = 'COMPLETE'").select("account", "symbol", F.col("fill_seq").alias("seq"), "side", "quantity", F.col("fill_price").alias("price"), "fees")
