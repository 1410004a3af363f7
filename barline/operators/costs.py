"""Trading costs as expressions: percentage costs by symbol, statutory costs of Indian equity delivery."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TradingCost:
    """Slippage and fee in percent, and a fixed fee, of one symbol. Without a symbol it fits no order."""

    symbol: str | None = None
    fee_percentage: float = 0.0
    slippage_percentage: float = 0.0
    fee_fixed: float = 0.0

    def fill(self, price, side: str):
        """Buys fill above, sells below the price; works on numbers and Columns."""
        return price * (1 + (1 if side == "BUY" else -1) * self.slippage_percentage / 100)

    def fee(self, value):
        return value * (self.fee_percentage / 100) + self.fee_fixed


ZERO_COST = TradingCost()


def cost_of(symbol: str, costs: list[TradingCost]) -> TradingCost:
    """The first cost of the symbol, otherwise none."""
    return next((c for c in costs if c.symbol and c.symbol.upper() == symbol.upper()), ZERO_COST)


@dataclass(frozen=True)
class StatutoryCosts:
    """Charges by side; percentages of the turnover, `sebi_per_crore` per ten million."""

    # The default rates.
    brokerage_pct: float = 0.0
    brokerage_flat: float = 0.0
    stt_pct_sell: float = 0.1
    stamp_duty_pct_buy: float = 0.015
    transaction_charge_pct: float = 0.00325
    gst_pct: float = 18.0
    sebi_per_crore: float = 10.0
    slippage_pct: float = 0.05

    def fill(self, price, side: str):
        return price * (1 + (1 if side == "BUY" else -1) * self.slippage_pct / 100)

    def parts(self, turnover: float, side: str) -> dict[str, float]:
        brokerage = max(self.brokerage_flat, turnover * self.brokerage_pct / 100) if self.brokerage_pct else self.brokerage_flat
        exchange = turnover * self.transaction_charge_pct / 100
        out = {
            "brokerage": brokerage,
            "stt": turnover * self.stt_pct_sell / 100 if side == "SELL" else 0.0,
            "stamp_duty": turnover * self.stamp_duty_pct_buy / 100 if side == "BUY" else 0.0,
            "transaction_charges": exchange,
            "sebi_charges": turnover * self.sebi_per_crore / 1e7,
            "gst": (brokerage + exchange) * self.gst_pct / 100,
        }
        return out | {"total": sum(out.values())}

    def total(self, turnover: float, side: str) -> float:
        return self.parts(turnover, side)["total"]

    def breakdown(self, turnover: Column, side: Column) -> Column:
        """The same parts as one struct Column."""
        side = F.upper(side)
        brokerage = F.greatest(F.lit(self.brokerage_flat), turnover * (self.brokerage_pct / 100)) if self.brokerage_pct else F.lit(self.brokerage_flat)
        exchange = turnover * (self.transaction_charge_pct / 100)
        only = lambda name, rate: F.when(side == name, turnover * (rate / 100)).otherwise(0.0)
        parts = {
            "brokerage": brokerage, "stt": only("SELL", self.stt_pct_sell), "stamp_duty": only("BUY", self.stamp_duty_pct_buy),
            "transaction_charges": exchange, "sebi_charges": turnover * (self.sebi_per_crore / 1e7), "gst": (brokerage + exchange) * (self.gst_pct / 100),
        }
        total = F.lit(0.0)
        for x in parts.values():
            total = total + x
        return F.struct(*(x.alias(k) for k, x in parts.items()), total.alias("total"))

    def executed(self, price: Column, quantity: Column, side: Column) -> Column:
        """Struct of fill price, turnover, costs and cash (paid by a buy, received by a sell)."""
        buys = F.upper(side) == "BUY"
        fill = F.when(buys, self.fill(price, "BUY")).otherwise(self.fill(price, "SELL"))
        turnover = fill * quantity
        cost = self.breakdown(turnover, side)
        return F.struct(fill.alias("fill"), turnover.alias("turnover"), cost["total"].alias("costs"), F.when(buys, turnover + cost["total"]).otherwise(turnover - cost["total"]).alias("cash"))
