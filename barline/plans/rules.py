"""Trading rules of a strategy: sizes, stops, targets, scaling, cooldowns. Plain values that travel to tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

from barline.schema import StrategyError

SIDES = ("buy", "sell", "any")


@dataclass(frozen=True)
class PositionSize:
    symbol: str
    percentage_of_portfolio: float | None = None
    fixed_amount: float | None = None

    def amount(self, portfolio_value: float) -> float:
        """The fixed amount, or the share of the portfolio."""
        if self.fixed_amount is not None:
            return self.fixed_amount
        if self.percentage_of_portfolio is not None:
            return portfolio_value * self.percentage_of_portfolio / 100
        raise StrategyError(f"{self.symbol}: neither a fixed amount nor a percentage")


@dataclass(frozen=True)
class Exit:
    """A stop loss or take profit in percent; trailing follows the highest price."""

    symbol: str
    percentage: float
    trailing: bool = False
    sell_percentage: float = 100.0


@dataclass(frozen=True)
class Scaling:
    """How to add to and to take from a position; of a list, the last share holds for all further steps."""

    symbol: str
    max_entries: int = 1
    scale_in: tuple[float, ...] = (100.0,)
    scale_out: tuple[float, ...] = (50.0,)
    max_position_percentage: float | None = None
    cooldown_bars: int = 0

    def share_in(self, k: int) -> float:
        return self.scale_in[min(k, len(self.scale_in) - 1)]

    def share_out(self, k: int) -> float:
        return self.scale_out[min(k, len(self.scale_out) - 1)]


@dataclass(frozen=True)
class Cooldown:
    """For `bars` bars after an order of side `trigger`, signals of side `blocks` don't count; without a symbol
    orders of any symbol trigger it, for all."""

    bars: int
    symbol: str | None = None
    trigger: str = "any"
    blocks: str = "any"

    def __post_init__(self):
        if self.bars < 0:
            raise ValueError(f"bars must not be negative: {self.bars}")
        if self.trigger not in SIDES or self.blocks not in SIDES:
            raise ValueError(f"sides are {SIDES}")


@dataclass
class CooldownState:
    """The last bar of each (scope, side); scope is a symbol or None for all."""

    last: dict[tuple[str | None, str], int] = field(default_factory=dict)

    def record(self, symbol: str, side: str, bar: int) -> None:
        for scope in (symbol, None):
            for s in (side, "any"):
                self.last[scope, s] = max(bar, self.last.get((scope, s), bar))

    def blocks(self, rules: tuple[Cooldown, ...], side: str, symbol: str, bar: int) -> bool:
        for r in rules:
            if r.bars and r.symbol in (None, symbol) and r.blocks in ("any", side):
                at = self.last.get((r.symbol, r.trigger))
                if at is not None and bar - at < r.bars:
                    return True
        return False


def rule_of(symbol: str, rules, default=None):
    """The first rule of the symbol."""
    return next((r for r in rules if r.symbol.upper() == symbol.upper()), default)
