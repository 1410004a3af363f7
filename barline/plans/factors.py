"""Cross-sectional factors: a small expression graph that compiles to staged DataFrame columns.

A node is immutable and equal to any node of the same kind, parameters and inputs, so a shared
subexpression is computed once. Window functions can't be nested, so each node has a stage: one more than
its inputs' where it needs their values in a window of another kind. All nodes of a stage come from one
select: windows over symbols share a shuffle, windows over times share another, however many factors a
pipeline has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.ewm import Mean, span_alpha, with_means
from barline.functions.windows import by_symbol, cumulative, full, ratio, rolling

ROW, SYMBOL, TIME = "row", "symbol", "time"


@dataclass(frozen=True)
class Node:
    """kind of computation, parameters, inputs; `scope` says over which rows it looks."""

    kind: str
    params: tuple = ()
    inputs: tuple[Node, ...] = ()
    scope: str = ROW
    columns: tuple[str, ...] = ()
    window: int = 1

    @property
    def stage(self) -> int:
        if not self.inputs:
            return 0 if self.scope == ROW else 1
        below = max(x.stage for x in self.inputs)
        return below if self.scope == ROW else below + 1

    def required_columns(self) -> list[str]:
        return sorted({c for x in (self, *self._below()) for c in x.columns})

    def required_window(self) -> int:
        return max(x.window for x in (self, *self._below()))

    def _below(self) -> list[Node]:
        return [y for x in self.inputs for y in (x, *x._below())]

    def value(self, *inputs: Column) -> Column:
        return _KINDS[self.kind](self, *inputs)


_KINDS: dict[str, Callable[..., Column]] = {}


def kind(name: str):
    """Registers the Column expression of a kind: f(node, *input columns)."""

    def put(f: Callable[..., Column]):
        _KINDS[name] = f
        return f

    return put


class Factor(Node):
    """A number for each row. Arithmetic gives factors, top and bottom give filters."""

    def rank(self, mask: Filter | None = None) -> Factor:
        """1 for the smallest of its time; null where the value is null or the mask doesn't hold."""
        return Factor("rank", (), _masked(self, mask), TIME)

    def zscore(self, mask: Filter | None = None, groups: Factor | dict | None = None) -> Factor:
        return Factor("zscore", (), (*_masked(self, mask), *_groups(groups)), TIME)

    def demean(self, mask: Filter | None = None, groups: Factor | dict | None = None) -> Factor:
        return Factor("demean", (), (*_masked(self, mask), *_groups(groups)), TIME)

    def winsorize(self, lower: float = 0.01, upper: float = 0.99, mask: Filter | None = None) -> Factor:
        """Clipped to the quantiles of its time (nearest rank)."""
        if not 0.0 <= lower < upper <= 1.0:
            raise ValueError(f"0 <= lower < upper <= 1 asked for, got {lower}, {upper}")
        (x,) = _masked(self, mask)
        return Factor("winsorize", (lower, upper), (x, Factor("rank", (), (x,), TIME), Factor("count", (), (x,), TIME)), TIME)

    def top(self, n: int) -> Filter:
        return Filter("top", (n, True), (self,), TIME)

    def bottom(self, n: int) -> Filter:
        return Filter("top", (n, False), (self,), TIME)

    def __neg__(self) -> Factor:
        return Factor("neg", (), (self,))

    def __add__(self, other) -> Factor:
        return Factor("add", (), (self, _factor(other)))

    def __radd__(self, other) -> Factor:
        return Factor("add", (), (_factor(other), self))

    def __sub__(self, other) -> Factor:
        return Factor("sub", (), (self, _factor(other)))

    def __rsub__(self, other) -> Factor:
        return Factor("sub", (), (_factor(other), self))

    def __mul__(self, other) -> Factor:
        return Factor("mul", (), (self, _factor(other)))

    def __rmul__(self, other) -> Factor:
        return Factor("mul", (), (_factor(other), self))

    def __truediv__(self, other) -> Factor:
        return Factor("div", (), (self, _factor(other)))

    def __rtruediv__(self, other) -> Factor:
        return Factor("div", (), (_factor(other), self))


class Filter(Node):
    """A condition for each row; null is unknown."""

    def __and__(self, other: Filter) -> Filter:
        return Filter("and", (), (self, other))

    def __or__(self, other: Filter) -> Filter:
        return Filter("or", (), (self, other))

    def __invert__(self) -> Filter:
        return Filter("not", (), (self,))


def _factor(x) -> Factor:
    if isinstance(x, Factor):
        return x
    if isinstance(x, (int, float)):
        return Factor("constant", (float(x),))
    raise TypeError(f"neither factor nor number: {x!r}")


def _masked(x: Factor, mask: Filter | None) -> tuple[Factor]:
    return (x,) if mask is None else (Factor("where", (), (x, mask)),)


def _groups(groups: Factor | dict | None) -> tuple:
    return () if groups is None else (static_per_symbol(groups) if isinstance(groups, dict) else groups,)


def _windowed(name: str, window: int, columns: tuple[str, ...], scope: str = SYMBOL) -> Factor:
    if not isinstance(window, int) or window < 1:
        raise ValueError(f"{name}: a window of 1 or more, not {window!r}")
    return Factor(name, (window, *columns), (), scope, columns, window)


def latest(column: str = "close") -> Factor:
    return Factor("latest", (column,), (), ROW, (column,))


def returns(window: int = 1, column: str = "close") -> Factor:
    return _windowed("returns", window, (column,))


def sma(window: int, column: str = "close") -> Factor:
    return _windowed("sma", window, (column,))


def ema(window: int, column: str = "close") -> Factor:
    """The adjusted mean (weights of the values there are)."""
    return _windowed("ema", window, (column,))


def average_dollar_volume(window: int) -> Factor:
    return _windowed("adv", window, ("close", "volume"))


def static_per_symbol(mapping: dict) -> Factor:
    """A label by symbol (any case); null for others."""
    return Factor("static", tuple(sorted((k.upper(), v) for k, v in mapping.items())), (), ROW, ("symbol",))


def expression(column_of: Callable[[], Column], name: str, *columns: str, scope: str = ROW) -> Factor:
    """An own factor: column_of() gives its Column; name stands for it where nodes are compared."""
    return Factor("own", (name, column_of), (), scope, columns)


@kind("own")
def _own(node):
    return node.params[1]()


@kind("latest")
def _latest(node):
    return F.col(node.params[0])


@kind("constant")
def _constant(node):
    return F.lit(node.params[0])


@kind("static")
def _static(node):
    if not node.params:
        return F.lit(None)
    return F.create_map(*(F.lit(x) for pair in node.params for x in pair))[F.upper("symbol")]


@kind("returns")
def _returns(node):
    n, column = node.params
    return F.lag(F.col(f"__filled_{column}"), n).over(by_symbol())


@kind("sma")
def _sma(node):
    n, column = node.params
    return full(F.col(column), F.avg(column).over(rolling(n)), n, rolling(n))


@kind("ema")
def _ema(node):
    return F.col(f"__mean_{node.params[0]}_{node.params[1]}")


@kind("adv")
def _adv(node):
    x = F.col("close") * F.col("volume")
    return full(x, F.avg(x).over(rolling(node.params[0])), node.params[0], rolling(node.params[0]))


@kind("where")
def _where(node, x, mask):
    return F.when(mask, x)


@kind("neg")
def _neg(node, x):
    return -x


@kind("add")
def _add(node, x, y):
    return x + y


@kind("sub")
def _sub(node, x, y):
    return x - y


@kind("mul")
def _mul(node, x, y):
    return x * y


@kind("div")
def _div(node, x, y):
    return ratio(x, y)


@kind("and")
def _and(node, x, y):
    return x & y


@kind("or")
def _or(node, x, y):
    return x | y


@kind("not")
def _not(node, x):
    return ~x


def _time(*groups: Column) -> Window:
    return Window.partitionBy("datetime", *groups)


@kind("rank")
def _rank(node, x):
    return F.when(x.isNotNull(), F.row_number().over(_time().orderBy(x.asc_nulls_last(), "symbol")).cast("double"))


@kind("top")
def _top(node, x):
    n, largest = node.params
    order = x.desc_nulls_last() if largest else x.asc_nulls_last()
    return (F.row_number().over(_time().orderBy(order, "symbol")) <= n) & x.isNotNull()


@kind("zscore")
def _zscore(node, x, *groups):
    w = _time(*groups)
    return ratio(x - F.avg(x).over(w), F.stddev_samp(x).over(w))


@kind("demean")
def _demean(node, x, *groups):
    return x - F.avg(x).over(_time(*groups))


@kind("count")
def _count(node, x):
    return F.count(x).over(_time())


@kind("winsorize")
def _winsorize(node, x, place, n):
    """The quantile is the value at its place in the order; no row carries its time's values along."""
    at = lambda q: F.max(F.when(place == F.round((n - 1) * F.lit(q)) + 1, x)).over(_time())
    return F.when(x.isNotNull(), F.greatest(F.least(x, at(node.params[1])), at(node.params[0])))


def evaluate(panel: DataFrame, nodes: dict[str, Node]) -> DataFrame:
    """The panel with a column for each named node; it replaces a column of the panel with its name."""
    order: list[Node] = []

    def visit(x: Node) -> None:
        if x not in order:
            for y in x.inputs:
                visit(y)
            order.append(x)

    for x in nodes.values():
        visit(x)
    name = {x: f"__n{k}" for k, x in enumerate(order)}
    df = panel
    filled = sorted({x.params[1] for x in order if x.kind == "returns"})
    if filled:
        df = df.select("*", *(F.last(c, ignorenulls=True).over(cumulative(by_symbol())).alias(f"__filled_{c}") for c in filled))
    means = {f"__mean_{x.params[0]}_{x.params[1]}": Mean(x.params[1], span_alpha(x.params[0]), adjust=True) for x in order if x.kind == "ema"}
    if means:
        df = with_means(df, means)
    for stage in range(max((x.stage for x in order), default=-1) + 1):
        here = [x for x in order if x.stage == stage]
        windows = [x for x in here if x.scope != ROW]
        if windows:
            df = df.select("*", *(x.value(*(F.col(name[y]) for y in x.inputs)).alias(name[x]) for x in windows))
            late = [x for x in windows if x.kind == "returns"]
            if late:
                df = df.withColumns({name[x]: ratio(F.col(f"__filled_{x.params[1]}"), F.col(name[x])) - 1.0 for x in late})
        # Row expressions need no stage of their own; those that build on each other come one after the other.
        rows = [x for x in here if x.scope == ROW]
        done: set[Node] = set(order) - set(rows)
        while rows:
            ready = [x for x in rows if all(y in done for y in x.inputs)]
            df = df.select("*", *(x.value(*(F.col(name[y]) for y in x.inputs)).alias(name[x]) for x in ready))
            done |= set(ready)
            rows = [x for x in rows if x not in done]
    kept = [f"`{c}`" for c in panel.columns if c not in nodes]
    return df.select(*kept, *(F.col(name[x]).alias(n) for n, x in nodes.items()))
