"""Reports of one run: as a dict, JSON, Markdown or HTML with a drawn equity curve."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame

from barline.operators import metrics

MOST_TRADES = 20


def _plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.isoformat() if hasattr(x, "isoformat") else x


class Report:
    """The tables of one run_id, reduced on the cluster. The dict, JSON and HTML hold all bars and trades of the
    run, which come to the driver; Markdown shows the first MOST_TRADES trades and says how many there are. The
    lines of the HTML are drawn through at most about `points` bars (evenly spaced, and the last one)."""

    def __init__(self, run_id: str, equity: DataFrame, trades: DataFrame, title: str = "Backtest", points: int = 2000):
        self.run_id, self.title = run_id, title
        self.equity, self.trades = equity.where(equity.run_id == run_id), trades.where(trades.run_id == run_id)
        self.points = points

    def metrics(self) -> dict:
        rows = metrics.all_metrics(self.equity, self.trades).drop("run_id").collect()
        return {k: _plain(v) for k, v in rows[0].asDict().items()} if rows else {}

    def _curve(self) -> list[tuple]:
        rows = metrics.curve(self.equity).select("datetime", "total_equity", "drawdown").orderBy("datetime").collect()
        return [(_plain(r.datetime), _plain(r.total_equity), _plain(r.drawdown)) for r in rows]

    def _months(self) -> list[dict]:
        return self._rows(metrics.monthly_heatmap(self.equity).orderBy("year"))

    def _rows(self, df: DataFrame) -> list[dict]:
        return [{k: _plain(v) for k, v in r.asDict().items() if k != "run_id"} for r in df.collect()]

    def to_dict(self) -> dict:
        curve = self._curve()
        return {
            "title": self.title, "run_id": self.run_id, "metrics": self.metrics(),
            "equity_curve": [{"datetime": t, "total_equity": v} for t, v, _ in curve], "drawdown": [{"datetime": t, "drawdown": d} for t, _, d in curve],
            "monthly_heatmap": self._months(),
            "trades": self._rows(self.trades.orderBy("datetime", "symbol")),
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2, default=str)

    def to_markdown(self) -> str:
        total, first = self.trades.count(), self._rows(self.trades.orderBy("datetime", "symbol").limit(MOST_TRADES))
        out = [f"# {self.title}", "", "## Metrics", "", "| metric | value |", "|---|---|"]
        out += [f"| {k} | {'' if v is None else v} |" for k, v in self.metrics().items()]
        for name, rows in (("Monthly returns", self._months()), ("Trades", first)):
            out += ["", f"## {name}", ""]
            if rows:
                out += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0])]
                out += ["| " + " | ".join("" if v is None else str(v) for v in r.values()) + " |" for r in rows]
        if total > MOST_TRADES:
            out += ["", f"_Showing first {MOST_TRADES} of {total} trades._"]
        return "\n".join(out) + "\n"

    def _thin(self, values: list[float]) -> list[float]:
        n = max(1, -(-len(values) // self.points))
        return values[::n] + (values[-1:] if (len(values) - 1) % n else [])

    @staticmethod
    def _line(values: list[float], width: int = 800, height: int = 240) -> str:
        """An SVG polyline; a flat curve is drawn in the middle."""
        if not values:
            return ""
        low, high = min(values), max(values)
        y = lambda v: height / 2 if high == low else height - (v - low) / (high - low) * height
        step = width / max(1, len(values) - 1)
        points = " ".join(f"{k * step:.1f},{y(v):.1f}" for k, v in enumerate(values))
        return f'<svg viewBox="0 0 {width} {height}"><polyline fill="none" stroke="black" points="{points}"/></svg>'

    def to_html(self) -> str:
        d = self.to_dict()
        table = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape('' if c is None else str(c))}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
        parts = [f"<h1>{html.escape(d['title'])}</h1>", "<h2>Equity curve</h2>", self._line(self._thin([x["total_equity"] for x in d["equity_curve"]])), "<h2>Drawdown</h2>", self._line(self._thin([-x["drawdown"] for x in d["drawdown"]]))]
        parts += ["<h2>Metrics</h2>", table(d["metrics"].items()), "<h2>Monthly returns</h2>", table([r.values() for r in d["monthly_heatmap"]]), "<h2>Trades</h2>", table([r.values() for r in d["trades"]])]
        return "<!doctype html><html><body>" + "".join(parts) + "</body></html>"

    def save(self, path: str) -> None:
        """By the path's ending: .json, .md or .html."""
        from barline.sources.store import write_text

        render = {"json": self.to_json, "md": self.to_markdown, "html": self.to_html}[path.rsplit(".", 1)[-1]]
        write_text(self.equity.sparkSession, path, render())
