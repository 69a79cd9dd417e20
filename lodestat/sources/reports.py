"""Reports as text and charts as specifications: both hold results, which are small, and never rows of accounts."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from .tables import write_json

#: A chart with more points than this is refused: it is no longer a result.
MOST_POINTS = 20_000


def money(x: float | None, unit: float = 1e6, suffix: str = "m") -> str:
    return "n/a" if x is None or x != x else f"USD {x / unit:,.2f}{suffix}"


def percentage(x: float | None, digits: int = 2) -> str:
    return "n/a" if x is None or x != x else f"{100 * x:.{digits}f}%"


def number(x: float | None, digits: int = 4) -> str:
    return "n/a" if x is None or x != x else f"{x:,.{digits}f}"


def markdown_table(df: DataFrame, most: int = 500) -> str:
    """A result table as Markdown, in its own order; one of over most rows is refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table holds at most {most} rows")
    cell = lambda v: "n/a" if v is None else number(v) if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = [df.columns, ["-"] * len(df.columns), *[[cell(v) for v in r] for r in rows]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


def render(template: str, facts: Mapping[str, object]) -> str:
    """Replace every {{name}} by its fact; a name without a fact is an error, so that no report has holes."""
    absent = sorted({n for n in re.findall(r"\{\{\s*([\w.]+)\s*\}\}", template) if n not in facts})
    if absent:
        raise KeyError(f"no facts for: {', '.join(absent)}")
    return re.sub(r"\{\{\s*([\w.]+)\s*\}\}", lambda m: str(facts[m[1]]), template)


def chart(df: DataFrame, mark: str, x: str, y: str, title: str, color: str | None = None) -> dict:
    """A Vega-Lite specification with the result's own rows as data."""
    rows = df.limit(MOST_POINTS + 1).collect()
    if len(rows) > MOST_POINTS:
        raise ValueError(f"a chart holds at most {MOST_POINTS} points")
    kinds = {c: "quantitative" if t in ("double", "float", "int", "bigint", "long") else "nominal" for c, t in df.dtypes}
    axes = {"x": x, "y": y} | ({"color": color} if color else {})
    return {"$schema": "https://vega.github.io/schema/vega-lite/v5.json", "title": title, "mark": mark, "data": {"values": [{k: v if isinstance(v, (int, float, str, type(None))) else str(v) for k, v in r.asDict().items()} for r in rows]}, "encoding": {k: {"field": c, "type": kinds[c]} for k, c in axes.items()}}


def write_chart(df: DataFrame, path: str, data_source: str, **how: str) -> None:
    write_json(df.sparkSession, chart(df, **how), path, data_source)
