"""Weight-of-evidence binning: fitted on histograms that Spark makes for all features at once, applied as expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from math import floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .rank import with_running
from .stability import bin_of

#: Fixed value: what is added to each count of a bin.
SMOOTH = 0.5


def woe_iv(table: DataFrame, bads: str = "bads", goods: str = "goods", by: Sequence[str] = (), smooth: float = SMOOTH) -> DataFrame:
    """Adds woe and iv_contrib to a table of bins: shares are smoothed over the bins of a group."""
    w = Window.partitionBy(*by)
    k = F.count("*").over(w)
    b = (F.col(bads) + smooth) / (F.sum(bads).over(w) + smooth * k)
    g = (F.col(goods) + smooth) / (F.sum(goods).over(w) + smooth * k)
    return table.withColumns({"woe": F.ln(g / b), "iv_contrib": (g - b) * F.ln(g / b)})


@dataclass
class Bins:
    """A fitted variable: edges of numeric bins, or groups of labels; a last bin for missing values."""

    variable: str
    edges: list[float] = field(default_factory=list)
    groups: list[list[str]] = field(default_factory=list)
    bads: list[int] = field(default_factory=list)
    goods: list[int] = field(default_factory=list)
    woe: list[float] = field(default_factory=list)
    iv: float = 0.0

    def index(self, c: Column) -> Column:
        """The bin of a value; missing is the last; a label never seen goes to the largest group."""
        last = len(self.bads) - 1
        if not self.groups:
            return F.coalesce(bin_of(c, self.edges), F.lit(last))
        out = F.when(c.isNull(), last)
        for i, g in enumerate(self.groups):
            out = out.when(c.isin(g), i)
        sizes = [b + g for b, g in zip(self.bads[:-1], self.goods[:-1], strict=True)]
        return out.otherwise(sizes.index(max(sizes)))

    def transform(self, c: Column) -> Column:
        return F.get(F.array(*[F.lit(w) for w in self.woe]), self.index(c))


def _rate(b: int, g: int) -> float:
    return (b + 0.5) / (b + g + 1)


class _Merge:
    """Neighbouring bins that are merged step by step; at most as many as there were first bins."""

    def __init__(self, bads: list[int], goods: list[int], names: list):
        self.b, self.g, self.names = list(bads), list(goods), list(names)

    def join(self, i: int) -> None:
        """Bins i and i + 1 become one."""
        self.b[i : i + 2], self.g[i : i + 2] = [sum(self.b[i : i + 2])], [sum(self.g[i : i + 2])]
        self.names[i : i + 2] = [self.names[i] + self.names[i + 1]]

    def rates(self) -> list[float]:
        return list(map(_rate, self.b, self.g))

    def at_least(self, share: float) -> None:
        total = sum(self.b) + sum(self.g)
        while len(self.b) > 1:
            sizes = [b + g for b, g in zip(self.b, self.g, strict=True)]
            i = sizes.index(min(sizes))
            if sizes[i] >= share * total:
                return
            r = self.rates()
            left = i > 0 and (i == len(r) - 1 or abs(r[i] - r[i - 1]) <= abs(r[i + 1] - r[i]))
            self.join(i - 1 if left else i)

    def at_most(self, bins: int) -> None:
        while len(self.b) > bins:
            r = self.rates()
            gaps = [abs(x - y) for x, y in zip(r, r[1:], strict=False)]
            self.join(gaps.index(min(gaps)))

    def monotone(self) -> None:
        if len(self.b) < 3:
            return
        sign = 1 if _trend(self.rates()) >= 0 else -1
        while len(self.b) > 2:
            r = self.rates()
            bad = next((i for i in range(len(r) - 1) if sign * (r[i + 1] - r[i]) < 0), None)
            if bad is None:
                return
            self.join(bad)


def _trend(r: list[float]) -> float:
    """Spearman's correlation of the rates with their order, up to a positive factor."""
    rank = [sum(y < x for y in r) + (sum(y == x for y in r) - 1) / 2 for x in r]
    m = (len(r) - 1) / 2
    return sum((i - m) * (q - m) for i, q in enumerate(rank))


def _finish(out: Bins, b: list[int], g: list[int], missing: tuple[int, int]) -> Bins:
    """WoE over all bins that hold something, missing values among them; empty bins have 0."""
    out.bads, out.goods = [*b, missing[0]], [*g, missing[1]]
    full = [x + y > 0 for x, y in zip(out.bads, out.goods, strict=True)]
    k, tb, tg = sum(full), sum(out.bads), sum(out.goods)
    for x, y, f in zip(out.bads, out.goods, full, strict=True):
        db, dg = (x + SMOOTH) / (tb + SMOOTH * k), (y + SMOOTH) / (tg + SMOOTH * k)
        out.woe.append(log(dg / db) if f else 0.0)
        out.iv += (dg - db) * log(dg / db) if f else 0.0
    return out


def lower_quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float]) -> dict[str, list[float]]:
    """The elements at floor((n - 1) * q) of each column's sorted values that are not null, for all columns in one pass.

    Distinct values are ordered in value buckets (``rank.with_running``), so that no task sees a whole column.
    """
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("v"), F.col(c).cast("double").alias("x")) for c in columns])).alias("r")).select("r.*").where("x is not null and not isnan(x)")
    counted = stored(long.groupBy("v", "x").agg(F.count("*").alias("count")), "distinct-values")
    sizes = counted.groupBy("v").agg(F.sum("count").alias("n"))  # a row for each column
    ends = with_running(counted, [F.col("x")], "x", {"hi": F.col("count")}, ["v"], descending=False).join(F.broadcast(sizes), "v")
    place = F.floor((F.col("n") - 1) * F.col("q"))
    at = ends.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in levels]))).where((place >= F.col("hi") - F.col("count")) & (place < F.col("hi")))
    out: dict[str, list[float]] = {c: [] for c in columns}
    for r in at.select("v", "x").distinct().collect():  # a number for each column and level
        out[r["v"]].append(r["x"])
    return {c: sorted(v) for c, v in out.items()}


def fit_numeric(df: DataFrame, columns: Sequence[str], y: str, prebins: int = 50, min_share: float = 0.05, max_bins: int = 8, monotone: bool = True) -> dict[str, Bins]:
    """Bins of every column: cuts at lower quantiles, then too small, non-monotone and too many bins are merged, in this order."""
    return merged(prebinned(df, columns, y, prebins), min_share, max_bins, monotone)


def prebinned(df: DataFrame, columns: Sequence[str], y: str, prebins: int = 50) -> dict[str, tuple[list[float], list[tuple[int, int]]]]:
    """Of every column the cuts at lower quantiles, and (bads, goods) of each bin, missing values last. Any number of merges starts from these."""
    cuts = lower_quantiles(df, columns, [i / prebins for i in range(1, prebins)])
    top = df.agg(*[F.max(F.col(c).cast("double")).alias(c) for c in columns]).first()
    cuts = {c: [e for e in v if e < top[c]] for c, v in cuts.items()}
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("v"), F.coalesce(bin_of(F.col(c), cuts[c]), F.lit(-1)).alias("bin")) for c in columns]))
    counts = {(r["v"], r["bin"]): (r["b"], r["g"]) for r in df.select(F.col(y).alias("y"), named.alias("r")).groupBy("r.v", "r.bin").agg(F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("g")).collect()}  # prebins rows for each column
    return {c: (cuts[c], [counts.get((c, i), (0, 0)) for i in [*range(len(cuts[c]) + 1), -1]]) for c in columns}


def merged(first: Mapping[str, tuple[list[float], list[tuple[int, int]]]], min_share: float = 0.05, max_bins: int = 8, monotone: bool = True) -> dict[str, Bins]:
    """Bins of every column from those that prebinned gives."""
    out = {}
    for c, (cuts, (*full, missing)) in first.items():
        m = _Merge([x for x, _ in full], [x for _, x in full], [[i] for i in range(len(full))])
        m.at_least(min_share)
        if monotone:
            m.monotone()
        m.at_most(max_bins)
        out[c] = _finish(Bins(c, edges=[cuts[n[-1]] for n in m.names[:-1]]), m.b, m.g, missing)
    return out


def fit_labels(df: DataFrame, column: str, y: str, row_id: str, min_share: float = 0.02, max_groups: int = 10, most: int = 1000) -> Bins:
    """Groups of labels, ordered by smoothed rate (then first appearance by row_id), merged like numeric bins. More than most labels raise."""
    counted = df.groupBy(F.col(column).alias("__label")).agg(F.sum(y).alias("__b"), F.sum(1 - F.col(y)).alias("__g"), F.min(row_id).alias("__first"))
    rows = [tuple(r) for r in counted.limit(most + 2).collect()]  # a row for each label, and one for missing ones
    if sum(r[0] is not None for r in rows) > most:
        raise ValueError(f"{column} has more than {most} labels")
    seen = sorted((r for r in rows if r[0] is not None), key=lambda r: (_rate(r[1], r[2]), r[3]))
    missing = next(((r[1], r[2]) for r in rows if r[0] is None), (0, 0))
    m = _Merge([r[1] for r in seen], [r[2] for r in seen], [[str(r[0])] for r in seen])
    m.at_least(min_share)
    m.at_most(max_groups)
    return _finish(Bins(column, groups=[sorted(n) for n in m.names]), m.b, m.g, missing)


def report(spark, bins: Sequence[Bins]) -> DataFrame:  # noqa: ANN001
    """One row for each bin of every fitted variable."""
    rows = [(s.variable, i, s.edges[i - 1] if s.edges and 0 < i <= len(s.edges) else None, s.edges[i] if i < len(s.edges) else None, s.groups[i] if i < len(s.groups) else [], b + g, b, w) for s in bins for i, (b, g, w) in enumerate(zip(s.bads, s.goods, s.woe, strict=True))]
    return spark.createDataFrame(rows, "variable string, bin_id int, lo double, hi double, categories array<string>, n long, bads long, woe double")


def lower_index(n: int, q: float) -> int:
    return floor((n - 1) * q)
