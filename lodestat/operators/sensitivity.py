"""Scenarios: all shocks of a population are scored in one pass over it, as rows of a scenario column."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .loss import average_ranks
from .stability import bin_of

Shocks = Mapping[str, tuple[str, float]]


def with_scenarios(df: DataFrame, scenarios: Mapping[str, Shocks]) -> DataFrame:
    """Each row once for each scenario, its columns shocked (``add`` an amount, ``pct`` a share). Derive features afterwards."""
    rows = df.withColumn("scenario", F.explode(F.array(*[F.lit(s) for s in scenarios])))
    touched: dict[str, Column] = {}
    for name, shocks in scenarios.items():
        for c, (kind, v) in shocks.items():
            moved = F.col(c) + v if kind == "add" else F.col(c) * (1 + v)
            touched[c] = F.when(F.col("scenario") == name, moved).otherwise(touched.get(c, F.col(c)))
    return rows.withColumns(touched) if touched else rows


def scenario_summary(df: DataFrame, row_id: str, base: str, shocked: str, lgd: Column, ead: Column, edges: Sequence[float]) -> DataFrame:
    """Of each scenario: change of the mean PD and of the loss in percent, and the share of rows that change their band.

    base and shocked are PDs on the same row, so no join brings them together.
    """
    moved = (bin_of(F.col(base), edges) != bin_of(F.col(shocked), edges)).cast("double")
    t = df.groupBy("scenario").agg(F.count("*").alias("n"), F.avg(base).alias("b"), F.avg(shocked).alias("s"), F.sum(F.col(base) * lgd * ead).alias("eb"), F.sum(F.col(shocked) * lgd * ead).alias("es"), F.avg(moved).alias("share_moved"))
    change = lambda x, y: 100 * (F.try_divide(F.col(x), F.col(y)) - 1)
    return t.select("scenario", "n", change("s", "b").alias("d_mean_pd_pct"), change("es", "eb").alias("d_el_pct"), "share_moved")


def rank_agreement(df: DataFrame, a: str, b: str, by: str, groups: Sequence[str]) -> DataFrame:
    """Spearman's correlation within each of a few named groups."""
    parts = [average_ranks(average_ranks(df.where(F.col(by) == g).select(F.col(a).alias("a"), F.col(b).alias("b")).dropna(), "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("spearman")).withColumn(by, F.lit(g)) for g in groups]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(by, "spearman")


def multiplied(p: Column, factor: float) -> Column:
    return F.least(p * factor, F.lit(1.0))


def grid(build: Callable[..., DataFrame], variants: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """One result for each named set of parameters, tagged by its name."""
    out = None
    for name, parameters in variants.items():
        part = build(**parameters).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
