"""Scores against benchmarks: standalone discrimination, paired tests and paired bootstrap intervals of all pairs on all splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..sources.scratch import narrowed, stored
from . import governance, rank, resampling

#: Fixed value: a difference is significant below this probability.
SIGNIFICANCE = 0.05


def pair_rows(df: DataFrame, y: str, pairs: Mapping[str, tuple[str, str]], split: str, splits: Sequence[str]) -> DataFrame:
    """(split, pair, auc_a, auc_b, gini_a, gini_b, d_auc, delong_z, delong_p): each pair's paired test on the rows of each split that have both scores."""
    parts = []
    for s in splits:
        rows = stored(df.where(F.col(split) == s).select(y, *dict.fromkeys(c for p in pairs.values() for c in p)), "benchmark")
        # One pair after the other: the plans of all at once take the driver's memory.
        parts += [stored(rank.delong(rows, y, a, b), "benchmark-pair").select(F.lit(s).alias("split"), F.lit(name).alias("pair"), "*") for name, (a, b) in pairs.items()]
    both = reduce(DataFrame.unionByName, parts).select("split", "pair", "auc_a", "auc_b", (2 * F.col("auc_a") - 1).alias("gini_a"), (2 * F.col("auc_b") - 1).alias("gini_b"), "d_auc", "delong_z")
    return governance.with_tails(both, {"delong_p": lambda s, r: None if r["delong_z"] is None else special.normal_two_sided(s, r["delong_z"])})


def _of_the_same_rows(df: DataFrame, pairs: Mapping[str, tuple[str, str]]) -> list[list[str]]:
    """Names of pairs, those together that have both scores on the same rows."""
    has = {name: reduce(Column.__and__, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in p]) for name, p in pairs.items()}
    met = {(a, b): F.count(F.when(has[a] & has[b], 1)) for a in pairs for b in pairs}
    n = dict(zip(met, df.agg(*met.values()).first()))
    out: list[list[str]] = []
    for name in pairs:
        like = next((g for g in out if n[name, g[0]] == n[name, name] == n[g[0], g[0]]), None)
        out.append([name]) if like is None else like.append(name)
    return out


def interval_rows(df: DataFrame, y: str, pairs: Mapping[str, tuple[str, str]], split: str, splits: Sequence[str], row_id: str, draws: int = resampling.DRAWS, seed: int = 0) -> DataFrame:
    """(split, pair, lo, hi, draws): the interval of the first AUC minus the second within the same draws, from all rows of a split that have both scores, as the paired test."""
    parts = []
    for s in splits:
        rows = df.where((F.col(split) == s) & F.col(y).isNotNull())
        for together in _of_the_same_rows(rows, pairs):
            names = list(dict.fromkeys(c for name in together for c in pairs[name]))
            reps = stored(resampling.aucs(rows, y, names, row_id, draws, seed), "benchmark-draws")
            parts += [resampling.paired_difference(reps, *pairs[name]).select(F.lit(s).alias("split"), F.lit(name).alias("pair"), "lo", "hi", "draws") for name in together]
    return reduce(DataFrame.unionByName, parts)


def benchmark_table(df: DataFrame, y: str, pairs: Mapping[str, tuple[str, str]], split: str, splits: Sequence[str], row_id: str, draws: int = resampling.DRAWS) -> DataFrame:
    """Every pair on every split: both AUCs and Ginis, the paired test, the bootstrap interval, and a light: Green only where the first is better beyond chance."""
    light: Column = governance.beats_light(F.col("d_auc"), F.col("delong_p"), SIGNIFICANCE)
    df = narrowed(df.where(F.col(split).isin(*splits)), row_id, split, y, *(c for p in pairs.values() for c in p), name="benchmark-rows")
    rows = pair_rows(df, y, pairs, split, splits).join(interval_rows(df, y, pairs, split, splits, row_id, draws), ["split", "pair"])  # a row for each pair and split
    return rows.withColumn("light", light)
