"""Scorecards: variables chosen by information value, correlation, sign, significance and collinearity; scaled to points."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import sigmoid
from .binning import Bins
from .regression import Fit, correlation, logit_on_patterns, patterns

# Selection limits, and the scale (points to double the odds, base score at base odds).
IV_MIN, P_MAX, VIF_MAX, CORR_MAX = 0.02, 0.05, 5.0, 0.7
PDO, BASE_SCORE, BASE_ODDS = 20.0, 600.0, 50.0


def scaling(pdo: float = PDO, base: float = BASE_SCORE, odds: float = BASE_ODDS) -> tuple[float, float]:
    """(factor, offset): score = offset - factor * margin."""
    factor = pdo / log(2)
    return factor, base - factor * log(odds)


@dataclass(frozen=True)
class Scorecard:
    bins: Mapping[str, Bins]
    fit: Fit
    dropped: tuple[tuple[str, str], ...] = ()

    def margin(self) -> Column:
        out = F.lit(self.fit.intercept)
        for name, b in zip(self.fit.names, self.fit.coef, strict=True):
            out = out + b * self.bins[name].transform(F.col(name))
        return out

    def probability(self) -> Column:
        return sigmoid(self.margin())

    def points(self, name: str) -> Column:
        """One variable's points; all variables' points add up to the score."""
        return points(self.bins[name].transform(F.col(name)), self.fit.coef[self.fit.names.index(name)], self.fit.intercept, len(self.fit.names))

    def score(self) -> Column:
        factor, offset = scaling()
        return offset - factor * self.margin()

    def points_table(self, spark: SparkSession) -> DataFrame:
        """One row for each bin of every variable in the card."""
        factor, offset = scaling()
        k, rows = len(self.fit.names), []
        for name, b in zip(self.fit.names, self.fit.coef, strict=True):
            s = self.bins[name]
            for i, w in enumerate(s.woe):
                lo, hi = (s.edges[i - 1] if 0 < i <= len(s.edges) else None), (s.edges[i] if i < len(s.edges) else None)
                rows.append((name, i, lo, hi, s.groups[i] if i < len(s.groups) else [], s.bads[i] + s.goods[i], w, b, -(b * w + self.fit.intercept / k) * factor + offset / k))
        return spark.createDataFrame(rows, "variable string, bin_id int, lo double, hi double, categories array<string>, n long, woe double, coef double, points double")

    def league(self, spark: SparkSession) -> DataFrame:
        """Every candidate by information value, with its first reason for leaving."""
        why = dict(reversed(self.dropped))
        rows = sorted(((n, b.iv, n in self.fit.names, why.get(n)) for n, b in self.bins.items()), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows, "variable string, iv double, kept boolean, reason string")


def points(woe: Column, coef: float, intercept: float, k: int) -> Column:
    factor, offset = scaling()
    return -(coef * woe + intercept / k) * factor + offset / k


def vifs(corr: np.ndarray) -> list[float]:
    """Variance inflation; 1 for a single column."""
    return [1.0] if len(corr) < 2 else [float(v) for v in np.diag(np.linalg.pinv(corr))]


def prune_correlated(names: Sequence[str], corr: np.ndarray, iv: Mapping[str, float], limit: float = CORR_MAX) -> tuple[list[str], list[str]]:
    """While a pair's absolute correlation passes the limit, the pair of the largest one loses the variable of lower value."""
    keep, out = list(names), []
    at = {n: i for i, n in enumerate(names)}
    while len(keep) > 1:
        worst, a, b = max(((abs(corr[at[x], at[y]]), x, y) for i, x in enumerate(keep) for y in keep[i + 1 :]), key=lambda t: t[0])
        if worst <= limit:
            break
        out.append(a if iv[a] < iv[b] else b)
        keep.remove(out[-1])
    return keep, out


def fit_scorecard(df: DataFrame, y: str, bins: Mapping[str, Bins], iv_min: float = IV_MIN, p_max: float = P_MAX, vif_max: float = VIF_MAX, corr_max: float = CORR_MAX) -> Scorecard:
    """Selection, then fits: each round drops the wrong-signed variable of lowest value, else the least significant, else the
    most collinear of lowest value. All rounds run on the table of distinct WoE patterns, which is made once.
    """
    spark, dropped = df.sparkSession, [(n, "iv") for n, b in bins.items() if b.iv < iv_min]
    names = [n for n, b in bins.items() if b.iv >= iv_min]
    if not names:
        raise ValueError("no variable reaches the least information value")
    iv = {n: bins[n].iv for n in names}
    table = patterns(df.select(y, *[bins[n].transform(F.col(n)).alias(n) for n in names]), y, names).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        corr, order = correlation(table, names), list(names)
        names, gone = prune_correlated(names, corr, iv, corr_max)
        dropped += [(n, "correlation") for n in gone]
        while names:
            fit = logit_on_patterns(table, names)
            wrong = [n for n, b in zip(names, fit.coef, strict=True) if b >= 0]
            p = {n: fit.p_value(spark, b, s) for n, b, s in zip(names, fit.coef, fit.se, strict=True)}
            at = [order.index(n) for n in names]
            inflated = [n for n, v in zip(names, vifs(corr[np.ix_(at, at)]), strict=True) if v > vif_max]
            if wrong:
                out = (min(wrong, key=iv.get), "sign")
            elif max(p.values()) > p_max:
                out = (max(p, key=p.get), "p-value")
            elif inflated:
                out = (min(inflated, key=iv.get), "collinearity")
            else:
                return Scorecard(bins, fit, tuple(dropped))
            dropped.append(out)
            names = [n for n in names if n != out[0]]
        raise ValueError("no variable stays in the scorecard")
    finally:
        table.unpersist()
