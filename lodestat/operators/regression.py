"""Regressions with their tests: logit with Wald p-values, least squares with t-tests, calibration slopes, Breusch-Pagan.

Spark's own estimators do the passes over the data; a logit runs on the table of distinct feature patterns, which gives the
same estimates as the rows do.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import special
from ..functions.clean import logit, sigmoid


@dataclass(frozen=True)
class Fit:
    """Estimates in order of names, then the intercept's; dof is None where p-values are normal."""

    names: tuple[str, ...]
    coef: tuple[float, ...]
    se: tuple[float, ...]
    intercept: float
    intercept_se: float
    n: int
    r2: float | None = None
    dof: int | None = None

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for name, b in zip(self.names, self.coef, strict=True):
            out = out + F.lit(b) * F.col(name).cast("double")
        return out

    def probability(self) -> Column:
        return sigmoid(self.margin())

    def p_value(self, spark: SparkSession, b: float, se: float) -> float:
        if se <= 0:
            return float("nan")
        return special.normal_two_sided(spark, b / se) if self.dof is None else special.student_two_sided(spark, b / se, self.dof)

    def table(self, spark: SparkSession) -> DataFrame:
        """One row for each term: estimate, standard error, statistic, two-sided p-value."""
        terms = [*zip(self.names, self.coef, self.se, strict=True), ("(intercept)", self.intercept, self.intercept_se)]
        rows = [(t, b, s, b / s if s > 0 else None, self.p_value(spark, b, s)) for t, b, s in terms]
        return spark.createDataFrame(rows, "term string, coef double, se double, stat double, p_value double")


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="__x").transform(df)


def patterns(df: DataFrame, y: str, features: Sequence[str]) -> DataFrame:
    """Distinct feature rows with their count ``__n`` and bads ``__b``; rows with a null in any of these columns don't count."""
    full = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    return full.groupBy(*features).agg(F.count("*").cast("double").alias("__n"), F.sum("__y").alias("__b"))


def correlation(table: DataFrame, names: Sequence[str], weight: str = "__n") -> np.ndarray:
    """Pearson correlations of a weighted table, a number for each pair of columns; constant columns give zeros.

    Two passes, the second around the means, so that large means cost no digits.
    """
    w = F.col(weight)
    mean = table.agg(F.sum(w).alias("w"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    off = [F.col(c) - F.lit(mean[f"m{i}"]) for i, c in enumerate(names)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = table.agg(*[F.sum(w * off[i] * off[j]).alias(f"p{k}") for k, (i, j) in enumerate(pairs)]).first()
    cov = np.zeros((len(names), len(names)))
    for k, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = (got[f"p{k}"] or 0.0) / (mean["w"] or 1.0)
    sd = np.sqrt(np.diag(cov))
    flat = sd <= 1e-12 * (1 + np.abs([mean[f"m{i}"] or 0.0 for i in range(len(names))]))
    sd[flat] = 1.0
    out = cov / np.outer(sd, sd)
    out[flat, :] = out[:, flat] = 0.0
    return out


def independent(table: DataFrame, names: Sequence[str], weight: str = "__n") -> list[str]:
    """The columns that are neither constant nor a combination of those before them."""
    corr, keep = correlation(table, names, weight), []
    for i in range(len(names)):
        at = [*keep, i]
        if corr[i, i] > 0 and np.linalg.eigvalsh(corr[np.ix_(at, at)])[0] > 1e-9:
            keep = at
    return [names[i] for i in keep]


def _widened(fit: Fit, features: Sequence[str]) -> Fit:
    """Columns left out get a coefficient of 0 without a standard error."""
    at = {n: (b, s) for n, b, s in zip(fit.names, fit.coef, fit.se, strict=True)}
    both = [at.get(n, (0.0, 0.0)) for n in features]
    return replace(fit, names=tuple(features), coef=tuple(b for b, _ in both), se=tuple(s for _, s in both))


def logit_on_patterns(table: DataFrame, features: Sequence[str]) -> Fit:
    """Unpenalised. Columns that depend on others are left out, which changes no prediction."""
    used = independent(table, features)
    n = table.agg(F.sum("__n").alias("n"), F.sum("__b").alias("b")).first()
    if not used:
        b, g = n["b"], n["n"] - n["b"]
        return _widened(Fit((), (), (), float(np.log(b / g)), float((1 / b + 1 / g) ** 0.5), int(n["n"])), features)
    rows = _assembled(table.withColumn("__rate", F.col("__b") / F.col("__n")), used)
    model = GeneralizedLinearRegression(family="binomial", featuresCol="__x", labelCol="__rate", weightCol="__n", maxIter=100, tol=1e-12).fit(rows)
    se = tuple(float(v) for v in model.summary.coefficientStandardErrors)
    return _widened(Fit(tuple(used), tuple(float(v) for v in model.coefficients), se[:-1], float(model.intercept), se[-1], int(n["n"])), features)


def penalised_logit(df: DataFrame, y: str, features: Sequence[str], c: float = 1.0) -> Fit:
    """L2 with inverse strength c, intercept free; no standard errors."""
    full = df.select(F.col(y).cast("double").alias("__y"), *[F.col(f).cast("double").alias(f) for f in features]).dropna()
    n = full.count()
    model = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=500, tol=1e-10).fit(_assembled(full, features))
    return Fit(tuple(features), tuple(float(v) for v in model.coefficients), (0.0,) * len(features), float(model.intercept), 0.0, n)


def logit_fit(df: DataFrame, y: str, features: Sequence[str]) -> Fit:
    table = patterns(df, y, features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return logit_on_patterns(table, features)
    finally:
        table.unpersist()


def ols_fit(df: DataFrame, y: str, features: Sequence[str]) -> Fit:
    """Least squares by the normal equations, one pass; dof is n - independent features - 1."""
    full = df.select(F.col(y).cast("double").alias("__y"), *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    used = independent(full.withColumn("__w", F.lit(1.0)), features, "__w")
    model = LinearRegression(featuresCol="__x", labelCol="__y", solver="normal", regParam=0.0).fit(_assembled(full, used))
    s = model.summary
    se = [float(v) for v in s.coefficientStandardErrors]
    n = int(s.numInstances)
    return _widened(Fit(tuple(used), tuple(float(v) for v in model.coefficients), tuple(se[:-1]), float(model.intercept), se[-1], n, float(s.r2), n - len(used) - 1), features)


def calibration_slope(df: DataFrame, y: str, p: str) -> DataFrame:
    """Slope and intercept of outcomes on the score's log-odds, with 95% Wald limits."""
    fit = logit_fit(df.select(F.col(y), logit(F.col(p)).alias("log_odds")), y, ["log_odds"])
    z = 1.959963984540054  # fixed value: the normal's 97.5% point
    b, s = fit.coef[0], fit.se[0]
    return df.sparkSession.createDataFrame([(b, b - z * s, b + z * s, fit.intercept, fit.intercept - z * fit.intercept_se, fit.intercept + z * fit.intercept_se)], "slope double, slope_lo double, slope_hi double, intercept double, intercept_lo double, intercept_hi double")


def breusch_pagan(df: DataFrame, y: str, fit: Fit) -> DataFrame:
    """LM and F statistics of squared residuals on the features, with p-values."""
    spark = df.sparkSession
    aux = ols_fit(df.withColumn("__e2", (F.col(y) - fit.margin()) ** 2), "__e2", fit.names)
    k = len(fit.names)
    lm, f = aux.n * aux.r2, (aux.r2 / k) / ((1 - aux.r2) / aux.dof)
    return spark.createDataFrame([(lm, special.chi2_sf(spark, lm, k), f, special.f_sf(spark, f, k, aux.dof))], "lm double, lm_p double, f double, f_p double")


def recalibration_shift(df: DataFrame, y: str, margin: Column, low: float = -10.0, high: float = 10.0, tol: float = 1e-10) -> float:
    """What to add to the margin so that the mean probability equals the observed rate; margins are collapsed first.

    Bisection inside the bounds; each pass is one sum over distinct margins. Fails if the bounds hold no such shift.
    """
    table = df.select(margin.alias("m"), F.col(y).alias("y")).dropna().groupBy("m").agg(F.count("*").alias("n"), F.sum("y").alias("b")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Sixteen parts at once: a pass over the data gives four halvings.
        while high - low > tol:
            cuts = [low + (high - low) * i / 16 for i in range(17)]
            gaps = table.agg(*[F.sum(F.col("n") * sigmoid(F.col("m") + F.lit(c)) - F.col("b")).alias(f"g{i}") for i, c in enumerate(cuts)]).first()
            at = next((i for i in range(16) if gaps[i] <= 0 <= gaps[i + 1]), None)
            if at is None:
                raise ValueError("no shift within the bounds gives the observed rate")
            low, high = cuts[at], cuts[at + 1]
        return (low + high) / 2
    finally:
        table.unpersist()
