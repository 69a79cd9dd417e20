"""Platt and isotonic calibration of margins, chosen by cross-fitted Brier scores."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clipped, sigmoid
from .regression import Fit, logit_fit

#: Fixed value: calibrated probabilities stay this far from 0 and 1.
FLOOR = 1e-6


@dataclass(frozen=True)
class Steps:
    """A monotone function: values at boundaries, joined by lines, and the end values beyond them."""

    boundaries: tuple[float, ...]
    values: tuple[float, ...]

    def at(self, x: Column) -> Column:
        at, v = np.array(self.boundaries), np.array(self.values)

        def run(c):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series(np.interp(c.to_numpy(), at, v)).where(c.notna().to_numpy())

        return F.pandas_udf(run, "double")(x.cast("double"))


@dataclass(frozen=True)
class Calibrator:
    kind: str
    model: Fit | Steps

    def apply(self, df: DataFrame, margin: Column) -> DataFrame:
        """Adds ``calibrated``; isotonic steps are joined by lines, and margins outside the learned range get the end values."""
        if isinstance(self.model, Fit):
            return df.withColumn("calibrated", clipped(sigmoid(F.lit(self.model.intercept) + self.model.coef[0] * margin), FLOOR, 1 - FLOOR))
        return df.withColumn("calibrated", clipped(self.model.at(sigmoid(margin)), FLOOR, 1 - FLOOR))


def platt(df: DataFrame, y: str, margin: Column) -> Calibrator:
    return Calibrator("platt", logit_fit(df.select(F.col(y).alias("y"), margin.alias("margin")), "y", ["margin"]))


def isotonic(df: DataFrame, y: str, margin: Column) -> Calibrator:
    """Equal scores are pooled by Spark first, so the fit sees distinct scores with weights."""
    pooled = df.select(sigmoid(margin).alias("__score"), F.col(y).cast("double").alias("__y")).dropna().groupBy("__score").agg(F.avg("__y").alias("__rate"), F.count("*").cast("double").alias("__n"))
    fitted = IsotonicRegression(featuresCol="__score", labelCol="__rate", weightCol="__n", predictionCol="__iso").fit(pooled)
    return Calibrator("isotonic", Steps(tuple(fitted.boundaries.toArray().tolist()), tuple(fitted.predictions.toArray().tolist())))  # two numbers for each step


def choose(df: DataFrame, y: str, margin: Column, row_id: str) -> Calibrator:
    """Each kind is fitted on either half (by a digest of the id) and judged on the other; the better one is fitted on all."""
    x = df.select(F.col(row_id).alias("i"), F.col(y).alias("y"), margin.alias("m")).withColumn("half", F.conv(F.substring(F.md5(F.col("i").cast("string")), 1, 1), 16, 10).cast("int") % 2)
    m, brier = F.col("m"), {}
    for make in (platt, isotonic):
        sums = [make(x.where(F.col("half") == 1 - h), "y", m).apply(x.where(F.col("half") == h), m).agg(F.sum((F.col("calibrated") - F.col("y")) ** 2)).first()[0] or 0.0 for h in (0, 1)]
        brier[make] = sum(sums)
    return min(brier, key=brier.get)(x, "y", m)
