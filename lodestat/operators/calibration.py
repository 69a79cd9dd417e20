"""Calibration: central tendency, Brier, Hosmer-Lemeshow, group tests, traffic lights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import calibration_table


def central_tendency(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    t = df.groupBy(*by).agg(F.avg(p).alias("mean_pd"), F.avg(y).alias("observed"))
    return t.withColumns({"ratio": F.try_divide(F.col("mean_pd"), F.col("observed")), "relative_deviation": F.try_divide(F.col("mean_pd") - F.col("observed"), F.col("observed"))})


def brier(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """The Brier score, and its skill against the base rate."""
    t = df.groupBy(*by).agg(F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"), F.avg(y).alias("__base"))
    return t.select(*by, "brier", (1 - F.try_divide(F.col("brier"), F.col("__base") * (1 - F.col("__base")))).alias("brier_skill"))


def hosmer_lemeshow(df: DataFrame, y: str, p: str, row_id: str, bins: int = 10, by: Sequence[str] = (), in_sample: bool = False) -> DataFrame:
    """The statistic over bins whose variance is positive, and its degrees of freedom. The p-value: functions.special.chi2_sf."""
    t = calibration_table(df, y, p, row_id, bins, by)
    var = F.col("n") * F.col("mean_pd") * (1 - F.col("mean_pd"))
    return t.groupBy(*by).agg(F.sum(F.when(var > 0, (F.col("bads") - F.col("expected_bads")) ** 2 / var)).alias("hl"), F.lit(bins - 2 if in_sample else bins).alias("df"))


def by_group(df: DataFrame, y: str, p: str, group: str) -> DataFrame:
    """n, bads, rates and z of each group; z is null unless 0 < mean PD < 1. Exact tails: functions.special."""
    t = df.groupBy(group).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("bads"), F.avg(y).alias("obs_rate"), F.avg(p).alias("mean_pd"))
    inside = (F.col("mean_pd") > 0) & (F.col("mean_pd") < 1)
    return t.withColumn("z", F.when(inside, (F.col("obs_rate") - F.col("mean_pd")) / F.sqrt(F.col("mean_pd") * (1 - F.col("mean_pd")) / F.col("n"))))


def light_high(v: Column, green: float, amber: float) -> Column:
    """More is better; limits count as reached; null is ``n/a``."""
    return F.when(v.isNull(), "n/a").when(v >= green, "Green").when(v >= amber, "Amber").otherwise("Red")


def light_low(v: Column, green: float, amber: float) -> Column:
    return F.when(v.isNull(), "n/a").when(v <= green, "Green").when(v <= amber, "Amber").otherwise("Red")


def light_band(v: Column, green: tuple[float, float], amber: tuple[float, float]) -> Column:
    return F.when(v.isNull(), "n/a").when(v.between(*green), "Green").when(v.between(*amber), "Amber").otherwise("Red")
