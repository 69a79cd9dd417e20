"""Long result tables with lights, and the findings log drawn from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibration import light_band, light_high, light_low

#: A metric's rule: kind (high, low or band) and its limits.
Rule = tuple[str, object, object]


def long_results(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value): one row for each metric of a wide result."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).select(*keys, "x.*")


def with_lights(results: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Adds light; metrics without a rule are ``n/a``."""
    make = {"high": light_high, "low": light_low, "band": light_band}
    out: Column = F.lit("n/a")
    for metric, (kind, green, amber) in rules.items():
        out = F.when(F.col("metric") == metric, make[kind](F.col("value"), green, amber)).otherwise(out)
    return results.withColumn("light", out)


def in_scope(results: DataFrame, models: Sequence[str], leave: Sequence[str] = ("dev_train",)) -> DataFrame:
    return results.where(F.col("model").isin(*models) & ~F.col("split").isin(*leave))


def severity(light: Column) -> Column:
    return F.when(light == "Red", "High").when(light == "Amber", "Medium").otherwise("Low")


def light_findings(results: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """One finding for each key whose worst light is not green: severity, and the evidence of all its rows in order."""
    bad = F.when(F.col("light") == "Red", 2).when(F.col("light") == "Amber", 1).otherwise(0)
    piece = F.concat(F.col(order), F.lit(" "), F.coalesce(F.col("value").cast("decimal(18,3)").cast("string"), F.lit("n/a")), F.lit(" ("), F.col("light"), F.lit(")"))
    t = results.groupBy(*keys).agg(F.max(bad).alias("__w"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t")))), lambda x: x["t"]), "; ").alias("evidence"))  # a few splits each
    return t.where(F.col("__w") > 0).select(*keys, F.when(F.col("__w") == 2, "High").otherwise("Medium").alias("severity"), "evidence")


def loss_findings(el: DataFrame, keys: Sequence[str], ratio: str, medium: float = 0.10, high: float = 0.25) -> DataFrame:
    """Groups whose expected loss is off the realised loss by more than the limits."""
    gap = F.abs(F.col(ratio) - 1)
    return el.where(gap > medium).select(*keys, F.when(gap > high, "High").otherwise("Medium").alias("severity"), F.when(F.col(ratio) < 1, "understated").otherwise("overstated").alias("direction"))


def build_log(parts: Sequence[DataFrame], order: Sequence[str]) -> DataFrame:
    """All parts one after the other; ids F-01, F-02, ... follow the parts and their order, place follows severity first."""
    every = None
    for i, part in enumerate(parts):
        part = part.withColumn("__part", F.lit(i))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    rank = F.row_number().over(Window.orderBy("__part", *order))  # a log of findings
    level = F.when(F.col("severity") == "High", 0).when(F.col("severity") == "Medium", 1).otherwise(2)
    out = every.withColumn("__n", rank)
    return out.withColumns({"finding_id": F.concat(F.lit("F-"), F.lpad(F.col("__n").cast("string"), F.greatest(F.lit(2), F.length(F.col("__n").cast("string"))), F.lit("0"))), "place": F.row_number().over(Window.orderBy(level, "__n"))}).drop("__part", "__n")


def compare_tables(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str, tolerance: Mapping[str, float], quantity: str) -> DataFrame:
    """Of each quantity: rows on both sides, rows on one side only, the largest difference and whether it is within tolerance."""
    a = expected.select(quantity, *keys, F.col(value).alias("__e"), F.lit(1).alias("__l"))
    b = actual.select(quantity, *keys, F.col(value).alias("__a"), F.lit(1).alias("__r"))
    t = a.join(b, [quantity, *keys], "full").groupBy(quantity).agg(F.sum(F.col("__l") * F.col("__r")).alias("matched"), F.sum(F.when(F.col("__l").isNull() | F.col("__r").isNull(), 1).otherwise(0)).alias("unmatched"), F.max(F.abs(F.col("__e") - F.col("__a"))).alias("max_diff"))
    limit: Column = F.lit(None).cast("double")
    for q, v in tolerance.items():
        limit = F.when(F.col(quantity) == q, v).otherwise(limit)
    return t.withColumn("within", F.coalesce((F.col("max_diff") <= limit) & (F.col("unmatched") == 0), F.lit(False)))
