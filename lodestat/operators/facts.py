"""Facts for reports: value counts, information values of many features, bins looked up in a table, chosen rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .binning import woe_iv


def melted(df: DataFrame, columns: Sequence[str], *keep: str, value: str = "label", kind: str = "string") -> DataFrame:
    """The columns in keep, variable, and its value: one row for each row and column."""
    parts = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast(kind).alias(value)) for c in columns])
    return df.select(*keep, F.explode(parts).alias("__x")).select(*keep, "__x.*")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, label, n, share): all columns counted in one pass; null is a label of its own."""
    counts = melted(df, columns).groupBy("variable", "label").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("variable")))


def label_values(df: DataFrame, y: str, columns: Sequence[str]) -> DataFrame:
    """(variable, iv, woe_range) of every column's labels as they are, from one aggregate."""
    table = melted(df.where(F.col(y).isNotNull()), columns, y).groupBy("variable", "label").agg(F.sum(y).alias("bads"), F.sum(1 - F.col(y)).alias("goods"))
    return woe_iv(table, by=["variable"]).groupBy("variable").agg(F.sum("iv_contrib").alias("iv"), (F.max("woe") - F.min("woe")).alias("woe_range"))


def bin_lookup(long: DataFrame, bins: DataFrame, value: str = "x") -> DataFrame:
    """Rows (variable, value, ...) with the columns of the bin that holds the value.

    bins: (variable, lo, hi, missing, ...): lo lies outside its bin, hi inside, null is open; the missing bin takes nulls.
    A bin table has some dozens of rows for each feature and is broadcast; each row meets its own variable's bins alone.
    """
    b = bins.withColumnRenamed("variable", "__variable")
    x = F.col(value)
    inside = F.when(x.isNull(), F.col("missing")).otherwise(~F.col("missing") & F.coalesce(x > F.col("lo"), F.lit(True)) & F.coalesce(x <= F.col("hi"), F.lit(True)))
    return long.join(F.broadcast(b), (F.col("variable") == F.col("__variable")) & inside).drop("__variable", "lo", "hi", "missing")


def preferred(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """One row for each key: the first in order. An aggregate, so that a large key is combined before the shuffle."""
    best = F.min_by(F.struct(*columns), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("__x")).select(*keys, "__x.*")


def target_variants(df: DataFrame, variants: dict[str, Column], *keep: str) -> DataFrame:
    """(variant, y, keep): the same accounts under several definitions of the target."""
    parts = F.array(*[F.struct(F.lit(n).alias("variant"), F.coalesce(c, F.lit(False)).cast("int").alias("y")) for n, c in variants.items()])
    return df.select(*keep, F.explode(parts).alias("__v")).select("__v.*", *keep)
