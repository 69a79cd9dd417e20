"""Expected loss, its back-tests, reconciliation joins and sensitivity of totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clipped
from ..sources.scratch import stored
from .rank import with_running


def expected_loss(pd: Column, lgd: Column, ead: Column, lgd_add: float = 0.0) -> Column:
    """The add-on's sum is kept within 0 and 1."""
    return pd * (clipped(lgd + lgd_add) if lgd_add else lgd) * ead


def _summary(funded: str, pd: str, bad: str, el: str, realized: str) -> list[Column]:
    return [F.count("*").alias("n"), F.sum(funded).alias("funded"), F.avg(pd).alias("mean_pd"), F.avg(bad).alias("bad_rate"), F.sum(el).alias("el"), F.sum(realized).alias("realized_loss")]


def _ratios(df: DataFrame) -> DataFrame:
    return df.withColumns({"el_pct_funded": F.try_divide("el", "funded"), "realized_pct_funded": F.try_divide("realized_loss", "funded"), "el_to_realized": F.when(F.col("realized_loss") != 0, F.try_divide("el", "realized_loss"))})


def back_test(df: DataFrame, outer: str, grade: str, funded: str, pd: str, bad: str, el: str, realized: str) -> DataFrame:
    """Totals by (outer, grade) and by outer alone, there with grade ``ALL``, in one pass."""
    t = df.groupingSets([(outer, grade), (outer,)], outer, grade).agg(*_summary(funded, pd, bad, el, realized), F.grouping(grade).alias("__all"))
    return _ratios(t.withColumn(grade, F.when(F.col("__all") == 1, "ALL").otherwise(F.col(grade))).drop("__all"))


def reconcile(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row: matched rows, ids on one side only, and each column's largest absolute difference."""
    renamed = b.select(key, *[F.col(c).alias(f"{c}_ref") for c in columns])
    met = a.join(renamed, key).agg(F.count("*").alias("matched"), *[F.max(F.abs(F.col(c) - F.col(f"{c}_ref"))).alias(f"max_diff_{c}") for c in columns])
    only = lambda x, y, name: x.select(key).distinct().join(y.select(key), key, "left_anti").agg(F.count("*").alias(name))
    return met.crossJoin(only(a, b, "only_left")).crossJoin(only(b, a, "only_right"))  # one row each


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n, R2, RMSE, MAE, correlation and means, in one aggregate."""
    a, p = F.col(actual), F.col(predicted)
    t = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum((a - p) ** 2).alias("__sse"), (F.var_pop(a) * F.count("*")).alias("__sst"), F.avg(F.abs(a - p)).alias("mae"), F.corr(a, p).alias("corr"), F.avg(a).alias("mean_actual"), F.avg(p).alias("mean_pred"))
    return t.select(*by, "n", (1 - F.try_divide("__sse", "__sst")).alias("r2"), F.sqrt(F.col("__sse") / F.col("n")).alias("rmse"), "mae", "corr", "mean_actual", "mean_pred")


def average_ranks(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds average ranks: distinct values are counted first, and only those are ordered, in value buckets."""
    counted = stored(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n")), "rank-counts")
    placed = with_running(counted, [F.col("__v")], "__v", {"__end": F.col("__n")}, descending=False).select("__v", (F.col("__end") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(placed, F.col(column) == F.col("__v"), "left").drop("__v")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    return average_ranks(average_ranks(both, "a", "ra"), "b", "rb").agg(F.corr("ra", "rb").alias("spearman"))


def shocked(df: DataFrame, shocks: dict[str, tuple[str, float]]) -> DataFrame:
    """Columns with an amount added (``add``) or scaled by a share (``pct``). Derive features again afterwards."""
    return df.withColumns({c: F.col(c) + v if kind == "add" else F.col(c) * (1 + v) for c, (kind, v) in shocks.items()})


def worst_by(df: DataFrame, keys: Sequence[str], light: str, order: str) -> DataFrame:
    """The worst light of each group (the first by order among equals), and all rows' lights as text in order."""
    severity = F.when(F.col(light) == "Red", 3).when(F.col(light) == "Amber", 2).when(F.col(light) == "Green", 1).otherwise(0)
    t = df.groupBy(*keys).agg(F.max(F.struct(severity.alias("s"), (-F.col(order)).alias("o"), F.col(light).alias("l"))).alias("__w"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(light).alias("l")))).alias("__all"))  # a few rows of results each
    return t.select(*keys, F.col("__w.l").alias("worst"), F.array_join(F.transform("__all", lambda x: x["l"]), ",").alias("evidence"))
