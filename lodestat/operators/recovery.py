"""Loss given default and exposure: feature designs learned on development defaults, two-stage recovery, diagnostics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import clipped
from ..sources.scratch import narrowed
from .rank import decile_of, ranked
from .regression import Fit, logit_fit, ols_fit
from .stability import exact_quantiles, grouped_quantiles

#: Winsor limits, the least share of a label with a column of its own, and the residual quantiles.
LIMITS, RARE, LEVELS = (0.01, 0.99), 0.01, (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


@dataclass(frozen=True)
class Design:
    numeric: Mapping[str, tuple[float, float, float, float, float]]
    labels: Mapping[str, tuple[str, ...]]
    reported: tuple[str, ...] = ()

    def columns(self) -> dict[str, Column]:
        """Imputed, winsorised z-scores; flags of reported values; a 0/1 column for each common label but the most frequent."""
        out = {}
        for c, (median, lo, hi, mean, sd) in self.numeric.items():
            x = F.least(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(median)), F.lit(lo)), F.lit(hi))
            out[f"{c}_z"] = (x - mean) / (sd if sd > 0 else 1.0)
        out |= {f"{c}_reported": F.col(c).isNotNull().cast("double") for c in self.reported}
        for c, levels in self.labels.items():
            out |= {f"{c}_{v}": F.coalesce(F.col(c) == v, F.lit(v == "nan")).cast("double") for v in levels}
        return out


def common_labels(df: DataFrame, column: str, share: float = RARE) -> list[str]:
    """Labels (null: ``nan``) of at least that share, most frequent first; the others are pooled and get no column."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("v")).count()
    total = counts.agg(F.sum("count")).first()[0] or 1
    rows = counts.where(F.col("count") >= share * total).orderBy(F.desc("count"), "v").collect()  # 1 / share rows at most
    return [r["v"] for r in rows]


def learn_design(df: DataFrame, numeric: Sequence[str], labels: Sequence[str], reported: Sequence[str] = ()) -> Design:
    """All quantiles in one pass, all moments in a second."""
    q = exact_quantiles(df, numeric, [0.5, *LIMITS])
    q = {c: q[c] or [0.0, 0.0, 0.0] for c in numeric}
    x = {c: F.least(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(q[c][0])), F.lit(q[c][1])), F.lit(q[c][2])) for c in numeric}
    m = df.agg(*[F.avg(x[c]).alias(f"m_{c}") for c in numeric], *[F.stddev_pop(x[c]).alias(f"s_{c}") for c in numeric]).first()
    return Design({c: (*q[c], m[f"m_{c}"] or 0.0, m[f"s_{c}"] or 0.0) for c in numeric}, {c: tuple(common_labels(df, c)[1:]) for c in labels}, tuple(reported))


@dataclass(frozen=True)
class LossModel:
    design: Design
    any_recovery: Fit
    recovery: Fit
    ccf: Fit

    def predict(self, df: DataFrame, funded: str) -> DataFrame:
        """Adds p_any, rr, lgd, lgd_hard (the first stage as a class, above 0.5), ccf_hat and ead, each ratio within 0 and 1."""
        x = df.withColumns(self.design.columns())
        x = x.withColumns({"p_any": self.any_recovery.probability(), "rr": clipped(self.recovery.margin()), "ccf_hat": clipped(self.ccf.margin())})
        hard = F.when(F.col("p_any") > 0.5, F.col("rr")).otherwise(0.0)
        return x.withColumns({"lgd": 1 - clipped(F.col("p_any") * F.col("rr")), "lgd_hard": 1 - clipped(hard), "ead": F.col("ccf_hat") * F.col(funded)}).select(*df.columns, "p_any", "rr", "lgd", "lgd_hard", "ccf_hat", "ead")


def fit_loss_model(defaults: DataFrame, recovery_rate: str, ccf: str, numeric: Sequence[str], labels: Sequence[str], reported: Sequence[str] = ()) -> LossModel:
    """Any recovery by logit on all defaults, the rate by least squares on those with some, conversion on all."""
    defaults = narrowed(defaults, recovery_rate, ccf, *numeric, *labels, *reported, name="loss-rows")
    design = learn_design(defaults, numeric, labels, reported)
    columns = design.columns()
    x = defaults.select(F.col(recovery_rate).alias("__rr"), F.col(ccf).alias("__ccf"), (F.col(recovery_rate) > 0).cast("int").alias("__any"), *[v.alias(k) for k, v in columns.items()])
    names = list(columns)
    return LossModel(design, logit_fit(x, "__any", names), ols_fit(x.where("__rr > 0"), "__rr", names), ols_fit(x, "__ccf", names))


def residual_quantiles(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """(level, residual): exact quantiles of actual minus predicted."""
    return grouped_quantiles(df, F.col(actual) - F.col(predicted), by, LEVELS).withColumnRenamed("value", "residual")


def predicted_deciles(df: DataFrame, actual: str, predicted: str, row_id: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Highest predictions first: n and both means of each decile that holds rows."""
    r = ranked(df.where(F.col(actual).isNotNull()), predicted, row_id, by).withColumn("decile", decile_of(F.col("rank"), F.col("n"), bins))
    return r.groupBy(*by, "decile").agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_pred"), F.avg(actual).alias("mean_actual"))


def class_agreement(df: DataFrame, actual: str, probability: str, by: Sequence[str] = ()) -> DataFrame:
    """How often the class (1 above 0.5) is right, and both means."""
    hit = ((F.col(probability) > 0.5).cast("int") == F.col(actual).cast("int")).cast("double")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("hit_rate"), F.avg(actual).alias("mean_actual"), F.avg(probability).alias("mean_pred"))
