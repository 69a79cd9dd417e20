"""Default targets with censoring, populations and deterministic samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clean import clipped, month_index, months_between

# The statuses that count as bad, and the charge-off ones.
BAD = ("Charged Off", "Default", "Late (31-120 days)", "Does not meet the credit policy. Status:Charged Off")
CHARGED_OFF = ("Charged Off", "Does not meet the credit policy. Status:Charged Off")
EXCLUDED = "Does not meet the credit policy"


def with_targets(df: DataFrame, status_date: str, windows: tuple[int, ...] = (12, 24), buffer: int = 2, status: str = "loan_status", issue: str = "issue_d", last: str = "last_pymnt_d") -> DataFrame:
    """Adds vintage, mob_last_pay (never paid: 0), mob_observed, target_badW and obsW for each window W, target_lifetime."""
    bad = F.coalesce(F.col(status).isin(*BAD), F.lit(False))
    paid = F.coalesce(months_between(F.col(last), F.col(issue)), F.lit(0))
    seen = months_between(F.lit(status_date).cast("date"), F.col(issue))
    out = {"vintage": F.year(issue), "mob_last_pay": paid, "mob_observed": seen, "target_lifetime": bad.cast("int")}
    for w in windows:
        out |= {f"target_bad{w}": (bad & (paid < w)).cast("int"), f"obs{w}": seen >= w + buffer}
    return df.withColumns(out)


def with_losses(df: DataFrame, status: str = "loan_status") -> DataFrame:
    """Adds recovery_rate, recovered_any, ccf (null unless charged off) and net_loss (else 0)."""
    off = F.col(status).isin(*CHARGED_OFF)
    rate = F.try_divide(F.col("recoveries"), F.col("funded_amnt"))
    open_share = F.try_divide(F.col("funded_amnt") - F.col("total_rec_prncp"), F.col("funded_amnt"))
    loss = F.col("funded_amnt") - F.col("total_rec_prncp") - F.col("recoveries") + F.col("collection_recovery_fee")
    return df.withColumns({"recovery_rate": F.when(off, clipped(rate)), "recovered_any": F.when(off, (F.col("recoveries") > 0).cast("int")), "ccf": F.when(off, clipped(open_share)), "net_loss": F.when(off, loss).otherwise(0.0)})


def vintage_audit(df: DataFrame, vintage: str, y: str, observed: Column, current: Column, long_term: Column) -> DataFrame:
    """Of each vintage: accounts, observed ones, bad rates over all and over observed ones, shares."""
    share = lambda c: F.avg(c.cast("double"))
    return df.groupBy(vintage).agg(F.count("*").alias("n_loans"), F.count(F.when(observed, 1)).alias("n_obs"), F.avg(y).alias("lifetime_bad_rate"), F.avg(F.when(observed, F.col(y))).alias("observed_bad_rate"), share(current).alias("share_current"), share(long_term).alias("share_long"))


def split_by_hash(df: DataFrame, row_id: str, share: float, seed: int, strata: tuple[str, ...] = ()) -> DataFrame:
    """Adds in_sample: of each stratum round(share * n) rows, those of smallest digest; the same rows however the data lie.

    A stratum's rows are ranked inside buckets of digests first, so that no stratum goes through one task.
    """
    h = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))).withColumn("__b", F.substring("__h", 1, 3))
    counts = h.groupBy(*strata, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*strata)
    before = counts.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(strata)], F.col("__b").alias("__at"), (F.sum("__n").over(w.orderBy("__b")) - F.col("__n")).alias("__before"), F.sum("__n").over(w).alias("__all"))  # at most 4096 rows for each stratum
    on = F.col("__b") == F.col("__at")
    for i, c in enumerate(strata):
        on = on & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    rank = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", row_id)) + F.col("__before")
    return h.join(before, on).select(*df.columns, (rank <= F.round(F.col("__all") * share)).alias("in_sample"))


def month_of(d: Column) -> Column:
    return month_index(d)


def floor_sample(df: DataFrame, row_id: str, stratum: str, wanted: int, floor: int, seed: int) -> DataFrame:
    """Of each stratum its share of the wanted rows, at least floor, at most all: those of smallest digest.

    Rows far from the cut are dropped by a digest threshold before the ranking, which only sees what may be taken.
    """
    d = df.withColumn("__d", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))).withColumn("__b", F.conv(F.substring("__d", 1, 3), 16, 10).cast("int"))
    counts = d.groupBy(stratum, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(stratum)
    counts = counts.withColumns({"__before": F.sum("__n").over(w.orderBy("__b")) - F.col("__n"), "__of": F.sum("__n").over(w), "__all": F.sum("__n").over(Window.partitionBy())})  # 4096 rows for each stratum
    take = F.least(F.col("__of"), F.greatest(F.lit(floor), F.rint(F.col("__of") * float(wanted) / F.col("__all")).cast("long")))
    near = counts.withColumn("__take", take).where(F.col("__before") < F.col("__take")).select(F.col(stratum).alias("__s"), F.col("__b").alias("__at"), "__before", "__take")
    met = d.join(near, F.col(stratum).eqNullSafe(F.col("__s")) & (F.col("__b") == F.col("__at")))
    rank = F.row_number().over(Window.partitionBy(stratum, "__b").orderBy("__d", row_id)) + F.col("__before")
    return met.withColumn("__rank", rank).where(F.col("__rank") <= F.col("__take")).select(*df.columns)
