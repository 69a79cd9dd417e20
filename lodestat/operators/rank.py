"""Ranking statistics: AUC, Gini, KS, stable ranks, decile and CAP tables, inversions.

A global order never goes through one task: rows are dealt into score buckets, whose totals (some thousand rows for
each group) give what lies before a bucket, and windows run inside buckets. Rows of one score stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: Buckets for each doubling of a score's size; sizes below 2 ** -SMALLEST share one.
BUCKETS, SMALLEST = 1024, 64


def _bucket(p: Column) -> Column:
    """Monotone in p, fine in proportion to its size: probabilities, points, log-odds and amounts alike are spread over thousands of buckets."""
    x = p.cast("double")
    size = F.floor((F.log2(F.greatest(F.abs(x), F.lit(2.0**-SMALLEST))) + SMALLEST) * BUCKETS).cast("int")
    return F.when(x < 0, -size).otherwise(size)


def with_running(df: DataFrame, order: Sequence[Column], p: str, sums: dict[str, Column], by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Adds each sum's total over all rows up to and with this one, in the given order, whose first part must follow p."""
    b = df.withColumn("__bucket", -_bucket(F.col(p)) if descending else _bucket(F.col(p)))
    totals = b.groupBy(*by, "__bucket").agg(*[F.sum(c).alias(f"__t_{k}") for k, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], F.col("__bucket").alias("__at"), *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__b_{k}") for k in sums])
    on = F.col("__bucket") == F.col("__at")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__g{i}"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = b.join(totals, on)
    return out.withColumns({k: F.col(f"__b_{k}") + F.sum(c).over(inside) for k, c in sums.items()}).select(*df.columns, *sums)


def score_counts(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct score: bads and goods."""
    return df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.col(y)).cast("long").alias("bads"), F.sum(1 - F.col(y)).cast("long").alias("goods"))


def discrimination(df: DataFrame, y: str, p: str, by: Sequence[str] = ()) -> DataFrame:
    """n, bads, auc (ties count half), gini, ks (after whole ties) of each group; null where a class is missing."""
    run = with_running(stored(score_counts(df, y, p, by), "score-counts"), [F.col("p")], "p", {"cum_b": F.col("bads"), "cum_g": F.col("goods")}, by, descending=False)
    whole = run.groupBy(*by).agg(F.sum("bads").alias("b"), F.sum("goods").alias("g"))
    keyed = run.join(whole.withColumnsRenamed({c: f"__{c}" for c in by}), reduce_and([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])) if by else run.crossJoin(F.broadcast(whole))  # one row
    s = keyed.groupBy(*by).agg(
        F.max(F.col("b") + F.col("g")).alias("n"), F.max("b").alias("bads"), F.max("g").alias("__g"),
        F.sum(F.col("bads") * (F.col("cum_g") - F.col("goods") / 2.0)).alias("__u"),
        F.max(F.abs(F.try_divide(F.col("cum_b"), F.col("b")) - F.try_divide(F.col("cum_g"), F.col("g")))).alias("ks"),
    )
    auc = F.try_divide(F.col("__u"), F.col("bads") * F.col("__g").cast("double"))
    return s.select(*by, "n", "bads", auc.alias("auc"), (2 * auc - 1).alias("gini"), F.when((F.col("bads") > 0) & (F.col("__g") > 0), F.col("ks")).alias("ks"))


def reduce_and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def ranked(df: DataFrame, p: str, row_id: str, by: Sequence[str] = (), descending: bool = True) -> DataFrame:
    """Adds rank (from 1; ties by row_id) and n, of each group."""
    order = [F.col(p).desc() if descending else F.col(p), F.col(row_id)]
    df = stored(df.where(F.col(p).isNotNull()), "ranked")  # read three times
    out = with_running(df, order, p, {"rank": F.lit(1)}, by, descending)
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    if not by:
        return out.crossJoin(F.broadcast(n))  # one row
    n = n.withColumnsRenamed({c: f"__{c}" for c in by})
    return out.join(n, reduce_and([F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])).drop(*[f"__{c}" for c in by])


def decile_of(rank: Column, n: Column, bins: int = 10) -> Column:
    """1-based: the first n / bins ranks are 1, and so on."""
    return (F.floor((rank - 1) * bins / n) + 1).cast("int")


def decile_table(df: DataFrame, y: str, p: str, row_id: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Riskiest first: n, bads, rates, score range, cumulative shares, KS, lift."""
    r = ranked(df.where(F.col(y).isNotNull()).select(*dict.fromkeys([*by, row_id, y, p])), p, row_id, by).withColumn("decile", decile_of(F.col("rank"), F.col("n"), bins))
    t = r.groupBy(*by, "decile").agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("bads"), F.avg(p).alias("mean_pd"), F.min(p).alias("score_min"), F.max(p).alias("score_max"))
    upto, every = Window.partitionBy(*by).orderBy("decile"), Window.partitionBy(*by)
    t = t.withColumns({"cum_bads": F.sum("bads").over(upto), "__cn": F.sum("n").over(upto), "__b": F.sum("bads").over(every), "__n": F.sum("n").over(every)})  # bins rows for each group
    rate = F.col("bads") / F.col("n")
    cb, cg = F.try_divide(F.col("cum_bads"), F.col("__b")), F.try_divide(F.col("__cn") - F.col("cum_bads"), F.col("__n") - F.col("__b"))
    base = F.col("__b") / F.col("__n")
    return t.select(*by, "decile", "n", "bads", rate.alias("bad_rate"), "mean_pd", "score_min", "score_max", "cum_bads", cb.alias("cum_bad_share"), cg.alias("cum_good_share"), F.abs(cb - cg).alias("ks_at_decile"), F.try_divide(rate, base).alias("lift"), F.try_divide(F.col("cum_bads") / F.col("__cn"), base).alias("cum_lift"))


def calibration_table(df: DataFrame, y: str, p: str, row_id: str, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Safest first: n, mean PD, observed rate, expected and observed bads."""
    r = ranked(df.where(F.col(y).isNotNull()).select(*dict.fromkeys([*by, row_id, y, p])), p, row_id, by, descending=False).withColumn("bin", decile_of(F.col("rank"), F.col("n"), bins))
    t = r.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_pd"), F.avg(y).alias("obs_rate"), F.sum(p).alias("expected_bads"), F.sum(y).cast("long").alias("bads"))
    return t.withColumn("diff", F.col("obs_rate") - F.col("mean_pd"))


def cap_table(df: DataFrame, y: str, p: str, row_id: str, points: int = 101) -> DataFrame:
    """Share of bads among the riskiest, at evenly spaced shares of the population, with the perfect and the random curve."""
    df = stored(df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([row_id, y, p])), "cap")
    r = with_running(df, [F.col(p).desc(), F.col(row_id)], p, {"rank": F.lit(1), "cum_bads": F.col(y)})
    whole = df.agg(F.count("*").alias("n"), F.sum(y).alias("b"))
    grid = whole.select("n", "b", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.rint(i * F.col("n") / (points - 1)).cast("long")))).alias("k"))
    met = F.broadcast(grid).join(r.select("rank", "cum_bads"), F.col("k") == F.col("rank"), "left")  # points rows
    return met.select((F.col("k") / F.col("n")).alias("population"), F.try_divide(F.coalesce("cum_bads", F.lit(0)), F.col("b")).alias("captured"), F.least(F.try_divide(F.col("k"), F.col("b")), F.lit(1.0)).alias("perfect"), (F.col("k") / F.col("n")).alias("random"))


def inversions(table: DataFrame, order: str, rate: str, by: Sequence[str] = (), increasing: bool = False) -> DataFrame:
    """How often a rate moves against the expected direction from one row to the next. For tables of a few rows each group."""
    last = F.lag(rate).over(Window.partitionBy(*by).orderBy(order))
    against = (F.col(rate) < last) if increasing else (F.col(rate) > last)
    return table.withColumn("__x", F.coalesce(against.cast("int"), F.lit(0))).groupBy(*by).agg(F.sum("__x").cast("long").alias("inversions"))


def group_inversions(df: DataFrame, y: str, p: str, group: str, least: int = 100) -> DataFrame:
    """Falls of the observed rate between groups of at least so many rows, ordered by mean PD."""
    g = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(y).alias("rate"), F.avg(p).alias("mean_pd")).where(F.col("n") >= least)
    return inversions(g, "mean_pd", "rate", increasing=True)


def curves(df: DataFrame, y: str, p: str) -> DataFrame:
    """ROC, CAP and KS points: one for each distinct score, riskiest first, with the shares up to it."""
    c = stored(score_counts(df, y, p), "score-counts")
    run = with_running(c, [F.col("p").desc()], "p", {"b": F.col("bads"), "g": F.col("goods")})
    whole = c.agg(F.sum("bads").alias("tb"), F.sum("goods").alias("tg"))
    return run.crossJoin(F.broadcast(whole)).select("p", F.try_divide("b", "tb").alias("tpr"), F.try_divide("g", "tg").alias("fpr"), ((F.col("b") + F.col("g")) / (F.col("tb") + F.col("tg"))).alias("population"))  # one row


def auc_from_deciles(deciles: DataFrame) -> DataFrame:
    """Trapezoids through a decile table's cumulative shares."""
    w = Window.orderBy("decile")  # a decile table
    x, yv = F.col("cum_good_share"), F.col("cum_bad_share")
    px, py = F.coalesce(F.lag(x).over(w), F.lit(0.0)), F.coalesce(F.lag(yv).over(w), F.lit(0.0))
    return deciles.select(((x - px) * (yv + py) / 2).alias("area")).agg(F.sum("area").alias("auc_approx"))


def min_rank_descending(df: DataFrame, column: str, name: str) -> DataFrame:
    """Competition rank, largest first; null stays null. For result tables."""
    return df.withColumn(name, F.when(F.col(column).isNotNull(), F.rank().over(Window.orderBy(F.col(column).desc_nulls_last()))))


def delong(df: DataFrame, y: str, p1: str, p2: str) -> DataFrame:
    """auc_a, auc_b, d_auc, delong_z of two scores on the same rows, from placements by average ranks.

    A row's placement is the share of the other class that it is on the right side of, ties half. z is null
    where the variance is zero; its probability comes from the normal tail (``governance.with_tails``).
    """
    rows = df.where(F.col(y).isNotNull() & F.col(p1).isNotNull() & F.col(p2).isNotNull())
    placed = stored(rows.groupBy(F.col(y).alias("y"), F.col(p1).alias("pa"), F.col(p2).alias("pb")).agg(F.count("*").alias("n")), "placements")  # everything below needs these counts alone
    whole = placed.agg(F.sum(F.col("y") * F.col("n")).alias("m"), F.sum((1 - F.col("y")) * F.col("n")).alias("k"))
    for c, name in (("pa", "va"), ("pb", "vb")):
        counts = placed.groupBy(F.col(c).alias("p")).agg(F.sum(F.col("y") * F.col("n")).alias("bads"), F.sum((1 - F.col("y")) * F.col("n")).alias("goods"))
        run = with_running(counts, [F.col("p")], "p", {"cb": F.col("bads"), "cg": F.col("goods")}, descending=False)
        at = run.select(F.col("p").alias("__p"), (F.col("cg") - F.col("goods") / 2.0).alias("__lower"), (F.col("cb") - F.col("bads") / 2.0).alias("__below"))
        placed = placed.join(at, F.col(c) == F.col("__p")).drop("__p").withColumnsRenamed({"__lower": f"{name}_g", "__below": f"{name}_b"})
    s = placed.crossJoin(F.broadcast(whole))  # one row
    # Halves are taken off, which changes no variance and keeps its digits.
    v = {n: F.when(F.col("y") == 1, F.col(f"{n}_g") / F.col("k")).otherwise(1 - F.col(f"{n}_b") / F.col("m")) - 0.5 for n in ("va", "vb")}
    s = s.select("y", "m", "k", "n", v["va"].alias("va"), v["vb"].alias("vb"), (v["va"] - v["vb"]).alias("vd"))
    total, mean = F.sum("n"), lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    spread = (F.sum(F.col("vd") * F.col("vd") * F.col("n")) - total * mean("vd") * mean("vd")) / F.nullif(total - 1, F.lit(0))
    parts = s.groupBy("y", "m", "k").agg((mean("va") + 0.5).alias("a"), (mean("vb") + 0.5).alias("b"), F.greatest(spread, F.lit(0.0)).alias("v"))
    one = parts.groupBy("m", "k").agg(F.max(F.when(F.col("y") == 1, F.col("a"))).alias("auc_a"), F.max(F.when(F.col("y") == 1, F.col("b"))).alias("auc_b"), F.sum(F.col("v") / F.when(F.col("y") == 1, F.col("m")).otherwise(F.col("k"))).alias("var"))
    z = F.when(F.col("var") > 1e-18, (F.col("auc_a") - F.col("auc_b")) / F.sqrt("var"))
    return one.select("auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("d_auc"), z.alias("delong_z"))
