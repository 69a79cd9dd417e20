"""Population and characteristic stability."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored

#: The least share of a bin, and how many bins.
FLOOR, BINS = 1e-4, 10
#: A sketch's rank error is at most 1 / ACCURACY of the rows.
ACCURACY = 100_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], at: Sequence[float]) -> dict[str, list[float]]:
    """Quantiles (linear between neighbours) of the values that are not null, of all columns at once; none for a column without values.

    A sketch brackets each wanted rank, one pass counts what lies below the brackets and each value inside, about
    4 / ACCURACY of the rows for each, and those of one value as one count; these are ordered bracket by bracket. No
    buffer holds a column's values, and a value costs a place in its sorted batch, not a test of every bracket.
    """
    narrow = stored(df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]), "quantile-columns")
    xs = [f"x{i}" for i in range(len(columns))]
    n = narrow.agg(*[F.count(x).alias(x) for x in xs]).first()
    wanted = {f"{x}_{i}": (x, p * (n[x] - 1)) for x in xs if n[x] for i, p in enumerate(at)}
    if not wanted:
        return {c: [] for c in columns}
    # A bracket reaches two rank errors and two rows beyond the wanted place on both sides.
    around = {k: [min(1.0, max(0.0, pos / max(1, n[x] - 1) + d * (2.0 / ACCURACY + 2.0 / n[x]))) for d in (-1, 1)] for k, (x, pos) in wanted.items()}
    mine = {x: [k for k, (y, _) in wanted.items() if y == x] for x in xs if n[x]}
    told = narrow.agg(*[F.percentile_approx(x, [v for k in ks for v in around[k]], ACCURACY).alias(x) for x, ks in mine.items()], *[F.min(x).alias(f"lo_{x}") for x in xs], *[F.max(x).alias(f"hi_{x}") for x in xs]).first()  # one sketch for each column
    rough = told.asDict() | {k: told[x][2 * i : 2 * i + 2] for x, ks in mine.items() for i, k in enumerate(ks)}
    brackets = [(rough[f"lo_{x}"] if around[k][0] == 0 else rough[k][0], rough[f"hi_{x}"] if around[k][1] == 1 else rough[k][1]) for k, (x, _) in wanted.items()]
    near = stored(_near(narrow, [xs.index(x) for x, _ in wanted.values()], brackets).groupBy("k", "v").agg(F.sum("n").alias("n")), "quantile-brackets")
    counts = {r["k"]: (r["below"], r["held"]) for r in near.groupBy("k").agg(F.sum(F.when(F.col("v").isNull(), F.col("n"))).alias("below"), F.sum(F.when(F.col("v").isNotNull(), F.col("n")).otherwise(0)).alias("held")).collect()}  # a row for each column and level
    ranks = []
    for i, (_, pos) in enumerate(wanted.values()):
        below, held = counts[i]
        ranks.append((floor(pos) - below, ceil(pos) - below))
        if ranks[i][0] < 0 or ranks[i][1] >= held:
            raise ArithmeticError("a sketch has missed a rank by more than its error")
    ends = near.where("v is not null").withColumn("end", F.sum("n").over(Window.partitionBy("k").orderBy("v")))
    first, last = (F.get(F.array(*[F.lit(r[i]) for r in ranks]), F.col("k")) for i in (0, 1))
    met = ends.where((first < F.col("end")) & (last >= F.col("end") - F.col("n"))).groupBy("k").agg(F.min("v").alias("first"), F.max("v").alias("last")).collect()  # a row for each column and level
    got = {r["k"]: (r["first"], r["last"]) for r in met}
    between = [got[i][0] + (pos - floor(pos)) * (got[i][1] - got[i][0]) for i, (_, pos) in enumerate(wanted.values())]
    return {c: [v for v, (y, _) in zip(between, wanted.values()) if y == x] for c, x in zip(columns, xs, strict=True)}


def _near(narrow: DataFrame, column: Sequence[int], brackets: Sequence[tuple[float, float]]) -> DataFrame:
    """(k, v, n) from each task: how many values lie below a bracket (v null), and how often each value inside it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, held = np.zeros(len(brackets), np.int64), [[] for _ in brackets]
        size = [0] * len(brackets)

        def counted(k: int) -> tuple[np.ndarray, np.ndarray]:
            values, at = np.unique(np.concatenate([v for v, _ in held[k]]), return_inverse=True)
            return values, np.bincount(at, np.concatenate([n for _, n in held[k]])).astype(np.int64)

        for b in batches:
            ordered = [np.sort(c.drop_null().to_numpy(zero_copy_only=False)) for c in b.columns]
            for k, (lo, hi) in enumerate(brackets):
                x = ordered[column[k]]
                i, j = np.searchsorted(x, lo, "left"), np.searchsorted(x, hi, "right")
                below[k] += i
                if i < j:
                    held[k].append(np.unique(x[i:j], return_counts=True))
                    size[k] += len(held[k][-1][0])
                    if size[k] > 10_000:  # one value of many rows is one count
                        held[k] = [counted(k)]
                        size[k] = len(held[k][0][0]) // 2
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(below)), pa.int32()), pa.nulls(len(below), pa.float64()), pa.array(below)], names=["k", "v", "n"])
        for k in range(len(brackets)):
            if held[k]:
                values, n = counted(k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k), pa.int32()), pa.array(values), pa.array(n)], names=["k", "v", "n"])

    return narrow.mapInArrow(run, "k int, v double, n long")


#: Groups of fewer rows than this are ordered whole; brackets of at most so many groups are broadcast.
SMALL, BROADCAST_GROUPS = ACCURACY, 10_000


def grouped_quantiles(df: DataFrame, column: str | Column, by: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(by, level, value): exact quantiles (linear between neighbours) of each group's values that are not null.

    A sketch for each group brackets each level; a pass counts each group's rows below its brackets and keeps what lies
    inside; only that is ordered, by (group, level). A group that lies whole in a bracket has fewer than SMALL rows, a
    larger one leaves about 6 / ACCURACY of its rows. Groups without values have no rows; a null group is one.
    """
    keys = [f"g{i}" for i in range(len(by))]
    narrow = stored(df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], (F.col(column) if isinstance(column, str) else column).cast("double").alias("v")).where("v is not null"), "quantile-groups")
    around = [x for p in at for x in (max(0.0, p - 3.0 / ACCURACY), min(1.0, p + 3.0 / ACCURACY))]
    told = narrow.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile_approx("v", around, ACCURACY).alias("rough"))
    bracket = lambda i: F.struct(F.when((F.col("n") >= SMALL) & F.lit(around[2 * i] > 0), F.col("rough")[2 * i]).otherwise(F.col("lo")).alias("lo"), F.when((F.col("n") >= SMALL) & F.lit(around[2 * i + 1] < 1), F.col("rough")[2 * i + 1]).otherwise(F.col("hi")).alias("hi"))
    told = stored(told.select(*keys, "n", F.array(*[bracket(i) for i in range(len(at))]).alias("b")), "quantile-brackets")
    near = F.broadcast(told) if told.count() <= BROADCAST_GROUPS else told
    same = F.lit(True)
    for k in keys:
        same = same & narrow[k].eqNullSafe(told[k])
    met = narrow.join(near, same).select(*[narrow[k] for k in keys], "v", "n", "b")
    below = met.groupBy(*keys, "n").agg(*[F.count_if(F.col("v") < F.col("b")[i]["lo"]).alias(f"below{i}") for i in range(len(at))])
    below = below.select(*keys, "n", F.posexplode(F.array(*[F.col(f"below{i}") for i in range(len(at))])).alias("i", "below"))
    inside = met.select(*keys, "v", F.explode(F.filter(F.array(*[F.when(F.col("v").between(F.col("b")[i]["lo"], F.col("b")[i]["hi"]), F.lit(i)) for i in range(len(at))]), lambda x: x.isNotNull())).alias("i"))
    counted = inside.groupBy(*keys, "i", "v").agg(F.count("*").alias("c"))
    ends = counted.withColumn("end", F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v")))
    both = F.col("x.i") == F.col("y.i")
    for k in keys:
        both = both & F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    placed = ends.alias("x").join(below.alias("y"), both).select(*[F.col(f"x.{k}") for k in keys], F.col("x.i").alias("i"), "v", (F.col("below") + F.col("end")).alias("end"), (F.col("below") + F.col("end") - F.col("c")).alias("start"), "n")
    pos = F.get(F.array(*[F.lit(float(p)) for p in at]), F.col("i")) * (F.col("n") - 1)
    value = lambda rank: F.max(F.when((rank >= F.col("start")) & (rank < F.col("end")), F.col("v")))
    out = placed.withColumns({"f": F.floor(pos), "c": F.ceil(pos), "w": pos - F.floor(pos)}).groupBy(*keys, "i").agg(value(F.col("f")).alias("a"), value(F.col("c")).alias("z"), F.first("w").alias("w"))
    missed = F.when(F.col("a").isNull() | F.col("z").isNull(), F.raise_error(F.lit("a sketch has missed a rank by more than its error")).cast("double"))
    return out.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.get(F.array(*[F.lit(float(p)) for p in at]), F.col("i")).alias("level"), F.coalesce(missed, F.col("a") + F.col("w") * (F.col("z") - F.col("a"))).alias("value"))


def edges(df: DataFrame, x: str, bins: int = BINS) -> list[float]:
    """Unique interior quantiles (linear between neighbours) of the values that are not null: bins - 1 numbers at most."""
    return sorted(set(exact_quantiles(df, [x], [i / bins for i in range(1, bins)])[x]))


def bin_of(x: Column, at: Sequence[float]) -> Column:
    """How many edges lie below x: a value on an edge belongs to the bin that ends there; null stays null."""
    if not at:
        return F.when(x.isNotNull(), 0)
    return F.when(x.isNotNull(), F.size(F.filter(F.array(*[F.lit(float(e)) for e in at]), lambda e: e < x.cast("double"))))


def contribution(expected: Column, actual: Column) -> Column:
    e, a = F.greatest(expected, F.lit(FLOOR)), F.greatest(actual, F.lit(FLOOR))
    return (a - e) * F.ln(a / e)


def psi_table(df: DataFrame, x: str, is_dev: Column, at: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Shares of development and current rows in each bin, zero-filled, and each bin's part of the PSI; current rows by group."""
    bins = df.sparkSession.range(len(at) + 1).select(F.col("id").cast("int").alias("bin"))
    rows = df.withColumn("bin", bin_of(F.col(x), at)).where("bin is not null")
    dev = rows.where(is_dev).groupBy("bin").agg(F.count("*").alias("__d"))
    cur = rows.where(~is_dev).groupBy(*by, "bin").agg(F.count("*").alias("__c"))
    groups = cur.select(*by).distinct() if by else df.sparkSession.range(1).select()
    full = groups.crossJoin(bins).join(dev, "bin", "left").join(cur, [*by, "bin"], "left").fillna(0, ["__d", "__c"])  # bins of each group: result size
    share = lambda c, w: c / F.greatest(F.sum(c).over(w), F.lit(1))
    full = full.withColumns({"dev_share": share(F.col("__d"), Window.partitionBy(*by)), "share": share(F.col("__c"), Window.partitionBy(*by))})
    return full.select(*by, "bin", "dev_share", "share", contribution(F.col("dev_share"), F.col("share")).alias("psi"))


def psi(df: DataFrame, x: str, is_dev: Column, by: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    t = psi_table(df, x, is_dev, edges(df.where(is_dev), x, bins), by)
    return t.groupBy(*by).agg(F.sum("psi").alias("psi"))


def csi(df: DataFrame, is_dev: Column, numeric: Sequence[str], labels: Sequence[str] = (), bins: int = BINS) -> DataFrame:
    """(variable, psi): all features melted once, missing values a bin of their own, one aggregate for everything."""
    dev = df.where(is_dev)
    q = exact_quantiles(dev, numeric, [i / bins for i in range(1, bins)]) if numeric else {}
    named = [F.struct(F.lit(c).alias("variable"), F.coalesce(bin_of(F.col(c), sorted(set(q[c]))).cast("string"), F.lit("(missing)")).alias("bin")) for c in numeric]
    named += [F.struct(F.lit(c).alias("variable"), F.coalesce(F.col(c).cast("string"), F.lit("(missing)")).alias("bin")) for c in labels]
    long = df.select(is_dev.alias("dev"), F.explode(F.array(*named)).alias("x")).groupBy("x.variable", "x.bin").agg(F.sum(F.col("dev").cast("int")).alias("d"), F.sum((~F.col("dev")).cast("int")).alias("c"))
    w = Window.partitionBy("variable")
    parts = long.select("variable", contribution(F.col("d") / F.greatest(F.sum("d").over(w), F.lit(1)), F.col("c") / F.greatest(F.sum("c").over(w), F.lit(1))).alias("x"))
    return parts.groupBy("variable").agg(F.sum("x").alias("psi"))
