"""Bootstrap intervals of AUC, Gini and KS that rerun the same: what a draw takes comes from digests of ids.

Draws are with replacement: a tree splits each draw's n rows among buckets of digests, at each node by a binomial draw that
has the node's number as its seed, and a bucket deals what it gets to its rows. Every draw so takes exactly n rows, and a
bucket needs nothing but the sizes of the buckets. Poisson(1) weights, the limit of that for many rows, need no sizes
at all; SQL can follow them. Where a row cap bounds the work, the rows of smallest digest are the sample; aucs needs none.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .rank import with_running

#: Draws, the row cap, and the limits of the interval.
DRAWS, ROW_CAP, LIMITS = 500, 50_000, (0.025, 0.975)
#: Draws served by one digest: six hexadecimal digits each.
PER_DIGEST = 5
#: Rows of a bucket, about; and how many buckets there may be, whose sizes the driver holds: beyond, buckets grow.
BUCKET_ROWS, MOST_BUCKETS = 256, 1 << 16
#: Buckets that are dealt together; rows of a part of a score's order, about, and how many parts there may be: beyond, parts grow.
TOGETHER, PART_ROWS, MOST_PARTS = 16, 8192, 4096
#: Draws whose sums a task works out at once.
DRAWS_AT_ONCE = 64


def _poisson_limits() -> list[float]:
    """Cumulative probabilities of Poisson(1), as parts of 2**24."""
    total, out = 0.0, []
    for k in range(9):
        total += exp(-1) / factorial(k)
        out.append(round(total * 2**24))
    return out


def poisson_weight(digest: Column, place: int) -> Column:
    u = F.conv(F.substring(digest, 1 + 6 * place, 6), 16, 10).cast("long")
    out = F.lit(0)
    for limit in _poisson_limits():
        out = out + (u >= limit).cast("int")
    return out


def capped_sample(df: DataFrame, row_id: str, cap: int = ROW_CAP, seed: int = 0) -> DataFrame:
    """The rows of smallest digest: the same however the data lie; all rows if there are no more than cap."""
    return df.withColumn("__d", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))).orderBy("__d").limit(cap).drop("__d")


def taken_by_bucket(sizes: np.ndarray, bucket: int, draws: int, seed: int = 0, known: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """How many rows of a bucket each draw takes: down the tree from all rows, halving the buckets, to this one. sizes has a power of two of buckets. known keeps what nodes gave, for buckets beside this one."""
    known = {} if known is None else known
    node, lo, hi = 1, 0, len(sizes)
    got = np.full(draws, int(sizes.sum()), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if node not in known:
            whole, left = int(sizes[lo:hi].sum()), int(sizes[lo:mid].sum())
            known[node] = np.random.default_rng([seed, node]).binomial(got, left / whole) if whole else got
        to_left = known[node]
        if bucket < mid:
            got, hi, node = to_left, mid, 2 * node
        else:
            got, lo, node = got - to_left, mid, 2 * node + 1
    return got


def dealt(got: np.ndarray, rows: int, bucket: int, seed: int = 0) -> np.ndarray:
    """draws x rows: how often each draw takes each row of a bucket."""
    return np.random.default_rng([seed, bucket, 1]).multinomial(got, np.full(rows, 1 / rows))


def _placed(df: DataFrame, row_id: str, seed: int):  # noqa: ANN202
    """Adds __digest and __bucket; and a broadcast of how many rows each bucket has."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row_id).cast("string")))
    n = df.count()
    buckets = 1 << max(0, min(MOST_BUCKETS, -(-n // BUCKET_ROWS)) - 1).bit_length()
    placed = df.withColumn("__digest", digest).withColumn("__bucket", F.pmod(F.conv(F.substring("__digest", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    sizes = np.zeros(buckets, np.int64)
    for r in placed.groupBy("__bucket").count().collect():  # MOST_BUCKETS numbers at most
        sizes[r["__bucket"]] = r["count"]
    return placed, df.sparkSession.sparkContext.broadcast(sizes)  # MOST_BUCKETS numbers at most


def with_replacement(df: DataFrame, row_id: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """Adds taken: for each draw how often it takes the row. A draw takes as many rows as there are, repeats counted.

    Rows are told apart by the digest of row_id; rows of one digest are taken in the order of all their columns.
    """
    placed, shared = _placed(df, row_id, seed)
    names = [*df.columns, "taken"]
    order = ["__digest", *df.columns]

    def deal(pdf):  # noqa: ANN001, ANN202
        pdf = pdf.sort_values(order, kind="stable")
        bucket = int(pdf["__bucket"].iloc[0])
        pdf["taken"] = list(dealt(taken_by_bucket(shared.value, bucket, draws, seed), len(pdf), bucket, seed).T.astype(np.int32))
        return pdf[names]

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return placed.groupBy("__bucket").applyInPandas(deal, f"{kinds}, taken array<int>")


def replicates(df: DataFrame, y: str, scores: Sequence[str], row_id: str, draws: int = DRAWS, seed: int = 0, poisson: bool = False) -> DataFrame:
    """(draw, model, auc, gini, ks): every score sees the same draws, with replacement or by Poisson weights; draws without both classes give nulls."""
    rows = df.select(F.col(row_id).alias("i"), F.col(y).alias("y"), *[F.col(s).alias(s) for s in scores]).dropna()
    if not poisson:
        taken = with_replacement(rows, "i", draws, seed)
        return _measured(taken.select("y", *scores, F.posexplode("taken").alias("draw", "w")).where("w > 0").select("y", *scores, F.struct("draw", "w").alias("d")), scores)
    batches = -(-draws // PER_DIGEST)
    rows = rows.withColumn("__batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__batch").cast("string"), F.col("i").cast("string"))))
    drawn = F.array(*[F.struct((F.col("__batch") * PER_DIGEST + j).alias("draw"), poisson_weight(F.col("__h"), j).alias("w")) for j in range(PER_DIGEST)])
    return _measured(rows.select("y", *scores, F.explode(drawn).alias("d")).where(F.col("d.w") > 0).where(F.col("d.draw") < draws), scores)


def _measured(rows: DataFrame, scores: Sequence[str]) -> DataFrame:
    """The metrics of each draw from rows (y, scores, d: a draw and how often it takes the row)."""
    models = F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).cast("double").alias("p")) for s in scores])
    counts = rows.select("d.draw", "d.w", "y", F.explode(models).alias("m")).groupBy("draw", "m.model", "m.p").agg(F.sum(F.col("w") * F.col("y")).alias("bads"), F.sum(F.col("w") * (1 - F.col("y"))).alias("goods"))
    run = with_running(counts, [F.col("p")], "p", {"cb": F.col("bads"), "cg": F.col("goods")}, ["draw", "model"], descending=False)
    whole = counts.groupBy("draw", "model").agg(F.sum("bads").alias("tb"), F.sum("goods").alias("tg"))
    t = run.join(whole, ["draw", "model"]).groupBy("draw", "model").agg(
        F.try_divide(F.sum(F.col("bads") * (F.col("cg") - F.col("goods") / 2.0)), F.max("tb") * F.max("tg").cast("double")).alias("auc"),
        F.max(F.abs(F.try_divide("cb", "tb") - F.try_divide("cg", "tg"))).alias("ks"),
    )
    return t.select("draw", "model", "auc", (2 * F.col("auc") - 1).alias("gini"), F.when(F.col("auc").isNotNull(), F.col("ks")).alias("ks"))


def aucs(df: DataFrame, y: str, scores: Sequence[str], row_id: str, draws: int = DRAWS, seed: int = 0) -> DataFrame:
    """(draw, model, auc): those of replicates with replacement, to the last bit, of any number of rows.

    A row's draws are dealt where its bucket is and go, as one block with others, to the part of each score's order that
    the row is in; equal scores of the buckets dealt together are one. Parts sum whole numbers for every draw at once, so
    that nothing is written out for each row and draw. A score of many rows comes to its part once from each such set of buckets.
    """
    names = [f"x{k}" for k in range(len(scores))]
    rows = stored(df.select(F.col(row_id).alias("i"), F.col(y).cast("int").alias("y"), *[F.col(s).cast("double").alias(x) for s, x in zip(scores, names)]).dropna(), "bootstrap-rows")
    placed, sizes = _placed(rows, "i", seed)
    parts, groups = min(MOST_PARTS, -(-int(sizes.value.sum()) // PART_ROWS)), -(-len(sizes.value) // TOGETHER)
    # Where a part ends changes no sum, so a sketch will do.
    cuts = [np.unique(c) for c in rows.approxQuantile(names, [k / parts for k in range(1, parts)], 1 / (4 * parts))] if parts > 1 else [np.empty(0)] * len(names)
    order, models = ["__bucket", "__digest", "i", "y", *names], list(scores)

    def deal(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        pdf = pdf.sort_values(order, kind="stable")
        held, rows_of = np.unique(pdf["__bucket"].to_numpy(), return_counts=True)
        known: dict = {}
        taken = [dealt(taken_by_bucket(sizes.value, int(b), draws, seed, known), int(n), int(b), seed).T for b, n in zip(held, rows_of)]
        taken = np.concatenate([t.astype(np.min_scalar_type(int(t.max()))) for t in taken])
        out, label = [], pdf["y"].to_numpy()
        for k, x in enumerate(names):
            p = pdf[x].to_numpy()
            at = np.lexsort((label, p))
            p, one = p[at], label[at]
            heads = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (one[1:] != one[:-1])])
            w = taken[at] if len(heads) == len(p) else np.add.reduceat(taken[at], heads, axis=0, dtype=np.int64)
            p, one, w = p[heads], one[heads].astype(np.int8), w.astype(np.min_scalar_type(int(w.max())), copy=False)
            part = np.searchsorted(cuts[k], p, side="left")
            ends = np.flatnonzero(np.r_[part[1:] != part[:-1], True]) + 1
            out += [(k, int(part[a]), p[a:b].tobytes(), one[a:b].tobytes(), w[a:b].tobytes()) for a, b in zip(np.r_[0, ends[:-1]], ends)]
        return pd.DataFrame(out, columns=["model", "part", "p", "y", "w"])

    def in_part(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        p, label = np.concatenate([np.frombuffer(b) for b in pdf["p"]]), np.concatenate([np.frombuffer(b, np.int8) for b in pdf["y"]])
        blocks = [np.frombuffer(w, f"u{len(w) // (len(one) * draws)}").reshape(len(one), draws) for w, one in zip(pdf["w"], pdf["y"])]
        at = np.argsort(p, kind="stable")
        p, bad = p[at], label[at][:, None] == 1
        heads, sums = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]), np.empty((3, draws), np.int64)
        most = int(sum(b.sum(axis=0, dtype=np.int64) for b in blocks).max())
        kind = np.int32 if 2 * most * most < 1 << 31 else np.int64  # no sum below is larger
        for a in range(0, draws, DRAWS_AT_ONCE):
            w = np.concatenate([b[:, a : a + DRAWS_AT_ONCE] for b in blocks]).astype(kind)[at]
            bads = w * bad
            goods = w - bads
            if len(heads) < len(p):
                bads, goods = np.add.reduceat(bads, heads, axis=0), np.add.reduceat(goods, heads, axis=0)
            sums[:, a : a + DRAWS_AT_ONCE] = bads.sum(axis=0), goods.sum(axis=0), (bads * (2 * np.cumsum(goods, axis=0, dtype=kind) - goods)).sum(axis=0)
        return pd.DataFrame({"model": pdf["model"].iloc[:1], "part": pdf["part"].iloc[:1], "s": [sums.tobytes()]})

    def whole(pdf):  # noqa: ANN001, ANN202
        import pandas as pd

        bads, goods, twice = np.stack([np.frombuffer(s, np.int64).reshape(3, draws) for s in pdf.sort_values("part")["s"]], axis=1)
        before = np.cumsum(goods, axis=0) - goods
        of_all = bads.sum(axis=0).astype(float) * goods.sum(axis=0)
        auc = np.divide((twice + 2 * bads * before).sum(axis=0) / 2.0, of_all, out=np.full(draws, np.nan), where=of_all > 0)
        return pd.DataFrame({"draw": np.arange(draws, dtype=np.int32), "model": models[int(pdf["model"].iloc[0])], "auc": auc})

    # Rows are few bytes but each costs all draws: a fixed number of tasks, which are not coalesced by size.
    tasks = max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups))
    dealt_out = placed.withColumn("__group", F.floor(F.col("__bucket") / TOGETHER).cast("int")).repartition(tasks, "__group").groupBy("__group").applyInPandas(deal, "model int, part int, p binary, y binary, w binary")
    summed = dealt_out.groupBy("model", "part").applyInPandas(in_part, "model int, part int, s binary")  # parts x draws sums for each score
    return summed.groupBy("model").applyInPandas(whole, "draw int, model string, auc double").withColumn("auc", F.when(~F.isnan("auc"), F.col("auc")))


def intervals(reps: DataFrame, metrics: Sequence[str] = ("auc", "gini", "ks")) -> DataFrame:
    """(model, metric, lo, hi, draws) by percentiles; draws without a value don't count."""
    long = reps.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])).alias("x")).select("model", "x.*").where("v is not null")
    return long.groupBy("model", "metric").agg(*[F.percentile("v", q).alias(n) for n, q in zip(("lo", "hi"), LIMITS, strict=True)], F.count("*").alias("draws"))


def paired_difference(reps: DataFrame, a: str, b: str, metric: str = "auc") -> DataFrame:
    """The interval of a's metric minus b's within the same draws."""
    t = reps.where(F.col("model").isin(a, b)).groupBy("draw").agg(*[F.max(F.when(F.col("model") == m, F.col(metric))).alias(n) for m, n in ((a, "va"), (b, "vb"))])
    d = t.select((F.col("va") - F.col("vb")).alias("d")).where("d is not null")
    return d.agg(*[F.percentile("d", q).alias(n) for n, q in zip(("lo", "hi"), LIMITS, strict=True)], F.avg("d").alias("mean"), F.count("*").alias("draws"))
