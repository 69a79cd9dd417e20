"""Mixing sources to target weights: exact block quotas, split among output shards by a multivariate-hypergeometric tree."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, local_rows, stored

#: Weights that sources take in turn, in code-point order, null last.
WEIGHTS = (3.0, 1.0, 2.0)
#: The mix's size as a share of all sizes, and how often a source may be used at most.
SHARE, MOST = 1.5, 2.0
SHARDS, SEED = 16, 20260
#: A block has about this many words. Of a large source the blocks grow and their number stays at MOST_BLOCKS: every document keeps its
#: block, and the last one that is taken in part is cut by hash, without its documents meeting in one task.
BLOCK_WORDS, MOST_BLOCKS = 20_000, 4096
#: The plan holds a few numbers for each source on the driver: more sources than this are an error.
MOST_SOURCES = 100_000
#: Bytes of a part of an output shard, as they are read.
PART_BYTES = 128 << 20
#: A plan of at most this many blocks (about 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_BLOCKS = 100_000


def split_quotas(quotas: list[int], shards: int, seed: int) -> list[list[int]]:
    """Each source's block quota for each shard: halve the shards, draw the left half's counts without replacement, go on.

    The counts of a node are one multivariate hypergeometric draw from its parent's, so the leaves have the law of one
    shuffle of all blocks dealt out in equal hands, and each source's quotas add up exactly.
    """
    rng = np.random.default_rng(seed)

    def down(counts: np.ndarray, n: int) -> list[np.ndarray]:
        if n == 1:
            return [counts]
        left = n // 2
        got = rng.multivariate_hypergeometric(counts, int(counts.sum()) * left // n, method="marginals")
        return down(got, left) + down(counts - got, n - left)

    return [x.tolist() for x in np.array(down(np.array(quotas, dtype=np.int64), shards)).T] if quotas else []


def source_targets(sources: DataFrame) -> DataFrame:
    """sources: (source, source_size). Adds src (order from 0) and target: shares by weight, none above MOST times its size, the excess reshared."""
    w = F.get(F.array(*[F.lit(x) for x in WEIGHTS]), F.col("src") % len(WEIGHTS))
    # One row for each source: these windows see no documents.
    ranked = sources.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).withColumn("__w", w).withColumn("__cap", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "src")
    everything = Window.partitionBy()
    capped = F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing))
    level = (SHARE * F.sum("source_size").over(everything) - capped) / open_weight
    # The level rises while capped sources leave room and falls once they don't: its maximum is the water line.
    return ranked.withColumn("__level", level).withColumn("target", F.least("__cap", F.col("__w") * F.max("__level").over(everything))).select("source", "source_size", "src", "target")


def _hash(*c: Column) -> Column:
    return F.xxhash64(F.lit(SEED), *c)


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *more: Column) -> DataFrame:
    """(__id, __source, size, __h) and more; rows that repeat an id but not its text have hashes of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), _hash(F.col(id_col).cast("string"), F.col(text_col)).alias("__h"), *more)


def _drawn(rows: DataFrame, shards: int) -> Callable[[DataFrame], DataFrame]:
    """Plan the draws of measured rows; the answer adds source_size, target and draws to the same rows, whatever else these carry."""
    spark = rows.sparkSession
    sizes = stored(rows.groupBy(F.col("__source").alias("source")).agg(F.sum("size").cast("long").alias("source_size")), "mix-sources")
    if sizes.count() > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    targets = source_targets(sizes)
    targets = targets.withColumn("__blocks", F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)))).withColumn("__passes", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0)).cast("int"))
    targets = stored(targets.withColumn("__rest", F.col("target") - F.col("__passes") * F.col("source_size")), "mix-targets")

    def placed_of(some: DataFrame) -> DataFrame:
        return some.join(targets, F.col("__source").eqNullSafe(F.col("source"))).withColumn("__block", F.pmod("__h", "__blocks").cast("int"))

    placed = placed_of(rows)
    # One row for each block, MOST_BLOCKS of a source at most; then one for each source, whose last pass takes the blocks that fit what is left.
    order = Window.partitionBy("src").orderBy(_hash(F.col("src"), F.col("__block")), "__block")
    blocks = stored(placed.groupBy("src", "__block", "__passes", "__rest").agg(F.sum("size").alias("__words")).withColumn("__nth", F.row_number().over(order) - 1), "mix-blocks")
    walk = F.aggregate("all", F.struct(F.col("__rest").alias("open"), F.expr("cast(array() as array<int>)").alias("took")), lambda a, x: F.when(
        (x["words"] <= a["open"]) & ((x["words"] > 0) | (a["open"] > 0) | (F.col("__passes") == 0)), F.struct((a["open"] - x["words"]).alias("open"), F.concat(a["took"], F.array(x["nth"])).alias("took")),
    ).otherwise(a))
    sources = blocks.groupBy("src", "__passes", "__rest").agg(F.array_sort(F.collect_list(F.struct(F.col("__nth").alias("nth"), F.col("__words").alias("words")))).alias("all"))
    sources = stored(sources.select("src", F.size("all").alias("__found"), walk.alias("w")).select("src", "__found", F.col("w.open").alias("__open"), F.col("w.took").alias("__took")), "mix-sources")
    heads = blocks.select("src", "__block", "__passes", "__nth").join(sources, "src").withColumn("__last", F.array_position("__took", F.col("__nth")) - 1)
    heads = stored(heads.select("src", "__block", "__passes", "__nth", "__found", "__open", F.when(F.col("__last") >= 0, F.col("__last")).alias("__last"), F.size("__took").alias("__whole")), "mix-heads")
    counted = heads.groupBy("src").agg(F.first(F.col("__passes").cast("long") * F.col("__found") + F.col("__whole")).alias("q"), F.count("*").alias("n")).orderBy("src").collect()  # a number for each source
    near = (lambda df: F.broadcast(df)) if sum(r["n"] for r in counted) <= BROADCAST_BLOCKS else (lambda df: df)

    # What is still open is less than any block left over: documents of these fill it, the largest sizes first, as many of each as fit.
    loose = placed.join(near(heads.where("__last is null and __open > 0").select("src", "__block", "__nth", "__open")), ["src", "__block"]).where((F.col("size") > 0) & (F.col("size") <= F.col("__open")))
    counts = stored(loose.groupBy("src", "__block", "__nth", "__open", "size").agg(F.count("*").alias("n")), "mix-counts")
    sizes = counts.groupBy("src", "__open", "size").agg(F.sum("n").alias("n")).groupBy("src", "__open").agg(F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("all"))
    fits = lambda a, x: F.least(x["n"], F.floor(a["open"] / x["size"]))
    fill = F.aggregate("all", F.struct(F.col("__open").alias("open"), F.expr("cast(array() as array<struct<size:bigint,take:bigint>>)").alias("out")), lambda a, x: F.when(
        fits(a, x) > 0, F.struct((a["open"] - fits(a, x) * x["size"]).alias("open"), F.concat(a["out"], F.array(F.struct(x["size"].alias("size"), fits(a, x).alias("take")))).alias("out")),
    ).otherwise(a), lambda a: a["out"])
    chosen = sizes.select("src", F.explode(fill).alias("x")).select("src", "x.size", "x.take")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("__nth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = stored(counts.join(chosen, ["src", "size"]).withColumn("__take", F.least(F.col("n"), F.col("take") - before)).where("__take > 0").select("src", "__block", "size", "__take", "n"), "mix-fill")
    # Where only some of a block's documents of one size are taken, the hash of the last of them is the cut; numbers alone are ordered here.
    alike = Window.partitionBy("src", "__block", "size").orderBy("__h")
    cut = placed.select("src", "__block", "size", "__h").join(filled.where("__take < n"), ["src", "__block", "size"]).withColumn("__nth", F.row_number().over(alike)).withColumn("__first", F.rank().over(alike)).withColumn("__ties", F.count("*").over(Window.partitionBy("src", "__block", "size", "__h")))
    cut = cut.where("__nth = __take").select("src", "__block", "size", F.col("__h").alias("__cut"), (F.col("__take") - F.col("__first") + 1).alias("__tied"), "__ties")
    filled = stored(filled.join(cut, ["src", "__block", "size"], "left"), "mix-cuts")
    extra = {r["src"]: (r["n"], r["tied"]) for r in filled.groupBy("src").agg(F.count("*").alias("n"), F.coalesce(F.max(F.col("__tied") < F.col("__ties")), F.lit(False)).alias("tied")).collect()}  # two numbers for each source

    dealt = split_quotas([r["q"] + (r["src"] in extra) for r in counted], shards, SEED)
    runs = local_rows(spark, json.dumps([{"src": r["src"], "ends": np.cumsum(x).tolist()} for r, x in zip(counted, dealt, strict=True)]), "src int, ends array<long>")
    # The draws of a source in order: pass after pass, in each pass the blocks in permuted order, and what fills up the last one as one more.
    draw = lambda k, at: F.struct(k.alias("pass"), F.size(F.filter("ends", lambda e: e <= at)).alias("shard"))
    start, none = F.col("__passes") * F.col("__found"), F.expr("cast(array() as array<struct<pass:int,shard:int>>)")
    full = F.when(F.col("__passes") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("__passes") - 1, F.lit(0))), lambda k: draw(k, k * F.col("__found") + F.col("__nth")))).otherwise(none)
    last = F.when(F.col("__last").isNotNull(), F.array(draw(F.col("__passes"), start + F.col("__last")))).otherwise(none)
    plan = stored(heads.join(runs, "src").select("src", "__block", F.concat(full, last).alias("__draws"), draw(F.col("__passes"), start + F.col("__whole")).alias("__more")), "mix-plan")
    few = F.broadcast(filled) if sum(n for n, _ in extra.values()) <= BROADCAST_BLOCKS else filled

    def answer(some: DataFrame) -> DataFrame:
        met = placed_of(some).join(near(plan), ["src", "__block"]).join(few, ["src", "__block", "size"], "left")
        tied = F.coalesce((F.col("__h") == F.col("__cut")) & (F.col("__tied") < F.col("__ties")), F.lit(False))
        took = F.col("__take").isNotNull() & (F.col("__cut").isNull() | (F.col("__h") <= F.col("__cut")))
        if any(t for _, t in extra.values()):  # rows equal in id and text, of which only some are taken
            some_of = Window.partitionBy("src", "__block", "size", "__h").orderBy("__id")
            met = met.where(~tied).withColumn("__in", took).unionByName(met.where(tied).withColumn("__in", F.row_number().over(some_of) <= F.col("__tied")))
        else:
            met = met.withColumn("__in", took)
        return met.withColumn("draws", F.when(F.col("__in"), F.concat("__draws", F.array("__more"))).otherwise(F.col("__draws")))

    return answer


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """How often, and to which shards, each document goes, so that sources reach their targets.

    Returns one row for each input row: id, size (words; null text: 0), source_size, target, taken (words, repeats
    counted: 0, 1 or 2 times size), draws (an array of (pass, shard), one entry for each time that the document is
    taken), order (a random place for the shuffle inside a shard).

    A source's rows are dealt into blocks by hash. Whole passes take all its blocks, the last pass takes blocks in
    permuted order, passing over those larger than what is left, and then documents of the blocks passed over: a source
    ends short by less than the smallest document with words that its last pass leaves. The block draws of a source,
    in permuted order, go to shards in runs as long as their quotas. Rows repeat as in the input, null ids are told
    apart by their texts, null sources are one source, more than MOST_SOURCES sources raise, a source without words has target 0, and reruns agree. An empty
    table gives no rows; other columns are not looked at.
    """
    rows = stored(_measured(docs, id_col, text_col, source_col), "mix-sizes")
    out = _drawn(rows, shards)(rows)
    return out.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), "draws", F.col("__h").alias("order"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", shards: int = SHARDS) -> DataFrame:
    """The mix itself: every drawn document, repeats included, with all its columns, dealt into shards and shuffled inside each.

    Planned on ids and sizes; texts move once, to their shards. A shard is split over as many tasks as its bytes need;
    inside each, rows are in random order. Documents without words are drawn with their block. The output has the
    columns of docs, whatever their names; an empty table gives no rows.
    """
    names = docs.columns
    rows = stored(_measured(docs, id_col, text_col, source_col, F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).alias("__bytes")), "mix-sizes")
    parts = max(1, -(-int(SHARE * (rows.agg(F.coalesce(F.sum("__bytes"), F.lit(0))).first()[0])) // (shards * PART_BYTES)))
    planned = _drawn(rows, shards)(_measured(docs, id_col, text_col, source_col, F.struct("*").alias("__row")))
    drawn = planned.select("__row", "__h", F.explode("draws").alias("__draw")).select("__row", F.col("__draw.shard").alias("__shard"), F.xxhash64("__h", "__draw.pass").alias("__place"))
    return drawn.repartition(shards * parts, "__shard", F.pmod("__place", F.lit(parts))).sortWithinPartitions("__shard", "__place").select(*[F.col("__row").getField(c).alias(c) for c in names])
