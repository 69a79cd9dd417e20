"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, ranges, overfull ones subdivided."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Ranges for each shard at least, and rows of a range as meant. A range is one task's window over short rows.
RANGES_PER_SHARD, RANGE_ROWS = 16, 1_000_000
#: Keys drawn for each range: the driver sees so many keys of 48 characters for each RANGE_ROWS rows, as expected.
KEYS_PER_RANGE = 12
#: A range of over so many times its share is subdivided by a second sample, at most ROUNDS times.
OVERFULL, ROUNDS = 2.0, 3
#: Equal texts stay in one shard while they hold at most this share of a shard's bytes, or as much as so many of the largest rows; larger groups are cut where a boundary falls.
TOLERANCE, LARGEST_ROWS = 0.02, 2
_START = "0" * 32


def _range_of(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at most the key, by bisection."""
    n = len(splitters)
    if not n:
        return F.lit(0)
    steps, all_of = [1 << i for i in range(n.bit_length() - 1, -1, -1)], F.split(F.lit(",".join(splitters)), ",")
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when((at + step <= n) & (F.get(all_of, F.least(at + step - 1, F.lit(n - 1))) <= key), at + step).otherwise(at),
    )


def quantiles(keys: list[str], ranges: int) -> list[str]:
    """Boundaries between so many ranges of equal numbers of sorted keys.

    A boundary goes to the start of its group (the key's first 16 characters), unless the group is so large that two
    boundaries fall into it: then these cut it.
    """
    picks = [keys[i * len(keys) // ranges] for i in range(1, ranges)] if keys else []
    often = Counter(k[:16] for k in picks)
    return sorted({k if often[k[:16]] > 1 else k[:16] + _START for k in picks})


def splitters_of(rows: DataFrame, ranges: int, total: int) -> list[str]:
    """Boundaries of ranges of nearly equal size in rows (__key, size): a size-weighted sample's quantiles, then those of a second sample in each range that is overfull."""
    die = F.pmod(F.xxhash64("__key", F.lit("draw")), F.lit(1 << 40)) / float(1 << 40)
    share = max(1.0, total / ranges)
    # A row is drawn with probability in proportion to its size: its hash, which the order of keys doesn't use, is the die.
    drawn = rows.where(die < F.col("size") * (KEYS_PER_RANGE / share)).select("__key").collect()
    found = quantiles(sorted(r[0] for r in drawn), ranges)
    for turn in range(ROUNDS):
        ranged = rows.withColumn("__range", _range_of(F.col("__key"), found))
        over = {r["__range"]: r["bytes"] for r in ranged.groupBy("__range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * share).collect()}  # a number for each overfull range
        if not over:
            break
        again = F.pmod(F.xxhash64("__key", F.lit(f"draw {turn}")), F.lit(1 << 40)) / float(1 << 40)
        drawn = ranged.where(F.col("__range").isin(list(over)) & (again < F.col("size") * (KEYS_PER_RANGE / share))).select("__range", "__key").collect()
        more = set(found)
        for r, held in over.items():
            more.update(quantiles(sorted(x["__key"] for x in drawn if x["__range"] == r), -int(-held // share)))
        if len(more) == len(found):
            break
        found = sorted(more)
    return found


def shard_by_ranges(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into shards 0 to shards - 1 of nearly equal bytes.

    Keys are ordered by a hash of the text, then of the id: equal texts lie together. A sample drawn with probability
    in proportion to size sets fine ranges, and ranges that hold too much are subdivided by a second sample; each
    range's exact bytes are then summed, and a row's shard follows from the exact number of bytes before it. A group of
    equal texts of at most TOLERANCE of a shard, or of at most LARGEST_ROWS times the largest row, goes as one into the
    shard that its middle falls into; larger groups are cut where boundaries fall. Shards so differ by at most about
    the larger of these two bounds.

    Returns id, size (UTF-8 bytes and 16; a null text has none), text_crc32 (null counts as empty), law (``bytes``),
    shard, slot (gapless from 0 in a shard), grown_shard (null). Null texts form one group with empty ones; rows repeat
    as in the input; an empty table gives no rows; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = lambda c: F.lpad(F.hex(c), 16, "0")
    # The last part tells rows apart that are equal in all; it is drawn once, as the rows are written.
    rows = stored(docs.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(hashed(F.xxhash64(text)), hashed(F.xxhash64(F.col(id_col).cast("string"), F.lit("id"))), hashed(F.monotonically_increasing_id())).alias("__key"),
    ), "shard-keys")
    total, count, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*"), F.coalesce(F.max("size"), F.lit(0))).first()
    bound = max(TOLERANCE * total / shards, LARGEST_ROWS * largest)
    ranges = shards * max(RANGES_PER_SHARD, -(-count // (shards * RANGE_ROWS)))
    found = splitters_of(rows, ranges, total)
    cut = sorted({k[:16] for k in found if k[16:] != _START})
    if cut:  # groups of a few boundaries that are small enough are not cut after all
        small = {r["g"] for r in rows.groupBy(F.left("__key", F.lit(16)).alias("g")).agg(F.sum("size").alias("held")).where(F.col("g").isin(cut) & (F.col("held") <= bound)).collect()}
        found = sorted({k[:16] + _START if k[:16] in small else k for k in found})
        cut = [g for g in cut if g not in small]
    ranged = rows.withColumn("__range", _range_of(F.col("__key"), found)).withColumn("__group", F.left("__key", F.lit(16)))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__range").agg(F.sum("size").alias("__bytes")).select("__range", F.coalesce(F.sum("__bytes").over(before), F.lit(0)).alias("__before"))  # at most as many rows as ranges
    inside = Window.partitionBy("__range").orderBy("__group", "__key")
    same = Window.partitionBy("__range", "__group")
    placed = ranged.join(F.broadcast(sums), "__range").withColumn("__start", F.col("__before") + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("__first", F.min("__start").over(same)).withColumn("__held", F.sum("size").over(same))
    whole = (F.col("__held") <= bound) & ~(F.array_contains(F.split(F.lit(",".join(cut)), ","), F.col("__group")) if cut else F.lit(False))
    middle = F.when(whole, F.col("__first") + F.col("__held") / 2.0).otherwise(F.col("__start") + F.col("size") / 2.0)
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / max(1, total))).cast("int"))
    placed = stored(placed.withColumn("__nth", F.row_number().over(Window.partitionBy("__range", "shard").orderBy("__key"))).select("__id", "size", "text_crc32", "shard", "__range", "__nth"), "shard-placed")
    pieces = placed.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
    pieces = pieces.select("shard", "__range", F.coalesce(F.sum("__n").over(Window.partitionBy("shard").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    # A shard has at most as many pieces as there are ranges, and all shards together ranges + shards.
    return placed.join(F.broadcast(pieces), ["shard", "__range"]).select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
