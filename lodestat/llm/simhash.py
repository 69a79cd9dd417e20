"""SimHash near-duplicates: fingerprints split into blocks so that close pairs share some, joined on blocks, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, slices, stored

#: Fingerprints link at this many differing bits or fewer.
DISTANCE = 2
#: 64 bits in BLOCKS blocks: DISTANCE bits spoil at most DISTANCE blocks, so that BLOCKS - DISTANCE of them agree, and a key is made of so many.
BLOCKS = 4
#: A key shared by more fingerprints than this is not paired off; there a link is found by a common neighbour.
PAIRED = 48
#: A key of more fingerprints than CROWDED is dealt to SALTS places where its rows are joined with its count; at most BROADCAST_KEYS such keys are broadcast.
CROWDED, SALTS, BROADCAST_KEYS = 100_000, 64, 1_000_000
SHINGLE = 3
SEED = 42
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None) -> int:
    """Bit b is 1 if it is set in over half of the XXH64 hashes of the word shingles, repeats included; no words: 0."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()  # bytes split at exactly the contracts' white space
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= SHINGLE:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    starts = np.zeros(n, np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    ends = (starts + sizes)[SHINGLE - 1 :].tolist()
    total, m = np.zeros(64, np.int64), len(ends)
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends, strict=False)), np.uint64, m)
    for at in range(0, m, 1 << 14):  # bounded memory for any text
        some = hashes[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(some, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > m).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: Column) -> DataFrame:
    """(id, fp) and more: fp is the fingerprint as a signed long."""
    chosen = docs.select(F.col(text_col).alias("t"), F.col(id_col).alias("id"), *[c.alias(k) for k, c in more.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = np.array([fingerprint(t) for t in b.column(0).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(got, pa.int64())], names=[*b.schema.names[1:], "fp"])

    return chosen.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[1:]) + ", fp long")


def _key_masks() -> list[int]:
    """The bits of each key, as signed longs: every choice of BLOCKS - DISTANCE blocks."""
    width = 64 // BLOCKS
    masks = [sum(((1 << width) - 1) << (width * b) for b in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - DISTANCE)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all within DISTANCE of each other.

    A key that few fingerprints share yields its verified pairs. Of a crowded key no pairs are made: each of its
    fingerprints names itself and all that differ from it in one of the bits outside the key, and those that name the
    same are linked to the smallest of them. Two bits apart means one name in common, so this loses no link, links
    none that are further apart, and stays linear in the group.
    """
    masks = F.array(*[F.lit(m) for m in _key_masks()])
    keyed = stored(distinct.select("fp", F.explode(masks).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")).transform(_with_sharers), "simhash-keys")
    few = keyed.where((F.col("n") > 1) & (F.col("n") <= PAIRED))
    pairs = few.groupBy("mask", "key").agg(F.sort_array(F.collect_list("fp")).alias("all"))
    pairs = pairs.select(F.explode("all").alias("a"), "all").select("a", F.explode(F.filter("all", lambda x: (x > F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= DISTANCE))).alias("b"))
    bits = F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i) for i in range(64)])
    named = keyed.where(F.col("n") > PAIRED).select("fp", "mask", F.explode(F.filter(bits, lambda bit: bit.bitwiseAND(F.col("mask")) == 0)).alias("bit"))
    named = named.select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("name")).distinct()
    least = named.groupBy("name").agg(F.min("fp").alias("a"), F.count("*").alias("m")).where("m > 1")
    stars = named.join(least, "name").where("fp != a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars).distinct()


def _with_sharers(keyed: DataFrame) -> DataFrame:
    """How many fingerprints share each key, for keys of more than one.

    Counts are summed before the shuffle. The join back deals every key to SALTS places, and keys of over CROWDED
    fingerprints to all of them, so that no place gets more than a share of a key's rows.
    """
    counts = stored(keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sharers")
    crowded = counts.where(F.col("n") > CROWDED).select("mask", "key", F.lit(1).alias("hot"))  # a row for each CROWDED fingerprints and key mask at most
    if crowded.isEmpty():
        return keyed.join(counts, ["mask", "key"])
    near = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    marked = keyed.join(near, ["mask", "key"], "left").withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).otherwise(-1)).drop("hot")
    places = F.when(F.col("n") > CROWDED, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    return marked.join(counts.withColumn("salt", F.explode(places)), ["mask", "key", "salt"]).drop("salt")


def joined_back(rows: DataFrame, key: str, table: DataFrame, often: str, other: str) -> DataFrame:
    """Join a table that has one row for each key, and in often how many rows share it, to the rows.

    Keys of over CROWDED rows are dealt to SALTS places by the column other, and their row of the table to all of them.
    """
    crowded = table.where(F.col(often) > CROWDED).select(key, F.lit(1).alias("hot"))  # a row for each CROWDED rows at most
    if crowded.isEmpty():
        return rows.join(table, key)
    near = F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded
    marked = rows.join(near, key, "left").withColumn("salt", F.when(F.col("hot") == 1, F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int")).otherwise(-1)).drop("hot")
    places = F.when(F.col(often) > CROWDED, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))
    return marked.join(table.withColumn("salt", F.explode(places)), [key, "salt"]).drop("salt")


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable along undirected edges, for every node of an edge.

    Alternating stars: each node links its larger neighbours, then its smaller ones, to the smallest; every round is a
    shuffle of at most as many rows as there are links, written to shared storage, and the rounds grow with the
    logarithm of the longest chain.
    """
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links")
    held = e.count()
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        met = joined_back(both, "u", stored(least, "hubs"), "n", "v") if held > CROWDED else both.join(least, "u")  # a hub has at most all links
        large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        new = stored(small, "links")
        before, after = (x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (e, new))
        e, held = new, after[0]
        if before == after:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components have not settled in {most_rounds} rounds")


def _rooted(distinct: DataFrame) -> DataFrame:
    """distinct (fp and more) with root, the smallest fingerprint of each one's group."""
    roots = components(links(distinct.select("fp")))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select(*[distinct[c] for c in distinct.columns], F.coalesce("root", distinct["fp"]).alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: id, fingerprint (16 hex digits), component_id (the smallest id reachable, itself included).

    Texts without words (null, empty, blanks) have fingerprint zero and are linked like any other; a null id is no
    smallest id unless its group has no other; rows repeat as in the input; an empty table gives no rows; other columns
    are not looked at. Copies collapse to one fingerprint before anything is joined.
    """
    found = stored(fingerprints(docs, id_col, text_col), "simhash")
    distinct = stored(found.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "simhash-distinct")
    member = stored(_rooted(distinct), "simhash-rooted")
    first = member.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    by_fp = joined_back(member, "root", first, "m", "fp").select("fp", "component_id", "n")
    return joined_back(found, "fp", by_fp, "n", "id").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id, null last, and of rows of one id that of the smallest digest of its text.

    Rows equal in id and text are told apart by nothing that matters, one of them stays. Null, empty and blank texts
    are one group; an empty table gives no rows; all columns stay, whatever their names.
    """
    names = docs.columns
    digests = {"k1": F.xxhash64(text_col), "k2": F.xxhash64(F.lit("second"), F.col(text_col))}
    found = stored(fingerprints(docs, id_col, text_col, **digests), "simhash")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("best")
    member = _rooted(stored(found.groupBy("fp").agg(best), "simhash-distinct"))
    kept = stored(member.groupBy("root").agg(F.min("best").alias("best")).select("best.id", "best.k1", "best.k2"), "simhash-kept")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["k1"] == b["k1"]) & (a["k2"] == b["k2"])
    often = stored(found.join(kept, same(found, kept), "left_semi").groupBy("id", "k1", "k2").agg(F.count("*").alias("n")).where("n > 1"), "simhash-repeated")
    keyed = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), *[c.alias(k) for k, c in digests.items()])
    if often.isEmpty():
        rows = keyed.join(kept, same(keyed, kept), "left_semi")
    else:
        once = kept.join(often, same(kept, often), "left_anti")
        repeated = keyed.join(often, same(keyed, often), "left_semi").dropDuplicates(["id", "k1", "k2"])
        rows = keyed.join(once, same(keyed, once), "left_semi").unionByName(repeated)
    return rows.select("row").select(*[F.col("row").getField(c).alias(c) for c in names])
