"""Packing by cutting stock: a linear program over length-histogram patterns, priced by a knapsack, rounded, dealt to ranked pieces."""

from __future__ import annotations

import json
import warnings
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ARROW_ROWS, local_rows, slices, stored

CAPACITY = 1024
#: How far from the linear program's optimum its solution may be.
GAP = 1e-3
#: Steps of the simplex after which its inverse is computed afresh, and steps for each class after which the solution is taken as it is, with a warning that names its gap.
REFRESH, TURNS = 200, 10
#: The program is also left once so many steps in a row have together saved under GAP of the sequences.
STALLED = 100
#: The share of the best bound's prices in those that a pattern is looked for with.
HELD = 0.8
#: The id that ends a document, and the text that the tokenizer reads as one special token.
END_ID, SPECIAL = 0, "<|endoftext|>"
#: Pieces of a length are ranked in buckets of about so many rows; a table of at most so many buckets (some 30 bytes each) is broadcast, a larger one joined by shuffle.
BUCKET_ROWS, BROADCAST_BUCKETS = 20_000, 1_000_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens:
    """The ids that the tokenizers file gives. Its ranks file, where there is one beside it, gives the same ids several times faster."""

    def __init__(self, path: str):
        import base64
        import os

        self.path, self.slow, self.fast = path, None, None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or SPECIAL in text:
            if self.slow is None:  # few texts need it, and a worker's memory is short
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's ids and the end id, cut after every capacity ids."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokens(tokenizer)
        for b in slices(batches):
            at, start, length, crc, total = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                ids = np.array([*encode(t or ""), END_ID], "<u4")
                raw = memoryview(ids.tobytes())
                for s in range(0, len(ids), capacity):
                    n = min(capacity, len(ids) - s)
                    at.append(i), start.append(s), length.append(n), crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)])), total.append(len(ids))
            long = [pa.array(x, pa.int64()) for x in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *long], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    return chosen.mapInArrow(run, f"id {chosen.schema['id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def _knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how often each size is taken within room."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for w in range(int(sizes[0]), room + 1):
        n = fits[w]
        v = best[w - sizes[:n]] + values[:n]
        i = int(v.argmax())
        if v[i] > best[w - 1]:
            best[w], took[w] = v[i], i
        else:
            best[w] = best[w - 1]
    pattern, w = np.zeros(len(sizes), np.int64), room
    while w > 0:
        if took[w] < 0:
            w -= 1
        else:
            pattern[took[w]] += 1
            w -= int(sizes[took[w]])
    return float(best[room]), pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchanges, in element-wise steps: a threaded BLAS may block in a process that has started a JVM."""
    m = len(a)
    both = np.hstack([a.astype(float), np.eye(m)])
    for i in range(m):
        j = i + int(np.abs(both[i:, i]).argmax())
        if abs(both[j, i]) < 1e-12:
            raise ArithmeticError("the basis is singular")
        both[[i, j]] = both[[j, i]]
        both[i] /= both[i, i]
        rows = np.flatnonzero(both[:, i])
        rows = rows[rows != i]
        both[rows] -= both[rows, i][:, None] * both[i]
    return both[:, m:]


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a times x over the columns where x is not zero, without BLAS."""
    at = np.flatnonzero(x)
    return (a[:, at] * x[at]).sum(axis=1)


def _largest_first(sizes: np.ndarray, need: np.ndarray, room: int) -> np.ndarray:
    """A pattern (column) for each size: fill largest first with sizes still needed, use that until one of them is met, and so on."""
    left, open_sizes, out = need.copy(), np.ones(len(sizes), bool), np.zeros((len(sizes), len(sizes)), np.int64)
    for _ in sizes:
        pattern, free = np.zeros(len(sizes), np.int64), room
        while (fits := np.flatnonzero(open_sizes & (sizes <= free))).size:
            i = fits[-1]
            pattern[i] = free // sizes[i]
            free -= int(pattern[i] * sizes[i])
        inside = np.flatnonzero(pattern)
        often = left[inside] / pattern[inside]
        met = inside[int(often.argmin())]
        left = np.maximum(left - often.min() * pattern, 0.0)
        out[:, met], open_sizes[met] = pattern, False
    return out


def cutting_stock(demand: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (how many of each size fit into room) and how often to use each, so that they hold at least the demand.

    Column generation: simplex over the patterns found so far, a knapsack at the dual prices finds the next one, until
    none can save more than GAP of the sequences, or one, or STALLED steps have saved no more. The solution is rounded down; what then is left, a few pieces for each pattern, is filled in largest
    first.
    """
    sizes = np.array(sorted(s for s, n in demand.items() if n > 0), np.int64)
    need = np.array([demand[s] for s in sizes.tolist()], float)
    m = len(sizes)
    if not m:
        return []
    exact = need + np.linspace(1, 2, m) * 1e-3  # slightly off the numbers, lest steps of length zero go round in circles
    patterns, cost = _largest_first(sizes, exact, room), np.ones(m)  # the basis: columns that are patterns, or (at no cost) room left over for a size
    centre = sizes / room  # prices that no pattern beats; what they make of the demand is the first bound
    least, fresh, total, was = float((need * centre).sum()), 0, 0.0, np.inf
    for turn in range(TURNS * m + 1):
        if turn >= fresh:
            inverse = _inverse(patterns)
            x, fresh = _times(inverse, exact), turn + REFRESH
        prices, total = _times(inverse.T, cost), float((cost * x).sum())
        if total - least <= max(GAP * total, 1.0):
            break
        if turn % STALLED == 0:
            if was - total < GAP * total:
                warnings.warn(f"the linear program has stalled at most {total - least:.1f} of {total:.1f} sequences from its optimum, more than asked for", stacklevel=2)
                break
            was = total
        for held in (HELD, 0.0):  # prices held near those of the best bound so far swing less, so that fewer patterns are needed
            asked = held * centre + (1 - held) * np.maximum(prices, 0)
            worth, new = _knapsack(sizes, asked, room)
            bound = float((need * asked).sum()) / max(worth, 1.0)
            if bound > least:
                least, centre = bound, asked / max(worth, 1.0)
            if (prices * new).sum() > 1 + 1e-7:
                price = 1.0
                break
        else:
            if prices.min() >= -1e-7:
                break  # no pattern can save anything
            c = int(prices.argmin())
            new, price = np.where(np.arange(m) == c, -1, 0), 0.0
        d = _times(inverse, new)
        ratio = np.where(d > 1e-7, x / np.where(d > 1e-7, d, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            fresh = turn + 1  # rounding errors alone can make a program unbounded whose patterns all hold something
            continue
        x = x - ratio[out] * d
        x[out] = ratio[out]
        patterns[:, out], cost[out] = new, price
        pivot, rows = inverse[out] / d[out], np.flatnonzero(d)
        inverse[rows] -= d[rows, None] * pivot
        inverse[out] = pivot
    else:
        warnings.warn(f"after {TURNS * m} steps the linear program is at most {total - least:.1f} of {total:.1f} sequences from its optimum, more than asked for", stacklevel=2)
    times = np.where(cost > 0, np.floor(np.maximum(x, 0) + 1e-6), 0).astype(np.int64)
    left = np.maximum(need.astype(np.int64) - (patterns * times).sum(axis=1), 0)
    found = [({int(s): int(a) for s, a in zip(sizes, patterns[:, p], strict=True) if a}, int(times[p])) for p in range(m) if times[p]]
    while left.any():  # the largest sizes that fit, as often as there are enough of them
        free, pattern = room, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            pattern[i] = min(int(left[i]), free // int(sizes[i]))
            free -= int(pattern[i] * sizes[i])
        often = int((left[pattern > 0] // pattern[pattern > 0]).min())
        left = left - often * pattern
        found.append(({int(s): int(a) for s, a in zip(sizes, pattern, strict=True) if a}, often))
    return found


def pack(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A sequence holds at most capacity tokens; offsets in it are gapless. The driver sees the histogram of lengths
    (capacity numbers) and packs it by the patterns of cutting_stock; pieces of a length, ranked by hash, take the
    patterns' slots in turn. Null and empty texts are one end id; texts of any length are cut into pieces; equal rows
    stay separate; an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer or default_tokenizer(), id_col, text_col, capacity).withColumn("nr", F.monotonically_increasing_id()), "pieces", arrow_rows=ARROW_ROWS)  # a number for each piece, once it is written, tells equal rows apart
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most capacity lengths
    slots, first, at = [], 0, dict.fromkeys(histogram, 0)
    for pattern, times in cutting_stock(histogram, capacity):
        for c, a in pattern.items():
            slots.append({"length": c, "lo": at[c], "hi": at[c] + a * times, "each": a, "first": first})
            at[c] += a * times
        first += times
    plan = local_rows(spark, json.dumps(slots), "length long, lo long, hi long, each long, first long")  # a few rows for each length
    buckets = [max(1, -(-histogram.get(n, 0) // BUCKET_ROWS)) for n in range(capacity + 1)]
    near = (lambda df: F.broadcast(df)) if sum(buckets) <= BROADCAST_BUCKETS else (lambda df: df)
    shares = F.split(F.lit(",".join(map(str, buckets))), ",")
    dealt = cut.withColumn("h", F.xxhash64(F.col("id").cast("string"), "start", "ids_crc32"))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("h", "nr"), F.get(shares, F.col("length").cast("int")).cast("long")))
    ranked = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("h", "id", "start", "doc_tokens", "nr")))
    before = dealt.groupBy("length", "bucket").count()
    before = before.select("length", "bucket", (F.sum("count").over(Window.partitionBy("length").orderBy("bucket")) - F.col("count")).alias("earlier"))
    seated = ranked.join(near(before), ["length", "bucket"]).withColumn("rank", F.col("earlier") + F.col("nth") - 1)
    seated = seated.join(F.broadcast(plan), "length").where("rank >= lo and rank < hi").withColumn("sequence_id", (F.col("first") + F.floor((F.col("rank") - F.col("lo")) / F.col("each"))).cast("long"))
    inside = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "rank").rowsBetween(Window.unboundedPreceding, 0)
    return seated.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", (F.sum("length").over(inside) - F.col("length")).alias("offset"))
