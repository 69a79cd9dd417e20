"""Nearest neighbours by additive quantisation: beam-searched codes over full-dimensional residual codebooks, table lookups, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

STAGES, WORDS, BEAM = 12, 256, 4
#: The codebooks are fitted on at most so many vectors, those of smallest hash.
SAMPLE, ROUNDS = 20_000, 8
#: Rows scored at once; of each such block the best by code are reranked exactly.
ROWS, RERANKED = 8192, 160
#: Queries of a block, and pairs of blocks that a worker gets at once (some 5 MB each).
QUERIES, PAIRS = 512, 8


@dataclass
class Codebooks:
    words: np.ndarray  # stages x words x dimensions

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes (rows x stages): at each stage the BEAM best partial sums of every row go on."""
        n, books = len(x), self.words
        norms = (books**2).sum(axis=2)
        rest, codes, lost = x[:, None, :], np.zeros((n, 1, 0), np.uint8), (x**2).sum(axis=1)[:, None]
        for m in range(len(books)):
            d = lost[:, :, None] - 2 * (rest @ books[m].T) + norms[m]
            flat = d.reshape(n, -1)
            k = min(BEAM, flat.shape[1])
            best = np.argpartition(flat, k - 1, axis=1)[:, :k]
            beam, word = best // books.shape[1], best % books.shape[1]
            lost = np.take_along_axis(flat, best, axis=1)
            rest = np.take_along_axis(rest, beam[:, :, None], axis=1) - books[m][word]
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        return codes[np.arange(n), lost.argmin(axis=1)]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(len(self.words)))


def fit(x: np.ndarray, seed: int = 7) -> Codebooks:
    """Codebooks for residuals: k-means on what the stages before have left."""
    rng, rest, books = np.random.default_rng(seed), x.astype(np.float32), []
    k = min(WORDS, len(x))
    for _ in range(STAGES):
        c = rest[rng.choice(len(rest), k, replace=False)].copy()
        for _ in range(ROUNDS):
            own = np.argmin((c**2).sum(axis=1) - 2 * (rest @ c.T), axis=1)
            order = np.argsort(own, kind="stable")
            at, first = np.unique(own[order], return_index=True)
            c[at] = np.add.reduceat(rest[order], first, axis=0) / np.diff(np.append(first, len(own)))[:, None]
        books.append(c)
        rest = rest - c[np.argmin((c**2).sum(axis=1) - 2 * (rest @ c.T), axis=1)]
    return Codebooks(np.stack(books).astype(np.float32))


def _vectors(b: pa.RecordBatch, name: str) -> np.ndarray:
    v = b.column(b.schema.get_field_index(name))
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of about so many."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): vectors as doubles, without null, zero, ragged, or non-finite ones. The most frequent length sets the number of dimensions, of equal ones the larger."""
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    good = good.where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists("v", lambda e: e != 0))
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return good.where(F.size("v") == (usual["d"] if usual else 0))


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and norms, whatever the size of the numbers."""
    top = np.abs(x).max(axis=1)
    small = x / top[:, None]
    size = np.sqrt((small**2).sum(axis=1))
    return (small / size[:, None]).astype(np.float32), size * top


def learn(good: DataFrame) -> Codebooks | None:
    """Codebooks for the directions of at most SAMPLE usable vectors, those of smallest hash. They are fitted in one task: its linear algebra has one thread, which in a driver beside a JVM may block."""
    n = good.count()
    if not n:
        return None
    thin = good.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < min(1.0, 1.3 * SAMPLE / n) * (1 << 30))
    thin = thin if not thin.isEmpty() else good
    sample = thin.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(SAMPLE).coalesce(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_vectors(b, "v") for b in batches]
        if held:
            words = fit(_directions(np.concatenate(held))[0]).words
            yield pa.RecordBatch.from_arrays([pa.array([list(words.shape)], pa.list_(pa.int64())), pa.array([words.tobytes()], pa.binary())], names=["shape", "words"])

    got = sample.mapInArrow(run, "shape array<long>, words binary").first()  # STAGES * WORDS vectors
    return Codebooks(np.frombuffer(got["words"], np.float32).reshape(got["shape"]))


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, Codebooks | None]:
    """Every usable vector with its codes and its norm over its code's norm, as a table in shared storage; and the codebooks."""
    good = usable(vectors, id_col, vector_col)
    books = learn(good)
    if books is None:
        return good.selectExpr("id", "v", "cast(null as binary) code", "0D ratio"), None
    shared = good.sparkSession.sparkContext.broadcast(books)  # STAGES * WORDS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, 2048):
            x, norm = _directions(_vectors(b, "v"))
            codes = shared.value.encode(x)
            size = np.sqrt((shared.value.decode(codes).astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(norm / np.where(size > 0, size, 1))], names=["id", "v", "code", "ratio"])

    return stored(good.mapInArrow(run, f"id {good.schema['id'].dataType.simpleString()}, v array<double>, code binary, ratio double"), "quantised"), books


def _first_copies(x: np.ndarray, most: int) -> np.ndarray:
    """The rows, in their order, without those that at least most earlier rows equal: ties go to the first, so that no more can be among a query's nearest."""
    _, which = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(which, kind="stable")
    starts = np.flatnonzero(np.diff(which[order], prepend=-1))
    nth = np.empty(len(x), np.int64)
    nth[order] = np.arange(len(x)) - np.repeat(starts, np.diff(np.append(starts, len(x))))
    return np.flatnonzero(nth < most)


def _packed(table: DataFrame, rows: int, name: str, most: int = 1 << 62) -> DataFrame:
    """One row for each block of at most so many vectors: block, and ids, vectors, codes and ratios as bytes. Of equal vectors in a block the most of smallest id stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made = TaskContext.get().partitionId() << 32
        for whole in _blocks(batches, rows):
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                ids = b.column(0).to_numpy().astype(np.int64)
                order = np.argsort(ids, kind="stable")
                order = order[_first_copies(_vectors(b, "v")[order], most)]
                codes = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(len(ids), -1)[order]
                parts = (ids[order], _vectors(b, "v")[order], codes, b.column(3).to_numpy()[order])
                yield pa.RecordBatch.from_arrays([pa.array([made]), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=["block", "ids", "v", "codes", "ratio"])
                made += 1

    return stored(table.mapInArrow(run, "block long, ids binary, v binary, codes binary, ratio binary"), name)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors of largest inner product for each vector whose id is divisible by every.

    Every usable row is indexed and scored by code for every query: blocks of rows meet blocks of queries, and Spark
    broadcasts the queries' blocks only while they are under its own limit. In each block of ROWS rows the RERANKED best
    by code (of equal ones those of smaller id) get exact products, and the best of all blocks are kept. Null, zero, ragged
    and non-finite vectors take no part; a query's own id is no candidate; rows that repeat an id are one query (the
    least vector's) and as many candidates; an empty table gives no rows; other columns are not looked at. Of vectors
    that equal each other in a block, those that cannot be among a query's k are left out before the search, so that
    copies don't take up the places that are reranked.
    """
    table, books = index(vectors, id_col, vector_col)
    spark = table.sparkSession
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = table.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min(F.struct("v", "code", "ratio")).alias("x")).select("id", "x.v", "x.code", "x.ratio")
    queries = _packed(asked, QUERIES, "query-blocks").select(F.col("block").alias("asked"), F.col("ids").alias("query_ids"), F.col("v").alias("query_v"))
    met = _packed(table, ROWS, "row-blocks", k + 1).crossJoin(queries)  # a stated query set against all rows, in blocks
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, PAIRS)
    try:
        found = stored(_answers(met, books, k), "neighbours")
    finally:
        spark.conf.set(limit, before)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _answers(met: DataFrame, books: Codebooks, k: int) -> DataFrame:
    """Each task's k best for each query that it meets."""
    shared = met.sparkSession.sparkContext.broadcast(books)  # STAGES * WORDS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = shared.value.words, {}
        dims = words.shape[2]
        for b in batches:
            for r in b.to_pylist():
                ids, own = np.frombuffer(r["query_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, x = np.frombuffer(r["query_v"]).reshape(-1, dims), np.frombuffer(r["v"]).reshape(-1, dims)
                codes, ratio = np.frombuffer(r["codes"], np.uint8).reshape(len(own), -1).T.astype(np.intp), np.frombuffer(r["ratio"])
                if r["asked"] not in seen:
                    seen[r["asked"]] = ids, np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)
                _scan(q, ids, x, own, codes, ratio, words, *seen[r["asked"]][1:])
        for ids, best, score in seen.values():
            real = best < np.iinfo(np.int64).max
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(best[real]), pa.array(score[real])], names=["query_id", "vec_id", "score"])

    return met.mapInArrow(run, "query_id long, vec_id long, score double")


def _scan(q: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, codes: np.ndarray, ratio: np.ndarray, words: np.ndarray, best: np.ndarray, score: np.ndarray) -> None:
    """Score a block of rows (sorted by id) for a block of queries by table lookups, rerank the nearest, and keep the best in best and score."""
    k, r = best.shape[1], min(RERANKED + 1, len(own))
    tables = np.einsum("mwd,qd->mwq", words, _directions(q)[0], optimize=True)  # a query's own length changes no order
    for lo in range(0, len(q), 64):
        part = np.ascontiguousarray(tables[:, :, lo : lo + 64])
        near = part[0].take(codes[0], axis=0)
        for m in range(1, len(codes)):
            near += part[m].take(codes[m], axis=0)
        near = np.ascontiguousarray((near * ratio[:, None]).T)  # doubles: lengths may differ by any factor
        limit = np.partition(near, len(own) - r, axis=1)[:, len(own) - r]
        for i in range(len(near)):
            over, even = np.flatnonzero(near[i] > limit[i]), np.flatnonzero(near[i] == limit[i])
            c = np.concatenate([over, even[: r - len(over)]])
            c = c[own[c] != ids[lo + i]]
            s = np.append(score[lo + i], (x[c] * q[lo + i]).sum(axis=1))
            n = np.append(best[lo + i], own[c])
            top = np.lexsort((n, -s))[:k]
            score[lo + i], best[lo + i] = s[top], n[top]
