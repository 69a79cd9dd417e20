"""Whitening of vectors by a bit-sliced scatter: exact integer cross-products from AND and popcount over bit planes.

Rows are fixed-point numbers. Each dimension is shifted to start at 0, its bit planes are packed across rows into 64-bit
words, and a cross-product is the sum of 2 ** (a + b) times the popcount of plane a of one dimension and plane b of
the other. Sums are centred as integers; only the centred matrix becomes doubles, for eigh.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Steps in a unit, and components returned.
STEPS, COMPONENTS = 256, 4
#: Rows whose bit planes are held at once, and words that one AND makes.
ROWS, AT_ONCE = 8192, 1 << 20
#: Directions of less variance than this share of the whole have no whitened value.
NOTHING = 1e-13
MOST_LONG = 2**63 - 1


@dataclass
class Whitening:
    n: int
    sums: list[int]
    directions: np.ndarray  # components x dimensions, unit vectors
    values: np.ndarray  # their eigenvalues
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values, rows x components; not a number where a direction has no variance. x - S / n is taken in whole numbers first."""
        s = np.array(self.sums, object)
        base = np.array([v // self.n for v in self.sums], object)
        part = np.array([float(a - b * self.n) / self.n for a, b in zip(s, base)])
        whole = _wide(x, base)
        with np.errstate(invalid="ignore", divide="ignore"):
            return (whole - part) @ self.directions.T / np.where(self.values > 0, np.sqrt(np.abs(self.values)), np.nan)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The exact sum of (n * x - S) ** 2 over the dimensions."""
        top = max(self.n * max(1, abs(int(x.min())), abs(int(x.max()))), *map(abs, self.sums)) * 2
        if top * top * max(1, x.shape[1]) < 2**62:
            return ((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1).tolist()
        return ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1).tolist()


def _wide(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """x - base as doubles, from whole numbers."""
    if max(map(abs, base), default=0) < 2**61 and np.abs(x.astype(np.float64)).max(initial=0) < 2.0**61:
        return (x - base.astype(np.int64)).astype(np.float64)
    return (x.astype(object) - base).astype(np.float64)


def fixed_point(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x): floor(256 * c) of each entry, as longs. Null vectors and those with null or non-finite entries are dropped, and so are empty ones and those not of the most frequent length (of equal ones the larger)."""
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where("v is not null and size(v) > 0")
    good = good.where(~F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))))
    usual = good.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    return good.where(F.size("v") == (usual["d"] if usual else 0)).select("id", F.transform("v", lambda e: F.floor(e * STEPS)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def planes(shifted: np.ndarray, bits: int) -> np.ndarray:
    """bits x dimensions x words: bit planes of rows of unsigned numbers, packed across the rows."""
    rows, dims = shifted.shape
    padded = np.zeros((dims, -(-rows // 64) * 64), np.uint64)
    padded[:, :rows] = shifted.T
    return np.stack([np.packbits(((padded >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), axis=1).view(np.uint64) for b in range(bits)])


def scatter(shifted: np.ndarray, bits: int) -> np.ndarray:
    """(2 * bits - 1) x dimensions x dimensions counts: weigh the k-th by 2 ** k and add up for the cross-products."""
    p = planes(shifted, bits)
    dims, words = p.shape[1:]
    out = np.zeros((max(1, 2 * bits - 1), dims, dims), np.int64)
    step = max(1, AT_ONCE // max(1, dims * words))
    for a in range(bits):
        for b in range(a, bits):
            for lo in range(0, dims, step):
                met = np.bitwise_count(p[a, lo : lo + step, None, :] & p[b, None, :, :]).sum(axis=2, dtype=np.int64)
                out[a + b, lo : lo + step] += met
                if a != b:
                    out[a + b, :, lo : lo + step] += met.T
    return out


def _sums(distinct: DataFrame) -> list[tuple[int, int, int, int]]:
    """(n, least, largest, sum) of each dimension: as many rows reach the driver as there are dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high, total = 0, None, None, None
        for b in batches:
            x = _matrix(b.column(0))
            if not len(x):
                continue
            halves = [int(u) + (int(o) << 32) for u, o in zip((x & 0xFFFFFFFF).sum(axis=0), (x >> 32).sum(axis=0))]
            n += len(x)
            low = x.min(axis=0) if low is None else np.minimum(low, x.min(axis=0))
            high = x.max(axis=0) if high is None else np.maximum(high, x.max(axis=0))
            total = halves if total is None else [p + q for p, q in zip(total, halves)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(low)), pa.int32()), pa.array([n] * len(low)), pa.array(low), pa.array(high), pa.array(total, pa.decimal128(38))], names=["d", "n", "low", "high", "s"])

    by = distinct.select("x").mapInArrow(run, "d int, n long, low long, high long, s decimal(38,0)").groupBy("d").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("s").alias("s"))
    return [(r["n"], r["low"], r["high"], int(r["s"])) for r in by.orderBy("d").collect()]


def cross_products(distinct: DataFrame, low: list[int], bits: int) -> DataFrame:
    """(i, j, k, n): for each pair of dimensions the counts that are weighed by 2 ** k. A task sends one set, whatever its rows."""
    shared = distinct.sparkSession.sparkContext.broadcast(np.array(low, np.int64))  # one number for each dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            whole = _matrix(b.column(0))
            for at in range(0, len(whole), ROWS):
                x = whole[at : at + ROWS]
                got = scatter(x.view(np.uint64) - shared.value.view(np.uint64), bits)  # modulo 2 ** 64: exact, as differences are below it
                out = got if out is None else out + got
        if out is not None:
            for k in range(len(out)):
                i, j = np.nonzero(np.triu(out[k]))
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(np.full(len(i), k), pa.int32()), pa.array(out[k][i, j])], names=["i", "j", "k", "n"])

    return distinct.select("x").mapInArrow(run, "i int, j int, k int, n long").groupBy("i", "j", "k").agg(F.sum("n").alias("n"))


def learn(distinct: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The first components of the different vectors (x), or None without any. What is solved in one task is as large as dimensions x dimensions."""
    told = _sums(distinct)
    if not told:
        return None
    n, sums, low = told[0][0], [t[3] for t in told], [t[1] for t in told]
    bits = max(1, max(t[2] - t[1] for t in told).bit_length())
    shifted_sums, dims = [s - n * x for s, x in zip(sums, low)], len(sums)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross = np.zeros((dims, dims), object)
        for b in batches:
            for i, j, k, c in zip(*[b.column(x).to_pylist() for x in range(4)]):
                cross[i, j] += c << k
        centred = np.array([[(n * cross[min(i, j), max(i, j)] - shifted_sums[i] * shifted_sums[j]) / (n * n) for j in range(dims)] for i in range(dims)], np.float64)  # whole numbers up to the division
        value, vector = np.linalg.eigh(centred)
        trace = float(np.trace(centred))
        for c in range(min(components, dims)):
            e = float(value[-1 - c]) if trace > 0 and value[-1 - c] > trace * NOTHING else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([e]), pa.array([e / trace if trace > 0 else 0.0]), pa.array([vector[:, -1 - c].tolist()], pa.list_(pa.float64()))], names=["c", "e", "explained", "v"])

    nothing = distinct.sparkSession.range(1).selectExpr("0 as i", "0 as j", "0 as k", "0L as n")  # equal vectors alone have no counts
    got = sorted(cross_products(distinct, low, bits).unionByName(nothing).repartition(1).mapInArrow(solve, "c int, e double, explained double, v array<double>").collect(), key=lambda r: r["c"])  # components x dimensions
    return Whitening(n, sums, np.array([r["v"] for r in got]), np.array([r["e"] for r in got]), np.array([r["explained"] for r in got]))


def identity_error(distinct: DataFrame, fitted: Whitening) -> float:
    """How far the covariance of the whitened fit rows is from the identity, at most: measured on the rows, over directions with variance."""
    shared = distinct.sparkSession.sparkContext.broadcast(fitted)  # components x dimensions
    used = int((fitted.values > 0).sum())
    if not used:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(used), np.zeros((used, used))
        for b in batches:
            if not b.num_rows:
                continue
            w = shared.value.project(_matrix(b.column(0)))[:, :used]
            first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([*[f"{i}" for i in range(used)], *[f"{i},{j}" for i in range(used) for j in range(used)]]), pa.array([*first, *second.ravel()])], names=["k", "s"])

    s = {r["k"]: r["s"] / fitted.n for r in distinct.select("x").mapInArrow(run, "k string, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}  # components x components
    return max(abs(s[f"{i},{j}"] - s[f"{i}"] * s[f"{j}"] - (i == j)) for i in range(used) for j in range(used))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): each usable vector in the directions of most variance.

    Covariances are over each different fixed-point vector once. Directions come in falling order of variance, fewer
    than components if there are fewer dimensions; one without variance has a null whitened value and explains 0.
    Null vectors and those with null, non-finite or missing entries, or not of the usual length, have no rows; rows
    that repeat, or repeat an id, stay so; zero vectors count as any other; entries beyond 2 ** 63 / 256 saturate; a
    deviation beyond a long is null; an empty table gives no rows; other columns are not looked at.
    """
    rows = fixed_point(vectors, id_col, vector_col)
    distinct = stored(rows.select("x").distinct(), "fixed-point")
    fitted = learn(distinct, components)
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fitted is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(distinct, fitted)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)  # components x dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        k = len(f.values)
        for b in batches:
            x = _matrix(b.column(1))
            m = len(x)
            if not m:
                continue
            deviation = [d if d <= MOST_LONG else None for d in f.deviation(x)]
            w = f.project(x).ravel()
            which = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(which), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n)), pa.array(deviation, pa.int64()).take(which), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(f.explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
