"""Boosted trees: grown side by side, level by level or leaf by leaf, with monotone signs, labels, samples and early stops.

Rows are kept as blocks of distinct patterns of bins and label, so that margins and gradients are worked out once for all
rows of a pattern. One pass over the blocks serves all models that are being grown: tasks sum gradients by (model, node,
feature, bin), the sums meet task by task, and the driver, which sees as many numbers as there are such keys, picks the splits. Of two
siblings the one with fewer rows is summed; the other is the parent without it. Gradients are whole numbers of 2 ** -26,
so that sums do not depend on their order: reruns and tasks that run again give the same trees.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import inf, log
from random import Random

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clean import sigmoid
from ..sources.scratch import stored
from .loss import spearman
from .rank import min_rank_descending
from .stability import exact_quantiles
from .trees import Flat, Forest, Node, flatten

__all__ = ["Boosted", "Fold", "Growth", "Node", "additivity", "compare_importance", "fit", "grow", "importance", "rank_agreement", "with_shap"]

#: A gradient's unit, and what a label needs besides its own weight to be put in order.
UNIT, SMOOTH = float(1 << 26), 10.0
#: Labels of a feature that have a bin of their own, the most frequent ones; others count as unseen.
MOST_LABELS = 64
#: Tables of at most so many tasks send their sums straight to the driver.
FEW_TASKS = 16
#: Rows of a block, or patterns where rows are only counted; and what a block holds.
BLOCK, BLOCK_COLUMNS = 1 << 15, ["fold", "side", "y", "b", "n", "d", "m"]
#: Without a limit of its own, a tree stops at this depth.
DEEPEST = 30
#: Folds of at most so many training rows, and bins of distinct patterns, may have their models grown apart, a task for each
#: that holds 8 bytes a row where trees draw rows, and about 10 a bin; and how many trees a task grows between two looks at
#: the validation rows, a multiple of STORE_EVERY.
TASK_ROWS, TASK_CELLS, ROUND = 10_000_000, 10_000_000, 40
#: After so many trees margins take in their sum.
STORE_EVERY = 10


@dataclass
class Boosted:
    """Trees over features, of which labels are texts. losses: validation loss after each tree that was tried."""

    features: Sequence[str]
    base: float
    trees: list[Node] = field(default_factory=list)
    labels: Sequence[str] = ()
    losses: list[float] = field(default_factory=list)

    def _applied(self, what: str, kind: str) -> Column:
        """A forest's method over the features, Arrow batch by Arrow batch; the trees travel with the tasks."""
        features, labels, base, roots, made = tuple(self.features), tuple(self.labels), self.base, list(self.trees), []

        def run(*columns):  # noqa: ANN002, ANN202
            import pandas as pd

            if not made:
                made.append(Forest(features, labels, base, roots))
            bins = made[0].bins([c.to_numpy() for c in columns])
            if what == "told":  # attributions, then the margin
                return pd.DataFrame({**{f"v{i}": x for i, x in enumerate(made[0].attributions(bins).T)}, "margin": made[0].margins(bins)})
            out = getattr(made[0], what)(bins)
            return pd.Series(out if out.ndim == 1 else list(out))

        return F.pandas_udf(run, kind)(*[F.col(f).cast("string" if f in labels else "double") for f in features])

    def margin(self) -> Column:
        return self._applied("margins", "double")

    def prefix_margins(self) -> Column:
        """An array: the margin after each tree."""
        return self._applied("prefixes", "array<double>")

    def probability(self) -> Column:
        return sigmoid(self.margin())


@dataclass(frozen=True)
class Growth:
    """How a model is grown. leaves: at most so many, best gain first; without it, every gainful split down to depth. rows, columns: shares drawn for each tree. least, least_rows: weight and rows that each side of a split must have."""

    trees: int = 100
    depth: int | None = 3
    rate: float = 0.1
    ridge: float = 1.0
    least: float = 5.0
    leaves: int | None = None
    rows: float = 1.0
    columns: float = 1.0
    seed: int = 0
    patience: int | None = None
    least_rows: int = 1


@dataclass
class Fold:
    """Rows that a model learns from, and those that tell when to stop."""

    train: Column
    valid: Column | None = None


@dataclass
class _Binned:
    """What the bins of a fold's features are."""

    edges: dict[str, list[float]]
    codes: dict[str, list[str]]
    base: float
    rows: int  # that the fold learns from

    def width(self) -> int:
        return 1 + max([len(e) + 1 for e in self.edges.values()] + [len(c) for c in self.codes.values()] + [1])


@dataclass
class _Split:
    gain: float
    feature: str
    goes_left: np.ndarray
    edge: float
    missing_left: bool
    labels: tuple[str, ...] | None
    left: tuple[float, float]  # value and rows
    right: tuple[float, float]


def best_split(sums: np.ndarray, low: float, high: float, features: Sequence[str], drawn: Sequence[int], binned: _Binned, signs: Mapping[str, int], ridge: float, least: float, least_rows: int = 1) -> _Split | None:
    """Of most gain among all features, edges or label sets, and sides of missing numbers, that keeps signs and bounds. sums: features x bins x (gradient, weight, rows), bin 0 missing.

    Labels are put in order of their gradient over their weight, and a beginning of that order goes left; missing and
    unseen labels go right. Ties go to the first feature, edge and side.
    """
    found: _Split | None = None

    def weight(g, h):  # noqa: ANN001, ANN202
        return np.clip(-g / (h + ridge), low, high)

    def gain_of(g, h, w):  # noqa: ANN001, ANN202
        return -(2 * g * w + (h + ridge) * w * w)

    for f in drawn:
        name, s = features[f], sums[f]
        g, h, n = s.sum(axis=0)
        whole = gain_of(g, h, weight(g, h))
        if name in binned.codes:
            held = np.flatnonzero(s[1:, 2] > 0) + 1
            order = held[np.argsort(s[held, 0] / (s[held, 1] + SMOOTH), kind="stable")]
            sides = (False,)
        else:
            order = np.arange(1, len(binned.edges[name]) + 1)
            sides = (True, False) if s[0, 2] > 0 else (True,)
        if not len(order):
            continue
        for missing_left in sides:
            left = np.cumsum(s[order], axis=0) + (s[0] if missing_left and name not in binned.codes else 0)
            gl, hl, nl = left.T
            wl, wr = weight(gl, hl), weight(g - gl, h - hl)
            gain = gain_of(gl, hl, wl) + gain_of(g - gl, h - hl, wr) - whole
            ok = (hl >= least) & (h - hl >= least) & (nl >= least_rows) & (n - nl >= least_rows) & (signs.get(name, 0) * (wr - wl) >= 0)
            gain = np.where(ok, gain, -inf)
            i = int(gain.argmax())
            if gain[i] > 1e-9 and (found is None or gain[i] > found.gain):
                goes = np.zeros(len(s), bool)
                goes[order[: i + 1]] = True
                goes[0] = missing_left and name not in binned.codes
                labels = tuple(sorted(binned.codes[name][b - 1] for b in order[: i + 1])) if name in binned.codes else None
                found = _Split(float(gain[i]), name, goes, 0.0 if labels else binned.edges[name][i], bool(goes[0]), labels, (float(wl[i]), float(nl[i])), (float(wr[i]), float(n - nl[i])))
    return found


class _Tree:
    """A tree that is being grown. Nodes are numbered as in a heap: 1, then 2 and 3, and so on."""

    def __init__(self, job: _Job):
        self.job, self.sums, self.split = job, {}, {}
        self.bounds: dict[int, tuple[float, float]] = {1: (-inf, inf)}
        self.value: dict[int, float] = {1: 0.0}
        self.rows: dict[int, float] = {1: 0.0}
        draw = Random(f"{job.growth.seed} {len(job.model.trees)}")
        count = len(job.features)
        self.drawn = sorted(draw.sample(range(count), max(1, round(job.growth.columns * count)))) if job.growth.columns < 1 else list(range(count))
        self.asked = [1]

    def told(self, sums: Mapping[int, np.ndarray]) -> None:
        """Take the sums of the nodes asked for, and of their siblings what is left of the parent."""
        job = self.job
        for n in self.asked:
            self.sums[n] = sums[n]
            if n == 1:
                g, h, self.rows[1] = sums[n][self.drawn[0]].sum(axis=0)
                self.value[1] = -g / (h + job.growth.ridge)
            else:
                self.sums[n ^ 1] = self.sums[n >> 1] - sums[n]
            for k in {n, n ^ 1 if n > 1 else n}:
                self.split[k] = best_split(self.sums[k], *self.bounds[k], job.features, self.drawn, job.binned, job.signs, job.growth.ridge, job.growth.least, job.growth.least_rows)
                if self.split[k]:
                    self._open(k, self.split[k])
        for n in [n for n in self.sums if (n << 1) in self.sums]:
            del self.sums[n]

    def _open(self, n: int, s: _Split) -> None:
        (low, high), mid, sign = self.bounds[n], (s.left[0] + s.right[0]) / 2, self.job.signs.get(s.feature, 0)
        self.bounds[2 * n] = (max(low, mid) if sign < 0 else low, min(high, mid) if sign > 0 else high)
        self.bounds[2 * n + 1] = (max(low, mid) if sign > 0 else low, min(high, mid) if sign < 0 else high)
        for k, (value, rows) in ((2 * n, s.left), (2 * n + 1, s.right)):
            self.value[k], self.rows[k] = value, rows

    def settle(self) -> set[int] | None:
        """The nodes that are split, best gain first; or None, and asked holds the nodes whose sums are needed to go on.

        Which split a node has does not depend on the order, so that children of all nodes that may be next are asked for at once.
        """
        growth, chosen, frontier = self.job.growth, set(), [1]
        depth = growth.depth or DEEPEST
        while True:
            room = growth.leaves - len(frontier) if growth.leaves else len(frontier)
            ready = sorted((n for n in frontier if self.split.get(n)), key=lambda n: (-self.split[n].gain, n)) if room > 0 else []
            if not ready:
                return chosen
            blind = lambda n: n.bit_length() < depth and 2 * n not in self.split
            if blind(ready[0]):
                self.asked = [2 * n + (self.rows[2 * n + 1] < self.rows[2 * n]) for n in ready[:room] if blind(n)]
                return None
            chosen.add(ready[0])
            frontier.remove(ready[0])
            frontier += [2 * ready[0], 2 * ready[0] + 1]

    def node(self, n: int, chosen: set[int]) -> Node:
        low, high = self.bounds[n]
        if n not in chosen:
            return Node(self.value[n] * self.job.growth.rate, self.rows[n], low, high)
        s = self.split[n]
        return Node(self.value[n], self.rows[n], low, high, s.feature, s.edge, s.missing_left, self.node(2 * n, chosen), self.node(2 * n + 1, chosen), s.labels)

    def places(self, slots: Mapping[int, int]) -> Node:
        """The tree down to the nodes asked for, whose values are their slots."""
        above = {n >> k for n in self.asked for k in range(1, n.bit_length())}

        def part(n: int) -> Node:
            if n not in above:
                return Node(float(slots.get(n, -1)), 0.0)
            s = self.split[n]
            return Node(0.0, 0.0, feature=s.feature, edge=s.edge, missing_left=s.missing_left, left=part(2 * n), right=part(2 * n + 1), labels=s.labels)

        return part(1)


class _Job:
    def __init__(self, number: int, growth: Growth, fold: int, binned: _Binned, features: Sequence[str], labels: Sequence[str], signs: Mapping[str, int], stops: bool):
        self.number, self.growth, self.fold, self.binned, self.features, self.signs, self.stops = number, growth, fold, binned, list(features), signs, stops
        self.model = Boosted(list(features), binned.base, labels=tuple(labels))
        self.pending: list = []
        self.tree: _Tree | None = _Tree(self) if growth.trees else None
        self.wants_loss, self.done, self.place, self.looked_at = False, not growth.trees, 0, 0

    def left_bins(self, n: Node) -> np.ndarray:
        if n.labels is not None:
            codes = self.binned.codes[n.feature]
            return np.r_[False, np.isin(codes, list(n.labels))]
        edges = self.binned.edges[n.feature]
        return np.r_[n.missing_left, np.arange(len(edges) + 1) <= edges.index(n.edge)]

    def flat(self, root: Node):  # noqa: ANN201
        return flatten(root, {f: i for i, f in enumerate(self.features)}, self.left_bins)

    def lost(self, loss: float) -> None:
        """Take the next tree's validation loss."""
        losses, patience = self.model.losses, self.growth.patience
        losses.append(loss)
        if patience and len(losses) - 1 - int(np.argmin(losses)) >= patience:
            self.done = True

    def advance(self, sums: Mapping[int, np.ndarray], loss: float | None) -> None:
        if loss is not None:
            self.lost(loss)
        if self.tree is None:
            self.done = True
        self.wants_loss = False
        if self.done:
            return
        self.tree.told(sums)
        chosen = self.tree.settle()
        if chosen is None:
            return
        root = self.tree.node(1, chosen)
        self.model.trees.append(root)
        self.pending.append(self.flat(root))
        self.wants_loss = self.stops
        more = len(self.model.trees) < self.growth.trees
        self.tree = _Tree(self) if more else None
        self.done = not more and not self.stops

    def result(self) -> Boosted:
        if self.stops and self.growth.patience and self.model.losses:
            del self.model.trees[int(np.argmin(self.model.losses)) + 1 :]
        return self.model


def _mixed(digest: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A mix of each row's digest with the seed and the tree's number, below 2 ** 53: a tree's sample is those below a share of that."""
    with np.errstate(over="ignore"):
        x = digest.view(np.uint64) ^ (np.uint64(seed * 1_000_003 + tree + 1) * np.uint64(0x9E3779B97F4A7C15))
        for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(k)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64)


def _flagged(df: DataFrame, y: str, features: Sequence[str], labels: Sequence[str], folds: Sequence[Fold], row_id: str | None) -> DataFrame:
    """Rows that a fold uses, as d: a digest; y; each fold's side: 1 learns, 2 validates; and the features as x0, x1, ... Read from storage from here on, whatever df costs."""
    digest = F.xxhash64(F.col(row_id).cast("string")) if row_id else F.xxhash64(*[F.col(f).cast("string") for f in [y, *features]])
    side = [F.when(f.train, 1).when(f.valid if f.valid is not None else F.lit(False), 2).otherwise(0).cast("byte").alias(f"s{k}") for k, f in enumerate(folds)]
    named = [F.col(f).cast("string" if f in labels else "double").alias(f"x{i}") for i, f in enumerate(features)]
    return stored(df.select(digest.alias("d"), F.col(y).cast("double").alias("y"), *side, *named).where("y is not null").where(" or ".join(f"s{k} > 0" for k in range(len(folds)))), "boosting-rows")


def _of_side(rows: DataFrame, side: int, folds: int) -> DataFrame:
    """The rows that a fold has on this side, on no other."""
    sides = [f"s{k}" for k in range(folds)]
    return rows.select(*[F.when(F.col(c) == side, F.col(c)).otherwise(0).cast("byte").alias(c) if c in sides else c for c in rows.columns]).where(" or ".join(f"{c} > 0" for c in sides))


def _bins_of_folds(rows: DataFrame, folds: int, features: Sequence[str], labels: Sequence[str], bins: int) -> list[_Binned]:
    """What each fold's training rows tell; the edges of all folds at once."""
    at = {f: f"x{i}" for i, f in enumerate(features)}
    numbers, ks = [f for f in features if f not in labels], range(folds)
    learns = lambda k, c: F.when(F.col(f"s{k}") == 1, F.col(c))
    told = rows.agg(*[x for k in ks for x in (F.avg(learns(k, "y")), F.count(learns(k, "y")))]).first()
    sides = rows.select(*[learns(k, at[f]).alias(f"{k}{at[f]}") for k in ks for f in numbers])
    got = exact_quantiles(sides, sides.columns, [i / bins for i in range(1, bins)]) if numbers else {}
    out = []
    for k in ks:
        train = rows.where(F.col(f"s{k}") == 1)
        codes = {f: [r[0] for r in train.where(F.col(at[f]).isNotNull()).groupBy(at[f]).count().orderBy(F.col("count").desc(), at[f]).limit(MOST_LABELS).collect()] for f in labels}
        rate, count = told[2 * k : 2 * k + 2]
        rate = min(1 - 1e-9, max(1e-9, rate)) if rate is not None else 0.5
        out.append(_Binned({f: sorted(set(got[f"{k}{at[f]}"])) for f in numbers}, codes, log(rate / (1 - rate)), count))
    return out


def _coded(rows: DataFrame, features: Sequence[str], folds: int, binned: Sequence[_Binned]) -> DataFrame:
    """A row for each fold that a row is in: fold and side (k, as 4 * fold + side) and bins as bytes of short numbers, label, digest."""
    edges = [{f: np.array(e) for f, e in b.edges.items()} for b in binned]
    codes = [{f: {x: i + 1 for i, x in enumerate(c)} for f, c in b.codes.items()} for b in binned]
    count, size = len(features), 2 * (len(features) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digest, y = b.column(0), b.column(1)
            columns = [b.column(2 + folds + i) for i in range(count)]
            columns = [c.dictionary_encode() if f in codes[0] else c.to_numpy(zero_copy_only=False).astype(np.float64) for f, c in zip(features, columns)]
            for k in range(folds):
                side = b.column(2 + k).to_numpy()
                use = np.flatnonzero(side)
                if not len(use):
                    continue
                out = np.empty((len(use), count + 1), np.int16)
                out[:, 0] = 4 * k + side[use]
                for i, (f, c) in enumerate(zip(features, columns)):
                    if f in codes[k]:
                        at = np.array([*[codes[k][f].get(x, 0) for x in c.dictionary.to_pylist()], 0], np.int16)
                        out[:, i + 1] = at[c.indices.fill_null(len(at) - 1).to_numpy()][use]
                    else:
                        x = c[use]
                        out[:, i + 1] = np.where(np.isnan(x), 0, 1 + np.searchsorted(edges[k][f], x, side="left"))
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(use), [None, pa.py_buffer(out)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([packed, y.take(pa.array(use)), digest.take(pa.array(use))], names=["p", "y", "d"])

    return rows.mapInArrow(run, "p binary, y double, d long")


def _blocks(coded: DataFrame, count: int, drawn: set[int], bases: Sequence[Sequence[float]]) -> DataFrame:
    """Blocks of distinct patterns of one fold and side: label y, bins b (features x patterns), how many rows n, margins m
    (models x patterns); and, where trees draw rows, their digests d, pattern by pattern.

    Rows of one pattern have one margin and one gradient, so that a pass works out each pattern once. Rows are ordered by
    pattern and digest over all tasks: equal rows of any number go to several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, size = None, 0

        def block() -> pa.RecordBatch:
            y, p, n, d = (np.concatenate(x) for x in zip(*held))
            m = np.repeat(np.array(bases[now >> 2], np.float64)[:, None], len(y), axis=1)
            parts = (y, np.ascontiguousarray(p.T), n, d, m)
            return pa.RecordBatch.from_arrays([pa.array([now >> 2], pa.int32()), pa.array([now & 3], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]], names=BLOCK_COLUMNS)

        for b in batches:
            packed, y, d = b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy()
            times = b.column(3).to_numpy() if b.num_columns > 3 else np.ones(len(y), np.int64)  # rows that are counted already
            if not len(y):
                continue
            first = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset]
            p = np.frombuffer(packed.buffers()[2], np.int16, len(y) * (count + 1), first).reshape(len(y), count + 1)
            heads = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(axis=1) | (y[1:] != y[:-1])])
            rows, ends, key = np.add.reduceat(times, heads), np.r_[heads[1:], len(y)], p[heads, 0]
            for k in np.unique(key):  # in order
                at = np.flatnonzero(key == k)
                mine = d[heads[at[0]] : ends[at[-1]]] if k >> 2 in drawn and k & 3 == 1 else d[:0]
                if held and (k != now or size >= BLOCK):
                    yield block()
                    held, size = [], 0
                now = int(k)
                held.append((y[heads[at]], p[heads[at], 1:], rows[at], mine))
                size += max(len(at), len(mine))
        if held:
            yield block()

    kinds = ["int", "int", *["binary"] * 5]
    # Counted rows are few bytes but each costs a look by all trees: a fixed number of tasks, which are not coalesced by size.
    tasks = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = coded.repartitionByRange(tasks, "p", "y").sortWithinPartitions("p", "y") if "n" in coded.columns else coded.orderBy("p", "y", "d")
    return ordered.mapInArrow(run, ", ".join(f"{a} {k}" for a, k in zip(BLOCK_COLUMNS, kinds)))


def _moved(table: DataFrame, jobs: Sequence[_Job]) -> DataFrame:
    """The margins after all trees that are not in them yet."""
    work = [(j.fold, j.place, j.pending) for j in jobs if j.pending]
    count = len(jobs[0].features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = []
            for fold, bins, m in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("fold", "b", "m")]):
                bins = np.frombuffer(bins, np.int16).reshape(count, -1).astype(np.intp)
                m = np.frombuffer(m, np.float64).reshape(-1, bins.shape[1]).copy()
                for _, place, pending in (w for w in work if w[0] == fold):
                    m[place] += sum(t.value[t.leaf_of(bins)] for t in pending)
                new.append(m.tobytes())
            yield b.set_column(b.schema.get_field_index("m"), "m", pa.array(new, pa.binary()))

    return table.mapInArrow(run, table.schema)


def _taken(mixed: np.ndarray, share: float, start: np.ndarray) -> np.ndarray:
    """How many rows of each pattern a tree draws."""
    return np.add.reduceat(mixed < share * float(1 << 53), start, dtype=np.int64)


def _drawn(digest: np.ndarray, seed: int, tree: int, share: float, start: np.ndarray) -> np.ndarray:
    """How many rows of each pattern a tree draws, as _taken; digests are mixed piece by piece, so that millions need no more than a byte each."""
    below = np.empty(len(digest), bool)
    for a in range(0, len(digest), BLOCK):
        below[a : a + BLOCK] = _mixed(digest[a : a + BLOCK], seed, tree) < share * float(1 << 53)
    return np.add.reduceat(below, start, dtype=np.int64)


def _loss(y: np.ndarray, n: np.ndarray, margin: np.ndarray) -> int:
    """The loss of all rows, in units."""
    return int((np.rint((np.logaddexp(0, margin) - y * margin) * UNIT).astype(np.int64) * n).sum())


def _add_sums(sums: np.ndarray, bins: np.ndarray, y: np.ndarray, times: np.ndarray, margin: np.ndarray, tree: Flat, drawn: Sequence[int]) -> None:
    """Add patterns to the sums of the nodes asked for, which are the tree's values: (gradient, weight, rows) x nodes x features x bins."""
    _, asked, _, width = sums.shape
    slot = tree.value[tree.leaf_of(bins)].astype(np.intp)
    keep = np.flatnonzero((slot >= 0) & (times > 0))
    slot, p, yy, times = slot[keep] * width, 1 / (1 + np.exp(-margin[keep])), y[keep], times[keep]
    of_all = (np.rint((p - yy) * UNIT) * times, np.rint(p * (1 - p) * UNIT) * times, times)
    for i in drawn:
        key = slot + bins[i, keep]
        for k, x in enumerate(of_all):
            sums[k, :, i] += np.bincount(key, x, asked * width).reshape(asked, width)


def _met(a: tuple, b: tuple) -> tuple:
    """Two tables of sums (key, then three numbers) as one: whole numbers, the same in any order."""
    key, at = np.unique(np.r_[a[0], b[0]], return_inverse=True)
    out = np.zeros((3, len(key)), np.int64)
    for k in range(3):
        np.add.at(out[k], at, np.r_[a[1][k], b[1][k]])
    return key, out


def _sums(blocks: RDD, jobs: Sequence[_Job], width: int, tasks: int) -> tuple[dict[tuple[int, int], np.ndarray], dict[int, float]]:
    """One pass: the sums of all nodes that the models ask for, and the validation losses of those that want one."""
    count, slots, work = len(jobs[0].features), {}, []
    for j in jobs:
        asked = list(j.tree.asked) if j.tree else []
        first, mine = len(slots), {n: i for i, n in enumerate(asked)}
        slots |= {(j.number, n): first + i for n, i in mine.items()}
        work.append((j.fold, j.place, first, len(asked), list(j.pending), j.flat(j.tree.places(mine)) if j.tree else None, j.tree.drawn if j.tree else [], j.growth.rows, j.growth.seed, len(j.model.trees), j.wants_loss))
    shared = blocks.context.broadcast(work)  # trees since the last store, and nodes asked for

    def run(rows: Iterator) -> Iterator[tuple]:
        todo = shared.value
        sums, losses = [np.zeros((3, w[3], count, width)) for w in todo], np.zeros((len(todo), 2), np.int64)
        for r in rows:
            here = [(i, w) for i, w in enumerate(todo) if w[0] == r["fold"] and (w[5] is not None if r["side"] == 1 else w[-1])]
            if not here:
                continue
            y, n, d = np.frombuffer(r["y"], np.float64), np.frombuffer(r["n"], np.int64), np.frombuffer(r["d"], np.int64)
            bins, m = np.frombuffer(r["b"], np.int16).reshape(count, -1).astype(np.intp), np.frombuffer(r["m"], np.float64).reshape(-1, len(y))
            start, mixed = np.cumsum(n) - n, {}
            for at, (_, place, _, _, pending, tree, drawn, share, seed, nth, _) in here:
                margin = m[place] + sum(t.value[t.leaf_of(bins)] for t in pending)
                if r["side"] == 2:
                    losses[at] += _loss(y, n, margin), n.sum()
                    continue
                times = n
                if share < 1:
                    if (seed, nth) not in mixed:
                        mixed[seed, nth] = _mixed(d, seed, nth)
                    times = _taken(mixed[seed, nth], share, start)
                _add_sums(sums[at], bins, y, times, margin, tree, drawn)
        flat = np.concatenate([s.reshape(3, -1) for s in sums], axis=1)
        key, lost = np.flatnonzero(flat[2]), np.flatnonzero(losses[:, 1])
        yield np.r_[key, -1 - lost], np.concatenate([flat[:, key].astype(np.int64), np.stack([*losses[lost].T, np.zeros(len(lost), np.int64)])], axis=1)

    parts = blocks.mapPartitions(run)
    # Sums of many tasks meet task by task, those of a few on the driver: nodes x features x bins numbers.
    got = parts.collect() if tasks <= FEW_TASKS else [parts.treeReduce(_met)]
    shared.destroy()
    dense, losses = np.zeros((3, max(1, len(slots)) * count * width), np.int64), {}
    for key, told in got:
        dense[:, key[key >= 0]] += told[:, key >= 0]
        for a, b, c in zip(key[key < 0], *told[:2, key < 0]):
            whole, rows = losses.get(int(a), (0, 0))
            losses[int(a)] = whole + int(b), rows + int(c)
    dense = np.stack([dense[0] / UNIT, dense[1] / UNIT, dense[2]], axis=1).reshape(-1, count, width, 3)
    return {key: dense[s] for key, s in slots.items()}, {jobs[-1 - a].number: float(b) / UNIT / max(1, c) for a, (b, c) in losses.items()}


class _Margins:
    """A model's margins over patterns, tree by tree. Trees are summed by STORE_EVERY, as they are where passes store margins."""

    def __init__(self, bins: np.ndarray, start: np.ndarray):
        self.bins, self.whole, self.part, self.count = bins, start, 0.0, 0

    def add(self, tree: Flat) -> np.ndarray:
        self.part, self.count = self.part + tree.value[tree.leaf_of(self.bins)], self.count + 1
        if self.count % STORE_EVERY == 0:
            self.whole, self.part = self.whole + self.part, 0.0
        return self.whole + self.part


def _next_trees(job: _Job, blocks: Sequence, width: int) -> list[Node]:
    """In a task: the next ROUND trees of one model, from the training patterns of its fold."""
    count = len(job.features)
    y, n, d = (np.concatenate([np.empty(0, kind), *[np.frombuffer(r[c], kind) for r in blocks]]) for c, kind in (("y", np.float64), ("n", np.int64), ("d", np.int64)))
    bins = np.concatenate([np.empty((count, 0), np.int16), *[np.frombuffer(r["b"], np.int16).reshape(count, -1) for r in blocks]], axis=1).astype(np.intp)
    start, trees, growth = np.cumsum(n) - n, job.model.trees, job.growth
    first, at = len(trees), _Margins(bins, np.full(len(y), job.binned.base))
    margin = at.whole
    for root in trees:
        margin = at.add(job.flat(root))
    while len(trees) < min(first + ROUND, growth.trees):
        tree, chosen = _Tree(job), None
        times = _drawn(d, growth.seed, len(trees), growth.rows, start) if growth.rows < 1 else n
        while chosen is None:
            slots = {k: i for i, k in enumerate(tree.asked)}
            sums = np.zeros((3, len(slots), count, width))
            _add_sums(sums, bins, y, times, margin, job.flat(tree.places(slots)), tree.drawn)
            tree.told({k: np.stack([sums[0, i] / UNIT, sums[1, i] / UNIT, sums[2, i]], axis=-1) for k, i in slots.items()})
            chosen = tree.settle()
        trees.append(tree.node(1, chosen))
        margin = at.add(job.flat(trees[-1]))
    return trees[first:]


def _looked(valid: DataFrame, jobs: Sequence[_Job]) -> DataFrame:
    """The validation blocks with the margins after all trees, and l: the loss after each tree that was not in them yet (models x ROUND), and the rows."""
    count, context = len(jobs[0].features), valid.sparkSession.sparkContext
    shared = {k: context.broadcast([j for j in jobs if j.fold == k]) for k in {j.fold for j in jobs}}  # a task reads those of its folds

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat: dict[int, list] = {}
        for b in batches:
            moved, lost = [], []
            for k, y, bins, n, m in zip(*[b.column(b.schema.get_field_index(c)).to_pylist() for c in ("fold", "y", "b", "n", "m")]):
                y, n = np.frombuffer(y, np.float64), np.frombuffer(n, np.int64)
                bins, m = np.frombuffer(bins, np.int16).reshape(count, -1).astype(np.intp), np.frombuffer(m, np.float64).reshape(-1, len(y)).copy()
                if k in shared and k not in flat:
                    flat[k] = [(j.place, [j.flat(t) for t in j.model.trees[j.looked_at :]]) for j in shared[k].value]
                told = np.zeros(len(m) * ROUND + 1, np.int64)
                told[-1] = n.sum()
                for place, trees in flat.get(k, []):
                    at = _Margins(bins, m[place].copy())
                    for i, t in enumerate(trees):
                        m[place] = at.add(t)
                        told[place * ROUND + i] = _loss(y, n, m[place])
                moved.append(m.tobytes())
                lost.append(told.tobytes())
            parts = {c: b.column(b.schema.get_field_index(c)) for c in BLOCK_COLUMNS} | {"m": pa.array(moved, pa.binary()), "l": pa.array(lost, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(parts.values()), names=list(parts))

    return valid.mapInArrow(run, ", ".join(f"{c} {'int' if c in BLOCK_COLUMNS[:2] else 'binary'}" for c in [*BLOCK_COLUMNS, "l"]))


def _grow_apart(train: DataFrame, valid: DataFrame, work: Sequence[_Job], width: int) -> None:
    """Rounds of two jobs: tasks grow ROUND trees of a model each, then one look at the validation rows tells the losses of all of them.

    For folds whose training rows are bounded: a task holds those of one fold, which are dealt to the tasks once, for all
    rounds. Validation rows stay in blocks.
    """
    of_fold = {k: [i for i, j in enumerate(work) if j.fold == k] for k in {j.fold for j in work}}
    held = train.select("fold", "y", "b", "n", "d").rdd.flatMap(lambda r: [(i, r) for i in of_fold.get(r["fold"], ())]).partitionBy(len(work), int).persist(StorageLevel.MEMORY_AND_DISK)
    while open_ := [j for j in work if not j.done]:
        shared = held.context.broadcast({i: j for i, j in enumerate(work) if not j.done})

        def grown(i: int, blocks: Iterator, shared=shared) -> Iterator[tuple]:  # noqa: ANN001
            if i in shared.value:
                yield i, _next_trees(shared.value[i], [r for _, r in blocks], width)

        for i, trees in held.mapPartitionsWithIndex(grown).collect():
            work[i].model.trees += trees
        shared.destroy()
        lost = {}
        if stops := [j for j in open_ if j.stops]:
            valid = stored(_looked(valid, stops), "boosting")
            lost = dict(valid.select("fold", "l").rdd.map(lambda r: (r["fold"], np.frombuffer(r["l"], np.int64))).reduceByKey(np.add).collect())
        for j in open_:
            for i in range(j.looked_at, len(j.model.trees)):
                if j.fold in lost and j.stops and not j.done:
                    told = lost[j.fold]
                    j.lost(float(told[j.place * ROUND + i - j.looked_at]) / UNIT / max(1, int(told[-1])))
            j.looked_at = len(j.model.trees)
            j.done = j.done or j.looked_at >= j.growth.trees
    held.unpersist()


def _fit_in_tasks(train: DataFrame, binned: Sequence[_Binned], features: int) -> bool:
    """Whether a task can hold the distinct patterns of each fold."""
    if all(b.rows * features <= TASK_CELLS for b in binned):
        return True
    most = train.groupBy("fold").agg(F.sum(F.length("b") / 2).alias("n")).agg(F.max("n")).first()[0]  # blocks tell short numbers
    return most is None or most <= TASK_CELLS


def grow(df: DataFrame, y: str, features: Sequence[str], jobs: Sequence[tuple[Growth, int]], folds: Sequence[Fold], labels: Sequence[str] = (), row_id: str | None = None, bins: int = 32, signs: Mapping[str, int] | None = None, store_every: int = STORE_EVERY, apart: bool = False) -> list[Boosted]:
    """A model for each (growth, number of its fold), all grown by the same passes over the rows.

    labels: features that are texts and split as sets. signs: 1 where the margin must not fall as the feature grows, -1
    where it must not rise. row_id names what tells rows apart when some are drawn for a tree; without it equal rows are
    drawn together. Rows without a label take no part; edges and labels come from a fold's training rows alone; with
    patience, a model ends where its validation loss is least, looking that many trees ahead. apart: where no fold has more
    than TASK_ROWS training rows, or TASK_CELLS bins of distinct ones, each model is grown by a task of its own, which takes a job for ROUND trees instead of
    one for each level; larger folds are grown by passes all the same.
    """
    rows = _flagged(df, y, features, labels, folds, row_id)
    learning = stored(_of_side(rows, 1, len(folds)), "boosting-train") if apart else rows
    binned = _bins_of_folds(learning, len(folds), features, labels, bins)
    work = [_Job(i, g, k, binned[k], features, labels, signs or {}, bool(g.patience) and folds[k].valid is not None) for i, (g, k) in enumerate(jobs)]
    width = max(b.width() for b in binned)
    for k in range(len(folds)):
        for i, j in enumerate(j for j in work if j.fold == k):
            j.place = i
    drawn = {j.fold for j in work if j.growth.rows < 1}
    bases = [[binned[k].base] * sum(j.fold == k for j in work) for k in range(len(folds))]
    blocked = lambda coded: _blocks(coded, len(features), drawn, bases)
    if apart and all(b.rows <= TASK_ROWS for b in binned):
        train = stored(blocked(_coded(learning, features, len(folds), binned)), "boosting")
        if _fit_in_tasks(train, binned, len(features)):
            told = _coded(_of_side(rows, 2, len(folds)), features, len(folds), binned).groupBy("p", "y").agg(F.count("*").alias("n"))  # they are not drawn: no digests
            _grow_apart(train, blocked(told.select("p", "y", F.lit(0).cast("long").alias("d"), "n")), work, width)
            return [j.result() for j in work]
    table = stored(blocked(_coded(rows, features, len(folds), binned)), "boosting")
    blocks = table.rdd.persist(StorageLevel.MEMORY_AND_DISK)  # read by every pass until margins are stored again
    tasks = blocks.getNumPartitions()
    while open_ := [j for j in work if not j.done]:
        sums, losses = _sums(blocks, open_, width, tasks)
        for j in open_:
            asked = list(j.tree.asked) if j.tree else []
            j.advance({n: sums[j.number, n] for n in asked}, losses.get(j.number) if j.wants_loss else None)
        if max(len(j.pending) for j in work) >= store_every and any(not j.done for j in work):
            table = stored(_moved(table, [j for j in work if not j.done]), "boosting")
            blocks.unpersist()
            blocks = table.rdd.persist(StorageLevel.MEMORY_AND_DISK)
            tasks = blocks.getNumPartitions()
            for j in work:
                j.pending = []
    blocks.unpersist()
    return [j.result() for j in work]


def fit(
    df: DataFrame, y: str, features: Sequence[str], trees: int = 100, depth: int | None = 3, rate: float = 0.1, bins: int = 32, ridge: float = 1.0, least: float = 5.0, signs: Mapping[str, int] | None = None,
    store_every: int = 10, labels: Sequence[str] = (), leaves: int | None = None, rows: float = 1.0, columns: float = 1.0, seed: int = 0, row_id: str | None = None, valid: Column | None = None, patience: int | None = None,
) -> Boosted:
    """One model, as grow makes it. valid: rows that are not learned from; with patience they tell when to stop."""
    growth = Growth(trees, depth, rate, ridge, least, leaves, rows, columns, seed, patience)
    fold = Fold(F.lit(True) if valid is None else ~F.coalesce(valid, F.lit(False)), valid)
    return grow(df, y, features, [(growth, 0)], [fold], labels, row_id, bins, signs, store_every)[0]


def with_shap(df: DataFrame, model: Boosted) -> DataFrame:
    """Adds shap_<feature>, the path-dependent Shapley values of the margin (covers stand in for features left out), shap_base and margin."""
    base = Forest(model.features, model.labels, model.base, model.trees).expected
    told = df.withColumn("__shap", model._applied("told", "struct<" + ", ".join(f"v{i}: double" for i in range(len(model.features))) + ", margin: double>"))
    return told.select(*df.columns, *[F.col(f"__shap.v{i}").alias(f"shap_{f}") for i, f in enumerate(model.features)], F.lit(base).alias("shap_base"), F.col("__shap.margin").alias("margin"))


def additivity(df: DataFrame, model: Boosted) -> DataFrame:
    """The largest gap between a margin and its parts."""
    total = F.col("shap_base")
    for f in model.features:
        total = total + F.col(f"shap_{f}")
    return df.agg(F.max(F.abs(total - F.col("margin"))).alias("max_gap"))


def importance(df: DataFrame, model: Boosted) -> DataFrame:
    """(variable, mean_abs, rank): mean absolute attributions, largest first."""
    one = df.agg(*[F.avg(F.abs(f"shap_{f}")).alias(f) for f in model.features])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("variable"), F.col(f).alias("mean_abs")) for f in model.features])).alias("x")).select("x.*")
    return min_rank_descending(long, "mean_abs", "rank")


def compare_importance(shap: DataFrame, iv: DataFrame, points: DataFrame) -> DataFrame:
    """Every variable of any table: its ranks by attribution, value and points range, and how far the first two are apart."""
    ranges = points.groupBy("variable").agg((F.max("points") - F.min("points")).alias("points_range"))
    t = shap.join(iv, "variable", "full").join(ranges, "variable", "full")
    for c, name in (("mean_abs", "shap_rank"), ("iv", "iv_rank"), ("points_range", "points_rank")):
        t = min_rank_descending(t, c, name)
    return t.withColumn("gap", F.col("shap_rank") - F.col("iv_rank"))


def rank_agreement(table: DataFrame, a: str = "mean_abs", b: str = "iv") -> DataFrame:
    """Spearman's correlation over the variables that have both; null for fewer than three."""
    both = table.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    n = both.agg(F.count("*").alias("n"))
    return spearman(both, a, b).crossJoin(F.broadcast(n)).select("n", F.when(F.col("n") >= 3, F.col("spearman")).alias("spearman"))  # one row
