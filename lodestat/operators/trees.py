"""Trees as arrays: margins and exact attributions of whole batches, inside tasks.

A node's split is a row of a table that says for each bin of its feature whether it goes left, so that numbers,
labels and missing values are one lookup. Bins come from the edges and labels that the trees themselves use.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import inf

import numpy as np


@dataclass
class Node:
    """A leaf of that value, or a split: values up to the edge, or the labels named, go left; missing numbers as told, missing and unseen labels right."""

    value: float
    cover: float
    low: float = -inf
    high: float = inf
    feature: str | None = None
    edge: float = 0.0
    missing_left: bool = True
    left: Node | None = None
    right: Node | None = None
    labels: Sequence[str] | None = None


def leaves(node: Node, path: tuple = ()) -> list[tuple[Node, tuple]]:
    """(leaf, ((split, whether it goes left), ...)) of each leaf."""
    if node.feature is None:
        return [(node, path)]
    left, right = (*path, (node, True)), (*path, (node, False))
    return leaves(node.left, left) + leaves(node.right, right)


def splits(node: Node) -> list[Node]:
    return [] if node.feature is None else [node, *splits(node.left), *splits(node.right)]


def expected(node: Node) -> float:
    if node.feature is None:
        return node.value
    return (node.left.cover * expected(node.left) + node.right.cover * expected(node.right)) / max(node.cover, 1.0)


#: Trees of up to so many splits are looked up by the outcomes of all their splits.
OUTCOME_BITS = 8


@dataclass
class Flat:
    """One tree: feature number (-1 at leaves), which bins go left (bin 0 is missing), children and values."""

    feature: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def __post_init__(self):
        self.nodes = np.flatnonzero(self.feature >= 0)
        self.next = np.where(self.goes_left, self.left[:, None], self.right[:, None]).ravel().astype(np.intp)
        self.bits = self.leaf = None
        if len(self.nodes) <= OUTCOME_BITS:  # which way every split goes is one number, and that number tells the leaf
            self.bits = [self.goes_left[n].astype(np.uint8) << k for k, n in enumerate(self.nodes)]
            outcomes, place, at = np.arange(1 << len(self.nodes)), np.zeros(len(self.feature), np.intp), np.zeros(1 << len(self.nodes), np.intp)
            place[self.nodes] = np.arange(len(self.nodes))
            for _ in range(self.depth):
                go = (outcomes >> place[at]) & 1
                at = np.where(self.feature[at] < 0, at, np.where(go, self.left[at], self.right[at]))
            self.leaf = at

    def outcomes(self, columns: np.ndarray) -> np.ndarray:
        """For each row a bit for each split that sends it left; of trees of at most OUTCOME_BITS splits. columns: features x rows."""
        out = np.zeros(columns.shape[1], np.uint8)
        for n, bits in zip(self.nodes, self.bits):
            out |= bits[columns[self.feature[n]]]
        return out

    def leaf_of(self, columns: np.ndarray) -> np.ndarray:
        """The leaf of each row of columns (features x rows)."""
        if self.bits is not None:
            return self.leaf[self.outcomes(columns)]
        count, n = columns.shape
        flat = np.r_[columns.ravel(), np.zeros(n, np.intp)]  # leaves look at a feature of zeros, and stay
        start, width = np.where(self.feature < 0, count, self.feature).astype(np.intp) * n, self.goes_left.shape[1]
        at, rows = np.zeros(n, np.intp), np.arange(n)
        for _ in range(self.depth):
            at = self.next[at * width + flat[start[at] + rows]]
        return at


def flatten(root: Node, features: dict[str, int], left_bins) -> Flat:  # noqa: ANN001
    """left_bins(node): for each bin of the node's feature whether it goes left."""
    feature, goes, left, right, value = [], [], [], [], []

    def add(n: Node) -> int:
        i = len(feature)
        feature.append(-1 if n.feature is None else features[n.feature])
        goes.append(np.zeros(1, bool) if n.feature is None else left_bins(n))
        left.append(i)
        right.append(i)
        value.append(n.value)
        if n.feature is not None:
            left[i], right[i] = add(n.left), add(n.right)
        return i

    add(root)
    deep = lambda n: 0 if n.feature is None else 1 + max(deep(n.left), deep(n.right))
    table = np.zeros((len(goes), max(map(len, goes))), bool)
    for i, g in enumerate(goes):
        table[i, : len(g)] = g
    return Flat(np.array(feature, np.int32), table, np.array(left, np.int32), np.array(right, np.int32), np.array(value), deep(root))


def path_shares(met: np.ndarray, share: Sequence[float]) -> np.ndarray:
    """Shapley values of the parts of one path, for a leaf of value 1.

    met: rows x parts, 1 where a row takes the path at that feature, else 0. share: of the training rows at the splits of
    that feature, how many take the path. The polynomial over subset sizes is built up part by part (extend); a part is
    taken out of it again (unwind) for what the path is worth without it.
    """
    n, d = met.shape
    w = np.zeros((n, d + 1))
    w[:, 0] = 1.0
    for k in range(d):  # extend by a part: of k + 1 parts that may be in a subset
        one, zero = met[:, k], share[k]
        for i in range(k, -1, -1):
            w[:, i + 1] += one * w[:, i] * (i + 1) / (k + 2)
            w[:, i] *= zero * (k + 1 - i) / (k + 2)
    out = np.empty((n, d))
    for k in range(d):
        one, zero = met[:, k], share[k]
        total, carry = np.zeros(n), w[:, d].copy()
        taken = one > 0
        for i in range(d - 1, -1, -1):
            with_one = carry * (d + 1) / (i + 1)  # unwind where the part is met
            without = w[:, i] * (d + 1) / (max(zero, 1e-300) * (d - i))  # and where it is not
            part = np.where(taken, with_one, without)
            total += part
            carry = np.where(taken, w[:, i] - part * zero * (d - i) / (d + 1), carry)
        out[:, k] = total * (one - zero)
    return out


#: Of a path of up to so many features, the values of all patterns of met and unmet features are worked out once.
PATTERN_BITS = 10


@dataclass
class _Path:
    value: float
    features: list[int]
    tests: list[list[tuple[int, bool]]]  # for each feature the splits on the path, as (position among the tree's splits, left)
    share: list[float]
    table: np.ndarray | None


class Forest:
    """A boosted model made ready for batches: bins, flat trees, and paths once they are asked for."""

    def __init__(self, features: Sequence[str], labels: Sequence[str], base: float, roots: Sequence[Node]):
        self.features, self.base, self.roots = list(features), base, list(roots)
        self.number = {f: i for i, f in enumerate(self.features)}
        used = [s for r in self.roots for s in splits(r)]
        self.codes = {f: {x: i + 1 for i, x in enumerate(sorted({x for s in used if s.feature == f for x in s.labels or ()}))} for f in labels}
        self.edges = {f: np.array(sorted({s.edge for s in used if s.feature == f})) for f in self.features if f not in self.codes}
        self.flat = [flatten(r, self.number, self._left_bins) for r in self.roots]
        self.splits = [splits(r) for r in self.roots]
        self._paths: list[list[_Path]] | None = None
        self._tables: list[np.ndarray | None] | None = None

    def _left_bins(self, n: Node) -> np.ndarray:
        if n.feature in self.codes:
            codes = self.codes[n.feature]
            out = np.zeros(len(codes) + 1, bool)
            out[[codes[x] for x in n.labels]] = True
            return out
        edges = self.edges[n.feature]
        return np.r_[n.missing_left, np.arange(len(edges) + 1) <= int(np.searchsorted(edges, n.edge))]

    def bins(self, columns: Sequence[Sequence]) -> np.ndarray:
        """Features x rows, from a column for each feature: numbers as doubles, labels as texts, null or not a number where missing."""
        out = np.zeros((len(self.features), len(columns[0])), np.intp)
        for i, (f, c) in enumerate(zip(self.features, columns)):
            if f in self.codes:
                known = self.codes[f]
                out[i] = [known.get(x, 0) for x in c]
            else:
                x = np.asarray(c, np.float64)
                out[i] = np.where(np.isnan(x), 0, 1 + np.searchsorted(self.edges[f], x, side="left"))
        return out

    def margins(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.base)
        for t in self.flat:
            out += t.value[t.leaf_of(bins)]
        return out

    def prefixes(self, bins: np.ndarray) -> np.ndarray:
        """Rows x trees: the margin after each tree."""
        if not self.flat:
            return np.zeros((bins.shape[1], 0))
        return self.base + np.cumsum(np.stack([t.value[t.leaf_of(bins)] for t in self.flat], axis=1), axis=1)

    @property
    def expected(self) -> float:
        return self.base + sum(expected(r) for r in self.roots)

    def paths(self) -> list[list[_Path]]:
        if self._paths is None:
            self._paths = []
            for root, nodes in zip(self.roots, self.splits):
                place, mine = {id(s): i for i, s in enumerate(nodes)}, []
                for leaf, path in leaves(root):
                    tests: dict[int, list[tuple[int, bool]]] = {}
                    share: dict[int, float] = {}
                    for node, left in path:
                        f = self.number[node.feature]
                        tests.setdefault(f, []).append((place[id(node)], left))
                        share[f] = share.get(f, 1.0) * (node.left if left else node.right).cover / max(node.cover, 1.0)
                    fs, d = list(tests), len(tests)
                    table = None
                    if 0 < d <= PATTERN_BITS:
                        every = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
                        table = leaf.value * path_shares(every.astype(float), [share[f] for f in fs])
                    mine.append(_Path(leaf.value, fs, [tests[f] for f in fs], [share[f] for f in fs], table))
                self._paths.append(mine)
        return self._paths

    def _attributed(self, goes: np.ndarray, paths: Sequence[_Path]) -> np.ndarray:
        """Features x rows: one tree's values, from which rows (splits x rows) go left."""
        out = np.zeros((len(self.features), goes.shape[1]))
        for p in paths:
            if not p.features:
                continue
            met = []
            for tests in p.tests:
                ok = np.ones(goes.shape[1], bool)
                for at, left in tests:
                    ok &= goes[at] == left
                met.append(ok)
            if p.table is not None:
                pattern = np.zeros(goes.shape[1], np.int32)
                for k, ok in enumerate(met):
                    pattern |= ok.astype(np.int32) << k
                worth = p.table[pattern]
            else:
                worth = p.value * path_shares(np.stack(met, axis=1).astype(float), p.share)
            out[p.features] += worth.T
        return out

    def attributions(self, bins: np.ndarray) -> np.ndarray:
        """Rows x features: path-dependent Shapley values of the margin; with expected they add up to it."""
        if self._tables is None:  # small trees: the values of every outcome of their splits
            self._tables = []
            for flat, nodes, paths in zip(self.flat, self.splits, self.paths()):
                small = flat.bits is not None and len(nodes)
                every = (np.arange(1 << len(nodes)) >> np.arange(len(nodes))[:, None]) & 1 if small else None
                self._tables.append(self._attributed(every.astype(bool), paths) if small else None)
        out = np.zeros(bins.shape)
        for flat, nodes, paths, table in zip(self.flat, self.splits, self.paths(), self._tables):
            if not nodes:
                continue
            if table is None:
                out += self._attributed(np.stack([self._left_bins(s)[bins[self.number[s.feature]]] for s in nodes], axis=0), paths)
                continue
            outcome = flat.outcomes(bins)
            for i in sorted({self.number[s.feature] for s in nodes}):
                out[i] += table[i][outcome]
        return out.T
