"""Search of boosting settings over expanding time windows: train on all earlier years, validate on the next.

All draws and years are grown side by side, from all rows of the years before. A task grows each model and one look at the
validation rows serves many trees of all of them; beyond boosting.TASK_ROWS or TASK_CELLS, a level of all trees is one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import astuple, dataclass, fields
from functools import reduce
from math import exp, inf, log
from random import Random
from statistics import mean, median

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from . import boosting
from .resampling import capped_sample

#: Draws, trees without gain before a fit stops, most trees, and what the chosen number of trees grows by.
DRAWS, PATIENCE, MOST_TREES, GROWTH, LEAST_TREES = 8, 30, 500, 1.15, 20
#: Ranges of the draws; rate and ridge are uniform in their logarithm.
RATE, DEPTH, LEAVES, LEAST, ROWS, COLUMNS, RIDGE = (0.03, 0.15), (3, 6), (8, 48), (30, 300), (0.6, 1.0), (0.6, 1.0), (1.0, 30.0)
#: The two ways to grow: all splits down to a depth, where LEAST / 10 is a side's weight; or best gain first, where LEAST is a side's rows.
LEVEL, LEAF = "level", "leaf"


@dataclass(frozen=True)
class Setting:
    rate: float
    depth: int
    leaves: int
    least: int
    rows: float
    columns: float
    ridge: float

    def growth(self, kind: str, trees: int, seed: int = 0, patience: int | None = None) -> boosting.Growth:
        common = {"trees": trees, "rate": self.rate, "ridge": self.ridge, "rows": self.rows, "columns": self.columns, "seed": seed, "patience": patience}
        if kind == LEVEL:
            return boosting.Growth(depth=self.depth, least=self.least / 10, **common)
        return boosting.Growth(depth=None, leaves=self.leaves, least=1e-3, least_rows=self.least, **common)


@dataclass
class Trial:
    draw: int
    year: int
    rate: float
    depth: int
    leaves: int
    least: int
    rows: float
    columns: float
    ridge: float
    trees: int
    loss: float | None


@dataclass
class Search:
    trials: list[Trial]
    best: Setting
    trees: int

    def table(self, spark) -> DataFrame:  # noqa: ANN001
        """One row for each draw and year."""
        return spark.createDataFrame([astuple(t) for t in self.trials], "draw int, year int, rate double, depth int, leaves int, least int, rows double, columns double, ridge double, trees int, loss double").select(*[f.name for f in fields(Trial)])


def settings(draws: int = DRAWS, seed: int = 0) -> list[Setting]:
    """Random settings; the same for a seed."""
    r = Random(seed)
    wide = lambda lo, hi: round(exp(r.uniform(log(lo), log(hi))), 6)
    return [Setting(wide(*RATE), r.randint(*DEPTH), r.randint(*LEAVES), r.randint(*LEAST), round(r.uniform(*ROWS), 6), round(r.uniform(*COLUMNS), 6), wide(*RIDGE)) for _ in range(draws)]


def expanding_search(
    df: DataFrame, y: str, features: Sequence[str], year: str, row_id: str, validate: Sequence[int], draws: int = DRAWS, most_trees: int = MOST_TREES, seed: int = 0, row_cap: int | None = None,
    signs: Mapping[str, int] | None = None, patience: int = PATIENCE, labels: Sequence[str] = (), kind: str = LEVEL,
) -> Search:
    """Fit every setting on the years before each validation year, stop where the validation loss is least, keep the least mean loss.

    A fold's training rows are all those of earlier years; a caller's row_cap takes that many of smallest digest. The final
    number of trees is the best setting's median over the folds, grown for the longer history. Of equal settings the
    first drawn wins; a fold with one class, or without rows, does not count.
    """
    sides = stored(df.where(F.col(y).isNotNull() & F.col(year).isNotNull()).select(*dict.fromkeys([row_id, year, y, *features])), "search-rows")
    marked, inside = sides, {v: F.col(year) < v for v in validate}
    if row_cap is not None and validate:  # the ids that each fold's cap lets through, worked out once; so that a fold is a condition on the one table
        caps = [capped_sample(sides.where(inside[v]).select(row_id), row_id, row_cap, seed).select(row_id, F.lit(v).alias("__v")) for v in validate]
        of_id = [F.max(F.col("__v") == v).alias(f"__in_{v}") for v in validate]
        marked = sides.join(stored(reduce(DataFrame.union, caps).groupBy(row_id).agg(*of_id), "search-caps"), row_id, "left")
        inside = {v: inside[v] & F.coalesce(F.col(f"__in_{v}"), F.lit(False)) for v in validate}
    counted = marked.agg(*[F.count_distinct(F.when(inside[v], F.col(y))).alias(f"t{v}") for v in validate], *[F.count_distinct(F.when(F.col(year) == v, F.col(y))).alias(f"v{v}") for v in validate]).first()
    used = [v for v in validate if counted[f"t{v}"] > 1 and counted[f"v{v}"] > 1]
    tried = settings(draws, seed)
    folds = [boosting.Fold(inside[v], F.col(year) == v) for v in used]
    jobs = [(s.growth(kind, most_trees, seed, patience), k) for k in range(len(used)) for s in tried]
    models = boosting.grow(marked, y, features, jobs, folds, labels, row_id, signs=signs, apart=True) if jobs else []
    trials = [Trial(i, used[k], *astuple(tried[i]), len(m.trees), min(m.losses, default=None)) for (k, i), m in zip([(k, i) for k in range(len(used)) for i in range(len(tried))], models)]
    score = lambda i: mean([t.loss for t in trials if t.draw == i and t.loss is not None] or [inf])
    best = min(range(len(tried)), key=lambda i: (score(i), i))
    return Search(trials, tried[best], max(LEAST_TREES, int(median([t.trees for t in trials if t.draw == best] or [0]) * GROWTH)))
