"""Toxicity by a logistic classifier that is regularised by counterfactuals.

Identity terms in labelled sentences are swapped for others of their group, and what such a swap changes in a score is
penalised, so that a mention of a group alone does not make a text toxic. Features are the words that a text holds and
their first letters, those that tell most of the label.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Bounds of the training sample: labelled texts of each label, those of smallest hash. Rows beyond it change the weights of the two labels alone.
SAMPLE = 10_000
#: Features that are chosen, texts that one must be in, lengths of word beginnings.
FEATURES, LEAST_TEXTS, BEGINNINGS = 512, 4, (4, 5, 6)
#: Strength of the ridge, and of the counterfactual penalty for each training row.
RIDGE, PENALTY = 0.1, 1.0
#: Steps of Newton's method at most, and the change that ends them.
STEPS, ENOUGH = 50, 1e-6
#: Different words of a task that are remembered at once.
REMEMBERED = 500_000
#: Terms of one group may stand for each other. Users give their own.
IDENTITY_GROUPS: Mapping[str, Sequence[str]] = {
    "gender": ("women", "men", "girls", "boys"), "gender one": ("woman", "man", "girl", "boy"), "faith": ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    "faith one": ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), "orientation": ("gay", "lesbian", "straight", "bisexual", "transgender"), "colour": ("black", "white", "asian", "latino", "indigenous"),
    "origin": ("immigrants", "refugees", "foreigners", "locals", "natives"), "ability": ("disabled", "deaf", "blind", "autistic"), "age": ("old", "young", "elderly"),
    "de": ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge", "behinderte"), "fr": ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "handicapés"),
    "es": ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "discapacitados"),
}

WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n\r]+")


def features_of(word: str) -> list[str]:
    """A word in lower case, marked, and its first letters, where it has more."""
    return ["=" + word, *[word[:k] for k in BEGINNINGS if len(word) > k]]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Numbers of features, their weights, and the weight of every text."""

    numbers: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    base: float = -40.0

    def score(self, found: Sequence[int]) -> float:
        m = self.base + float(self.weights[list(found)].sum())
        return 1 / (1 + exp(-m)) if m >= 0 else exp(max(m, -700.0)) / (1 + exp(max(m, -700.0)))


class Lookup:
    """The known features of words, remembered for words that have been seen."""

    def __init__(self, numbers: Mapping[str, int]):
        self.numbers, self.known = numbers, {}

    def of(self, words: set[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        out: set[int] = set()
        for w in words:
            got = self.known.get(w)
            if got is None:
                got = self.known[w] = tuple(self.numbers[f] for f in features_of(w) if f in self.numbers)
            out.update(got)
        return sorted(out)


def labelled(docs: DataFrame, labels: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> tuple[DataFrame, dict[int, int]]:
    """(y, t, times), the different texts of at most sample ids for each label; and how many labelled texts each label has in all.

    Ids alone meet the labels first; the texts of the ids that are chosen, by hash, follow. An id with several labels is toxic
    if one of them says so; of an id with several texts each counts; null ids, labels and texts take no part.
    """
    told = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    ids = docs.where(train & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id")).groupBy("id").agg(F.count("*").alias("copies")).join(told, "id")
    counts = {r["y"]: r["n"] for r in ids.groupBy("y").agg(F.sum("copies").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        some = ids.where(F.col("y") == y).select("id", "y", F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")).alias("h")).orderBy("h", "id").limit(sample)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(chosen), "id")  # at most 2 * sample ids
    rows = texts.groupBy("id", "y", F.xxhash64("t").alias("of")).agg(F.first("t").alias("t"), F.count("*").alias("times"))
    return rows.select("y", "t", "times"), counts


def choose_features(rows: DataFrame, groups: Mapping[str, Sequence[str]] = IDENTITY_GROUPS, most: int = FEATURES) -> dict[str, int]:
    """Numbers of the features that toxic texts hold more often than others, by chi-squared, and of all identity terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = Counter(), Counter()

        def sent() -> pa.RecordBatch:
            names = sorted(n[0].keys() | n[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[0][f] for f in names], pa.int64()), pa.array([n[1][f] for f in names], pa.int64())], names=["f", "n0", "n1"])
            n[0].clear()
            n[1].clear()
            return out

        for b in slices(batches):
            for y, t, times in zip(*[b.column(i).to_pylist() for i in range(3)]):
                for f in {f for w in words_of(t) for f in features_of(w)}:
                    n[y][f] += times
                if len(n[0]) + len(n[1]) > REMEMBERED:
                    yield sent()
        if n[0] or n[1]:
            yield sent()

    total = rows.groupBy().agg(F.sum(F.when(F.col("y") == 0, F.col("times"))).alias("m0"), F.sum(F.when(F.col("y") == 1, F.col("times"))).alias("m1"))
    by = rows.select("y", "t", "times").mapInArrow(run, "f string, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = F.col("m1") / (F.col("m0") + F.col("m1"))
    expected = (F.col("n0") + F.col("n1")) * share
    gain = (F.col("n1") - expected) * (F.col("n1") - expected) / (expected * (1 - share))
    good = by.where(F.col("n0") + F.col("n1") >= LEAST_TEXTS).crossJoin(F.broadcast(total)).where(F.col("n1") > expected)  # one row
    found = [r["f"] for r in good.select("f", gain.alias("gain")).orderBy(F.col("gain").desc(), "f").limit(most).collect()]
    terms = [f"={t}" for g in sorted(groups) for t in groups[g]]
    return {f: i for i, f in enumerate(dict.fromkeys(found + terms))}


def examples(rows: DataFrame, numbers: Mapping[str, int]) -> DataFrame:
    """(y, found, n): labelled texts as the features that they hold; those that hold the same ones are counted once."""
    shared = rows.sparkSession.sparkContext.broadcast(dict(numbers))  # FEATURES and the identity terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(shared.value)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([look.of(words_of(t)) for t in b.column(1).to_pylist()], pa.list_(pa.int32())), b.column(2)], names=["y", "found", "n"])

    return rows.select("y", "t", "times").mapInArrow(run, "y int, found array<int>, n long").groupBy("y", "found").agg(F.sum("n").alias("n"))


def swaps(sentence: str, groups: Mapping[str, Sequence[str]]) -> Iterator[str]:
    """The sentence with each of its identity terms, wherever it stands, exchanged for each other of its group."""
    low = sentence.lower()
    held = set(WORD.findall(low))
    for terms in groups.values():
        for term in terms:
            if term in held:
                for other in terms:
                    if other != term:
                        yield re.sub(rf"(?<![^\W\d_]){re.escape(term)}(?![^\W\d_])", other, low)


def counterfactuals(rows: DataFrame, numbers: Mapping[str, int], groups: Mapping[str, Sequence[str]] = IDENTITY_GROUPS) -> DataFrame:
    """(gone, come, n): what swaps of identity terms in labelled sentences take from the features and add to them."""
    shared = rows.sparkSession.sparkContext.broadcast((dict(numbers), {k: tuple(v) for k, v in groups.items()}))  # FEATURES and the identity terms
    terms = {t for v in groups.values() for t in v}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = shared.value
        look = Lookup(known)
        for b in slices(batches):
            out: Counter = Counter()
            for t, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if terms.isdisjoint(words_of(t)):
                    continue
                for s in SENTENCE.split(t):
                    before = set(look.of(words_of(s)))
                    for other in swaps(s, parts):
                        after = set(look.of(words_of(other)))
                        out[tuple(sorted(before - after)), tuple(sorted(after - before))] += times
            keys = [k for k in out if k[0] or k[1]]
            yield pa.RecordBatch.from_arrays([pa.array([list(k[i]) for k in keys], pa.list_(pa.int32())) for i in (0, 1)] + [pa.array([out[k] for k in keys], pa.int64())], names=["gone", "come", "n"])

    return rows.select("t", "times").mapInArrow(run, "gone array<int>, come array<int>, n long").groupBy("gone", "come").agg(F.sum("n").alias("n"))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray, changes: np.ndarray, times: np.ndarray, ridge: float = RIDGE, penalty: float = PENALTY) -> np.ndarray:
    """Weights, the base last, of least weighted log loss + ridge + penalty on what counterfactual changes do to the margin; Newton's method with halved steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    d = x.shape[1]
    fixed = np.eye(d) * ridge
    fixed[-1, -1] = 1e-9
    if len(changes):
        c = np.hstack([changes, np.zeros((len(changes), 1))])
        fixed += penalty * n.sum() * (c * (times / times.sum())[:, None]).T @ c
    rate = min(1 - 1e-9, max(1e-9, (n * y).sum() / n.sum()))
    w = np.zeros(d)
    w[-1] = log(rate / (1 - rate))
    loss = lambda w: float((n * np.logaddexp(0, np.where(y > 0, -1.0, 1.0) * (x @ w))).sum() + w @ fixed @ w / 2)
    now = loss(w)
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -700, 700)))
        g = x.T @ (n * (p - y)) + fixed @ w
        h = fixed.copy()
        for lo in range(0, len(x), 4096):
            part = x[lo : lo + 4096]
            h += (part * (n * p * (1 - p))[lo : lo + 4096, None]).T @ part
        step = np.linalg.solve(h + 1e-9 * np.eye(d), g)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > now:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
        now = loss(w)
        if np.abs(size * step).max() < ENOUGH:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, train: Column, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", groups: Mapping[str, Sequence[str]] = IDENTITY_GROUPS, sample: int = SAMPLE, ridge: float = RIDGE, penalty: float = PENALTY) -> Model:
    """A model from labelled texts. Without any, every score is 0; with one label alone, every score is that label's smoothed rate.

    The weights are found in one task from at most 2 * sample rows of feature numbers, those of smallest hash, weighted
    so that the labels are as frequent as among all labelled texts.
    """
    rows, totals = labelled(docs, labels, train, text_col, id_col, label_col, sample)
    if len(totals) < 2:
        return Model(base=log((totals.get(1, 0) + 0.5) / (totals.get(0, 0) + 0.5)) if totals else Model.base)
    rows = stored(rows, "labelled")
    numbers = choose_features(rows, groups)
    size = len(numbers)
    seen = examples(rows, numbers).select(F.lit(0).alias("kind"), "y", F.col("found").alias("a"), F.expr("cast(array() as array<int>)").alias("b"), "n")
    seen = seen.withColumn("h", F.xxhash64("a", "y")).orderBy("h", "y", "a").limit(2 * sample).drop("h")
    pairs = counterfactuals(rows, numbers, groups).select(F.lit(1).alias("kind"), F.lit(0).alias("y"), F.col("gone").alias("a"), F.col("come").alias("b"), "n")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for b in batches for r in b.to_pylist()]
        if not held:
            return
        held.sort(key=lambda r: (r["kind"], r["y"], r["a"], r["b"]))
        ex, ch = [r for r in held if r["kind"] == 0], [r for r in held if r["kind"] == 1]

        def matrix(some: list, sides: tuple[tuple[str, float], ...]) -> np.ndarray:
            m = np.zeros((len(some), size))
            for i, r in enumerate(some):
                for k, v in sides:
                    m[i, r[k]] = v
            return m

        y = np.array([r["y"] for r in ex], float)
        n = np.array([r["n"] for r in ex], float)
        whole = n.sum()
        for k, total in totals.items():
            n[y == k] *= total / max(1.0, n[y == k].sum())
        n *= whole / n.sum()
        w = fit(matrix(ex, (("a", 1.0),)), y, n, matrix(ch, (("a", -1.0), ("b", 1.0))), np.array([r["n"] for r in ch], float), ridge, penalty)
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["w"])

    got = seen.unionByName(pairs).coalesce(1).mapInArrow(solve, "w array<double>").first()
    w = np.array(got["w"])
    return Model(numbers, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns in keep, and score (0 to 1) and predicted (1 from 0.5 on).

    Every text is read whole; null and empty ones hold no feature and have the base score; rows repeat as in the input;
    equal texts have equal scores; an empty table gives no rows; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES and the identity terms
    chosen = docs.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("t"))
    schema = ", ".join([f"k{i} {chosen.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        look = Lookup(m.numbers)
        for b in slices(batches):
            s = [m.score(look.of(words_of(t))) for t in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names=[*[f"k{i}" for i in range(len(keep))], "score", "predicted"])

    return chosen.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})
