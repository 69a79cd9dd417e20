import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import binning, loss, recovery, stability

LEVELS = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]


@pytest.mark.parametrize("small", [100_000, 50])
def test_quantiles_of_groups_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(stability, "SMALL", small)
    monkeypatch.setattr(stability, "ACCURACY", small)
    r = np.random.default_rng(3)
    rows = [("a", float(v)) for v in r.normal(size=4000)] + [("b", float(v)) for v in r.integers(0, 5, 700)] + [(None, 1.5), (None, -2.0), ("one", 3.0), ("none", None)] + [("ties", 7.0)] * 500
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {(q["g"], q["level"]): q["value"] for q in stability.grouped_quantiles(df, "x", ["g"], LEVELS).collect()}
    assert {g for g, _ in got} == {"a", "b", None, "one", "ties"}
    for (g, p), v in got.items():
        assert v == pytest.approx(np.quantile([x for k, x in rows if k == g], p), abs=1e-12)
    assert stability.grouped_quantiles(df.limit(0), "x", ["g"], LEVELS).collect() == []


def test_lower_quantiles_take_elements(spark):
    r = np.random.default_rng(4)
    x, z = r.normal(size=999), r.integers(0, 9, 999)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, z)] + [(None, None)], "x double, z int")
    got = binning.lower_quantiles(df, ["x", "z"], [0.1, 0.5, 0.9])
    for c, v in (("x", x), ("z", z)):
        assert got[c] == sorted(set(np.quantile(v, [0.1, 0.5, 0.9], method="lower")))


def test_average_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 613).alias("v"))
    ranks = {r["v"]: r["k"] for r in loss.average_ranks(df.repartition(7), "v", "k").distinct().collect()}
    order = np.sort([i * 7919 % 613 for i in range(5000)])
    assert all(k == (np.searchsorted(order, v) + np.searchsorted(order, v, "right") + 1) / 2 for v, k in ranks.items())


def test_a_probability_of_one_half_is_no_class(spark):
    df = spark.createDataFrame([(0.5, 0), (0.5, 1), (0.51, 1), (0.49, 0)], "p double, a int")
    assert recovery.class_agreement(df, "a", "p").first()["hit_rate"] == 0.75


def test_quantiles_of_many_levels_are_exact_and_test_no_row_for_each(spark, monkeypatch):
    monkeypatch.setattr(stability, "ACCURACY", 200)
    r = np.random.default_rng(5)
    x, z = r.normal(size=6000), r.integers(0, 4, 6000).astype(float)
    df = spark.createDataFrame([(float(a), float(b) if i % 9 else None) for i, (a, b) in enumerate(zip(x, z))] + [(None, None)], "x double, z double").repartition(4)
    ran, agg = [], type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *c: ran.append(len(c)) or agg(self, *c))
    at = [i / 32 for i in range(1, 32)]
    got = stability.exact_quantiles(df, ["x", "z"], at)
    for c, v in (("x", x), ("z", [b for i, b in enumerate(z) if i % 9])):
        assert got[c] == pytest.approx(list(np.quantile(v, at)), abs=1e-12)
    assert ran and max(ran) < 31


def test_a_loss_model_works_its_rows_out_once(spark):
    worked = spark.sparkContext.accumulator(0)

    def count(x: float) -> float:
        worked.add(1)
        return x

    r = np.random.default_rng(6)
    rows = [(float(a), float(b), float(max(0.0, c)), float(abs(c) % 1), "uvw"[i % 3]) for i, (a, b, c) in enumerate(r.normal(size=(300, 3)))]
    df = spark.createDataFrame(rows, "a double, b double, rr double, ccf double, g string").withColumn("a", F.udf(count, "double")("a"))
    recovery.fit_loss_model(df, "rr", "ccf", ["a", "b"], ["g"])
    assert worked.value == 300


def test_variants_of_bins_share_their_first_bins(spark, monkeypatch):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(float(x), int(x + e > 0.3)) for x, e in r.normal(size=(2000, 2))] + [(None, 1)], "x double, y int")
    want = {k: binning.fit_numeric(df, ["x"], "y", min_share=k[0], max_bins=k[1])["x"] for k in ((0.03, 8), (0.1, 5))}
    first = binning.prebinned(df, ["x"], "y")
    monkeypatch.setattr(binning, "lower_quantiles", None)  # no pass after the first
    assert {k: binning.merged(first, *k)["x"] for k in want} == want
