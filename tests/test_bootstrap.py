import hashlib
import os

import numpy as np
import pytest

from lodestat.operators import benchmark, resampling
from lodestat.plans import battery, modelling  # noqa: F401
from lodestat.plans.lens import accounts

SF = "/root/testdata/sf0.001"


def _plain(rows):
    """AUC, Gini and KS of every draw and score: the tree of binomial draws, then each bucket's rows in the order of their digests."""
    digest = lambda r: hashlib.md5(f"0:{r['id']}".encode()).hexdigest()
    count = 1
    while count < -(-len(rows) // resampling.BUCKET_ROWS):
        count *= 2
    held = [[] for _ in range(count)]
    for r in sorted(rows, key=digest):
        held[int(digest(r)[:8], 16) % count].append(r)

    def down(got, lo, hi, node):
        if hi - lo == 1:
            return {lo: got}
        mid, total = (lo + hi) // 2, sum(len(b) for b in held[lo:hi])
        left = np.random.default_rng([0, node]).binomial(got, sum(len(b) for b in held[lo:mid]) / total)
        return down(left, lo, mid, 2 * node) | down(got - left, mid, hi, 2 * node + 1)

    got = down(np.full(resampling.DRAWS, len(rows)), 0, count, 1)
    weights = np.concatenate([np.random.default_rng([0, i, 1]).multinomial(got[i], np.full(len(b), 1 / len(b))) for i, b in enumerate(held) if b], axis=1)
    assert (weights.sum(axis=1) == len(rows)).all()
    rows = [r for b in held for r in b]
    out = {}
    for d, w in enumerate(weights):
        for m in ("p", "p2"):
            _, at = np.unique([r[m] for r in rows], return_inverse=True)
            y = np.array([r["y"] for r in rows])
            bad, good = np.bincount(at, w * y), np.bincount(at, w * (1 - y))
            cb, cg = np.cumsum(bad), np.cumsum(good)
            auc = (bad * (cg - good / 2)).sum() / (cb[-1] * cg[-1])
            out[m, d] = {"auc": auc, "gini": 2 * auc - 1, "ks": np.abs(cb / cb[-1] - cg / cg[-1]).max()}
    return out


def test_draws_take_exactly_as_many_rows_as_there_are(spark):
    df = spark.range(3000).selectExpr("id", "id % 7 as k").union(spark.createDataFrame([(5, 9), (5, 8)], "id long, k long"))
    got = resampling.with_replacement(df.repartition(5), "id", 40, seed=3)
    rows = {(r["id"], r["k"]): r["taken"] for r in got.collect()}
    w = np.array(list(rows.values()))
    assert w.shape == (3002, 40) and (w.sum(axis=0) == 3002).all()
    assert abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w.T)[np.triu_indices(40, 1)]).max() < 0.1
    again = {(r["id"], r["k"]): r["taken"] for r in resampling.with_replacement(df.repartition(2), "id", 40, seed=3).collect()}
    assert rows == again
    assert resampling.with_replacement(df.limit(0), "id", 4).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_registered_bootstraps_run_all_draws_on_all_rows(spark):
    rows = accounts(spark, SF).select("id", "y", "p", "p2").dropna().collect()
    assert len(rows) <= resampling.ROW_CAP
    want = _plain(rows)
    lo, hi = (100 * x for x in resampling.LIMITS)
    got = {(r["model"], r["metric"]): r for r in battery.QUERIES["v6_bootstrap_ci_whole"](spark, SF).collect()}
    assert set(got) == {(m, k) for m in ("p", "p2") for k in ("auc", "gini", "ks")}
    for (m, k), r in got.items():
        v = [want[m, d][k] for d in range(500)]
        assert r["draws"] == 500 and (r["lo"], r["hi"]) == pytest.approx(np.percentile(v, [lo, hi]), abs=2e-6)
    d = [want["p", i]["auc"] - want["p2", i]["auc"] for i in range(500)]
    r = battery.QUERIES["v7_bootstrap_difference"](spark, SF).first()
    assert r["draws"] == 500 and (r["lo"], r["hi"], r["mean"]) == pytest.approx((*np.percentile(d, [lo, hi]), np.mean(d)), abs=2e-6)


def test_parts_sum_to_the_same_draws(spark, monkeypatch):
    """With ties that span blocks, copies of ids, missing scores, and parts of few rows; a table of one class has no AUC, an empty one no draws."""
    monkeypatch.setattr(resampling, "PART_ROWS", 200)
    df = spark.range(9000).selectExpr("id % 8900 as id", "cast(xxhash64(id, 1) % 5 = 0 as int) as y", "case when id % 40 > 0 then xxhash64(id, 2) / 1e18 end as a", "cast(id % 3 as int) as b")
    get = lambda t: {(r["draw"], r["model"]): r["auc"] for r in t.collect()}
    got = get(resampling.aucs(df.repartition(5), "y", ["a", "b"], "id", 70, seed=3))
    assert len(got) == 140 and got == get(resampling.replicates(df, "y", ["a", "b"], "id", 70, seed=3))
    assert get(resampling.aucs(df.where("y = 0"), "y", ["b"], "id", 3)) == {(d, "b"): None for d in range(3)}
    assert get(resampling.aucs(df.limit(0), "y", ["b"], "id", 3)) == {}


def test_benchmark_intervals_come_from_all_rows(spark):
    """Beyond 50,000 rows; and a pair keeps the rows that lack the score of another pair."""
    df = spark.range(52_000).selectExpr("id", "1 as split", "cast(xxhash64(id, 1) % 5 = 0 as int) as y", "xxhash64(id, 2) / 1e18 as a", "cast(id % 30 as double) as b", "case when id % 4 > 0 then cast(id % 7 as double) end as c").repartition(4)
    pairs = {"ab": ("a", "b"), "ac": ("a", "c"), "ba": ("b", "a")}
    got = {r["pair"]: r for r in benchmark.interval_rows(df, "y", pairs, "split", (1,), "id", draws=4).collect()}
    for name, p in pairs.items():
        want = resampling.paired_difference(resampling.replicates(df.select("id", "y", *p), "y", p, "id", 4), *p).first()
        assert (got[name]["lo"], got[name]["hi"], got[name]["draws"]) == (want["lo"], want["hi"], 4)
    assert got["ab"]["lo"] == pytest.approx(-got["ba"]["hi"])
