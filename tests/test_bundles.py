import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.operators import benchmark, bundles, calibrators, governance, rank, search
from lodestat.sources import models


@pytest.fixture(scope="module")
def loans(spark):
    r = np.random.default_rng(11)
    n = 1600
    a, b, g = r.normal(size=n), r.normal(size=n), r.choice(["u", "v", "w"], n)
    z = -0.3 + 1.2 * a - 0.8 * b + np.array([{"u": 0.9, "v": -0.9, "w": 0.0}[k] for k in g])
    y = (r.random(n) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(i, 2000 + i % 4, float(p), float(q) if i % 11 else None, str(k), int(c), int(c or i % 5 == 0)) for i, (p, q, k, c) in enumerate(zip(a, b, g, y))]
    return spark.createDataFrame(rows, "id long, year int, a double, b double, g string, y int, ever int").cache()


def test_a_run_has_six_models_in_order_that_read_back_whole(spark, loans, tmp_path):
    data = bundles.Data(loans.where("year < 2002"), loans.where("year = 2002"), loans.where("year = 2003"), loans, "y", "ever", "id", "year")
    design = bundles.DummyDesign({"a": [(-9, -0.5), (-0.5, 0.5), (0.5, 9)]}, {"g": {"uw": ["u", "w"], "v": ["v"]}}, ("a_-0.5_0.5", "g_v"))
    assert {"a_m9_m0p5", "g_uw"} <= set(design.columns()) and "a_m0p5_0p5" not in design.columns()
    setting = {k: (search.Setting(0.3, 2, 4, 20, 0.9, 1.0, 1.0), 8) for k in ("level", "leaf")}
    run = bundles.train_all(data, ["a", "b", "g"], ["a"], ["g"], design, {"a": 1}, ["ever"], settings=setting)
    assert tuple(run) == bundles.ORDER and run["full"].shift == 0 != run["recalibrated"].shift
    path = str(tmp_path / "run.json")
    models.save_bundles(spark, run, path, "loans")
    back = models.load_bundles(spark, path)
    assert list(back) == list(run)
    rows = loans
    for name in bundles.ORDER:
        rows = back[name].apply(run[name].apply(rows, f"was_{name}"))
    gap = rows.agg(*[F.max(F.abs(F.col(n) - F.col(f"was_{n}"))).alias(n) for n in bundles.ORDER]).first()
    assert max(gap) < 1e-12
    later = rows.where("year = 2003")
    assert later.agg(F.avg("recalibrated") - F.avg("y")).first()[0] == pytest.approx(0, abs=1e-6)
    auc = {n: rank.discrimination(later, "y", n).first()["auc"] for n in ("full", "independent", "level", "leaf")}
    assert min(auc.values()) > 0.65 and auc["full"] > auc["independent"]
    with pytest.raises(ValueError, match="not known"):
        bundles.train_all(data, ["a", "ever"], ["a"], [], design, forbidden=["ever"], settings=setting)
    with pytest.raises(ValueError, match="order"):
        models.save_bundles(spark, dict(reversed(run.items())), path, "loans")


def test_isotonic_steps_are_joined_by_lines(spark):
    steps = calibrators.Steps((0.2, 0.6), (0.1, 0.5))
    got = [r[0] for r in spark.createDataFrame([(0.0,), (0.4,), (0.9,), (None,)], "x double").select(steps.at(F.col("x")))  .collect()]
    assert got[:3] == pytest.approx([0.1, 0.3, 0.5]) and got[3] is None


def test_benchmark_table_has_every_pair_on_every_split(spark, loans):
    rows = loans.withColumns({"good": F.col("a"), "noise": F.rand(1)})
    got = benchmark.benchmark_table(rows, "y", {"good against noise": ("good", "noise"), "same": ("good", "good")}, "year", (2002, 2003), "id", draws=60).collect()
    assert {(r["split"], r["pair"]) for r in got} == {(s, p) for s in (2002, 2003) for p in ("good against noise", "same")}
    for r in got:
        if r["pair"] == "same":
            assert (r["d_auc"], r["delong_z"], r["lo"], r["hi"], r["light"]) == (0, None, 0, 0, "Red")
        else:
            assert 0 < r["lo"] < r["d_auc"] < r["hi"] and r["delong_p"] < 0.001 and r["light"] == "Green" and r["draws"] == 60


def test_digest_shares_are_even(spark):
    s = governance.with_digest_share(spark.range(4000), "id").agg(F.avg("__share"), F.min("__share"), F.max("__share")).first()
    assert abs(s[0] - 0.5) < 0.02 and 0 <= s[1] < 0.01 and 0.99 < s[2] < 1
