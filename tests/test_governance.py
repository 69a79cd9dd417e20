"""Rules, tails, encoders, exact quantiles and score buckets against plain values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import clean, special
from lodestat.operators import governance as gov
from lodestat.operators import rank, stability


def test_tails_have_known_values(spark):
    assert special.chi2_sf(spark, 145.725, 10) == pytest.approx(2.82e-26, rel=1e-2)
    assert special.binomial_at_least(spark, 8, 10, 0.5) == pytest.approx(56 / 1024)
    assert special.binomial_at_least(spark, 0, 10, 0.5) == 1.0
    x = (np.arange(200_000) + 0.5) / 200_000
    density = x**2.5 * (1 - x) ** 6.5
    assert special.jeffreys(spark, 3, 10, 0.4) == pytest.approx(density[x <= 0.4].sum() / density.sum(), abs=1e-4)
    t = gov.group_tails(spark.createDataFrame([("a", 10, 8, 0.5, 1.9), ("b", 4, 0, 0.0, None)], "g string, n long, bads long, mean_pd double, z double")).orderBy("g").collect()
    assert t[0]["p_exact"] == pytest.approx(56 / 1024) and t[1]["p_exact"] is None and t[0]["p_normal"] == pytest.approx(0.0287, abs=1e-4)
    with pytest.raises(ValueError):
        gov.with_tails(spark.range(gov.MOST_ROWS + 5), {})


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(8)
    for x in (rng.normal(size=9973), rng.integers(0, 5, 5000).astype(float), np.array([3.0]), np.array([1.0, 2.0]), np.full(400, 7.0), np.arange(8.0)):
        df = spark.createDataFrame([(float(v), None) for v in x] + [(None, None)], "a double, b double").repartition(3)
        at = [0.0, 0.01, 0.1, 0.3, 0.5, 0.75, 0.9, 1.0]
        got = stability.exact_quantiles(df, ["a", "b"], at)
        assert got["b"] == [] and np.allclose(got["a"], np.quantile(x, at), rtol=1e-12)
    assert stability.exact_quantiles(spark.createDataFrame([], "a double"), ["a"], [0.5]) == {"a": []}


def test_coarse_sketches_still_give_exact_quantiles(spark, monkeypatch):
    monkeypatch.setattr(stability, "ACCURACY", 50)
    x = np.random.default_rng(1).lognormal(size=20_000)
    got = stability.exact_quantiles(spark.createDataFrame([(float(v),) for v in x], "a double"), ["a"], [0.05, 0.5, 0.95])
    assert np.allclose(got["a"], np.quantile(x, [0.05, 0.5, 0.95]), rtol=1e-12)


def test_score_buckets_follow_the_scores(spark):
    x = sorted([0.0, 1e-300, -1e-300, 1e300, *np.random.default_rng(2).normal(0, 300, 3000), *np.linspace(300, 850, 3000), *np.linspace(0, 1, 3000)])
    got = [r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").orderBy("i").select(rank._bucket(F.col("x"))).collect()]
    assert got == sorted(got) and len(set(got)) > 4000
    y = (np.arange(6000) % 7 == 0).astype(int)
    points = np.linspace(300, 850, 6000)
    r = rank.discrimination(spark.createDataFrame(list(zip(y.tolist(), points.tolist(), strict=True)), "y int, p double"), "y", "p").first()
    pos, neg = points[y == 1], points[y == 0]
    assert r["auc"] == pytest.approx((pos[:, None] > neg[None]).mean(), abs=1e-9)


def test_rules_and_encoders(spark):
    with pytest.raises(ValueError, match="status"):
        gov.assert_no_leakage(["a", "status"], {"status", "y"})
    gov.assert_no_leakage(["a"], {"status"})
    df = spark.createDataFrame([("b", "2024-01-01"), ("a", "2024-01-01"), (None, "2024-01-01"), ("z", None)], "c string, d string")
    e = gov.learn_encoder(df.where("c <> 'z'"), "c")
    assert e.labels == ("a", "b") and [r[0] for r in df.select(e.code()).collect()] == [1, 0, None, None]
    assert [tuple(r) for r in df.select(*e.one_hot().values()).collect()] == [(0, 1), (1, 0), (0, 0), (0, 0)]
    with pytest.raises(ValueError):
        gov.learn_encoder(df, "c", most=2)
    out, missing = gov.aligned(df, ["c", "q"])
    assert missing == ["q"] and {r["q"] for r in out.collect()} == {0}
    assert gov.resolve(["Id", "Loan_Amnt"], ["amount", "loan_amnt"]) == "Loan_Amnt" and gov.resolve([], ["a"]) is None
    assert [gov.interval_label(None, 1.5), gov.interval_label(2.0, None), gov.interval_label(1.0, 2.5)] == ["<= 1.5", "> 2", "(1, 2.5]"]
    assert gov.threshold_text(("high", 0.3, 0.2)) == "Green >= 0.3; Amber >= 0.2" and gov.threshold_text(("low", 0.1, 0.25)) == "Green <= 0.1; Amber <= 0.25"
    d = spark.sql("select to_date('2062-03-01') e, to_date('2010-01-01') i union all select to_date('1999-03-01'), to_date('2010-01-01') union all select to_date('2062-03-01'), null")
    assert [str(r[0]) for r in d.select(clean.fix_century(F.col("e"), F.col("i"))).collect()] == ["1962-03-01", "1999-03-01", "2062-03-01"]
    t = spark.createDataFrame([("AUTO-loans x",), ("it",), ("item",), ("none",)], "t string").select(gov.area_of(F.col("t"), [(("auto",), "A"), (("it",), "B")], "O")).collect()
    assert [r[0] for r in t] == ["A", "B", "O", "O"]
    lights = spark.createDataFrame([(None, 0.1), (-0.1, 0.01), (0.1, 0.01), (0.1, 0.3), (0.1, None)], "d double, p double").select(gov.beats_light(F.col("d"), F.col("p"))).collect()
    assert [r[0] for r in lights] == ["n/a", "Red", "Green", "Amber", "Amber"]
    assert gov.fraction_sample(spark.range(1000), "id", 1.0).count() == 1000 and 130 < gov.fraction_sample(spark.range(1000), "id", 0.2).count() < 270
