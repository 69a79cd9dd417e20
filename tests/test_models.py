import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestat.functions import special
from lodestat.operators import boosting, calibrators, regression, resampling, scorecard, trees
from lodestat.operators.regression import Fit


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 2))
    y = (r.random(600) < 1 / (1 + np.exp(-(0.4 + x[:, 0] - 0.5 * x[:, 1])))).astype(int)
    return x, y, spark.createDataFrame([(i, float(a), float(b) if i % 10 else None, int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y int").cache()


def _newton(x, y):
    d = np.c_[np.ones(len(x)), x]
    w = np.zeros(d.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-d @ w))
        w = w + np.linalg.solve(d.T @ (d * (p * (1 - p))[:, None]), d.T @ (y - p))
    p = 1 / (1 + np.exp(-d @ w))
    return w, np.sqrt(np.diag(np.linalg.inv(d.T @ (d * (p * (1 - p))[:, None]))))


def test_logit_is_the_newton_solution_and_dependent_columns_get_zero(rows):
    x, y, df = rows
    fit = regression.logit_fit(df.withColumns({"twice": 2 * F.col("a"), "one": F.lit(1.0)}), "y", ["a", "twice", "one"])
    w, se = _newton(x[:, :1], y)
    assert np.allclose([fit.intercept, fit.coef[0]], w, atol=1e-7) and np.allclose([fit.intercept_se, fit.se[0]], se, atol=1e-6)
    assert fit.coef[1:] == (0.0, 0.0)


def test_student_and_f_tails(spark):
    assert special.student_two_sided(spark, 2.0, 10) == pytest.approx(0.07338803477074, abs=1e-10)
    assert special.f_sf(spark, 4.0, 1, 10) == pytest.approx(special.student_two_sided(spark, 2.0, 10), abs=1e-12)


def test_recalibrated_mean_is_the_observed_rate(rows):
    _, y, df = rows
    shift = regression.recalibration_shift(df, "y", F.col("a"))
    assert df.agg(F.avg(1 / (1 + F.exp(-F.col("a") - shift)))).first()[0] == pytest.approx(y.mean(), abs=1e-8)


def test_scaling_and_pruning():
    factor, offset = scorecard.scaling()
    assert (round(factor, 4), round(offset, 4)) == (28.8539, 487.1229)
    corr = np.array([[1, 0.9, 0.1], [0.9, 1, 0.2], [0.1, 0.2, 1]])
    assert scorecard.prune_correlated(["a", "b", "c"], corr, {"a": 0.1, "b": 0.2, "c": 0.3}) == (["b", "c"], ["a"])
    assert scorecard.vifs(np.eye(1)) == [1.0]


def test_boosting_learns_keeps_its_sign_and_adds_up(rows):
    _, y, df = rows
    model = boosting.fit(df, "y", ["a", "b"], trees=5, depth=3, store_every=2, signs={"a": 1})
    out = boosting.with_shap(df, model)
    assert boosting.additivity(out, model).first()[0] < 1e-9
    p = np.array([r[0] for r in df.orderBy("id").select(model.probability()).collect()])
    assert ((p - y) ** 2).mean() < y.mean() * (1 - y.mean()) * 0.95
    line = [r[0] for r in df.sparkSession.range(-30, 31).select("id", (F.col("id") / 10).alias("a"), F.lit(0.3).alias("b")).orderBy("id").select(model.margin()).collect()]
    assert all(u <= v + 1e-12 for u, v in zip(line, line[1:]))


def test_shap_is_the_shapley_value_of_a_small_tree(spark):
    tree = boosting.Node(0.0, 10.0, feature="a", edge=0.0, left=boosting.Node(1.0, 4.0), right=boosting.Node(0.0, 6.0, feature="b", edge=0.0, left=boosting.Node(2.0, 3.0), right=boosting.Node(5.0, 3.0)))
    got = boosting.with_shap(spark.createDataFrame([(1.0, 1.0)], "a double, b double"), boosting.Boosted(["a", "b"], 0.0, [tree])).first()
    none, only_a, only_b, both = 0.4 * 1 + 0.6 * 3.5, 3.5, 0.4 * 1 + 0.6 * 5, 5.0
    assert got["shap_base"] == pytest.approx(none)
    assert got["shap_a"] == pytest.approx(((only_a - none) + (both - only_b)) / 2)
    assert got["shap_b"] == pytest.approx(((only_b - none) + (both - only_a)) / 2)


def test_isotonic_is_monotone_and_clamps(rows):
    _, _, df = rows
    c = calibrators.isotonic(df, "y", F.col("a"))
    v = [r[0] for r in c.apply(df.sparkSession.range(-9, 10).select(F.col("id").cast("double").alias("a")), F.col("a")).orderBy("a").select("calibrated").collect()]
    assert all(x <= y for x, y in zip(v, v[1:])) and v[0] >= 1e-6 and v[-1] <= 1 - 1e-6
    assert calibrators.choose(df, "y", F.col("a"), "id").kind in ("platt", "isotonic")


def test_poisson_weights_have_mean_and_variance_one(spark):
    w = spark.range(20000).select(resampling.poisson_weight(F.md5(F.col("id").cast("string")), 1).alias("w")).agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(w[0] - 1) < 0.03 and abs(w[1] - 1) < 0.05


def test_margin_of_a_fit(spark):
    fit = Fit(("a",), (2.0,), (1.0,), -1.0, 1.0, 5)
    assert spark.range(1).select(F.lit(3.0).alias("a")).select(fit.probability()).first()[0] == pytest.approx(1 / (1 + math.exp(-5)))


def _subset_formula(model, row):
    """Attributions by every subset of a path's features, covers standing in for features left out."""
    out = dict.fromkeys(model.features, 0.0)
    goes = lambda n: (row[n.feature] in n.labels if n.labels is not None else n.missing_left if row[n.feature] is None else row[n.feature] <= n.edge)
    for tree in model.trees:
        for leaf, path in trees.leaves(tree):
            met, share = {}, {}
            for n, left in path:
                met[n.feature] = met.get(n.feature, True) and goes(n) == left
                share[n.feature] = share.get(n.feature, 1.0) * (n.left if left else n.right).cover / max(n.cover, 1.0)
            d = len(met)
            for f in met:
                others = [o for o in met if o != f]
                for k in range(d):
                    for chosen in itertools.combinations(others, k):
                        part = math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                        for o in others:
                            part *= float(met[o]) if o in chosen else share[o]
                        out[f] += leaf.value * (met[f] - share[f]) * part
    return out


@pytest.fixture(scope="module")
def wide(spark):
    r = np.random.default_rng(8)
    x, g = r.normal(size=(900, 3)), r.choice(["u", "v", "w", "rare"], 900, p=[0.4, 0.3, 0.28, 0.02])
    z = 0.8 * x[:, 0] - 0.6 * x[:, 1] * x[:, 2] + np.array([{"u": 1.0, "v": -1.0, "w": 0.8, "rare": 0.0}[k] for k in g])
    y = (r.random(900) < 1 / (1 + np.exp(-z))).astype(int)
    rows = [(i, *[None if (i + k) % 17 == 0 else float(v) for k, v in enumerate(a)], None if i % 19 == 0 else str(k), int(c)) for i, (a, k, c) in enumerate(zip(x, g, y))]
    return rows, spark.createDataFrame(rows, "id long, a double, b double, c double, g string, y int").repartition(3).cache()


@pytest.mark.parametrize("how", [{"depth": 3}, {"depth": None, "leaves": 9, "least_rows": 20, "least": 1e-3}])
def test_attributions_equal_the_subset_formula(wide, monkeypatch, how):
    rows, df = wide
    model = boosting.grow(df, "y", ["a", "b", "c", "g"], [(boosting.Growth(trees=6, rows=0.7, columns=0.75, **how), 0)], [boosting.Fold(F.lit(True))], ["g"], "id", signs={"a": 1})[0]
    for most in (10, 0):  # by patterns, and row by row
        monkeypatch.setattr(trees, "PATTERN_BITS", most)
        forest = trees.Forest(model.features, model.labels, model.base, model.trees)
        got = forest.attributions(forest.bins([np.array([np.nan if k < 4 and r[k] is None else r[k] for r in rows], object if k == 4 else float) for k in (1, 2, 3, 4)]))
        for i in range(0, 900, 37):
            want = _subset_formula(model, dict(zip("abcg", rows[i][1:5])))
            assert np.allclose(got[i], [want[f] for f in model.features], atol=1e-10)
    out = boosting.with_shap(df, model)
    assert boosting.additivity(out, model).first()[0] < 1e-9


def _plain_split(rows, features, edges, labels, g, h, ridge, least_rows):
    """The gain of the best split by trying every edge and every set of labels that is a beginning of their order."""
    best = (1e-9, None)
    part = lambda use: (sum(g[i] for i in use), sum(h[i] for i in use))
    score = lambda s: s[0] ** 2 / (s[1] + ridge)
    for f in features:
        cuts = []
        if f in labels:
            kinds = sorted({r[f] for r in rows if r[f] is not None})
            order = sorted(kinds, key=lambda k: part([i for i, r in enumerate(rows) if r[f] == k])[0] / (part([i for i, r in enumerate(rows) if r[f] == k])[1] + boosting.SMOOTH))
            cuts = [[i for i, r in enumerate(rows) if r[f] in order[: k + 1]] for k in range(len(order))]
        else:
            for e in edges[f]:
                low = [i for i, r in enumerate(rows) if r[f] is not None and r[f] <= e]
                cuts += [low + [i for i, r in enumerate(rows) if r[f] is None], low]
        for left in cuts:
            right = sorted(set(range(len(rows))) - set(left))
            if min(len(left), len(right)) >= least_rows:
                gain = score(part(left)) + score(part(right)) - score(part(range(len(rows))))
                if gain > best[0]:
                    best = (gain, (f, tuple(sorted(left))))
    return best


def test_first_split_is_the_best_of_all(wide):
    rows, df = wide
    dicts = [dict(zip(("a", "b", "c", "g"), r[1:5])) for r in rows]
    model = boosting.grow(df, "y", ["a", "b", "c", "g"], [(boosting.Growth(trees=1, depth=1, rate=1.0, least=0.0, least_rows=30), 0)], [boosting.Fold(F.lit(True))], ["g"], "id", bins=8)[0]
    p = np.mean([r[5] for r in rows])
    quantile = lambda f: np.quantile([r[f] for r in dicts if r[f] is not None], [i / 8 for i in range(1, 8)])
    gain, (f, left) = _plain_split(dicts, ["a", "b", "c", "g"], {f: quantile(f) for f in "abc"}, {"g"}, [p - r[5] for r in rows], [p * (1 - p)] * len(rows), 1.0, 30)
    root = model.trees[0]
    assert root.feature == f and root.left.cover == len(left) and root.cover == len(rows)
    assert root.left.value == pytest.approx(-sum(p - rows[i][5] for i in left) / (len(left) * p * (1 - p) + 1.0), abs=1e-5)


def test_leaf_wise_growth_takes_the_best_gain_first(wide):
    _, df = wide
    fold = [boosting.Fold(F.lit(True))]
    jobs = [(boosting.Growth(trees=1, depth=4, least=1.0), 0)] + [(boosting.Growth(trees=1, depth=4, least=1.0, leaves=n), 0) for n in (2, 3, 5, 8)]
    full, *some = boosting.grow(df, "y", ["a", "b", "c", "g"], jobs, fold, ["g"], "id")
    sizes = [len(trees.leaves(m.trees[0])) for m in some]
    assert sizes == [2, 3, 5, 8] and len(trees.leaves(full.trees[0])) > 8

    def inside(small, big):
        return small.feature is None or ((small.feature, small.edge, small.labels) == (big.feature, big.edge, big.labels) and inside(small.left, big.left) and inside(small.right, big.right))

    chain = [some[0], *some[1:], full]
    assert all(inside(a.trees[0], b.trees[0]) for a, b in zip(chain, chain[1:]))


def test_models_grown_together_equal_those_grown_alone(wide, monkeypatch):
    _, df = wide
    valid = F.col("id") % 4 == 0
    growths = [boosting.Growth(trees=40, depth=3, rate=0.4, patience=3, rows=0.8, seed=5), boosting.Growth(trees=8, depth=2, columns=0.5, seed=1), boosting.Growth(trees=30, depth=None, leaves=6, rate=0.3, patience=2)]
    together = boosting.grow(df, "y", ["a", "b", "c", "g"], [(g, 0) for g in growths], [boosting.Fold(~valid, valid)], ["g"], "id", store_every=4)
    monkeypatch.setattr(boosting, "FEW_TASKS", 0)  # their sums meet by a shuffle
    for g, m in zip(growths, together):
        alone = boosting.grow(df.repartition(5), "y", ["a", "b", "c", "g"], [(g, 0)], [boosting.Fold(~valid, valid)], ["g"], "id", store_every=4)[0]
        assert alone == m  # to the last bit, whatever the partitions
    first = together[0]
    assert len(first.trees) < 40 and len(first.trees) == int(np.argmin(first.losses)) + 1 and len(first.losses) == len(first.trees) + 3
    held = df.where(valid)
    p = first.probability()
    loss = held.agg(F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p)))).first()[0]
    assert loss == pytest.approx(min(first.losses), abs=1e-6)


def test_leaves_do_not_look_at_wide_features(spark):
    df = spark.range(400).selectExpr("id", "cast(id as double) as wide", "cast(id % 2 as double) as narrow", "cast(id % 2 as int) as y")
    model = boosting.fit(df, "y", ["wide", "narrow"], trees=2, depth=3)
    assert {s.feature for t in model.trees for s in trees.splits(t)} == {"narrow"}
    got = df.select("y", model.probability().alias("p")).groupBy("y").agg(F.min("p").alias("lo"), F.max("p").alias("hi")).collect()
    assert all(r["lo"] == pytest.approx(r["hi"]) and (r["hi"] > 0.5) == (r["y"] == 1) for r in got)


def test_unseen_labels_go_right_and_empty_models_score(wide, spark):
    _, df = wide
    model = boosting.fit(df, "y", ["g"], trees=2, depth=1, labels=["g"], row_id="id")
    root = model.trees[0]
    got = {r["g"]: r["m"] for r in spark.createDataFrame([("new",), (None,), (root.labels[0],)], "g string").select("g", model.margin().alias("m")).collect()}
    assert got["new"] == got[None] != got[root.labels[0]]
    none = boosting.fit(df.where("y = 1"), "y", ["a"], trees=3)
    assert none.trees and df.select(none.probability().alias("p")).agg(F.min("p")).first()[0] > 0.99


def test_a_pass_works_out_equal_rows_once(spark, monkeypatch):
    df = spark.range(0, 6000, 1, 6).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 5).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("g"))
    seen, sums = [], boosting._sums

    def told(blocks, *rest):
        seen.append(blocks.map(lambda r: (len(r["y"]) // 8, len(r["d"]) // 8)).collect())
        return sums(blocks, *rest)

    monkeypatch.setattr(boosting, "_sums", told)
    model = boosting.grow(df, "y", ["a", "g"], [(boosting.Growth(trees=2, depth=2, rows=0.5), 0)], [boosting.Fold(F.lit(True))], ["g"], "id")[0]
    patterns, rows = map(sum, zip(*seen[0]))
    assert rows == 6000 and patterns < 300 and len(model.trees) == 2  # 20 patterns, in a few batches
    assert boosting.with_shap(df, model)._jdf.queryExecution().executedPlan().toString().count("run(") == 1  # attributions and margin together
