import pytest
from pyspark.sql import functions as F

from lodestat.operators import boosting, search
from lodestat.sources import reports
from lodestat.sources.tables import read_json


def test_templates_have_no_holes():
    assert reports.render("AUC {{ auc }} of {{n}}", {"auc": reports.number(0.68594), "n": 3}) == "AUC 0.6859 of 3"
    with pytest.raises(KeyError, match="gini"):
        reports.render("{{gini}}", {})
    assert (reports.percentage(0.125), reports.money(59_890_000.0), reports.number(None)) == ("12.50%", "USD 59.89m", "n/a")


def test_tables_and_charts_hold_results(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1, 0.5), (None, 2, None)], "g string, n int, v double")
    assert reports.markdown_table(df.orderBy("n")).splitlines()[2:] == ["| a\\|b | 1 | 0.5000 |", "| n/a | 2 | n/a |"]
    with pytest.raises(ValueError, match="at most 1"):
        reports.markdown_table(df, 1)
    reports.write_chart(df, f"{tmp_path}/chart", "test", mark="bar", x="n", y="v", title="t", color="g")
    got = read_json(spark, f"{tmp_path}/chart")
    assert got["encoding"]["color"] == {"field": "g", "type": "nominal"} and len(got["data"]["values"]) == 2


def test_settings_are_the_same_for_a_seed():
    assert search.settings(3, 1) == search.settings(3, 1) != search.settings(3, 2)
    assert search.settings(1)[0].growth(search.LEAF, 7).leaves and search.settings(1)[0].growth(search.LEVEL, 7).leaves is None


@pytest.mark.parametrize("kind", [search.LEVEL, search.LEAF])
def test_search_trains_on_the_past_only(spark, kind):
    rows = spark.range(1200).selectExpr("id", "2000 + id % 4 as year", "cast(id * 7919 % 100 as double) as x", "cast(id * 104729 % 97 as double) as z", "cast((id * 7919 % 100 + id * 31 % 40) > 70 as int) as y")
    found = search.expanding_search(rows, "y", ["x", "z"], "year", "id", validate=(2002, 2003, 2009), draws=2, most_trees=6, row_cap=400, kind=kind)
    assert [(t.draw, t.year) for t in found.trials] == [(0, 2002), (1, 2002), (0, 2003), (1, 2003)]
    assert all(t.loss < 0.69 and 0 < t.trees <= 6 for t in found.trials) and found.trees == search.LEAST_TREES and found.table(spark).count() == 4
    # One of the trials alone, on its own rows, is the same model.
    t = found.trials[1]
    growth = search.settings(2)[1].growth(kind, 6, patience=search.PATIENCE)
    past = search.capped_sample(rows.where("year < 2002"), "id", 400, 0).unionByName(rows.where("year = 2002"))
    alone = boosting.grow(past, "y", ["x", "z"], [(growth, 0)], [boosting.Fold(past["year"] < 2002, past["year"] == 2002)], row_id="id")[0]
    assert (len(alone.trees), min(alone.losses)) == (t.trees, t.loss)


def test_models_grown_apart_are_those_of_passes(spark):
    """Also beyond a round, with a stop in its midst, with copies of ids, without validation rows, and without training rows."""
    rows = spark.range(1800).selectExpr("id % 1500 as id", "id % 3 as part", "case when id % 50 > 0 then cast(id * 7919 % 100 as double) end as x", "chr(cast(65 + id * 31 % 7 as int)) as z", "cast((id * 7919 % 100 + xxhash64(id) % 100) > 60 as int) as y")
    folds = [boosting.Fold(F.col("part") == 0, F.col("part") == 1), boosting.Fold(F.col("part") < 2, F.lit(False)), boosting.Fold(F.lit(False), F.col("part") == 2)]
    grown = lambda trees, seed, **more: boosting.Growth(trees, seed=seed, rows=0.7, columns=0.6, **more)
    jobs = [(grown(43, 1, depth=1, patience=60), 0), (grown(30, 2, depth=4, rate=0.5, patience=3), 0), (grown(3, 3, depth=None, leaves=5, patience=2), 1), (grown(2, 3, depth=2, patience=2), 2)]
    together = boosting.grow(rows, "y", ["x", "z"], jobs, folds, ["z"], "id", bins=8, apart=True)
    for (growth, k), got in zip(jobs, together):
        want = boosting.grow(rows, "y", ["x", "z"], [(growth, 0)], [folds[k]], ["z"], "id", bins=8)[0]
        assert (got.base, got.trees, got.losses) == (want.base, want.trees, want.losses)
    assert len(together[0].losses) == 43 > boosting.ROUND and 0 < len(together[1].trees) < len(together[1].losses) < 30 and len(together[2].trees) == 3


def test_search_takes_a_few_jobs_not_one_for_each_level(spark, monkeypatch):
    monkeypatch.setattr(boosting, "_sums", lambda *_: pytest.fail("a pass for a level"))
    rows = spark.range(600).selectExpr("id", "2000 + id % 3 as year", "cast(id * 7919 % 100 as double) as x", "cast((id * 7919 % 100 + id * 31 % 40) > 70 as int) as y")
    assert search.expanding_search(rows, "y", ["x"], "year", "id", validate=(2002,), draws=2, most_trees=4).trials
    monkeypatch.setattr(boosting, "TASK_ROWS", 399)  # larger folds go on by passes
    with pytest.raises(pytest.fail.Exception):
        search.expanding_search(rows, "y", ["x"], "year", "id", validate=(2002,), draws=2, most_trees=4)


def test_search_learns_from_all_earlier_rows(spark, monkeypatch):
    """Beyond 80,000 rows, each model in a task of its own; and by passes where a fold has too many patterns for one, with the same outcome."""
    rows = spark.range(82_500).selectExpr("id", "2001 + cast(id >= 82000 as int) as year", "cast(id * 7919 % 1000 as double) as x", "cast((id * 7919 % 1000 + xxhash64(id) % 900) > 500 as int) as y")
    growth = search.settings(1)[0].growth(search.LEVEL, 3, patience=search.PATIENCE)
    alone = boosting.grow(rows, "y", ["x"], [(growth, 0)], [boosting.Fold(F.col("year") < 2002, F.col("year") == 2002)], row_id="id")[0]
    seen, passes = [], boosting._sums
    monkeypatch.setattr(boosting, "_sums", lambda *a: (seen.append(1), passes(*a))[1])
    find = lambda: search.expanding_search(rows, "y", ["x"], "year", "id", validate=(2002,), draws=1, most_trees=3).trials
    (t,) = find()
    assert (t.trees, t.loss) == (len(alone.trees), min(alone.losses)) and not seen
    monkeypatch.setattr(boosting, "TASK_CELLS", 30)
    assert find() == [t] and seen
