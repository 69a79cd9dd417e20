"""Queries of models, inference, scenarios, findings and cleaning over the account lens. They join the battery's register."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import binning, boosting, calibrators, findings, loss, rank, recovery, regression, resampling, scorecard, sensitivity, stability, targets
from ..sources.scratch import narrowed
from .battery import _SCORES, query
from .lens import accounts

NUMERIC, LABELS = ["balance", "qty", "funded"], ["segment", "grade"]


def _terms(df: DataFrame) -> DataFrame:
    return df.select("term", *[F.round(c, 5).alias(c) for c in ("coef", "se", "stat")])


def _known(a: DataFrame, *columns: str) -> DataFrame:
    return a.dropna(subset=list(columns))


@query("m6_logit", """$LENS, x as (select case when grade in ('1', '2') then 1 else 0 end as f, sum(y) as b, sum(1 - y) as g from acc group by 1),
t as (select max(case when f = 0 then ln(b / g) end) as l0, max(case when f = 1 then ln(b / g) end) as l1, max(case when f = 0 then 1.0 / b + 1.0 / g end) as v0, max(case when f = 1 then 1.0 / b + 1.0 / g end) as v1 from x)
select '(intercept)' as term, round(l0, 5) as coef, round(sqrt(v0), 5) as se, round(l0 / sqrt(v0), 5) as stat from t union all select 'low', round(l1 - l0, 5), round(sqrt(v0 + v1), 5), round((l1 - l0) / sqrt(v0 + v1), 5) from t""")
def _(a: DataFrame) -> DataFrame:
    x = a.select("y", F.col("grade").isin("1", "2").cast("int").alias("low"))
    return _terms(regression.logit_fit(x, "y", ["low"]).table(a.sparkSession))


_OLS = """$LENS, s as (select count(*) as n, avg(qty) as m1, avg(n_lines) as m2, avg(funded) as my, var_pop(qty) * count(*) as s11, var_pop(n_lines) * count(*) as s22, covar_pop(qty, n_lines) * count(*) as s12, covar_pop(qty, funded) * count(*) as s1y, covar_pop(n_lines, funded) * count(*) as s2y, var_pop(funded) * count(*) as syy from acc where qty is not null),
b as (select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as b2 from s),
v as (select *, my - b1 * m1 - b2 * m2 as b0, (syy - b1 * s1y - b2 * s2y) / (n - 3) as s2 from b),
e as (select *, sqrt(s2 * s22 / (s11 * s22 - s12 * s12)) as e1, sqrt(s2 * s11 / (s11 * s22 - s12 * s12)) as e2, sqrt(s2 * (1.0 / n + (m1 * m1 * s22 + m2 * m2 * s11 - 2 * m1 * m2 * s12) / (s11 * s22 - s12 * s12))) as e0 from v)
"""


@query("m7_ols", _OLS + "select 'qty' as term, round(b1, 3) as coef, round(e1, 3) as se, round(b1 / e1, 4) as stat from e union all select 'n_lines', round(b2, 3), round(e2, 3), round(b2 / e2, 4) from e union all select '(intercept)', round(b0, 3), round(e0, 3), round(b0 / e0, 4) from e")
def _(a: DataFrame) -> DataFrame:
    t = regression.ols_fit(a, "funded", ["qty", "n_lines"]).table(a.sparkSession)
    return t.select("term", F.round("coef", 3).alias("coef"), F.round("se", 3).alias("se"), F.round("stat", 4).alias("stat"))


@query("m9_breusch_pagan", """$LENS, f as (select regr_slope(funded, qty) as b, regr_intercept(funded, qty) as a from acc where qty is not null), r as (select qty, (funded - a - b * qty) ** 2 as e2 from acc, f where qty is not null), t as (select count(*) as n, corr(e2, qty) ** 2 as r2 from r)
select round(n * r2, 4) as lm, round(r2 / ((1 - r2) / (n - 2)), 4) as f from t""")
def _(a: DataFrame) -> DataFrame:
    x = _known(a.select("funded", "qty"), "qty")
    t = regression.breusch_pagan(x, "funded", regression.ols_fit(x, "funded", ["qty"]))
    return t.select(F.round("lm", 4).alias("lm"), F.round("f", 4).alias("f"))


@query("m8_calibration_slope", """$LENS, c as (select ln(p / (1 - p)) as x, cast(count(*) as double) as n, cast(sum(y) as double) as b from acc group by p),
it as (select * from (with recursive z(i, a, s, haa, has, hss) as (select 0, 0.0::double, 0.0::double, 0.0::double, 0.0::double, 0.0::double union all
select i + 1, a + (ga * hss - gs * has) / (haa * hss - has * has), s + (gs * haa - ga * has) / (haa * hss - has * has), haa, has, hss from (select i, a, s, sum(b - n / (1 + exp(-a - s * x))) as ga, sum((b - n / (1 + exp(-a - s * x))) * x) as gs,
sum(n * (1 / (1 + exp(-a - s * x))) * (1 - 1 / (1 + exp(-a - s * x)))) as haa, sum(x * n * (1 / (1 + exp(-a - s * x))) * (1 - 1 / (1 + exp(-a - s * x)))) as has, sum(x * x * n * (1 / (1 + exp(-a - s * x))) * (1 - 1 / (1 + exp(-a - s * x)))) as hss from z, c where i < 25 group by i, a, s) q) select * from z) where i = 25)
select round(s, 5) as slope, round(s - 1.959963984540054 * sqrt(haa / (haa * hss - has * has)), 5) as slope_lo, round(s + 1.959963984540054 * sqrt(haa / (haa * hss - has * has)), 5) as slope_hi, round(a, 5) as intercept, round(a - 1.959963984540054 * sqrt(hss / (haa * hss - has * has)), 5) as intercept_lo, round(a + 1.959963984540054 * sqrt(hss / (haa * hss - has * has)), 5) as intercept_hi from it""")
def _(a: DataFrame) -> DataFrame:
    t = regression.calibration_slope(a, "y", "p")
    return t.select(*[F.round(c, 5).alias(c) for c in t.columns])


@query("m14_recalibration", """$LENS, c as (select ln(p / (1 - p)) as x, cast(count(*) as double) as n, cast(sum(y) as double) as b from acc where split = 'dev' group by p),
it as (select * from (with recursive z(i, a) as (select 0, 0.0::double union all select i + 1, a + g / h from (select i, a, sum(b - n / (1 + exp(-a - x))) as g, sum(n * (1 / (1 + exp(-a - x))) * (1 - 1 / (1 + exp(-a - x)))) as h from z, c where i < 30 group by i, a) q) select * from z) where i = 30) select round(a, 5) as shift from it""", lens=False)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    dev = accounts(spark, sf_dir).where("split = 'dev'")
    return spark.createDataFrame([(round(regression.recalibration_shift(dev, "y", clean.logit(F.col("p"))), 5),)], "shift double")


_WOE = """$LENS, s as (select segment, sum(y) as b, sum(1 - y) as g from acc group by 1), w as (select segment, ln(((g + 0.5) / (sum(g) over () + 0.5 * count(*) over ())) / ((b + 0.5) / (sum(b) over () + 0.5 * count(*) over ()))) as woe from s),
qs as (select case when qty is null then 4 else len(list_filter([50.0, 100.0, 150.0], lambda x: x < qty)) end as bin, sum(y) as b, sum(1 - y) as g from acc group by 1), qw as (select bin, ln(((g + 0.5) / (sum(g) over () + 0.5 * count(*) over ())) / ((b + 0.5) / (sum(b) over () + 0.5 * count(*) over ()))) as woe from qs)
"""


def _bins_of(table: DataFrame, variable: str, edges: list[float], groups: list[list[str]], k: int) -> binning.Bins:
    """Bins of given edges or groups, with counts made by Spark."""
    got = {r["i"]: (r["b"], r["g"]) for r in table.collect()}  # a row for each bin
    pairs = [got.get(i, (0, 0)) for i in range(k)]
    return binning._finish(binning.Bins(variable, edges=edges, groups=groups), [b for b, _ in pairs], [g for _, g in pairs], got.get(k, (0, 0)))


@query("m3_scorecard_points", _WOE + "select id, round(w.woe, 6) as segment_woe, round(-(-0.8 * w.woe - 0.7 / 2) * (20 / ln(2)) + (600 - 20 / ln(2) * ln(50)) / 2, 4) as segment_points, round((600 - 20 / ln(2) * ln(50)) - 20 / ln(2) * (-0.7 - 0.8 * w.woe - 0.5 * qw.woe), 4) as score, round(1 / (1 + exp(0.7 + 0.8 * w.woe + 0.5 * qw.woe)), 6) as pd from acc join w using (segment) join qw on qw.bin = case when qty is null then 4 else len(list_filter([50.0, 100.0, 150.0], lambda x: x < qty)) end")
def _(a: DataFrame) -> DataFrame:
    a = a.where("segment is not null")
    counts = [F.sum("y").alias("b"), F.sum(1 - F.col("y")).alias("g")]
    names = sorted(r[0] for r in a.select("segment").distinct().collect())  # a few labels
    seg = _bins_of(a.groupBy((F.array_position(F.lit(names), F.col("segment")) - 1).cast("int").alias("i")).agg(*counts), "segment", [], [[n] for n in names], len(names))
    qty = _bins_of(a.groupBy(F.coalesce(stability.bin_of(F.col("qty"), [50.0, 100.0, 150.0]), F.lit(4)).alias("i")).agg(*counts), "qty", [50.0, 100.0, 150.0], [], 4)
    card = scorecard.Scorecard({"segment": seg, "qty": qty}, regression.Fit(("segment", "qty"), (-0.8, -0.5), (0.1, 0.1), -0.7, 0.1, 0))
    return a.select("id", seg.transform(F.col("segment")).alias("segment_woe"), F.round(card.points("segment"), 4).alias("segment_points"), F.round(card.score(), 4).alias("score"), card.probability().alias("pd"))


def _card(a: DataFrame) -> scorecard.Scorecard:
    dev = narrowed(a.where("split = 'dev'"), "id", "y", "balance", "disc", "qty", "returned", "n_lines", "segment")
    bins = {**binning.fit_numeric(dev, ["balance", "disc", "qty", "returned", "n_lines"], "y"), "segment": binning.fit_labels(dev, "segment", "y", "id")}
    # The lens holds little signal; the limits are open so that the whole selection loop runs.
    return scorecard.fit_scorecard(dev, "y", bins, iv_min=0.0, p_max=0.5)


@query("m1_m5_scorecard")
def _(a: DataFrame) -> DataFrame:
    return _card(a).points_table(a.sparkSession)


@query("q5_iv_league")
def _(a: DataFrame) -> DataFrame:
    return _card(a).league(a.sparkSession).withColumn("band", clean.iv_band(F.col("iv")))


@query("q7_score_odds_pd", "select cast(400 + 20 * i as bigint) as score, round(50 * 2 ** ((400 + 20 * i - 600) / 20.0), 6) as odds, round(1 / (1 + 50 * 2 ** ((400 + 20 * i - 600) / 20.0)), 6) as pd, (select count(*) from orders where o_totalprice / 1000 >= 400 + 20 * i) as above from range(0, 16) t(i)", lens=False)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    ladder = spark.range(16).select((400 + 20 * F.col("id")).alias("score"))
    odds = scorecard.BASE_ODDS * F.pow(F.lit(2.0), (F.col("score") - scorecard.BASE_SCORE) / scorecard.PDO)
    counted = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.least(F.floor((F.col("o_totalprice") / 1000 - 400) / 20), F.lit(15)).alias("step")).where("step >= 0").groupBy("step").count()
    near = ladder.join(F.broadcast(counted), F.col("step") >= (F.col("score") - 400) / 20, "left").groupBy("score").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("above"))  # 16 rows each
    return near.select("score", odds.alias("odds"), (1 / (1 + odds)).alias("pd"), "above")


@query("m10_m11_loss_model")
def _(a: DataFrame) -> DataFrame:
    bad = narrowed(a.where("y = 1").withColumn("ccf", clean.clipped(F.col("disc") * 10)), "id", "split", "returned", "ccf", *NUMERIC, *LABELS)
    model = recovery.fit_loss_model(bad.where("split = 'dev'"), "returned", "ccf", NUMERIC, LABELS, ["balance"])
    return model.predict(bad, "funded").select("id", "split", "p_any", "rr", "lgd", "lgd_hard", "ccf_hat", "ead")


@query("l6_diagnostics")
def _(a: DataFrame) -> DataFrame:
    bad = narrowed(a.where("y = 1").withColumn("ccf", clean.clipped(F.col("disc") * 10)), "id", "split", "returned", "ccf", *NUMERIC, *LABELS)
    x = recovery.fit_loss_model(bad.where("split = 'dev'"), "returned", "ccf", NUMERIC, LABELS).predict(bad, "funded")
    parts = F.array(*[F.struct(F.lit(n).alias("component"), F.col(p).alias("predicted"), v.cast("double").alias("actual")) for n, p, v in (("any", "p_any", (F.col("returned") > 0).cast("int")), ("recovery", "rr", F.when(F.col("returned") > 0, F.col("returned"))), ("lgd", "lgd", 1 - F.col("returned")), ("ccf", "ccf_hat", F.col("ccf")))])
    return loss.regression_metrics(x.select("split", F.explode(parts).alias("c")).select("split", "c.*").where("actual is not null"), "actual", "predicted", ["component", "split"])


@query("a24_residual_quantiles", "$LENS select split, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as level, round(unnest(quantile_cont(returned - p, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99])), 6) as residual from acc where returned is not null group by split")
def _(a: DataFrame) -> DataFrame:
    return recovery.residual_quantiles(a.where("returned is not null"), "returned", "p", ["split"])


@query("w8_predicted_deciles", "$LENS, r as (select *, row_number() over (order by p desc, id) as rk, count(*) over () as nn from acc where y = 1 and returned is not null) select cast(floor((rk - 1) * 10 / nn) + 1 as bigint) as decile, count(*) as n, round(avg(p), 6) as mean_pred, round(avg(returned), 6) as mean_actual from r group by 1")
def _(a: DataFrame) -> DataFrame:
    return recovery.predicted_deciles(a.where("y = 1"), "returned", "p", "id")


@query("a25_class_agreement", "$LENS select split, count(*) as n, round(avg(case when (p > 0.5) = (y = 1) then 1.0 else 0.0 end), 6) as hit_rate, round(avg(y), 6) as mean_actual, round(avg(p), 6) as mean_pred from acc group by split")
def _(a: DataFrame) -> DataFrame:
    return recovery.class_agreement(a, "y", "p", ["split"])


@query("a7_loss_by_grade", "$LENS select grade, count(*) as n, round(avg(p), 6) as predicted, round(avg(returned), 6) as actual from acc where y = 1 group by grade")
def _(a: DataFrame) -> DataFrame:
    return a.where("y = 1").groupBy("grade").agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), F.avg("returned").alias("actual"))


@query("a8_j4_population_and_sample", "$LENS, s as (select grade, count(*) as n_sample, sum(p * 0.45 * funded) as el_sample from acc where id % 7 = 0 and grade <> '5' group by 1) select a.grade as grade, count(*) as n, round(sum(p * 0.45 * funded), 2) as el, coalesce(max(n_sample), 0) as n_sample, round(coalesce(max(el_sample), 0), 2) as el_sample from acc a left join s on a.grade = s.grade group by a.grade")
def _(a: DataFrame) -> DataFrame:
    el = F.sum(loss.expected_loss(F.col("p"), F.lit(0.45), F.col("funded")))
    sample = a.where("id % 7 = 0 and grade <> '5'").groupBy("grade").agg(F.count("*").alias("n_sample"), F.round(el, 2).alias("el_sample"))
    return a.groupBy("grade").agg(F.count("*").alias("n"), F.round(el, 2).alias("el")).join(sample, "grade", "left").fillna(0, ["n_sample", "el_sample"])


@query("a26_split_meta", "$LENS select split, count(*) as n, round(avg(y), 6) as bad_rate, min(issue_d) as first_issue, max(issue_d) as last_issue from acc group by split")
def _(a: DataFrame) -> DataFrame:
    return a.groupBy("split").agg(F.count("*").alias("n"), F.avg("y").alias("bad_rate"), F.min("issue_d").alias("first_issue"), F.max("issue_d").alias("last_issue"))


@query("p24_p26_design", """$LENS, q as (select median(balance) as m, quantile_cont(balance, 0.01) as lo, quantile_cont(balance, 0.99) as hi from acc), x as (select id, grade, segment, balance, greatest(least(coalesce(balance, m), hi), lo) as v from acc, q), t as (select segment, row_number() over (order by count(*) desc, segment) as k from acc group by 1)
select id, round((v - avg(v) over ()) / stddev_pop(v) over (), 6) as balance_z, case when balance is null then 0.0 else 1.0 end as balance_reported, case when segment = (select segment from t where k = 2) then 1.0 else 0.0 end as second from x""")
def _(a: DataFrame) -> DataFrame:
    d = recovery.learn_design(a, ["balance"], ["segment"], ["balance"])
    c = d.columns()
    return a.select("id", c["balance_z"].alias("balance_z"), c["balance_reported"].alias("balance_reported"), c[f"segment_{d.labels['segment'][0]}"].alias("second"))


@query("v6_bootstrap_ci", """$LENS, s as (select id, y, p, p2 from acc order by md5('0:' || cast(id as varchar)) limit 2000), h as (select y, p, p2, b, md5('0:' || cast(b as varchar) || ':' || cast(id as varchar)) as h from s, range(0, 4) t(b)),
d as (select b * 5 + j as draw, y, p, p2, ('0x' || substr(h, 1 + 6 * j, 6))::bigint as u from h, range(0, 5) k(j)), w as (select draw, y, p, p2, len(list_filter($LIMITS, lambda x: x <= u)) as w from d),
m as (select draw, 'p' as model, p, y, w from w union all select draw, 'p2', p2, y, w from w), c as (select draw, model, p, sum(w * y) as b, sum(w * (1 - y)) as g from m where w > 0 group by 1, 2, 3),
r as (select *, sum(b) over (partition by draw, model order by p) as cb, sum(g) over (partition by draw, model order by p) as cg, sum(b) over (partition by draw, model) as tb, sum(g) over (partition by draw, model) as tg from c),
a as (select draw, model, sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)) as auc, max(abs(cb / tb - cg / tg)) as ks from r group by 1, 2), l as (select model, 'auc' as metric, auc as v from a union all select model, 'gini', 2 * auc - 1 from a union all select model, 'ks', ks from a)
select model, metric, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi, count(*) as draws from l group by 1, 2""".replace("$LIMITS", str(resampling._poisson_limits())))
def _(a: DataFrame) -> DataFrame:
    return resampling.intervals(resampling.replicates(resampling.capped_sample(a, "id", 2000), "y", ["p", "p2"], "id", 20, poisson=True))


@query("v7_bootstrap_difference")
def _(a: DataFrame) -> DataFrame:
    return resampling.paired_difference(resampling.replicates(resampling.capped_sample(a, "id"), "y", ["p", "p2"], "id"), "p", "p2")


# The feature's own cap and draws, with replacement; v6_bootstrap_ci and its SQL have Poisson weights for 2,000 rows and 20 draws.
@query("v6_bootstrap_ci_whole")
def _(a: DataFrame) -> DataFrame:
    return resampling.intervals(resampling.replicates(resampling.capped_sample(a, "id"), "y", ["p", "p2"], "id"))


_RESULTS = _SCORES + """, r as (select split, sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)) as auc, max(abs(cb / tb - cg / tg)) as ks from q group by split), k as (select split, avg(p) / avg(y) as ratio from acc group by 1),
l as (select split, 'auc' as metric, auc as value from r union all select split, 'ks', ks from r union all select split, 'ratio', ratio from k),
z as (select 'score' as model, split, metric, value, case metric when 'auc' then case when value >= 0.5 then 'Green' when value >= 0.49 then 'Amber' else 'Red' end when 'ratio' then case when value between 0.9 and 1.1 then 'Green' when value between 0.75 and 1.25 then 'Amber' else 'Red' end else 'n/a' end as light from l)
"""
RULES = {"auc": ("high", 0.5, 0.49), "ratio": ("band", (0.9, 1.1), (0.75, 1.25))}


def _results(a: DataFrame) -> DataFrame:
    ranks = findings.long_results(rank.discrimination(a, "y", "p", ["split"]), ["split"], ["auc", "ks"])
    ratio = findings.long_results(a.groupBy("split").agg((F.avg("p") / F.avg("y")).alias("ratio")), ["split"], ["ratio"])
    return findings.with_lights(ranks.unionByName(ratio).select(F.lit("score").alias("model"), "split", "metric", "value"), RULES)


@query("v8_battery", _RESULTS + "select model, split, metric, round(value, 6) as value, light from z")
def _(a: DataFrame) -> DataFrame:
    return _results(a)


_FOUND = _RESULTS + ", f as (select model, metric, case when bool_or(light = 'Red') then 'High' else 'Medium' end as severity, string_agg(split || ' ' || cast(cast(value as decimal(18,3)) as varchar) || ' (' || light || ')', '; ' order by split) as evidence from z where split <> 'dev_train' group by 1, 2 having bool_or(light in ('Red', 'Amber')))\n"


@query("f1_f3_findings", _FOUND + "select * from f")
def _(a: DataFrame) -> DataFrame:
    return findings.light_findings(findings.in_scope(_results(a), ["score"]), ["model", "metric"], "split")


_EL_RATIO = "e as (select vintage, sum(p * 0.45 * funded) / sum(case when y = 1 then funded * 0.6 else 0 end) as r from acc group by 1 having sum(y) > 0), v as (select cast(vintage as varchar) as vintage, case when abs(r - 1) > 0.25 then 'High' else 'Medium' end as severity, case when r < 1 then 'understated' else 'overstated' end as direction from e where abs(r - 1) > 0.1)"


def _el(a: DataFrame) -> DataFrame:
    t = a.groupBy("vintage").agg(F.try_divide(F.sum(F.col("p") * 0.45 * F.col("funded")), F.sum(F.when(F.col("y") == 1, F.col("funded") * 0.6).otherwise(0.0))).alias("ratio"))
    return findings.loss_findings(t.select(F.col("vintage").cast("string").alias("vintage"), "ratio"), ["vintage"], "ratio")


@query("f2_el_findings", "$LENS, " + _EL_RATIO + " select * from v")
def _(a: DataFrame) -> DataFrame:
    return _el(a)


@query("f6_log", _FOUND + ", " + _EL_RATIO + """, u as (select 0 as part, metric as subject, severity from f union all select 1, vintage, severity from v), n as (select *, row_number() over (order by part, subject) as k from u)
select subject, severity, 'F-' || lpad(cast(k as varchar), greatest(2, len(cast(k as varchar)))::integer, '0') as finding_id, row_number() over (order by case severity when 'High' then 0 when 'Medium' then 1 else 2 end, k) as place from n""")
def _(a: DataFrame) -> DataFrame:
    lights = findings.light_findings(findings.in_scope(_results(a), ["score"]), ["model", "metric"], "split").select(F.col("metric").alias("subject"), "severity")
    return findings.build_log([lights, _el(a).select(F.col("vintage").alias("subject"), "severity")], ["subject"])


@query("x2_compare", "$LENS, e as (select 'mean_pd' as quantity, split, avg(p) as v from acc group by 2 union all select 'funded', split, sum(funded) from acc group by 2), b as (select quantity, split, v + case when quantity = 'funded' then 1 else 0 end as v from e where split <> 'partial') select quantity, count(b.v) as matched, cast(count(*) - count(b.v) as bigint) as unmatched, round(max(abs(e.v - b.v)), 4) as max_diff, count(*) = count(b.v) and max(abs(e.v - b.v)) <= 0.001 as within from e left join b using (quantity, split) group by quantity")
def _(a: DataFrame) -> DataFrame:
    t = findings.long_results(a.groupBy("split").agg(F.avg("p").alias("mean_pd"), F.sum("funded").alias("funded")), ["split"], ["mean_pd", "funded"]).withColumnRenamed("metric", "quantity")
    other = t.where("split <> 'partial'").withColumn("value", F.col("value") + F.when(F.col("quantity") == "funded", 1.0).otherwise(0.0))
    return findings.compare_tables(t, other, ["split"], "value", {"mean_pd": 0.001, "funded": 0.001}, "quantity").withColumn("max_diff", F.round("max_diff", 4))


SCENARIOS = {"base": {}, "qty_up": {"qty": ("pct", 0.1)}, "lines_up": {"n_lines": ("add", 1.0)}, "all": {"qty": ("pct", 0.1), "n_lines": ("add", 1.0)}}


@query("n2_n3_shock_grid", """$LENS, s(scenario, m, k) as (values ('base', 1.0, 0.0), ('qty_up', 1.1, 0.0), ('lines_up', 1.0, 1.0), ('all', 1.1, 1.0)), x as (select scenario, p as b, funded, round((coalesce(qty * m, 0) + 1.0) / (coalesce(n_lines + k, 0) * 50 + 10.0), 6) as s from acc, s)
select scenario, count(*) as n, round(100 * (avg(s) / avg(b) - 1), 4) as d_mean_pd_pct, round(100 * (sum(s * 0.45 * funded) / sum(b * 0.45 * funded) - 1), 4) as d_el_pct, round(avg(case when len(list_filter([0.2, 0.4, 0.6, 0.8], lambda e: e < b)) <> len(list_filter([0.2, 0.4, 0.6, 0.8], lambda e: e < s)) then 1.0 else 0.0 end), 6) as share_moved from x group by scenario""")
def _(a: DataFrame) -> DataFrame:
    x = sensitivity.with_scenarios(a.withColumn("base", F.col("p")), SCENARIOS)
    x = x.withColumn("p", F.round((F.coalesce("qty", F.lit(0.0)) + 1.0) / (F.coalesce("n_lines", F.lit(0)) * 50 + 10.0), 6))
    t = sensitivity.scenario_summary(x, "id", "base", "p", F.lit(0.45), F.col("funded"), [0.2, 0.4, 0.6, 0.8])
    return t.withColumns({c: F.round(c, 4) for c in ("d_mean_pd_pct", "d_el_pct")})


@query("n4_binning_grid")
def _(a: DataFrame) -> DataFrame:
    names = ["balance", "disc", "qty", "returned"]
    first = binning.prebinned(narrowed(a.where("split = 'dev'"), "y", *names), names, "y")  # what all variants merge

    def build(min_share: float, max_bins: int) -> DataFrame:
        return a.sparkSession.createDataFrame([(v, len(b.bads) - 1, b.iv) for v, b in binning.merged(first, min_share, max_bins).items()], "variable string, bins int, iv double")

    return sensitivity.grid(build, {f"{s}/{m}": {"min_share": s, "max_bins": m} for s, m in ((0.03, 8), (0.10, 8), (0.05, 5), (0.05, 12))})


@query("k1_benchmark_auc", "$LENS, m as (select 'p' as model, split, y, p as s from acc union all select 'grade', split, y, cast(grade as double) from acc union all select 'funded', split, y, funded from acc), c as (select model, split, s, sum(y) as b, sum(1 - y) as g from m group by 1, 2, 3), r as (select *, sum(g) over (partition by model, split order by s) as cg, sum(b) over (partition by model, split) as tb, sum(g) over (partition by model, split) as tg from c) select model, split, round(sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)), 6) as auc from r group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    # Scores outside 0 to 1 are scaled, so that they spread over the buckets.
    models = F.array(*[F.struct(F.lit(n).alias("model"), s.cast("double").alias("s")) for n, s in (("p", F.col("p")), ("grade", F.col("grade").try_cast("double") / 10), ("funded", F.col("funded") / 1e6))])
    return rank.discrimination(a.select("split", "y", F.explode(models).alias("m")).select("split", "y", "m.*"), "y", "s", ["model", "split"]).select("model", "split", "auc")


@query("p1_p7_cleaning", """with x as (select o_orderkey as id, cast(round(o_totalprice / 1e4, 2) as decimal(18,2)) || '%' as pct, ' c' || o_custkey || ' ' as clerk, o_orderpriority as pr, cast(o_orderdate as date) as d, case when o_orderkey % 4 = 0 then '< 1 year' when o_orderkey % 4 = 1 then '10+ years' when o_orderkey % 4 = 2 then 'n/a' else '3 years' end as e from orders)
select id, round(cast(rtrim(pct, '%') as double), 2) as pct, trim(clerk) as clerk, case when left(pr, 1) in ('4', '5') then 'OTHER' else pr end as pr, date_trunc('month', d)::date as month, case when id % 4 = 0 then 0.0 when id % 4 = 1 then 10.0 when id % 4 = 2 then null else 3.0 end as years from x""", lens=False)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    raw = o.select(F.col("o_orderkey").alias("id"), F.concat(F.round(F.col("o_totalprice") / 1e4, 2).cast("decimal(18,2)").cast("string"), F.lit("%")).alias("pct"), F.concat(F.lit(" c"), F.col("o_custkey").cast("string"), F.lit(" ")).alias("clerk"), F.col("o_orderpriority").alias("pr"), F.date_format("o_orderdate", "MMM-yy").alias("my"), F.when(F.col("o_orderkey") % 4 == 0, "< 1 year").when(F.col("o_orderkey") % 4 == 1, "10+ years").when(F.col("o_orderkey") % 4 == 2, "n/a").otherwise("3 years").alias("e"))
    return raw.select("id", clean.percent(F.col("pct")).alias("pct"), F.trim("clerk").alias("clerk"), F.when(F.substring("pr", 1, 1).isin("4", "5"), "OTHER").otherwise(F.col("pr")).alias("pr"), clean.month_year(F.col("my")).alias("month"), clean.employment_years(clean.null_if(F.col("e"), "n/a")).alias("years"))


@query("p9_p13_targets", """$LENS, x as (select id, issue_d, case when y = 1 then 'Charged Off' else 'Current' end as st, case when id % 5 <> 0 then issue_d + interval (cast(id % 30 as integer)) month end as lp, funded, funded * 0.3 as prn, funded * (id % 11) / 10.0 as rec, 5.0 as fee from acc),
m as (select *, coalesce(year(lp) * 12 + month(lp) - year(issue_d) * 12 - month(issue_d), 0) as mob, (2001 * 12 + 1) - year(issue_d) * 12 - month(issue_d) as seen, st = 'Charged Off' as bad from x)
select id, mob as mob_last_pay, seen as mob_observed, cast(bad as bigint) as target_lifetime, cast(bad and mob < 12 as bigint) as target_bad12, seen >= 14 as obs12, cast(bad and mob < 24 as bigint) as target_bad24, seen >= 26 as obs24, round(case when bad then least(greatest(rec / funded, 0), 1) end, 6) as recovery_rate, case when bad then cast(rec > 0 as bigint) end as recovered_any, round(case when bad then least(greatest((funded - prn) / funded, 0), 1) end, 6) as ccf, round(case when bad then funded - prn - rec + fee else 0 end, 4) as net_loss from m""")
def _(a: DataFrame) -> DataFrame:
    x = a.select("id", "issue_d", F.when(F.col("y") == 1, "Charged Off").otherwise("Current").alias("loan_status"), F.when(F.col("id") % 5 != 0, F.add_months("issue_d", (F.col("id") % 30).cast("int"))).alias("last_pymnt_d"), F.col("funded").alias("funded_amnt"), (F.col("funded") * 0.3).alias("total_rec_prncp"), (F.col("funded") * (F.col("id") % 11) / 10.0).alias("recoveries"), F.lit(5.0).alias("collection_recovery_fee"))
    t = targets.with_losses(targets.with_targets(x, "2001-01-31")).withColumn("net_loss", F.round("net_loss", 4))
    return t.select("id", "mob_last_pay", "mob_observed", "target_lifetime", "target_bad12", "obs12", "target_bad24", "obs24", "recovery_rate", "recovered_any", "ccf", "net_loss")


@query("p27_p28_dummies", "$LENS select id, cast(coalesce(qty > 0 and qty <= 50, false) as bigint) as qty_0_50, cast(coalesce(qty > 50 and qty <= 100, false) as bigint) as qty_50_100, cast(qty is null as bigint) as qty_missing, cast(coalesce(segment in ('BUILDING', 'MACHINERY'), false) as bigint) as segment_industry from acc")
def _(a: DataFrame) -> DataFrame:
    return a.select("id", *[c.alias(n) for n, c in clean.ladder_dummies("qty", [(0, 50), (50, 100)]).items()], *[c.alias(n) for n, c in clean.group_dummies("segment", {"industry": ["BUILDING", "MACHINERY"]}).items()])


@query("p32_ladder", "$LENS select grade, cast(case when grade in ('1', '2', '3') then cast(grade as integer) - 1 end as bigint) as place, count(*) as n from acc group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    return a.select("grade", clean.ladder(F.col("grade"), ["1", "2", "3"]).alias("place")).groupBy("grade", "place").agg(F.count("*").alias("n"))


@query("u2_union_missing", "$LENS select split, count(*) as n, round(avg(p), 6) as mean_pd, cast(null as bigint) as bads from acc group by 1 union all select 'ALL', count(*), null, sum(y)::bigint from acc")
def _(a: DataFrame) -> DataFrame:
    every = a.agg(F.count("*").alias("n"), F.sum("y").alias("bads")).withColumn("split", F.lit("ALL"))
    return a.groupBy("split").agg(F.count("*").alias("n"), F.avg("p").alias("mean_pd")).unionByName(every, allowMissingColumns=True)


@query("u3_id_differences", "$LENS select (select count(*) from (select id from acc where id % 3 = 0 except select id from acc where id % 2 = 0)) as only_a, (select count(*) from (select id from acc where id % 3 = 0 intersect select id from acc where id % 2 = 0)) as both_sides")
def _(a: DataFrame) -> DataFrame:
    x, z = a.where("id % 3 = 0").select("id").distinct(), a.where("id % 2 = 0").select("id").distinct()
    return x.join(z, "id", "left_anti").agg(F.count("*").alias("only_a")).crossJoin(x.join(z, "id", "left_semi").agg(F.count("*").alias("both_sides")))  # one row each


@query("t2_largest_changes", "$LENS select vintage, grade, round(avg(y) - avg(p), 6) as gap from acc group by 1, 2 order by abs(avg(y) - avg(p)) desc, vintage, grade limit 8")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("vintage", "grade").agg((F.avg("y") - F.avg("p")).alias("gap"))
    return t.orderBy(F.abs("gap").desc(), "vintage", "grade").limit(8)


@query("t6_stratified_floor_sample", """$LENS, c as (select grade, count(*) as n from acc group by 1), k as (select grade, least(n, greatest(20, cast(round_even(n * 500.0 / (select count(*) from acc), 0) as bigint))) as k from c), r as (select id, grade, row_number() over (partition by grade order by md5('7:' || cast(id as varchar)), id) as rk from acc) select id, r.grade as grade from r join k using (grade) where rk <= k""")
def _(a: DataFrame) -> DataFrame:
    return targets.floor_sample(a.select("id", "grade"), "id", "grade", 500, 20, 7)


@query("j5_first_of_id", "with e as (select l_orderkey as id, l_linenumber as line, l_quantity as qty, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as k from lineitem) select o_orderkey as id, line, qty from orders join e on o_orderkey = id where k = 1 and qty is not null", lens=False)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", F.struct(F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", F.col("l_quantity").alias("qty")).alias("r"))
    first = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("r").alias("r"))  # combined before the shuffle, unlike row_number
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return orders.join(first, "id").select("id", "r.line", "r.qty").where("qty is not null")


@query("q2_status_counts", "$LENS select status, count(*) as n, case when status = 'F' then 'Bad' else 'Good' end as coding from acc group by 1")
def _(a: DataFrame) -> DataFrame:
    return a.groupBy("status").agg(F.count("*").alias("n")).withColumn("coding", F.when(F.col("status") == "F", "Bad").otherwise("Good"))


@query("q3_q4_yearly_shares", "$LENS select vintage, round(avg(case when segment = 'BUILDING' then 1.0 when segment is null then null else 0.0 end), 6) as building_share, count(*) filter (y = 1) as bad, count(*) filter (y = 1 and quarter(issue_d) <= 2) as bad_early, round(count(*) filter (y = 1 and quarter(issue_d) <= 2) / nullif(count(*) filter (y = 1), 0), 6) as early_share from acc group by 1")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("vintage").agg(F.avg((F.col("segment") == "BUILDING").cast("double")).alias("building_share"), F.sum("y").alias("bad"), F.sum((F.quarter("issue_d") <= 2).cast("int") * F.col("y")).alias("bad_early"))
    return t.withColumn("early_share", F.try_divide("bad_early", "bad"))


@query("q6_q10_widest", "$LENS, t as (select segment, grade, avg(y) as rate from acc group by 1, 2) select segment, round(min(rate), 6) as lowest, round(max(rate), 6) as highest, round(max(rate) - min(rate), 6) as width, arg_max(grade, (rate, -cast(grade as integer))) as worst_grade from t group by 1")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("segment", "grade").agg(F.avg("y").alias("rate"))
    return t.groupBy("segment").agg(F.min("rate").alias("lowest"), F.max("rate").alias("highest"), (F.max("rate") - F.min("rate")).alias("width"), F.max_by("grade", F.struct("rate", -F.col("grade").try_cast("int"))).alias("worst_grade"))


@query("b11_apply_labels", "$LENS, c as (select segment, count(*) as n from acc where segment in ('BUILDING', 'MACHINERY') group by 1) select segment, case when segment is null then 'missing' when segment in ('BUILDING', 'MACHINERY') then segment else (select arg_max(segment, n) from c) end as grp, count(*) as n from acc group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    names = ["BUILDING", "MACHINERY"]
    n = {r[0]: r[1] for r in a.where(F.col("segment").isin(*names)).groupBy("segment").count().collect()}  # two labels
    bins = binning.Bins("segment", groups=[[v] for v in names], bads=[n.get(v, 0) for v in names] + [0], goods=[0, 0, 0])
    return a.select("segment", F.get(F.array(*[F.lit(v) for v in [*names, "missing"]]), bins.index(F.col("segment"))).alias("grp")).groupBy("segment", "grp").agg(F.count("*").alias("n"))


_grown: dict[tuple, boosting.Boosted] = {}


def _boosted(a: DataFrame) -> boosting.Boosted:
    """100 trees of depth 3, grown once for the accounts as they are."""
    key = a.sparkSession.sparkContext.applicationId, a.semanticHash()
    if key not in _grown:
        _grown[key] = boosting.fit(a.where("split = 'dev'"), "y", ["balance", "qty", "returned", "disc", "segment"], trees=100, depth=3, signs={"qty": 1}, labels=["segment"], row_id="id", rows=0.8, columns=0.8)
    return _grown[key]


@query("m15_boosting")
def _(a: DataFrame) -> DataFrame:
    return a.select("id", "split", "y", _boosted(a).probability().alias("pd"))


@query("m21_m23_shap_importance")
def _(a: DataFrame) -> DataFrame:
    model = _boosted(a)
    return boosting.importance(boosting.with_shap(a, model), model)


@query("m22_shap_additivity")
def _(a: DataFrame) -> DataFrame:
    model = _boosted(a)
    return boosting.additivity(boosting.with_shap(a, model), model)


@query("m24_importance_comparison")
def _(a: DataFrame) -> DataFrame:
    model, card = _boosted(a), _card(a)
    shap = boosting.importance(boosting.with_shap(a, model), model).select("variable", "mean_abs")
    return boosting.compare_importance(shap, card.league(a.sparkSession).select("variable", "iv"), card.points_table(a.sparkSession))


@query("m12_m13_calibrators")
def _(a: DataFrame) -> DataFrame:
    dev = a.where("split = 'dev'")
    choice = calibrators.choose(dev, "y", clean.logit(F.col("p2")), "id")
    return choice.apply(a.select("id", "split", "p2"), clean.logit(F.col("p2"))).select("id", "split", F.lit(choice.kind).alias("kind"), "calibrated")


@query("m17_penalised_logit")
def _(a: DataFrame) -> DataFrame:
    x = a.select("y", *[c.cast("int").alias(n) for n, c in {**clean.ladder_dummies("qty", [(0, 50), (50, 100)]), **clean.group_dummies("segment", {"industry": ["BUILDING", "MACHINERY"]})}.items()])
    return regression.penalised_logit(x, "y", x.columns[1:]).table(a.sparkSession).select("term", "coef")
