"""Queries of model rules, encoders, the long battery, refitted back-tests and evidence over the account lens. They join the battery's register."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import benchmark, binning, bundles, calibration, loss, rank, recovery, regression, resampling, scorecard, sensitivity
from ..operators import governance as gov
from ..sources.models import load_bundles, save_bundles
from ..sources.scratch import narrowed, shared_dir
from .battery import query
from .modelling import LABELS, NUMERIC, SCENARIOS

# Fixed values of the lens: what is known only after the decision, and where models are tested and calibrated.
_AFTER = ("status", "returned", "y")
_RULES = {"p": gov.Applies(("dev", "oot1", "oot2")), "p2": gov.Applies(("dev", "oot1", "oot2"), ("oot2",)), "recal": gov.Applies(("oot2",))}
_LIGHTS = {"gini": ("high", 0.4, 0.25), "ks": ("high", 0.3, 0.2), "decile_rank_inversions": ("low", 0, 1), "central_tendency": ("low", 0.1, 0.2), "hl_p": ("high", 0.05, 0.01), "gini_decay": ("low", 0.1, 0.2)}


@query("p18_leakage_guard", "$LENS select 'balance' as variable, false as leaks, count(balance) as n from acc union all select 'status', true, count(status) from acc union all select 'qty', false, count(qty) from acc union all select 'returned', true, count(returned) from acc")
def _(a: DataFrame) -> DataFrame:
    names = ["balance", "status", "qty", "returned"]
    bad = gov.leaks(names, _AFTER)
    each = F.array(*[F.struct(F.lit(c).alias("variable"), F.lit(c in bad).alias("leaks"), F.col(c).isNotNull().cast("int").alias("there")) for c in names])
    return a.select(F.explode(each).alias("x")).groupBy("x.variable", "x.leaks").agg(F.sum("x.there").alias("n"))


@query("p30_aligned_columns", "$LENS select id, qty, cast(0 as bigint) as tenure, balance, cast(0 as bigint) as limit_use, cast(2 as bigint) as n_missing from acc")
def _(a: DataFrame) -> DataFrame:
    out, missing = gov.aligned(a, ["qty", "tenure", "balance", "limit_use"], ["id"])
    return out.withColumn("n_missing", F.lit(len(missing)))


@query("p31_encoders", """$LENS, c as (select segment, row_number() over (order by segment) - 1 as code from (select distinct segment from acc where split = 'dev' and segment <> 'MACHINERY'))
select id, cast(code as bigint) as code, cast(coalesce(acc.segment = 'AUTOMOBILE', false) as bigint) as "segment_AUTOMOBILE", cast(coalesce(acc.segment = 'BUILDING', false) as bigint) as "segment_BUILDING", cast(coalesce(acc.segment = 'FURNITURE', false) as bigint) as "segment_FURNITURE", cast(coalesce(acc.segment = 'HOUSEHOLD', false) as bigint) as "segment_HOUSEHOLD" from acc left join c on acc.segment = c.segment""")
def _(a: DataFrame) -> DataFrame:
    e = gov.learn_encoder(a.where("split = 'dev' and segment <> 'MACHINERY'"), "segment")
    return a.select("id", e.code().alias("code"), *[c.alias(n) for n, c in e.one_hot().items()])


_CUTS = [-500.5, 0.0, 4000.25]


@query("p36_interval_labels", "$LENS select case when balance is null then '(missing)' when balance <= -500.5 then '<= -500.5' when balance <= 0 then '(-500.5, 0]' when balance <= 4000.25 then '(0, 4000.25]' else '> 4000.25' end as label, count(*) as n, round(avg(y), 6) as bad_rate from acc group by 1")
def _(a: DataFrame) -> DataFrame:
    x, out = F.col("balance"), F.lit("(missing)")
    for lo, hi in zip([None, *_CUTS], [*_CUTS, None], strict=True):
        inside = (F.lit(True) if lo is None else x > lo) & (F.lit(True) if hi is None else x <= hi)
        out = F.when(inside, gov.interval_label(lo, hi)).otherwise(out)
    return a.groupBy(out.alias("label")).agg(F.count("*").alias("n"), F.avg("y").alias("bad_rate"))


_AREAS = [(("auto", "it"), "Mobility"), (("build", "machinery"), "Industry"), (("house", "fur"), "Home")]


@query("p38_areas", """$LENS, t as (select lower(segment) || '-' || status as test from acc)
select test, case when starts_with(test, 'auto') then 'Mobility' when starts_with(test, 'build') or starts_with(test, 'machinery') then 'Industry' when starts_with(test, 'house') then 'Home' else 'Other' end as area, case when starts_with(test, 'auto') then 'auto_' || upper(right(test, 1)) || '.csv' else 'results.csv' end as file, count(*) as n from t group by 1, 2, 3""")
def _(a: DataFrame) -> DataFrame:
    t = a.select(F.concat_ws("-", F.lower("segment"), "status").alias("test"))
    file = gov.by_prefix(F.col("test"), [("auto", F.concat(F.lit("auto_"), F.upper(F.right("test", F.lit(1))), F.lit(".csv")))], F.lit("results.csv"))
    return t.groupBy("test", gov.area_of(F.col("test"), _AREAS, "Other").alias("area"), file.alias("file")).agg(F.count("*").alias("n"))


@query("p40_resolved_column", "$LENS select split, round(avg(balance), 6) as mean, count(*) as n from acc group by 1")
def _(a: DataFrame) -> DataFrame:
    name = gov.resolve(a.columns, ["current_balance", "BALANCE", "qty"])
    return a.groupBy("split").agg(F.avg(name).alias("mean"), F.count("*").alias("n"))


@query("p6_century", "$LENS, d as (select id, issue_d, cast(issue_d + interval (cast(id % 3 as integer) * 60 - 40) month as date) as e from acc) select id, case when e > issue_d then cast(e - interval 1200 month as date) else e end as earliest from d")
def _(a: DataFrame) -> DataFrame:
    e = F.add_months("issue_d", ((F.col("id") % 3) * 60 - 40).cast("int"))
    return a.select("id", clean.fix_century(e, F.col("issue_d")).alias("earliest"))


@query("p35_lights", """$LENS, t as (select vintage, sum(p * 0.45 * funded) / nullif(sum(case when y = 1 then funded * 0.6 else 0 end), 0) as ratio, avg(p) - avg(p2) as d, count(*) as n from acc group by 1)
select vintage, round(ratio, 6) as ratio, case when ratio is null then 'n/a' when abs(1 - ratio) <= 0.1 then 'Green' when abs(1 - ratio) <= 0.25 then 'Amber' else 'Red' end as gap, case when d <= 0 then 'Red' when 1.0 / n < 0.001 then 'Green' else 'Amber' end as beats, 'Green in (0.9, 1.1); Amber in (0.75, 1.25)' as threshold from t""")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("vintage").agg(F.try_divide(F.sum(F.col("p") * 0.45 * F.col("funded")), F.nullif(F.sum(F.when(F.col("y") == 1, F.col("funded") * 0.6).otherwise(0.0)), F.lit(0.0))).alias("ratio"), (F.avg("p") - F.avg("p2")).alias("d"), F.count("*").alias("n"))
    return t.select("vintage", "ratio", gov.gap_light(F.col("ratio")).alias("gap"), gov.beats_light(F.col("d"), 1.0 / F.col("n"), 0.001).alias("beats"), F.lit(gov.threshold_text(("band", (0.9, 1.1), (0.75, 1.25)))).alias("threshold"))


@query("t8_fraction_sample", "$LENS select id, split from acc where substr(md5('0:' || cast(id as varchar)), 1, 8) < '33333333'")
def _(a: DataFrame) -> DataFrame:
    return gov.fraction_sample(a, "id", 0.2).select("id", "split")


_BATTERY_SQL = """, w as (select *, sum(b) over o as cb, sum(g) over o as cg, sum(b) over k as tb, sum(g) over k as tg from (select model, split, p, cast(sum(y) as double) as b, cast(sum(1 - y) as double) as g from m group by 1, 2, 3) window o as (partition by model, split order by p), k as (partition by model, split)),
d0 as (select model, split, sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)) as auc, max(abs(cb / tb - cg / tg)) as ks from w group by 1, 2),
b0 as (select model, split, avg((p - y) ** 2) as brier, 1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))) as skill, avg(p) as mp, avg(y) as obs from m group by 1, 2),
r1 as (select *, row_number() over (partition by model, split order by p desc, id) as rk, row_number() over (partition by model, split order by p, id) as up, count(*) over (partition by model, split) as nn from m),
t1 as (select model, split, floor((rk - 1) * 10 / nn) as dec, count(*) as n, sum(y) as b from r1 group by 1, 2, 3),
t2 as (select *, sum(b) over o as cb, sum(n) over o as cn, sum(b) over k as tb, sum(n) over k as tn, lag(b / n) over o as was from t1 window o as (partition by model, split order by dec), k as (partition by model, split)),
t3 as (select model, split, max(abs(cb / tb - (cn - cb) / (tn - tb))) as ksd, cast(sum(case when b / n > was then 1 else 0 end) as double) as inv from t2 group by 1, 2),
h1 as (select model, split, floor((up - 1) * 10 / nn) as bin, count(*) as n, avg(p) as mp, sum(p) as e, sum(y) as b from r1 group by 1, 2, 3),
h2 as (select model, split, sum((b - e) ** 2 / (n * mp * (1 - mp))) as hl from h1 group by 1, 2),
h3 as (select *, exp(-hl / 2) * list_sum(list_transform(range(0, 5), lambda i: (hl / 2) ** i / gamma(i + 1))) as hp from h2),
l as (select model, split, 'auc' as test, auc as value from d0 union all select model, split, 'gini', 2 * auc - 1 from d0 union all select model, split, 'ks', ks from d0 union all select model, split, 'brier', brier from b0 union all select model, split, 'brier_skill', skill from b0
union all select model, split, 'ks_decile', ksd from t3 union all select model, split, 'decile_rank_inversions', inv from t3
union all select model, split, 'mean_pd', mp from b0 where fits union all select model, split, 'obs_rate', obs from b0 where fits union all select model, split, 'central_tendency', abs(mp / obs - 1) from b0 where fits union all select model, split, 'central_tendency_signed', mp / obs - 1 from b0 where fits
union all select model, split, 'hl_stat', hl from h3 where fits union all select model, split, 'hl_p', hp from h3 where fits
union all select o.model, o.split, 'gini_decay', ((2 * d.auc - 1) - (2 * o.auc - 1)) / (2 * d.auc - 1) from d0 o join d0 d on o.model = d.model and d.split = 'dev' where o.split <> 'dev' and d.auc > 0.5)
select model, split, test, round(value, 5) as value, case test when 'gini' then 'Green >= 0.4; Amber >= 0.25' when 'ks' then 'Green >= 0.3; Amber >= 0.2' when 'decile_rank_inversions' then 'Green <= 0; Amber <= 1' when 'central_tendency' then 'Green <= 0.1; Amber <= 0.2' when 'hl_p' then 'Green >= 0.05; Amber >= 0.01' when 'gini_decay' then 'Green <= 0.1; Amber <= 0.2' else '' end as threshold,
case test when 'gini' then case when value >= 0.4 then 'Green' when value >= 0.25 then 'Amber' else 'Red' end when 'ks' then case when value >= 0.3 then 'Green' when value >= 0.2 then 'Amber' else 'Red' end when 'decile_rank_inversions' then case when value <= 0 then 'Green' when value <= 1 then 'Amber' else 'Red' end when 'central_tendency' then case when value <= 0.1 then 'Green' when value <= 0.2 then 'Amber' else 'Red' end when 'hl_p' then case when value >= 0.05 then 'Green' when value >= 0.01 then 'Amber' else 'Red' end when 'gini_decay' then case when value <= 0.1 then 'Green' when value <= 0.2 then 'Amber' else 'Red' end else 'n/a' end as light from l"""
_LONG_SQL = "$LENS, m as (select 'p' as model, split, id, y, p from acc where split <> 'partial' union all select 'p2', split, id, y, p2 from acc where split <> 'partial' union all select 'recal', split, id, y, p * 0.9 from acc where split = 'oot2')"


def _long(a: DataFrame) -> DataFrame:
    return gov.scored(a, {"p": F.col("p"), "p2": F.col("p2"), "recal": F.col("p") * 0.9}, _RULES, {}, F.col("y"), "id", "split", "grade")


def _shown(t: DataFrame) -> DataFrame:
    return t.withColumn("value", F.round("value", 5))


@query("v8_v9_full_battery", _LONG_SQL + _BATTERY_SQL.replace("where fits", "where model in ('p', 'recal') or split = 'oot2'"))
def _(a: DataFrame) -> DataFrame:
    return _shown(gov.battery(_long(a), _RULES, _LIGHTS, "dev"))


def _lifetime() -> Column:
    return F.col("status").isin("F", "P").cast("int")


@query("v9_target_choice", _LONG_SQL.replace("id, y, p", "id, case when split = 'oot2' then cast(status in ('F', 'P') as int) else y end as y, p").replace("id, y, p2", "id, case when split = 'oot2' then cast(status in ('F', 'P') as int) else y end, p2") + _BATTERY_SQL.replace("where fits", "where model in ('p', 'recal') or split = 'oot2'"))
def _(a: DataFrame) -> DataFrame:
    """The battery where the last split has the lifetime target."""
    long = gov.scored(a, {"p": F.col("p"), "p2": F.col("p2"), "recal": F.col("p") * 0.9}, _RULES, {"oot2": _lifetime()}, F.col("y"), "id", "split")
    return _shown(gov.battery(long, _RULES, _LIGHTS, "dev"))


@query("v9_group_p")
def _(a: DataFrame) -> DataFrame:
    """The battery with each model's least group probability."""
    return _shown(gov.battery(_long(a), _RULES, _LIGHTS, "dev", group="grade"))


@query("x1_sample_metrics", "$LENS, m as (select 'p' as model, split, id, y, p from (select * from acc where split <> 'partial' order by md5('0:' || cast(id as varchar)) limit 5000))" + _BATTERY_SQL.replace("where fits", ""))
def _(a: DataFrame) -> DataFrame:
    sample = resampling.capped_sample(a.where("split <> 'partial'"), "id", 5000)  # the sample that is scored again
    return _shown(gov.battery(gov.scored(sample, {"p": F.col("p")}, {"p": _RULES["p"]}, {}, F.col("y"), "id", "split"), {"p": _RULES["p"]}, _LIGHTS, "dev"))


@query("v2_group_tails", """$LENS, t as (select grade, count(*) as n, cast(sum(y) as bigint) as bads, avg(p) as mean_pd from acc group by grade)
select grade, n, bads, round(mean_pd, 6) as mean_pd, round(list_sum(list_transform(range(bads, n + 1), lambda k: exp(lgamma(n + 1) - (case when k = 0 then 0 else lgamma(k + 1) end) - (case when k = n then 0 else lgamma(n - k + 1) end) + k * ln(mean_pd) + (n - k) * ln(1 - mean_pd)))), 5) as p_exact from t""")
def _(a: DataFrame) -> DataFrame:
    t = gov.group_tails(calibration.by_group(a, "y", "p", "grade"))  # the SQL adds up every term of the tail
    return t.select("grade", "n", "bads", "mean_pd", F.round("p_exact", 5).alias("p_exact"))


@query("v2_v5_p_values")
def _(a: DataFrame) -> DataFrame:
    """All tails of all grades, and the paired test's two-sided one."""
    groups = gov.group_tails(calibration.by_group(a, "y", "p", "grade")).select("grade", "z", "p_normal", "p_exact", "p_jeffreys")
    pair = gov.with_tails(rank.delong(a, "y", "p", "p2"), {"p_two_sided": lambda s, r: None if r["delong_z"] is None else gov.special.normal_two_sided(s, r["delong_z"])})
    return groups.unionByName(pair.select(F.lit("p and p2").alias("grade"), F.col("delong_z").alias("z"), F.col("p_two_sided").alias("p_normal")), allowMissingColumns=True)


@query("v1_p_value", "select hl, df, round(exp(-hl / 2) * list_sum(list_transform(range(0, 5), lambda i: (hl / 2) ** i / gamma(i + 1))), 6) as p from (" + "$LENS, r as (select *, row_number() over (order by p, id) as rk, count(*) over () as nn from acc), t as (select floor((rk - 1) * 10 / nn) as bin, count(*) as n, avg(p) as mp, sum(p) as e, sum(y) as b from r group by 1) select round(sum((b - e) ** 2 / (n * mp * (1 - mp))), 6) as hl, cast(10 as bigint) as df from t)")
def _(a: DataFrame) -> DataFrame:
    t = calibration.hosmer_lemeshow(a, "y", "p", "id").select("hl", F.col("df").cast("int").alias("df"))
    return gov.with_tails(t, {"p": lambda s, r: gov.special.chi2_sf(s, r["hl"], r["df"])})


@query("n2_rank_agreement", """$LENS, s(scenario, m, k) as (values ('qty_up', 1.1, 0.0), ('all', 1.1, 1.0)), x as (select scenario, p as b, round((coalesce(qty * m, 0) + 1.0) / (coalesce(n_lines + k, 0) * 50 + 10.0), 6) as c from acc, s),
r as (select scenario, rank() over (partition by scenario order by b) + (count(*) over (partition by scenario, b) - 1) / 2.0 as rb, rank() over (partition by scenario order by c) + (count(*) over (partition by scenario, c) - 1) / 2.0 as rc from x)
select scenario, round(corr(rb, rc), 6) as spearman from r group by 1""")
def _(a: DataFrame) -> DataFrame:
    x = sensitivity.with_scenarios(a.withColumn("base", F.col("p")), {k: SCENARIOS[k] for k in ("qty_up", "all")})
    x = x.withColumn("p", F.round((F.coalesce("qty", F.lit(0.0)) + 1.0) / (F.coalesce("n_lines", F.lit(0)) * 50 + 10.0), 6))
    return sensitivity.rank_agreement(x, "base", "p", "scenario", ["qty_up", "all"])


@query("f4_evidence", "$LENS select split, printf('%s: %d accounts, %d bad', split, count(*), cast(sum(y) as bigint)) as evidence from acc group by split")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("split").agg(F.count("*").alias("n"), F.sum("y").cast("long").alias("bads"))
    return t.select("split", gov.evidence(t, "%s: %d accounts, %d bad", "split", "n", "bads").alias("evidence"))


def _card(rows: DataFrame, names: list[str]) -> scorecard.Scorecard:
    return scorecard.fit_scorecard(rows, "y", binning.fit_numeric(rows, names, "y"), iv_min=0.0, p_max=1.0)  # the lens's features carry little information


@query("m19_m20_champions")
def _(a: DataFrame) -> DataFrame:
    """The full and the independent scorecard and a penalised logit, trained on the development rows in one call; then every model's discrimination on every split."""
    gov.assert_no_leakage(NUMERIC, _AFTER)
    a = narrowed(a, "id", "split", "y", *NUMERIC, "disc")

    def logit(rows: DataFrame) -> Column:
        x = rows.select("y", "balance", "qty").dropna()
        fit = regression.penalised_logit(x, "y", ["balance", "qty"])
        return F.coalesce(fit.probability(), F.lit(0.5))

    models = gov.train(a.where("split = 'dev'"), {"full": lambda r: _card(r, ["balance", "qty", "funded", "disc"]).probability(), "independent": lambda r: _card(r, ["balance", "funded"]).probability(), "logit": logit})
    rules = {m: gov.Applies(("dev", "oot1", "oot2")) for m in models}
    return rank.discrimination(gov.scored(a, models, rules, {}, F.col("y"), "id", "split"), "y", "p", ["model", "split"])


_DESIGN = bundles.DummyDesign({"qty": [(0, 50), (50, 100), (100, 200)]}, {"segment": {"industry": ["BUILDING", "MACHINERY"], "home": ["HOUSEHOLD", "FURNITURE"], "car": ["AUTOMOBILE"]}}, ("qty_0_50", "segment_car"))


@query("m20_training_run")
def _(a: DataFrame) -> DataFrame:
    """All six models of a training run, saved whole and read back; then every model's discrimination on every split."""
    a = narrowed(a.withColumn("lifetime", _lifetime()), "id", "split", "y", "vintage", "lifetime", *NUMERIC, "disc", "segment")
    dev = gov.with_digest_share(a.where("split = 'dev'"), "id")
    data = bundles.Data(dev.where("__share < 0.8"), dev.where("__share >= 0.8"), a.where("split = 'oot1'"), dev, "y", "lifetime", "id", "vintage")
    setting = {k: (bundles.SETTING, 60) for k in ("level", "leaf")}  # the search is m16_expanding_search
    run = bundles.train_all(data, ["balance", "qty", "funded", "disc", "segment"], ["balance", "disc"], ["segment"], _DESIGN, {"qty": 1}, _AFTER, settings=setting, selection={"iv_min": 0.0, "p_max": 1.0})
    path = f"{shared_dir(a.sparkSession)}/bundles-{uuid.uuid4().hex}.json"
    save_bundles(a.sparkSession, run, path, "orders")
    rows = a.where("split <> 'partial'")
    for b in load_bundles(a.sparkSession, path).values():
        rows = b.apply(rows)
    long = rows.select("split", "y", F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(n).alias("p")) for n in bundles.ORDER])).alias("m")).select("split", "y", "m.*")
    return rank.discrimination(long, "y", "p", ["model", "split"])


_PAIRS = {"score against grade": ("p", "grade_rank"), "challenger against grade": ("p2", "grade_rank"), "score against challenger": ("p", "p2"), "score against rate": ("p", "disc")}


def _ranked(a: DataFrame) -> DataFrame:
    return a.withColumn("grade_rank", F.col("grade").cast("double")).withColumn("p2", F.col("p2").cast("double"))


@query("k3_benchmark_table")
def _(a: DataFrame) -> DataFrame:
    """Every pair on both later splits, with 500 draws for each interval."""
    return benchmark.benchmark_table(_ranked(a), "y", _PAIRS, "split", ("oot1", "oot2"), "id")


def _pairs_sql() -> str:
    """Paired tests from average placements, pair by pair."""
    one = """select {name!r} as pair, split, max(case when y = 1 then a end) as auc_a, max(case when y = 1 then b end) as auc_b, max(case when y = 1 then a - b end) / sqrt(sum(s / n)) as delong_z from (
      select split, y, count(*) as n, avg(va) as a, avg(vb) as b, var_samp(va - vb) as s from (
        select split, y, case when y = 1 then la / k else 1 - ua / m end as va, case when y = 1 then lb / k else 1 - ub / m end as vb from (
          select *, sum(y) over s as m, sum(1 - y) over s as k, sum(1 - y) over (partition by split order by {a}) - sum(1 - y) over (partition by split, {a}) / 2.0 as la, sum(y) over (partition by split order by {a}) - sum(y) over (partition by split, {a}) / 2.0 as ua,
            sum(1 - y) over (partition by split order by {b}) - sum(1 - y) over (partition by split, {b}) / 2.0 as lb, sum(y) over (partition by split order by {b}) - sum(y) over (partition by split, {b}) / 2.0 as ub
          from (select *, cast(grade as double) as grade_rank from acc where split in ('oot1', 'oot2')) where {a} is not null and {b} is not null window s as (partition by split)))
      group by 1, 2) group by 2"""
    rows = " union all ".join(one.format(name=n, a=a, b=b) for n, (a, b) in _PAIRS.items())
    return f"$LENS select split, pair, round(auc_a, 6) as auc_a, round(auc_b, 6) as auc_b, round(2 * auc_a - 1, 6) as gini_a, round(2 * auc_b - 1, 6) as gini_b, round(auc_a - auc_b, 6) as d_auc, round(delong_z, 5) as delong_z from ({rows})"


@query("k3_pair_tests", _pairs_sql())
def _(a: DataFrame) -> DataFrame:
    return benchmark.pair_rows(_ranked(a), "y", _PAIRS, "split", ("oot1", "oot2")).drop("delong_p").withColumn("delong_z", F.round("delong_z", 5))


@query("l3_lifetime_back_test")
def _(a: DataFrame) -> DataFrame:
    """Scorecard and loss model refitted on vintages to 1997, expected against realized loss on these and on 1998, by grade and in all."""
    rows = a.withColumns({"ccf": clean.clipped(F.col("disc") * 10), "sample": F.when(F.col("vintage") <= 1997, "train (in-sample)").when(F.col("vintage") == 1998, "test 1998")}).where("sample is not null")
    rows = narrowed(rows, "vintage", "sample", "y", "returned", "ccf", *NUMERIC, *LABELS)
    train = rows.where("vintage <= 1997")
    card = _card(train, ["balance", "qty", "funded"])
    model = recovery.fit_loss_model(train.where("y = 1"), "returned", "ccf", [c for c in NUMERIC if c != "funded"], LABELS)
    told = model.predict(rows.withColumn("pd", card.probability()), "funded")
    told = told.withColumns({"el": F.col("pd") * F.col("lgd") * F.col("ead"), "realized": F.col("funded") * F.col("y") * 0.6})
    return loss.back_test(told, "sample", "grade", "funded", "pd", "y", "el", "realized")


@query("l4_model_inputs", """$LENS, s as (select * from (select *, row_number() over (partition by grade order by md5('0:' || cast(id as varchar))) as k from acc where split = 'oot1') where k <= 40)
select id, grade, cast(case when qty is null then 12 when qty <= 50 then 20 when qty <= 100 then 35 else 41 end as bigint) as points_qty, round(funded * p, 4) as exposure from s""")
def _(a: DataFrame) -> DataFrame:
    """A stratified sample with its points columns, as a model's inputs are handed over."""
    from pyspark.sql import Window

    digest = F.md5(F.concat_ws(":", F.lit("0"), F.col("id").cast("string")))
    s = a.where("split = 'oot1'").withColumn("k", F.row_number().over(Window.partitionBy("grade").orderBy(digest))).where("k <= 40")
    points = F.when(F.col("qty").isNull(), 12).when(F.col("qty") <= 50, 20).when(F.col("qty") <= 100, 35).otherwise(41)
    return s.select("id", "grade", points.alias("points_qty"), F.round(F.col("funded") * F.col("p"), 4).alias("exposure"))
