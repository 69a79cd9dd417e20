"""Queries of reports, benchmarks, searches and designs over the account lens. They join the battery's register."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import facts, rank, regression, resampling, search, stability
from .battery import _SCORES, SQL, _psi_sql, query
from .modelling import _RESULTS, _results

#: Fixed value: the index above which a feature counts as red.
RED = 0.25


@query("q8_psi_terms", _psi_sql("split") + "select grp as split, bin, round(cs - ds, 6) as difference, round(ln(a / e), 6) as log_ratio, round((a - e) * ln(a / e), 6) as psi from f")
def _(a: DataFrame) -> DataFrame:
    dev = F.col("split") == "dev"
    t = stability.psi_table(a, "p", dev, stability.edges(a.where(dev), "p"), ["split"])
    floored = lambda c: F.greatest(F.col(c), F.lit(stability.FLOOR))
    return t.select("split", "bin", (F.col("share") - F.col("dev_share")).alias("difference"), F.ln(floored("share") / floored("dev_share")).alias("log_ratio"), "psi")


@query("c7_stability_rows", f"select (select max(psi) from ({SQL['c5_csi']})) as csi_max, (select count(*) from ({SQL['c5_csi']}) where psi > {RED}) as csi_n_red, (select max(psi) from ({SQL['c6_psi_by_quarter']})) as quarter_max")
def _(a: DataFrame) -> DataFrame:
    dev = F.col("split") == "dev"
    features = stability.csi(a, dev, ["balance", "qty"], ["segment"]).agg(F.max("psi").alias("csi_max"), F.count_if(F.col("psi") > RED).alias("csi_n_red"))
    return features.crossJoin(F.broadcast(stability.psi(a, "p", dev, ["quarter"]).agg(F.max("psi").alias("quarter_max"))))  # one row each


_VARIANTS = "m as (select 'base' as variant, p, y from acc union all select 'with_pending', p, case when status in ('F', 'P') then 1 else 0 end from acc union all select 'short', p, case when y = 1 and n_lines < 3 then 1 else 0 end from acc)"


@query("n5_target_variants", _SCORES.replace("$LENS,", f"$LENS, {_VARIANTS},").replace("from acc group", "from m group").replace("split", "variant") + "select variant, cast(max(tb + tg) as bigint) as n, cast(max(tb) as bigint) as bads, round(sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)), 6) as auc, round(2 * sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)) - 1, 6) as gini, round(max(abs(cb / tb - cg / tg)), 6) as ks from q group by variant")
def _(a: DataFrame) -> DataFrame:
    bad = F.col("y") == 1
    return rank.discrimination(facts.target_variants(a, {"base": bad, "with_pending": F.col("status").isin("F", "P"), "short": bad & (F.col("n_lines") < 3)}, "p"), "y", "p", ["variant"])


@query("a10_a11_top_features", """$LENS, t as (select variable, label, sum(y) as bads, sum(1 - y) as goods from (select 'segment' as variable, segment as label, y from acc union all select 'grade', grade, y from acc union all select 'quarter', quarter, y from acc) group by 1, 2),
s as (select *, (bads + 0.5) / (sum(bads) over (partition by variable) + 0.5 * count(*) over (partition by variable)) as b, (goods + 0.5) / (sum(goods) over (partition by variable) + 0.5 * count(*) over (partition by variable)) as g from t)
select variable, round(sum((g - b) * ln(g / b)), 6) as iv, round(max(ln(g / b)) - min(ln(g / b)), 6) as woe_range from s group by variable order by sum((g - b) * ln(g / b)) desc limit 2""")
def _(a: DataFrame) -> DataFrame:
    return facts.label_values(a, "y", ["segment", "grade", "quarter"]).orderBy(F.col("iv").desc(), "variable").limit(2)


@query("a12_u1_union_by_vintage", "$LENS select vintage, count(*) as n, round(avg(y), 6) as bad_rate from acc where split in ('dev', 'oot1') group by vintage")
def _(a: DataFrame) -> DataFrame:
    both = a.where("split = 'dev'").select("vintage", "y").unionByName(a.where("split = 'oot1'").select("vintage", "y"))
    return both.groupBy("vintage").agg(F.count("*").alias("n"), F.avg("y").alias("bad_rate"))


@query("a15_light_counts", _RESULTS + "select split, light, count(*) as n from z group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    return _results(a).groupBy("split", "light").agg(F.count("*").alias("n"))


@query("a16_preferred_row", "$LENS, r as (select quarter, id, grade, row_number() over (partition by quarter order by grade <> '1', id) as k from acc) select quarter, id, grade from r where k = 1")
def _(a: DataFrame) -> DataFrame:
    return facts.preferred(a, ["quarter"], [F.col("grade") != "1", F.col("id")], ["id", "grade"])


@query("s14_value_counts", "$LENS, m as (select 'status' as variable, status as label from acc union all select 'segment', segment from acc union all select 'vintage', cast(vintage as varchar) from acc) select variable, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by variable), 6) as share from m group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    return facts.value_counts(a, ["status", "segment", "vintage"])


@query("p14_p17_features", "$LENS select id, cast(regexp_extract(quarter, '([0-9]+)', 1) as double) as year_number, case segment when 'BUILDING' then 0.0 when 'MACHINERY' then null else cast(grade as double) end as years, (year(issue_d) * 12 + month(issue_d)) - (1990 * 12 + 1) as age, round(case when balance > 0 then funded / balance end, 4) as ratio from acc")
def _(a: DataFrame) -> DataFrame:
    job = F.when(F.col("segment") == "BUILDING", "< 1 year").when(F.col("segment") == "MACHINERY", "n/a").otherwise(F.concat("grade", F.lit(" years")))
    return a.select("id", clean.first_number(F.col("quarter")).cast("double").alias("year_number"), clean.employment_years(job).cast("double").alias("years"), clean.months_between(F.col("issue_d"), F.lit("1990-01-01").cast("date")).alias("age"), F.round(clean.guarded_ratio(F.col("funded"), F.col("balance")), 4).alias("ratio"))


@query("p19_p21_windows", "$LENS select cast(issue_d between date '1995-01-01' and date '1997-06-30' and n_lines >= 1 as bigint) as in_dev, cast(starts_with(segment, 'HOUSE') as bigint) as excluded, count(*) as n, cast(sum(y) as bigint) as bads from acc where n_lines is not null group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    known = a.where("n_lines is not null")
    flags = known.select((F.col("issue_d").between("1995-01-01", "1997-06-30") & (F.col("n_lines") >= 1)).cast("int").alias("in_dev"), F.col("segment").startswith("HOUSE").cast("int").alias("excluded"), "y")
    return flags.groupBy("in_dev", "excluded").agg(F.count("*").alias("n"), F.sum("y").alias("bads"))


@query("t5_t7_capped_sample", "$LENS select id, split from acc order by md5('0:' || cast(id as varchar)) limit 500")
def _(a: DataFrame) -> DataFrame:
    return resampling.capped_sample(a, "id", 500).select("id", "split")


# Bins of two variables with their points; lo lies outside, hi inside, null is open.
_BINS = [("qty", 1, None, 50.0, False, 20), ("qty", 2, 50.0, 100.0, False, 35), ("qty", 3, 100.0, None, False, 41), ("qty", 4, None, None, True, 12), ("balance", 1, None, 0.0, False, 18), ("balance", 2, 0.0, 5000.0, False, 30), ("balance", 3, 5000.0, None, False, 44), ("balance", 4, None, None, True, 25)]
_BINS_SQL = "$LENS, b(variable, bin, lo, hi, missing, points) as (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in _BINS) + """),
m as (select id, y, 'qty' as variable, cast(qty as double) as x from acc union all select id, y, 'balance', cast(balance as double) from acc),
l as (select m.*, b.bin, b.points from m join b on m.variable = b.variable and case when x is null then b.missing else not b.missing and coalesce(x > b.lo, true) and coalesce(x <= b.hi, true) end)
"""


def _looked_up(a: DataFrame) -> DataFrame:
    bins = a.sparkSession.createDataFrame(_BINS, "variable string, bin int, lo double, hi double, missing boolean, points int")
    return facts.bin_lookup(facts.melted(a, ["qty", "balance"], "id", "y", value="x", kind="double"), bins)


@query("j7_j8_bin_lookup", _BINS_SQL + "select variable, cast(bin as bigint) as bin, count(*) as n, round(avg(y), 6) as bad_rate, cast(sum(points) as bigint) as points from l group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    return _looked_up(a).groupBy("variable", "bin").agg(F.count("*").alias("n"), F.avg("y").alias("bad_rate"), F.sum("points").alias("points"))


@query("q12_worked_score", _BINS_SQL + "select variable, round(x, 6) as x, cast(bin as bigint) as bin, cast(points as bigint) as points from l where id = (select min(id) from acc where split = 'oot1')")
def _(a: DataFrame) -> DataFrame:
    one = a.where("split = 'oot1'").orderBy("id").limit(1)
    return _looked_up(one).select("variable", "x", "bin", "points")


@query("l1_account_el", "$LENS select id, round(p * 0.45 * funded, 4) as el from acc")
def _(a: DataFrame) -> DataFrame:
    return a.select("id", F.round(F.col("p") * 0.45 * F.col("funded"), 4).alias("el"))


def _placements(p: str) -> str:
    return f"(select split, {p}, sum(sum(1 - y)) over (partition by split order by {p}) - sum(1 - y) / 2.0 as lo, sum(sum(y)) over (partition by split order by {p}) - sum(y) / 2.0 as up from acc group by 1, 2)"


@query("k2_k3_benchmark_pairs", f"""$LENS, w as (select split, sum(y) as m, sum(1 - y) as k from acc where split in ('oot1', 'oot2') group by 1), sa as {_placements('p')}, sb as {_placements('p2')},
v as (select w.split as split, y, m, k, case when y = 1 then sa.lo / k else 1 - sa.up / m end as va, case when y = 1 then sb.lo / k else 1 - sb.up / m end as vb from acc join w on acc.split = w.split join sa on acc.p = sa.p and acc.split = sa.split join sb on acc.p2 = sb.p2 and acc.split = sb.split),
g as (select split, y, max(case when y = 1 then m else k end) as n, avg(va) as a, avg(vb) as b, var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb) as s from v group by 1, 2)
select split, round(max(case when y = 1 then a end), 6) as auc_a, round(max(case when y = 1 then b end), 6) as auc_b, round(2 * max(case when y = 1 then a end) - 1, 6) as gini_a, round(2 * max(case when y = 1 then b end) - 1, 6) as gini_b, round(max(case when y = 1 then a - b end), 6) as d_auc, round(max(case when y = 1 then a - b end) / sqrt(sum(s / n)), 5) as delong_z from g group by split""")
def _(a: DataFrame) -> DataFrame:
    both = reduce(DataFrame.unionByName, [rank.delong(a.where(F.col("split") == s), "y", "p", "p2").withColumn("split", F.lit(s)) for s in ("oot1", "oot2")])
    return both.select("split", "auc_a", "auc_b", (2 * F.col("auc_a") - 1).alias("gini_a"), (2 * F.col("auc_b") - 1).alias("gini_b"), "d_auc", F.round("delong_z", 5).alias("delong_z"))


# Fixed values of a dummy design: steps (lo, hi], groups of labels, and the levels that are left out as references.
_LADDERS = {"qty": [(0, 50), (50, 100), (100, 200)], "balance": [(-1000, 0), (0, 5000), (5000, 10000)]}
_GROUPS = {"segment": {"industry": ["BUILDING", "MACHINERY"], "home": ["HOUSEHOLD", "FURNITURE"], "car": ["AUTOMOBILE"]}, "grade": {g: [g] for g in "12345"}}
_REFERENCES = ("qty_0_50", "balance_0_5000", "segment_car", "grade_1")


def _design_sql() -> str:
    flag = lambda test, name: f"cast(coalesce({test}, false) as bigint) as {name}"
    out = [x for c, steps in _LADDERS.items() for x in [*[(f"{c} > {lo} and {c} <= {hi}", f"{c}_{lo}_{hi}".replace("-", "m")) for lo, hi in steps], (f"{c} is null", f"{c}_missing")]]
    out += [(f"{c} in ({', '.join(map(repr, labels))})", f"{c}_{n}") for c, groups in _GROUPS.items() for n, labels in groups.items()]
    return "$LENS select id, " + ", ".join(flag(*x) for x in out if x[1] not in _REFERENCES) + " from acc"


@query("p29_dummy_design", _design_sql())
def _(a: DataFrame) -> DataFrame:
    return a.select("id", *[c.alias(n.replace("-", "m")) for n, c in clean.dummy_design(_LADDERS, _GROUPS, _REFERENCES).items()])


@query("q11_wald_comparison")
def _(a: DataFrame) -> DataFrame:
    x = a.select("y", *[c.alias(n.replace("-", "m")) for n, c in clean.dummy_design({}, _GROUPS, _REFERENCES[2:]).items()])
    plain = regression.logit_fit(x, "y", x.columns[1:]).table(a.sparkSession).select("term", "coef", "se")
    shrunk = regression.penalised_logit(x, "y", x.columns[1:]).table(a.sparkSession).select("term", F.col("coef").alias("coef_penalised"))
    return plain.join(shrunk, "term").withColumn("shrink", F.col("coef") - F.col("coef_penalised"))  # a row for each term


@query("m18_combined_benchmark")
def _(a: DataFrame) -> DataFrame:
    x = a.where("split = 'dev'").select("y", clean.ladder(F.col("grade"), list("12345")).alias("grade_rank"), clean.logit(F.col("p")).alias("margin"))
    return regression.logit_fit(x, "y", ["grade_rank", "margin"]).table(a.sparkSession)


@query("m16_expanding_search")
def _(a: DataFrame) -> DataFrame:
    found = search.expanding_search(a.where("split = 'dev'"), "y", ["balance", "qty", "returned", "segment"], "vintage", "id", validate=(1996, 1997, 1998), labels=["segment"])
    return found.table(a.sparkSession)


@query("q1_point_lookup", _RESULTS + "select round(max(case when split = 'oot1' and metric = 'auc' then value end), 6) as oot1_auc, round(max(case when split = 'oot2' and metric = 'ks' then value end), 6) as oot2_ks, round(max(case when split = 'none' then value end), 6) as absent from z")
def _(a: DataFrame) -> DataFrame:
    at = lambda split, metric, name: F.max(F.when((F.col("split") == split) & (F.col("metric") == metric), F.col("value"))).alias(name)
    return _results(a).agg(at("oot1", "auc", "oot1_auc"), at("oot2", "ks", "oot2_ks"), at("none", "auc", "absent"))


@query("u4_label_universe", "$LENS select segment from acc where split = 'dev' union select segment from acc where split = 'oot1'")
def _(a: DataFrame) -> DataFrame:
    return a.where("split = 'dev'").select("segment").union(a.where("split = 'oot1'").select("segment")).distinct()

