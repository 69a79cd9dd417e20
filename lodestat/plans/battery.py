"""The registered queries over the account lens, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import clean
from ..operators import binning, calibration, loss, rank, stability, targets
from .lens import LENS_SQL, accounts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint") else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, lens: bool = True) -> Callable:
    """Register a function of the account lens (or of the session and the folder)."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = (lambda spark, sf_dir: _rounded(f(accounts(spark, sf_dir)))) if lens else (lambda spark, sf_dir: _rounded(f(spark, sf_dir)))
        if sql is not None:
            SQL[name] = sql.replace("$LENS", LENS_SQL.strip())
        return f

    return add


_DECILES = """$LENS, r as (select *, row_number() over (order by p desc, id) as rk, count(*) over () as nn from acc),
t as (select cast(floor((rk - 1) * 10 / nn) + 1 as bigint) as decile, count(*) as n, sum(y) as bads, avg(p) as mean_pd, min(p) as score_min, max(p) as score_max from r group by 1),
c as (select *, sum(bads) over (order by decile) as cb, sum(n) over (order by decile) as cn, sum(bads) over () as tb, sum(n) over () as tn from t)
"""
_SELECT_DECILES = """select decile, n, cast(bads as bigint) as bads, round(bads / n, 6) as bad_rate, round(mean_pd, 6) as mean_pd, score_min, score_max, cast(cb as bigint) as cum_bads, round(cb / tb, 6) as cum_bad_share, round((cn - cb) / (tn - tb), 6) as cum_good_share,
round(abs(cb / tb - (cn - cb) / (tn - tb)), 6) as ks_at_decile, round((bads / n) / (tb / tn), 6) as lift, round((cb / cn) / (tb / tn), 6) as cum_lift from c"""


@query("w4_decile_table", _DECILES + _SELECT_DECILES)
def _(a: DataFrame) -> DataFrame:
    return rank.decile_table(a, "y", "p", "id")


_SCORES = """$LENS, s as (select split, p, sum(y) as b, sum(1 - y) as g from acc group by 1, 2),
q as (select *, sum(b) over (partition by split order by p) as cb, sum(g) over (partition by split order by p) as cg, sum(b) over (partition by split) as tb, sum(g) over (partition by split) as tg from s)
"""


@query("w1_w2_discrimination", _SCORES + "select split, cast(max(tb + tg) as bigint) as n, cast(max(tb) as bigint) as bads, round(sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)), 6) as auc, round(2 * sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)) - 1, 6) as gini, round(max(abs(cb / tb - cg / tg)), 6) as ks from q group by split")
def _(a: DataFrame) -> DataFrame:
    return rank.discrimination(a, "y", "p", ["split"])


@query("a6_vintage_performance", (_SCORES + "select split as vintage, cast(max(tb + tg) as bigint) as n, round(max(tb) / max(tb + tg), 6) as bad_rate, round(sum(p * (b + g)) / max(tb + tg), 6) as mean_pd, round(sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)), 6) as auc from q group by split").replace("split", "vintage"))
def _(a: DataFrame) -> DataFrame:
    auc = rank.discrimination(a, "y", "p", ["vintage"]).select("vintage", "auc")
    return a.groupBy("vintage").agg(F.count("*").alias("n"), F.avg("y").alias("bad_rate"), F.avg("p").alias("mean_pd")).join(auc, "vintage")


@query("w3_w9_stable_ranks", "$LENS select id, p, row_number() over (order by p desc, id) as \"rank\", cast(floor((row_number() over (order by p desc, id) - 1) * 10 / count(*) over ()) + 1 as bigint) as decile from acc")
def _(a: DataFrame) -> DataFrame:
    return rank.ranked(a.select("id", "p"), "p", "id").select("id", "p", "rank", rank.decile_of(F.col("rank"), F.col("n")).alias("decile"))


_CALIBRATION = """$LENS, r as (select *, row_number() over (order by p, id) as rk, count(*) over () as nn from acc),
t as (select cast(floor((rk - 1) * 10 / nn) + 1 as bigint) as bin, count(*) as n, avg(p) as mean_pd, avg(y) as obs_rate, sum(p) as expected_bads, sum(y) as bads from r group by 1)
"""


@query("w5_calibration_table", _CALIBRATION + "select bin, n, round(mean_pd, 6) as mean_pd, round(obs_rate, 6) as obs_rate, round(expected_bads, 6) as expected_bads, cast(bads as bigint) as bads, round(obs_rate - mean_pd, 6) as diff from t")
def _(a: DataFrame) -> DataFrame:
    return rank.calibration_table(a, "y", "p", "id")


@query("v1_hosmer_lemeshow", _CALIBRATION + "select round(sum((bads - expected_bads) ** 2 / (n * mean_pd * (1 - mean_pd))), 6) as hl, cast(10 as bigint) as df from t")
def _(a: DataFrame) -> DataFrame:
    return calibration.hosmer_lemeshow(a, "y", "p", "id")


@query("q9_hl_contributions", _CALIBRATION + "select bin, round((bads - expected_bads) ** 2 / (n * mean_pd * (1 - mean_pd)), 6) as contribution, round((bads - expected_bads) ** 2 / (n * mean_pd * (1 - mean_pd)) / sum((bads - expected_bads) ** 2 / (n * mean_pd * (1 - mean_pd))) over (), 6) as share from t")
def _(a: DataFrame) -> DataFrame:
    t = rank.calibration_table(a, "y", "p", "id").withColumn("contribution", (F.col("bads") - F.col("expected_bads")) ** 2 / (F.col("n") * F.col("mean_pd") * (1 - F.col("mean_pd"))))
    return t.select("bin", "contribution", (F.col("contribution") / F.sum("contribution").over(Window.partitionBy())).alias("share"))  # ten rows


@query("w6_cap_table", """$LENS, r as (select y, row_number() over (order by p desc, id) as rk from acc), c as (select rk, sum(y) over (order by rk) as cb from r),
w as (select count(*) as n, sum(y) as b from acc), g as (select distinct cast(round_even(i * n / 100.0, 0) as bigint) as k, n, b from w, range(0, 101) as t(i))
select round(k / n, 6) as population, round(coalesce(cb, 0) / b, 6) as captured, round(least(k / b, 1.0), 6) as perfect, round(k / n, 6) as random from g left join c on k = rk""")
def _(a: DataFrame) -> DataFrame:
    return rank.cap_table(a, "y", "p", "id")


@query("w7_rank_order_inversions", _DECILES + ", l as (select bads / n as rate, lag(bads / n) over (order by decile) as before from t) select cast(sum(case when rate > before then 1 else 0 end) as bigint) as inversions from l")
def _(a: DataFrame) -> DataFrame:
    return rank.inversions(rank.decile_table(a, "y", "p", "id"), "decile", "bad_rate")


@query("a13_group_inversions", "$LENS, g as (select segment, count(*) as n, avg(y) as rate, avg(p) as m from acc group by 1 having count(*) >= 100), l as (select rate, lag(rate) over (order by m) as before from g) select cast(sum(case when rate < before then 1 else 0 end) as bigint) as inversions from l")
def _(a: DataFrame) -> DataFrame:
    return rank.group_inversions(a, "y", "p", "segment")


@query("w11_curves", "$LENS, s as (select p, sum(y) as b, sum(1 - y) as g from acc group by 1) select p, round(sum(b) over (order by p desc) / sum(b) over (), 6) as tpr, round(sum(g) over (order by p desc) / sum(g) over (), 6) as fpr, round(sum(b + g) over (order by p desc) / sum(b + g) over (), 6) as population from s")
def _(a: DataFrame) -> DataFrame:
    return rank.curves(a, "y", "p")


@query("w12_auc_from_deciles", _DECILES + ", d as (select cb / tb as yv, (cn - cb) / (tn - tb) as x, decile from c), e as (select x, yv, coalesce(lag(x) over (order by decile), 0) as px, coalesce(lag(yv) over (order by decile), 0) as py from d) select round(sum((x - px) * (yv + py) / 2), 6) as auc_approx from e")
def _(a: DataFrame) -> DataFrame:
    return rank.auc_from_deciles(rank.decile_table(a, "y", "p", "id"))


@query("v5_delong", """$LENS, w as (select sum(y) as m, sum(1 - y) as k from acc),
sa as (select p, sum(sum(1 - y)) over (order by p) - sum(1 - y) / 2.0 as lo, sum(sum(y)) over (order by p) - sum(y) / 2.0 as up from acc group by p),
sb as (select p2, sum(sum(1 - y)) over (order by p2) - sum(1 - y) / 2.0 as lo, sum(sum(y)) over (order by p2) - sum(y) / 2.0 as up from acc group by p2),
v as (select y, m, k, case when y = 1 then sa.lo / k else 1 - sa.up / m end as va, case when y = 1 then sb.lo / k else 1 - sb.up / m end as vb from acc join sa on acc.p = sa.p join sb on acc.p2 = sb.p2, w),
g as (select y, max(case when y = 1 then m else k end) as n, avg(va) as a, avg(vb) as b, var_samp(va) + var_samp(vb) - 2 * covar_samp(va, vb) as s from v group by y)
select round(max(case when y = 1 then a end), 6) as auc_a, round(max(case when y = 1 then b end), 6) as auc_b, round(max(case when y = 1 then a - b end), 6) as d_auc, round(max(case when y = 1 then a - b end) / sqrt(sum(s / n)), 6) as delong_z from g""")
def _(a: DataFrame) -> DataFrame:
    return rank.delong(a, "y", "p", "p2")


@query("v3_central_tendency", "$LENS select split, round(avg(p), 6) as mean_pd, round(avg(y), 6) as observed, round(avg(p) / avg(y), 6) as ratio, round((avg(p) - avg(y)) / avg(y), 6) as relative_deviation from acc group by split")
def _(a: DataFrame) -> DataFrame:
    return calibration.central_tendency(a, "y", "p", ["split"])


@query("v4_brier", "$LENS select split, round(avg((p - y) ** 2), 6) as brier, round(1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y))), 6) as brier_skill from acc group by split")
def _(a: DataFrame) -> DataFrame:
    return calibration.brier(a, "y", "p", ["split"])


@query("v2_binomial_by_group", "$LENS select grade, count(*) as n, cast(sum(y) as bigint) as bads, round(avg(y), 6) as obs_rate, round(avg(p), 6) as mean_pd, round((avg(y) - avg(p)) / sqrt(avg(p) * (1 - avg(p)) / count(*)), 6) as z from acc group by grade")
def _(a: DataFrame) -> DataFrame:
    return calibration.by_group(a, "y", "p", "grade")


@query("v10_gini_decay", _SCORES + ", gg as (select split, 2 * sum(b * (cg - g / 2.0)) / (max(tb) * max(tg)) - 1 as gini from q group by split) select o.split as split, round(case when d.gini > 0 then (d.gini - o.gini) / d.gini end, 5) as decay from gg d, gg o where d.split = 'dev' and o.split in ('oot1', 'oot2')")
def _(a: DataFrame) -> DataFrame:
    g = rank.discrimination(a, "y", "p", ["split"])
    dev = g.where("split = 'dev'").select(F.col("gini").alias("d"))
    return g.where("split in ('oot1', 'oot2')").crossJoin(F.broadcast(dev)).select("split", F.round(F.when(F.col("d") > 0, (F.col("d") - F.col("gini")) / F.col("d")), 5).alias("decay"))  # one row


_EDGES = "$LENS, e as (select list_sort(list_distinct(quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as cuts from acc where split = 'dev'), b as (select *, len(list_filter(e.cuts, lambda x: x < p)) as bin from acc, e)"


def _psi_sql(group: str) -> str:
    return _EDGES + f""", d as (select bin, count(*) / sum(count(*)) over () as s from b where split = 'dev' group by bin), c as (select {group} as grp, bin, count(*) / sum(count(*)) over (partition by {group}) as s from b where split <> 'dev' group by 1, 2),
f as (select g.grp, n.bin, greatest(coalesce(d.s, 0), 0.0001) as e, greatest(coalesce(c.s, 0), 0.0001) as a, coalesce(d.s, 0) as ds, coalesce(c.s, 0) as cs from (select distinct grp from c) g cross join (select unnest(range(0, (select len(cuts) + 1 from e))) as bin) n left join d on d.bin = n.bin left join c on c.bin = n.bin and c.grp = g.grp)
"""


@query("c4_psi_table", _psi_sql("split") + "select grp as split, bin, round(ds, 6) as dev_share, round(cs, 6) as share, round((a - e) * ln(a / e), 6) as psi from f")
def _(a: DataFrame) -> DataFrame:
    dev = F.col("split") == "dev"
    return stability.psi_table(a, "p", dev, stability.edges(a.where(dev), "p"), ["split"])


@query("c6_psi_by_quarter", _psi_sql("quarter") + "select grp as quarter, round(sum((a - e) * ln(a / e)), 6) as psi from f group by grp")
def _(a: DataFrame) -> DataFrame:
    return stability.psi(a, "p", F.col("split") == "dev", ["quarter"])


@query("c5_csi", """$LENS, e as (select list_sort(list_distinct(quantile_cont(balance, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as eb, list_sort(list_distinct(quantile_cont(qty, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) as eq from acc where split = 'dev'),
l as (select split = 'dev' as dev, 'balance' as variable, coalesce(cast(case when balance is not null then len(list_filter(eb, lambda x: x < balance)) end as varchar), '(missing)') as bin from acc, e
union all select split = 'dev', 'qty', coalesce(cast(case when qty is not null then len(list_filter(eq, lambda x: x < qty)) end as varchar), '(missing)') from acc, e union all select split = 'dev', 'segment', coalesce(segment, '(missing)') from acc),
s as (select variable, bin, count(*) filter (dev) as d, count(*) filter (not dev) as c from l group by 1, 2), f as (select variable, greatest(d / sum(d) over (partition by variable), 0.0001) as e, greatest(c / sum(c) over (partition by variable), 0.0001) as a from s)
select variable, round(sum((a - e) * ln(a / e)), 6) as psi from f group by variable""")
def _(a: DataFrame) -> DataFrame:
    return stability.csi(a, F.col("split") == "dev", ["balance", "qty"], ["segment"])


@query("a18_quantiles", "$LENS select split, round(quantile_cont(balance, 0.01), 6) as q01, round(quantile_cont(balance, 0.5), 6) as q50, round(quantile_cont(balance, 0.99), 6) as q99 from acc group by split")
def _(a: DataFrame) -> DataFrame:
    q = stability.grouped_quantiles(a, "balance", ["split"], [0.01, 0.5, 0.99])
    return q.groupBy("split").agg(*[F.max(F.when(F.col("level") == p, F.col("value"))).alias(n) for n, p in (("q01", 0.01), ("q50", 0.5), ("q99", 0.99))])


@query("a19_lower_quantiles", "$LENS, r as (select 'balance' as variable, balance as x, row_number() over (order by balance) as rk, count(*) over () as n from acc where balance is not null union all select 'qty', qty, row_number() over (order by qty), count(*) over () from acc where qty is not null), q as (select unnest([0.25, 0.5, 0.95]) as q) select distinct variable, round(x, 6) as x from r, q where rk = floor((n - 1) * q.q) + 1", lens=False)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = binning.lower_quantiles(accounts(spark, sf_dir), ["balance", "qty"], [0.25, 0.5, 0.95])
    return spark.createDataFrame([(v, x) for v, xs in got.items() for x in xs], "variable string, x double")


@query("b1_woe_iv", "$LENS, t as (select segment, sum(y) as bads, sum(1 - y) as goods from acc group by 1), s as (select *, (bads + 0.5) / (sum(bads) over () + 0.5 * count(*) over ()) as b, (goods + 0.5) / (sum(goods) over () + 0.5 * count(*) over ()) as g from t) select segment, cast(bads as bigint) as bads, cast(goods as bigint) as goods, round(ln(g / b), 6) as woe, round((g - b) * ln(g / b), 8) as iv_contrib from s")
def _(a: DataFrame) -> DataFrame:
    t = binning.woe_iv(a.groupBy("segment").agg(F.sum("y").alias("bads"), F.sum(1 - F.col("y")).alias("goods")))
    return t.withColumn("iv_contrib", F.round("iv_contrib", 8).cast("decimal(18,8)").cast("string")).select("segment", "bads", "goods", "woe", F.col("iv_contrib").cast("double").alias("iv_contrib"))


@query("b8_b13_fitted_bins", lens=False)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = accounts(spark, sf_dir).where("split = 'dev'")
    return binning.report(spark, [*binning.fit_numeric(a, ["balance", "disc", "qty", "returned"], "y").values(), binning.fit_labels(a, "segment", "y", "id")])


@query("b10_apply_bins", "$LENS select id, cast(case when qty is null then 4 else len(list_filter([50.0, 100.0, 150.0], lambda x: x < qty)) end as bigint) as bin from acc")
def _(a: DataFrame) -> DataFrame:
    return a.select("id", F.coalesce(stability.bin_of(F.col("qty"), [50.0, 100.0, 150.0]), F.lit(4)).alias("bin"))


_EL = """$LENS, x as (select *, p * 0.45 * funded as el, case when y = 1 then funded * 0.4 else 0 end as realized from acc), t as (select KEY, case when grouping(grade) = 1 then 'ALL' else grade end as grade, count(*) as n, sum(funded) as funded, avg(p) as mean_pd, avg(y) as bad_rate, sum(el) as el, sum(realized) as realized_loss from x group by grouping sets ((KEY, grade), (KEY)))
select KEY, grade, n, round(funded, 2) as funded, round(mean_pd, 6) as mean_pd, round(bad_rate, 6) as bad_rate, round(el, 2) as el, round(realized_loss, 2) as realized_loss, round(el / funded, 6) as el_pct_funded, round(realized_loss / funded, 6) as realized_pct_funded, round(case when realized_loss <> 0 then el / realized_loss end, 6) as el_to_realized from t"""


def _back_test(a: DataFrame, key: str) -> DataFrame:
    x = a.withColumns({"el": loss.expected_loss(F.col("p"), F.lit(0.45), F.col("funded")), "realized": F.when(F.col("y") == 1, F.col("funded") * 0.4).otherwise(0.0)})
    t = loss.back_test(x, key, "grade", "funded", "p", "y", "el", "realized")
    return t.withColumns({c: F.round(c, 2) for c in ("funded", "el", "realized_loss")})


@query("a4_l2_el_back_test", _EL.replace("KEY", "vintage"))
def _(a: DataFrame) -> DataFrame:
    return _back_test(a, "vintage")


@query("a5_el_by_sample", _EL.replace("KEY", "split"))
def _(a: DataFrame) -> DataFrame:
    return _back_test(a, "split")


@query("n1_total_el_add_on", "$LENS select round(sum(p * 0.95 * funded), 2) as el, round(sum(p * 1.0 * funded), 2) as el_added from acc")
def _(a: DataFrame) -> DataFrame:
    return a.agg(F.round(F.sum(loss.expected_loss(F.col("p"), F.lit(0.95), F.col("funded"))), 2).alias("el"), F.round(F.sum(loss.expected_loss(F.col("p"), F.lit(0.95), F.col("funded"), 0.10)), 2).alias("el_added"))


@query("j1_j2_reconcile", "$LENS, a as (select id, p, funded from acc where id % 3 <> 0), b as (select id, p + 0.001 as p, funded from acc where id % 5 <> 0) select (select count(*) from a join b using (id)) as matched, (select round(max(abs(a.p - b.p)), 6) from a join b using (id)) as max_diff_p, (select round(max(abs(a.funded - b.funded)), 6) from a join b using (id)) as max_diff_funded, (select count(*) from a where id not in (select id from b)) as only_left, (select count(*) from b where id not in (select id from a)) as only_right")
def _(a: DataFrame) -> DataFrame:
    return loss.reconcile(a.where("id % 3 <> 0").select("id", "p", "funded"), a.where("id % 5 <> 0").select("id", (F.col("p") + 0.001).alias("p"), "funded"), "id", ["p", "funded"])


@query("a1_vintage_audit", "$LENS select vintage, count(*) as n_loans, count(*) filter (quarter(issue_d) <= 2) as n_obs, round(avg(y), 6) as lifetime_bad_rate, round(avg(case when quarter(issue_d) <= 2 then y end), 6) as observed_bad_rate, round(avg(case when status = 'O' then 1.0 else 0.0 end), 6) as share_current, round(avg(case when n_lines > 4 then 1.0 when n_lines is null then null else 0.0 end), 6) as share_long from acc group by vintage")
def _(a: DataFrame) -> DataFrame:
    return targets.vintage_audit(a, "vintage", "y", F.quarter("issue_d") <= 2, F.col("status") == "O", F.col("n_lines") > 4)


@query("a2_vintage_means", "$LENS select vintage, count(*) as n, round(avg(case when returned > 0 then 1.0 when returned is null then null else 0.0 end), 6) as any_share, round(avg(returned), 6) as mean_rate from acc where y = 1 group by vintage")
def _(a: DataFrame) -> DataFrame:
    return a.where("y = 1").groupBy("vintage").agg(F.count("*").alias("n"), F.avg((F.col("returned") > 0).cast("double")).alias("any_share"), F.avg("returned").alias("mean_rate"))


@query("a9_value_shares", "$LENS select split, segment, count(*) as n, round(count(*) / sum(count(*)) over (partition by split), 6) as share from acc group by 1, 2")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("split", "segment").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split")))


@query("a17_pivot", "$LENS select vintage, round(avg(case when grade = '1' then y end), 6) as g1, round(avg(case when grade = '2' then y end), 6) as g2, round(avg(case when grade = '3' then y end), 6) as g3 from acc group by vintage")
def _(a: DataFrame) -> DataFrame:
    return a.groupBy("vintage").pivot("grade", ["1", "2", "3"]).agg(F.avg("y")).withColumnsRenamed({"1": "g1", "2": "g2", "3": "g3"})


@query("a21_spearman", "$LENS, r as (select rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as ra, rank() over (order by balance) + (count(*) over (partition by balance) - 1) / 2.0 as rb from acc where balance is not null) select round(corr(ra, rb), 6) as spearman from r")
def _(a: DataFrame) -> DataFrame:
    return loss.spearman(a, "p", "balance")


@query("a20_a22_correlation", "$LENS select split, round(corr(balance, qty), 6) as corr, round(covar_samp(balance, qty), 4) as covariance from acc where balance is not null and qty is not null group by split")
def _(a: DataFrame) -> DataFrame:
    return a.where("balance is not null and qty is not null").groupBy("split").agg(F.corr("balance", "qty").alias("corr"), F.round(F.covar_samp("balance", "qty"), 4).alias("covariance"))


@query("a23_regression_metrics", "$LENS select split, count(*) as n, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 6) as r2, round(sqrt(sum((y - p) ** 2) / count(*)), 6) as rmse, round(avg(abs(y - p)), 6) as mae, round(corr(y, p), 6) as corr, round(avg(y), 6) as mean_actual, round(avg(p), 6) as mean_pred from acc group by split")
def _(a: DataFrame) -> DataFrame:
    return loss.regression_metrics(a, "y", "p", ["split"])


@query("p34_traffic_lights", "$LENS, t as (select split, grade, avg(y) as rate, avg(p) as mean_pd from acc group by 1, 2) select split, grade, case when rate >= 0.34 then 'Green' when rate >= 0.32 then 'Amber' else 'Red' end as high, case when rate <= 0.32 then 'Green' when rate <= 0.34 then 'Amber' else 'Red' end as low, case when mean_pd / rate between 0.9 and 1.1 then 'Green' when mean_pd / rate between 0.75 and 1.25 then 'Amber' else 'Red' end as band from t")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("split", "grade").agg(F.avg("y").alias("rate"), F.avg("p").alias("mean_pd"))
    return t.select("split", "grade", calibration.light_high(F.col("rate"), 0.34, 0.32).alias("high"), calibration.light_low(F.col("rate"), 0.32, 0.34).alias("low"), calibration.light_band(F.col("mean_pd") / F.col("rate"), (0.9, 1.1), (0.75, 1.25)).alias("band"))


@query("a14_worst_light", "$LENS, t as (select segment, vintage, case when avg(y) <= 0.32 then 'Green' when avg(y) <= 0.35 then 'Amber' else 'Red' end as light from acc group by 1, 2) select segment, case max(case light when 'Red' then 3 when 'Amber' then 2 else 1 end) when 3 then 'Red' when 2 then 'Amber' else 'Green' end as worst, string_agg(light, ',' order by vintage) as evidence from t group by segment")
def _(a: DataFrame) -> DataFrame:
    t = a.groupBy("segment", "vintage").agg(calibration.light_low(F.avg("y"), 0.32, 0.35).alias("light"))
    return loss.worst_by(t, ["segment"], "light", "vintage")


@query("p22_p23_scalars", "$LENS select id, round(ln(greatest(least(p, 1 - 1e-9), 1e-9) / (1 - greatest(least(p, 1 - 1e-9), 1e-9))), 6) as logit, round(ln(1 + greatest(balance, 0)), 6) as log_balance, round(case when qty > 0 then funded / qty end, 6) as per_unit, (year(issue_d) * 12 + month(issue_d)) - (1995 * 12 + 1) as months, quarter from acc")
def _(a: DataFrame) -> DataFrame:
    return a.select("id", clean.logit(F.col("p")).alias("logit"), clean.log1p_clipped(F.col("balance")).alias("log_balance"), clean.guarded_ratio(F.col("funded"), F.col("qty")).alias("per_unit"), clean.months_between(F.col("issue_d"), F.lit("1995-01-01").cast("date")).alias("months"), clean.quarter_label(F.col("issue_d")).alias("quarter"))


@query("p24_winsor_zscore", "$LENS, s as (select median(qty) as m, quantile_cont(qty, 0.01) as lo, quantile_cont(qty, 0.99) as hi from acc), x as (select id, greatest(least(coalesce(qty, m), hi), lo) as v from acc, s) select id, round((v - avg(v) over ()) / stddev_pop(v) over (), 6) as z from x")
def _(a: DataFrame) -> DataFrame:
    s = stability.exact_quantiles(a, ["qty"], [0.5, 0.01, 0.99])["qty"]
    x = a.select("id", F.least(F.greatest(F.coalesce("qty", F.lit(s[0])), F.lit(s[1])), F.lit(s[2])).alias("v"))
    m = x.agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return x.crossJoin(F.broadcast(m)).select("id", F.when(F.col("s") > 0, (F.col("v") - F.col("m")) / F.col("s")).otherwise(F.col("v") - F.col("m")).alias("z"))  # one row


@query("w10_min_rank", "$LENS, t as (select segment, sum(y) as bads from acc group by 1) select segment, cast(bads as bigint) as bads, rank() over (order by bads desc) as \"rank\" from t")
def _(a: DataFrame) -> DataFrame:
    return rank.min_rank_descending(a.groupBy("segment").agg(F.sum("y").alias("bads")), "bads", "rank")


@query("t4_stratified_split", "$LENS select id, y, row_number() over (partition by y order by md5('42:' || cast(id as varchar)), id) <= round(count(*) over (partition by y) * 0.2) as in_sample from acc")
def _(a: DataFrame) -> DataFrame:
    return targets.split_by_hash(a.select("id", "y"), "id", 0.2, 42, ("y",))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
