"""The benchmark tables seen as scored accounts: one row for each order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, issue_d, vintage, quarter, funded, status, y, grade, segment, features, p (a score with many ties), p2, split."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    lines = read("lineitem").groupBy("l_orderkey").agg(F.round(F.avg("l_discount"), 6).alias("disc"), F.sum("l_quantity").alias("qty"), F.count("*").alias("n_lines"), F.round(F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), 6).alias("returned"))
    rows = read("orders").join(read("customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    vintage = F.year("o_orderdate")
    return rows.select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("issue_d"), vintage.alias("vintage"), F.concat(vintage.cast("string"), F.lit("Q"), F.quarter("o_orderdate").cast("string")).alias("quarter"),
        F.col("o_totalprice").alias("funded"), F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").cast("int").alias("y"), F.substring("o_orderpriority", 1, 1).alias("grade"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("balance"), "disc", "qty", "n_lines", "returned",
        F.round((F.coalesce("qty", F.lit(0.0)) + 1.0) / (F.coalesce("n_lines", F.lit(0)) * 50 + 10.0), 6).alias("p"), F.round(F.pmod("o_orderkey", F.lit(97)) / 100.0 + 0.01, 6).alias("p2"),
        F.when(vintage <= 1998, "dev").when(vintage == 1999, "oot1").when(vintage == 2000, "oot2").otherwise("partial").alias("split"),
    )


#: The same rows for the SQL oracle.
LENS_SQL = """
with li as (select l_orderkey, round(avg(l_discount), 6) as disc, sum(l_quantity) as qty, count(*) as n_lines, round(avg(case when l_returnflag = 'R' then 1.0 else 0.0 end), 6) as returned from lineitem group by 1),
acc as (select o_orderkey as id, cast(o_orderdate as date) as issue_d, year(o_orderdate) as vintage, year(o_orderdate) || 'Q' || quarter(o_orderdate) as quarter, o_totalprice as funded, o_orderstatus as status,
  case when o_orderstatus = 'F' then 1 else 0 end as y, substr(o_orderpriority, 1, 1) as grade, c_mktsegment as segment, c_acctbal as balance, disc, qty, n_lines, returned,
  round((coalesce(qty, 0) + 1.0) / (coalesce(n_lines, 0) * 50 + 10.0), 6) as p, round((o_orderkey % 97) / 100.0 + 0.01, 6) as p2,
  case when year(o_orderdate) <= 1998 then 'dev' when year(o_orderdate) = 1999 then 'oot1' when year(o_orderdate) = 2000 then 'oot2' else 'partial' end as split
  from orders left join customer on o_custkey = c_custkey left join li on o_orderkey = l_orderkey)
"""
