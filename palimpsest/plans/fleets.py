"""Queries over a fleet of databases: a nation is a database, its region a label."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fleet
from ..sources.tables import table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


def _rows(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("db"), "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("decimal(18,2)").alias("balance"))


def _registry(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("db"), "n_name", F.create_map(F.lit("region"), "r_name").alias("labels"))


@query("select c_mktsegment, count(c_acctbal) n, sum(c_acctbal::decimal(18, 2))::double total, min(c_acctbal::decimal(18, 2))::double lowest, max(c_acctbal::decimal(18, 2))::double highest from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA' group by 1")
def fleet_fanout_agg(spark, sf_dir):
    fleet.check(["count", "sum", "min", "max"])
    on = fleet.labelled(_registry(spark, sf_dir), region="ASIA").select("db")
    out = fleet.fan_out(_rows(spark, sf_dir).join(on, "db", "left_semi"), "db", ["c_mktsegment"], "balance")
    return out.select("c_mktsegment", "n", *[F.col(c).cast("double").alias(c) for c in ("total", "lowest", "highest")])


@query("select c_mktsegment, sum(c_acctbal::decimal(18, 2))::double / count(*) mean from customer group by 1")
def fleet_fanout_avg(spark, sf_dir):
    fleet.check(["avg"])
    return fleet.fan_out(_rows(spark, sf_dir), "db", ["c_mktsegment"], "balance").select("c_mktsegment", "mean")


@query("select c_nationkey::bigint db, min(c_acctbal)::double min_value, max(c_acctbal)::double max_value, count(*) n from customer group by 1")
def fleet_statistics(spark, sf_dir):
    return table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("db")).agg(F.min("c_acctbal").alias("min_value"), F.max("c_acctbal").alias("max_value"), F.count("*").alias("n"))


@query("select c_nationkey::bigint db from customer group by 1 having max(c_acctbal) >= 9950 and min(c_acctbal) <= 10100")
def fleet_prune(spark, sf_dir):
    return fleet.prune(fleet_statistics(spark, sf_dir), F.lit(9950), F.lit(10100)).select("db")


@query("select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20")
def fleet_topk(spark, sf_dir):
    return fleet.top(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), 20, F.desc("c_acctbal"), F.asc("c_custkey"))


@query("select n_nationkey::bigint db, n_name from nation join region on n_regionkey = r_regionkey where r_name = 'EUROPE'")
def fleet_labels(spark, sf_dir):
    return fleet.labelled(_registry(spark, sf_dir), region="EUROPE").select(F.col("db").cast("long").alias("db"), "n_name")


@query("select n_nationkey::bigint db, case when n_nationkey % 10 = 0 then 'canary' when n_nationkey % 10 < 4 then 'early' else 'rest' end cohort, n_nationkey % 3 <> 0 needs_migration from nation")
def fleet_migration_cohorts(spark, sf_dir):
    n = F.col("n_nationkey")
    cohort = F.when(n % 10 == 0, "canary").when(n % 10 < 4, "early").otherwise("rest")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("db"), cohort.alias("cohort"), (n % 3 != 0).alias("needs_migration"))


@query("select 'customer' source, c_nationkey::bigint db, count(*) n from customer group by 2 union all select 'supplier', s_nationkey::bigint, count(*) from supplier group by 2")
def fleet_union_partials(spark, sf_dir):
    parts = [table(spark, sf_dir, t).groupBy(F.lit(t).alias("source"), F.col(k).cast("long").alias("db")).agg(F.count("*").alias("n")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"))]
    return parts[0].unionByName(parts[1])
