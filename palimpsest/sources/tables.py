"""The provided tables, and versioned fixtures derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ROWS_PER_PAGE


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_branches(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """A base state of the orders and two branches with edits, additions and deletions: (k, v, ck)."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_custkey").alias("ck"))
    a = F.when(F.col("k") % 7 == 0, "X").when(F.col("k") % 11 == 0, "S").otherwise(F.col("v"))
    b = F.when(F.col("k") % 5 == 0, "Y").when(F.col("k") % 11 == 0, "S").otherwise(F.col("v"))
    return {
        "base": rows.where("k % 10 < 8"),
        "a": rows.where("k % 10 < 9 and k % 13 <> 0").withColumn("v", a),
        "b": rows.where("k % 17 <> 0").withColumn("v", b),
    }


ORDER_BRANCHES = """
base as (select o_orderkey k, o_orderstatus v, o_custkey ck from orders where o_orderkey % 10 < 8),
a as (select o_orderkey k, case when o_orderkey % 7 = 0 then 'X' when o_orderkey % 11 = 0 then 'S' else o_orderstatus end v from orders where o_orderkey % 10 < 9 and o_orderkey % 13 <> 0),
b as (select o_orderkey k, case when o_orderkey % 5 = 0 then 'Y' when o_orderkey % 11 = 0 then 'S' else o_orderstatus end v from orders where o_orderkey % 17 <> 0),
j as (select coalesce(base.k, a.k, b.k) k, base.v base, a.v a, b.v b from base full join a on base.k = a.k full join b on coalesce(base.k, a.k) = b.k),
c as (select *, case when a is not distinct from b then case when a is distinct from base then 'BothSame' end when a is not distinct from base then 'BOnly' when b is not distinct from base then 'AOnly' else 'Conflict' end as class from j)"""


def page_no(key: str = "k"):
    return F.expr(f"{key} div {ROWS_PER_PAGE}")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: lsn, page_no, page_id (null: removed), is_commit, is_checkpoint, bad, created_at; one segment for 500 records."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("lsn"),
        F.expr("event_id div 500").alias("segment"),
        F.col("user_id").alias("page_no"),
        F.when(F.col("event_type") != "error", F.col("event_id")).alias("page_id"),
        (F.col("event_type") == "purchase").alias("is_commit"),
        ((F.col("event_type") == "signup") & (F.col("event_id") % 500 == 0)).alias("is_checkpoint"),
        (F.col("value") > 480).alias("bad"),
        F.col("ts").alias("created_at"),
    )


LOG = "log as (select event_id lsn, event_id // 500 segment, user_id page_no, case when event_type <> 'error' then event_id end page_id, event_type = 'purchase' is_commit, event_type = 'signup' and event_id % 500 = 0 is_checkpoint, value > 480 bad, ts created_at from events)"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit graph over parts: node, parent, overlay_base."""
    n = F.col("p_partkey")
    parent = F.when(n > 1, F.expr("p_partkey div 2"))
    return table(spark, sf_dir, "part").where(n >= 1).select(n.alias("node"), parent.alias("parent"), F.when(n % 8 != 0, parent).alias("overlay_base"))


COMMITS = "commits as (select p_partkey node, case when p_partkey > 1 then p_partkey // 2 end parent, case when p_partkey > 1 and p_partkey % 8 <> 0 then p_partkey // 2 end overlay_base from part where p_partkey >= 1)"


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content-addressed objects with injected faults: every 50th is corrupt, every 77th missing."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2("text", 256).alias("page_id"), F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("bytes"), (F.col("doc_id") % 77 == 0).alias("missing"), F.length("text").cast("long").alias("n_bytes"))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as cached pages: page, size, touched, durable."""
    touched = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("_u")).agg(F.max("event_id").alias("touched"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), (4 * F.size("embedding")).cast("long").alias("size"), (F.col("vec_id") % 4 != 0).alias("durable"), (F.col("vec_id") % 150).alias("_u"))
    return e.join(touched, "_u", "left").select("page", "size", "durable", F.coalesce("touched", F.lit(0)).alias("touched"))


TIERS = "tiers as (select vec_id page, (4 * len(embedding))::bigint size, vec_id % 4 <> 0 durable, coalesce(t, 0) touched from embeddings left join (select user_id u, max(event_id) t from events group by user_id) on u = vec_id % 150)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as bitemporal claims."""
    e = table(spark, sf_dir, "events")
    known = F.col("ts") + F.make_dt_interval(F.col("event_id").cast("int") % 7)
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("value").alias("object"), F.col("ts").alias("valid_from"), known.alias("known_from"), (F.col("event_id") % 4).alias("trust"), (F.col("event_id") % 3).alias("method"), (F.col("event_id") % 5).alias("evidence_n"))


CLAIMS = "claims as (select event_id id, user_id subject, event_type predicate, value object, ts valid_from, ts + to_days((event_id % 7)::int) known_from, event_id % 4 trust, event_id % 3 \"method\", event_id % 5 evidence_n from events)"
