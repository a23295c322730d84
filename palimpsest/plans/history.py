"""Queries on the log and the tiers: transactions, recovery, restore points, caches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import WARM_SET_CAP
from ..operators import logs, versions
from ..sources.tables import LOG, TIERS, log, table, tiers
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_TXN = f"{LOG}, t as (select *, coalesce(sum(is_commit::int) over (order by lsn rows between unbounded preceding and 1 preceding), 0)::bigint txn from log)"
_GOOD = f"{LOG}, good as (select * from log l where lsn < coalesce((select min(lsn) from log b where bad and b.segment = l.segment), 9e18))"


@query("select o_orderkey page_no, o_custkey txn, row_number() over (order by o_custkey, o_orderkey)::bigint lsn from orders")
def wal_lsn(spark, sf_dir):
    return logs.numbered(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_no"), F.col("o_custkey").alias("txn")))


@query(f"with {_TXN} select txn, count(*) filter (not is_commit) writes, min(lsn) first_lsn, max(lsn) last_lsn from t group by txn")
def wal_txn_groups(spark, sf_dir):
    t = logs.transactions(log(spark, sf_dir))
    return t.groupBy("txn").agg(F.count_if(~F.col("is_commit")).alias("writes"), F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"))


@query(f"with {_GOOD} select segment, count(*) records, count(*) filter (is_commit) commits, max(lsn) last_lsn from good group by segment")
def wal_recover_prefix(spark, sf_dir):
    good = logs.readable(log(spark, sf_dir))
    return good.groupBy("segment").agg(F.count("*").alias("records"), F.count_if("is_commit").alias("commits"), F.max("lsn").alias("last_lsn"))


@query(f"with {LOG} select lsn, page_no, page_id from log where lsn > coalesce((select max(lsn) from log where is_checkpoint), -1)")
def wal_checkpoint_skip(spark, sf_dir):
    return logs.after_checkpoint(log(spark, sf_dir)).select("lsn", "page_no", "page_id")


@query(f"with {LOG} select count(distinct page_no) discarded from log where lsn > (select max(lsn) from log where is_commit)")
def wal_discarded(spark, sf_dir):
    last = log(spark, sf_dir).where("is_commit").agg(F.max("lsn").alias("_c"))
    return log(spark, sf_dir).join(last, F.col("lsn") > F.col("_c")).agg(F.countDistinct("page_no").alias("discarded"))


@query(f"with {_GOOD}, w as (select *, row_number() over (partition by page_no order by lsn desc) r from good where not is_commit and not is_checkpoint and lsn <= (select max(lsn) from good where is_commit)) select page_no, page_id from w where r = 1 and page_id is not null")
def wal_head_state(spark, sf_dir):
    return logs.head_state(logs.readable(log(spark, sf_dir)))


@query(f"with {_GOOD}, rest as (select * from good where lsn > coalesce((select max(lsn) from good where is_checkpoint), -1)) select count(*) records_replayed, count(*) filter (is_commit) committed_txns, max(lsn) filter (is_commit) durable_lsn, (select count(distinct segment) from log where bad) torn_segments from rest")
def wal_recovery_report(spark, sf_dir):
    l = log(spark, sf_dir)
    torn = l.where("bad").agg(F.countDistinct("segment").alias("torn_segments"))
    report = logs.after_checkpoint(logs.readable(l)).agg(F.count("*").alias("records_replayed"), F.count_if("is_commit").alias("committed_txns"), F.max(F.when(F.col("is_commit"), F.col("lsn"))).alias("durable_lsn"))
    return report.join(torn, F.lit(True))


@query(f"with {LOG}, m as (select min(created_at) + (max(created_at) - min(created_at)) / 2 t from log), w as (select *, row_number() over (partition by page_no order by lsn desc) r from log where not is_commit and lsn <= (select max(lsn) from log, m where is_commit and created_at <= t)) select page_no, page_id from w where r = 1 and page_id is not null")
def pitr_timestamp(spark, sf_dir):
    l = log(spark, sf_dir)
    middle = l.agg((F.min("created_at") + (F.max("created_at") - F.min("created_at")) / 2).alias("_t"))
    stop = l.where("is_commit").join(middle, F.col("created_at") <= F.col("_t")).agg(F.max("lsn").alias("_l"))
    chain = l.where("not is_commit").join(stop, F.col("lsn") <= F.col("_l")).select("page_no", "page_id", (-F.col("lsn")).alias("hop"))
    return versions.resolve(chain)


@query(f"with {LOG}, w as (select *, row_number() over (partition by page_no order by lsn desc) r from log where not is_commit and lsn <= (select max(lsn) from log where is_commit and lsn <= 700)) select page_no, page_id from w where r = 1 and page_id is not null")
def pitr_lsn(spark, sf_dir):
    l = log(spark, sf_dir).where("lsn <= 700")
    stop = l.where("is_commit").agg(F.max("lsn").alias("_l"))
    return versions.resolve(l.where("not is_commit").join(stop, F.col("lsn") <= F.col("_l")).select("page_no", "page_id", (-F.col("lsn")).alias("hop")))


@query(f"with {LOG} select max(lsn) - max(lsn) filter (is_commit) uncommitted_lag, max(lsn) filter (is_commit) visible_lsn from log")
def replica_lag(spark, sf_dir):
    visible = F.max(F.when(F.col("is_commit"), F.col("lsn")))
    return log(spark, sf_dir).agg((F.max("lsn") - visible).alias("uncommitted_lag"), visible.alias("visible_lsn"))


@query(f"with {TIERS} select page, case when page % 3 = 0 then 'hit' when durable then 'fault' else 'lost' end outcome from tiers")
def tier_read_through(spark, sf_dir):
    t = tiers(spark, sf_dir)
    local, remote = t.where("page % 3 = 0").select("page", F.lit(True).alias("l")), t.where("durable").select("page", F.lit(True).alias("r"))
    outcome = F.when(F.col("l"), "hit").when(F.col("r"), "fault").otherwise("lost")
    return t.select("page").join(local, "page", "left").join(remote, "page", "left").select("page", outcome.alias("outcome"))


@query("select event_id pos, user_id page, sha256(d.text) page_id from events left join documents d on d.doc_id = user_id")
def batch_fetch(spark, sf_dir):
    ids = table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("page"))
    store = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.sha2("text", 256).alias("page_id"))
    return logs.batch(ids, store)


@query(f"with {TIERS}, r as (select *, (select sum(size) from tiers) total, coalesce(sum(size) over (order by touched, page rows between unbounded preceding and 1 preceding), 0) colder from tiers where durable) select page, size, touched from r where total - colder > 40000")
def evict_lru(spark, sf_dir):
    return logs.evictions(tiers(spark, sf_dir), 40_000)


@query(f"with f as (select user_id page, min(event_id) seq from events group by 1) select page, seq, row_number() over (order by seq, page)::bigint place from f order by seq, page limit {WARM_SET_CAP}")
def warm_set(spark, sf_dir):
    return logs.warm_set(table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_id").alias("seq")), WARM_SET_CAP)


@query(f"with {TIERS} select count(*) filter (page % 3 = 0) hits, count(*) filter (page % 3 <> 0 and durable) misses, count(*) filter (durable) durable_pages, count(*) filter (not durable) pending, sum(size) filter (page % 3 = 0)::bigint local_bytes from tiers")
def tier_stats(spark, sf_dir):
    local = F.col("page") % 3 == 0
    return tiers(spark, sf_dir).agg(F.count_if(local).alias("hits"), F.count_if(~local & F.col("durable")).alias("misses"), F.count_if("durable").alias("durable_pages"), F.count_if(~F.col("durable")).alias("pending"), F.sum(F.when(local, F.col("size"))).alias("local_bytes"))


@query(f"with {TIERS} select page, size from tiers where not durable")
def flush_plan(spark, sf_dir):
    t = tiers(spark, sf_dir)
    return t.select("page", "size").join(t.where("durable").select("page"), "page", "left_anti")


@query()
def record_crc(spark, sf_dir):
    l = log(spark, sf_dir)
    return l.select("lsn", F.crc32(F.concat_ws("|", "lsn", "page_no", F.coalesce(F.col("page_id").cast("string"), F.lit("-"))).cast("binary")).alias("crc"))


_CLOCK = "select event_id, epoch_us(ts) // 1000 - (event_id % 5) * 3456000000 wall from events"


def _clock(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.unix_millis(F.col("ts").cast("timestamp")) - (F.col("event_id") % 5) * 3_456_000_000).alias("wall"))


@query(f"with c as ({_CLOCK}) select event_id, wall, max(wall) over (order by event_id) high_water from c")
def high_water_clock(spark, sf_dir):
    c = _clock(spark, sf_dir).withColumn("_b", F.expr("event_id div 1000"))
    tops = c.groupBy("_b").agg(F.max("wall").alias("_m"))
    earlier = logs.before(tops, "_b", "_m", "_p", F.max).drop("_m")
    run = F.max("wall").over(Window.partitionBy("_b").orderBy("event_id"))
    return c.withColumn("_r", run).join(earlier, "_b").select("event_id", "wall", F.greatest("_r", "_p").alias("high_water"))


_LICENSES = "(values (0, 'ok', 0, 400, 30, true), (1, 'short', 0, 20, 30, true), (2, 'grace', 0, -10, 30, true), (3, 'past', 0, -60, 30, true), (4, 'early', 10, 400, 30, true), (5, 'forged', 0, 400, 30, false)) l(id, name, from_day, to_day, grace_days, valid)"


@query(f"with c as ({_CLOCK}), h as (select event_id, wall, max(wall) over (order by event_id) high from c), z as (select min(wall) z from c), x as (select event_id, name, high now, high - wall back, z + from_day * 86400000::bigint nb, high - (high - z) % 864000000 + to_day * 86400000::bigint na, grace_days, valid from h, z, {_LICENSES} where event_id % 6 = id), y as (select *, na + grace_days * 86400000::bigint hard from x) select event_id, name, case when not valid then 'Degraded' when now < nb then 'Degraded' when now >= hard then 'Degraded' when now >= na then 'Warning' when back > 30 * 86400000::bigint then 'Warning' when (na - now) // 86400000::bigint <= 30 then 'Warning' else 'Ok' end status, (case when not valid or now < nb or now >= hard then null when now >= na then (hard - now) // 86400000::bigint else (na - now) // 86400000::bigint end)::bigint as days from y")
def license_status(spark, sf_dir):
    day = F.lit(86_400_000).cast("long")
    h = high_water_clock(spark, sf_dir).join(_clock(spark, sf_dir).agg(F.min("wall").alias("z")), F.lit(True))
    terms = spark.sql(f"select * from {_LICENSES}")
    x = h.join(F.broadcast(terms), F.col("event_id") % 6 == F.col("id")).withColumns(
        {
            "now": F.col("high_water"),
            "back": F.col("high_water") - F.col("wall"),
            "nb": F.col("z") + F.col("from_day") * day,
            "na": F.col("high_water") - (F.col("high_water") - F.col("z")) % 864_000_000 + F.col("to_day") * day,
        }
    )
    x = x.withColumn("hard", F.col("na") + F.col("grace_days") * day)
    now, na, hard = F.col("now"), F.col("na"), F.col("hard")
    off = ~F.col("valid") | (now < F.col("nb")) | (now >= hard)
    left = F.expr("(na - now) div 86400000L")
    status = F.when(off, "Degraded").when(now >= na, "Warning").when(F.col("back") > 30 * day, "Warning").when(left <= 30, "Warning").otherwise("Ok")
    days = F.when(off, None).when(now >= na, F.expr("(hard - now) div 86400000L")).otherwise(left)
    return x.select("event_id", "name", status.alias("status"), days.cast("long").alias("days"))
