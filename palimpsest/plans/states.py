"""Queries on table states: diffs, merges, content identity, scrubbing, the commit graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content
from ..operators import versions
from ..sources.tables import COMMITS, LOG, ORDER_BRANCHES, commits, log, objects, order_branches, page_no, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()


def _changed(spark, sf_dir):
    """Three-way classes of the records: one aggregation over the three sides.

    Hashing pages first to leave out equal ones costs more than the diff, unless their ids
    are at hand already.
    """
    s = order_branches(spark, sf_dir)
    return versions.diff3(s["base"], s["a"], s["b"], "k", "v")


@query(f"with {ORDER_BRANCHES} select c_mktsegment, class, count(*) n from c join orders on o_orderkey = k join customer on c_custkey = o_custkey where class is not null group by all")
def flagship_diff3_by_segment(spark, sf_dir):
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"))
    segment = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return _changed(spark, sf_dir).join(owner, "k").join(segment, "c_custkey").groupBy("c_mktsegment", "class").agg(F.count("*").alias("n"))


@query(f"with {ORDER_BRANCHES} select k, class, base, a, b from c where class is not null")
def diff3_classes(spark, sf_dir):
    return _changed(spark, sf_dir)


@query(f"with {ORDER_BRANCHES} select k, base, a, b from c where class = 'Conflict'")
def diff3_conflicts(spark, sf_dir):
    return _changed(spark, sf_dir).where("class = 'Conflict'").drop("class")


@query(f"with {ORDER_BRANCHES} select k, a from c where class = 'BothSame'")
def diff3_convergent(spark, sf_dir):
    return _changed(spark, sf_dir).where("class = 'BothSame'").select("k", "a")


@query(f"with {ORDER_BRANCHES} select coalesce(base.k, a.k) k, case when base.k is null then 'Added' when a.k is null then 'Removed' else 'Modified' end change, base.v from_id, a.v to_id from base full join a on base.k = a.k where base.v is distinct from a.v")
def diff_two_way(spark, sf_dir):
    s = order_branches(spark, sf_dir)
    return versions.diff(s["base"], s["a"], "k", "v")


@query(f"with {ORDER_BRANCHES} select k, v from a where false")
def diff_identity_empty(spark, sf_dir):
    a = order_branches(spark, sf_dir)["a"]
    return versions.diff(a, a, "k", "v").select("k", F.col("to_id").alias("v"))


@query(f"with {ORDER_BRANCHES}, d as (select coalesce(base.k, a.k) k from base full join a on base.k = a.k where base.v is distinct from a.v), g as (select k, k - row_number() over (order by k) g from d) select min(k) first_page, max(k) last_page, count(*) n_pages from g group by g")
def diff_ranges(spark, sf_dir):
    s = order_branches(spark, sf_dir)
    return versions.ranges(versions.diff(s["base"], s["a"], "k", "v"), "k")


@query(f"with {ORDER_BRANCHES} select k, class, case when class = 'BOnly' then b when class = 'Conflict' then null else a end merged from c where class is not null")
def merge_record_level(spark, sf_dir):
    return versions.merge(_changed(spark, sf_dir), F.lit(None).cast("string")).select("k", "class", "merged")


@query("select c_custkey k, (b + (a - b) + (c - b))::double merged from (select c_custkey, c_acctbal::decimal(18, 2) b, (c_acctbal + case when c_custkey % 3 = 0 then 10 else 0 end)::decimal(18, 2) a, (c_acctbal - case when c_custkey % 5 = 0 then 7 else 0 end)::decimal(18, 2) c from customer)")
def merge_additive(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").cast("decimal(18,2)").alias("base"))
    a = F.expr("cast(base + if(k % 3 = 0, 10, 0) as decimal(18,2))")
    b = F.expr("cast(base - if(k % 5 = 0, 7, 0) as decimal(18,2))")
    return c.select("k", (F.col("base") + (a - F.col("base")) + (b - F.col("base"))).cast("double").alias("merged"))


_CANON = "o_orderkey::varchar || '|' || o_orderstatus"


@query(f"select o_orderkey // 64 page_no, sha256(string_agg(sha256({_CANON}), ',' order by o_orderkey)) page_id from orders group by 1")
def page_hash(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return versions.page_hashes(o, page_no("o_orderkey"), "o_orderkey", content.canonical(F.col("o_orderkey"), F.col("o_orderstatus")))


@query(f"select o_orderkey, sha256('k1|out|' || sha256('k1|in|' || {_CANON})) page_id from orders")
def page_hash_keyed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", content.keyed_page_id(content.canonical(F.col("o_orderkey"), F.col("o_orderstatus")), "k1").alias("page_id"))


@query("select o_orderpriority pool, count(distinct o_orderpriority || '/' || sha256(o_orderstatus)) n_objects, count(*) n_rows from orders group by 1")
def pool_separation(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("pool"), content.page_id(F.col("o_orderstatus")).alias("page_id"))
    each = o.groupBy("pool", "page_id").agg(F.count("*").alias("n"))
    return each.groupBy("pool").agg(F.count("*").alias("n_objects"), F.sum("n").alias("n_rows"))


@query("select sha256(text) page_id, min(doc_id) first_doc, count(*) n from documents group by 1")
def cas_dedup(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("page_id")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


@query("select doc_id, doc_id % 50 <> 0 verified from documents where doc_id % 77 <> 0")
def cas_verify(spark, sf_dir):
    return objects(spark, sf_dir).where("not missing").select("doc_id", (F.sha2("bytes", 256) == F.col("page_id")).alias("verified"))


@query("select sha256(text) page_id from documents group by 1 having bool_and(doc_id % 77 = 0)")
def cas_missing(spark, sf_dir):
    o = objects(spark, sf_dir)
    return o.select("page_id").distinct().join(o.where("not missing").select("page_id"), "page_id", "left_anti")


@query("select sha256(text) page_id, substr(sha256(text), 1, 12) short, 'p/pages/' || substr(sha256(text), 1, 2) || '/' || substr(sha256(text), 3, 2) || '/' || sha256(text) object_key from documents group by text")
def object_keys(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("page_id")).distinct()
    return ids.select("page_id", content.short_id(F.col("page_id")).alias("short"), content.object_key(F.lit("p"), "pages", F.col("page_id")).alias("object_key"))


_STORED = "stored as (select sha256(text) page_id, bool_and(doc_id % 50 <> 0) ok from documents where doc_id % 77 <> 0 group by 1), used as (select distinct sha256(text) page_id from documents where doc_id % 3 <> 0), st as (select coalesce(u.page_id, s.page_id) page_id, case when u.page_id is null then 'unreferenced' when s.page_id is null then 'missing' when ok then 'healthy' else 'corrupt' end state from used u full join stored s on u.page_id = s.page_id)"


def _scrubbed(spark, sf_dir):
    o = objects(spark, sf_dir)
    stored = o.where("not missing").groupBy("page_id").agg(F.min(F.struct((F.sha2("bytes", 256) == F.col("page_id")).alias("ok"), "bytes"))["bytes"].alias("bytes"))
    return versions.scrub(o.where("doc_id % 3 <> 0"), stored)


@query(f"with {_STORED} select state, count(*) n from st group by 1")
def scrub_report(spark, sf_dir):
    return _scrubbed(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


@query(f"with {_STORED} select page_id, case when page_id in (select sha256(text) from documents where doc_id % 5 <> 0) then 'repaired' else 'unrepairable' end state from st where state in ('corrupt', 'missing')")
def repair_report(spark, sf_dir):
    remote = table(spark, sf_dir, "documents").where("doc_id % 5 <> 0").select(F.sha2("text", 256).alias("page_id"), F.col("text").alias("bytes"))
    return versions.repair(_scrubbed(spark, sf_dir).where("state in ('corrupt', 'missing')"), remote).select("page_id", "state")


@query(f"with {LOG}, w as (select *, row_number() over (partition by page_no order by lsn desc) r from log where not is_commit) select page_no, page_id from w where r = 1 and page_id is not null")
def resolve_head(spark, sf_dir):
    chain = log(spark, sf_dir).where("not is_commit").select("page_no", "page_id", (-F.col("lsn")).alias("hop"))
    return versions.resolve(chain)


@query(f"with {LOG}, w as (select *, row_number() over (partition by page_no order by lsn desc) r from log where not is_commit and lsn <= (select max(lsn) // 2 from log)) select page_no, page_id from w where r = 1 and page_id is not null")
def resolve_as_of(spark, sf_dir):
    l = log(spark, sf_dir)
    half = l.agg(F.expr("max(lsn) div 2").alias("_h"))
    return versions.resolve(l.where("not is_commit").join(half, F.col("lsn") <= F.col("_h")).select("page_no", "page_id", (-F.col("lsn")).alias("hop")))


@query(f"with {LOG}, w as (select *, row_number() over (partition by page_no order by lsn desc) r from log where not is_commit) select distinct c_custkey page_no, page_id from customer left join (select * from w where r = 1) w on c_custkey = page_no")
def lookup_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_no"))
    chain = log(spark, sf_dir).where("not is_commit").select("page_no", "page_id", (-F.col("lsn")).alias("hop"))
    return versions.lookup(chain, pages)


_STAGED = f"with {LOG}, m as (select max(lsn) // 2 h from log), w as (select *, row_number() over (partition by page_no order by lsn desc) r from log, m where not is_commit and lsn <= h), base as (select page_no, page_id from w where r = 1 and page_id is not null), s as (select page_no, arg_max(struct_pack(p := page_id), lsn).p page_id from log, m where not is_commit and lsn > h group by 1), e as (select s.page_no, s.page_id, case when s.page_id is not distinct from base.page_id then 'none' when base.page_id is null then 'add' when s.page_id is null then 'remove' else 'change' end effect from s left join base using (page_no))"


def _staged(spark, sf_dir):
    l = log(spark, sf_dir).where("not is_commit")
    half = log(spark, sf_dir).agg(F.expr("max(lsn) div 2").alias("_h"))
    base = versions.resolve(l.join(half, F.col("lsn") <= F.col("_h")).select("page_no", "page_id", (-F.col("lsn")).alias("hop")))
    staged = l.join(half, F.col("lsn") > F.col("_h")).groupBy("page_no").agg(F.max_by(F.struct("page_id"), "lsn").alias("_x")).select("page_no", "_x.page_id")
    return base, staged


@query(f"{_STAGED} select page_no, page_id, effect, (case effect when 'add' then 1 when 'remove' then -1 else 0 end)::bigint delta from e")
def commit_derive_overlay(spark, sf_dir):
    return versions.derive(*_staged(spark, sf_dir))


@query(f"{_STAGED} select effect, count(*) n from e group by 1")
def commit_noop(spark, sf_dir):
    return versions.derive(*_staged(spark, sf_dir)).groupBy("effect").agg(F.count("*").alias("n"))


@query("select p_partkey node, (p_partkey % 9)::bigint depth, p_partkey % 9 = 0 is_flat from part")
def commit_flatten_depth(spark, sf_dir):
    # the n-th commit on an empty root: depths 1 to 8, then flat
    step = F.aggregate(F.sequence(F.lit(1), (F.col("node") % 9).cast("int") + 9), F.lit(0), lambda d, _: versions.next_depth(d))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")).withColumn("depth", step.cast("long")).withColumn("is_flat", F.col("depth") == 0)


_UP = "up as (with recursive r(root, node, distance) as (select node, node, 0 from commits where node % 97 = 0 union all select root, parent, distance + 1 from r join commits using (node) where parent is not null) select * from r)"


def _ancestors(spark, sf_dir, where):
    c = commits(spark, sf_dir)
    return versions.closure(c.withColumnRenamed("node", "child"), c.where(where).select("node"))


@query(f"with {COMMITS}, {_UP} select root, node, distance::bigint distance from up")
def ancestors(spark, sf_dir):
    return _ancestors(spark, sf_dir, "node % 97 = 0").withColumn("distance", F.col("distance").cast("long"))


@query(f"with recursive {COMMITS}, x(node, distance) as (select 97, 0 union all select parent, distance + 1 from x join commits using (node) where parent is not null), y(node, distance) as (select 150, 0 union all select parent, distance + 1 from y join commits using (node) where parent is not null) select arg_min(y.node, y.distance)::bigint merge_base, min(y.distance)::bigint from_b from x join y using (node)")
def merge_base(spark, sf_dir):
    up = _ancestors(spark, sf_dir, "node in (97, 150)")
    return versions.merge_base(up.where("root = 97"), up.where("root = 150")).select("merge_base", F.col("from_b").cast("long").alias("from_b"))


_LIVE = f"with recursive {COMMITS}, live(node) as (select node from commits where node % 97 = 0 or node % 101 = 0 union select unnest(list_filter([parent, overlay_base], lambda v: v is not null)) from live join commits using (node))"


def _live(spark, sf_dir):
    c = commits(spark, sf_dir)
    edges = c.select(F.col("node").alias("child"), "parent").union(c.select("node", "overlay_base")).where("parent is not null").distinct()
    roots = c.where("node % 97 = 0 or node % 101 = 0").select("node")
    return versions.flood(edges, roots).select("node")


@query(f"{_LIVE} select distinct node from live")
def reachable(spark, sf_dir):
    return _live(spark, sf_dir)


@query(f"{_LIVE} select node page_id, node not in (select node from live) and node % 1000 <> 1 swept from commits")
def gc_sweep(spark, sf_dir):
    c = commits(spark, sf_dir)
    pins = c.where("node % 1000 = 1").select(F.col("node").alias("page_id"))
    return versions.sweep(_live(spark, sf_dir).select(F.col("node").alias("page_id")), pins, c.select(F.col("node").alias("page_id")))


@query(f"{_LIVE}, g as (select node not in (select node from live) and node % 1000 <> 1 swept from commits) select count(*) filter (swept) swept, count(*) filter (not swept) retained from g")
def gc_stats(spark, sf_dir):
    return gc_sweep(spark, sf_dir).agg(F.count_if("swept").alias("swept"), F.count_if(~F.col("swept")).alias("retained"))


@query("select distinct p_partkey root from part where p_partkey % 97 = 0 or p_partkey % 101 = 0")
def branch_roots(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("root"))
    return p.where("root % 97 = 0").union(p.where("root % 101 = 0")).distinct()


@query("select p_brand tag, count(distinct p_size)::bigint targets from part group by 1 having count(distinct p_size) > 1")
def tag_immutability_violations(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("tag")).agg(F.countDistinct("p_size").alias("targets")).where("targets > 1")


@query()
def seal_open_roundtrip(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("bytes"), F.sha2("text", 256).alias("pid"), content.data_key("m", F.col("source")).alias("key"))
    sealed = content.seal(F.col("bytes"), F.col("key"), F.col("pid"), F.lit("pool"))
    return d.select("doc_id", (content.unseal(sealed, F.col("key"), F.col("pid"), F.lit("pool")) == F.col("bytes")).alias("same"))


@query()
def relocation_fails(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("bytes"), F.sha2("text", 256).alias("pid"), content.data_key("m", F.col("source")).alias("key"))
    sealed = content.seal(F.col("bytes"), F.col("key"), F.col("pid"), F.lit("pool"))
    return d.select("doc_id", content.unseal(sealed, F.col("key"), F.sha2(F.col("pid"), 256), F.lit("pool")).isNull().alias("refused"))
