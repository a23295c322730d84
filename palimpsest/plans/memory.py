"""Queries on an agent's memory: read sets, refusals, tenants, recall, packing, entitlements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import logs, retrieval, versions
from ..sources.tables import CLAIMS, ORDER_BRANCHES, claims, objects, order_branches, table
from .agents import ORACLE_SQL as AGENTS_SQL
from .agents import _DERIVED, _edges, _stale, _tainted, retrieve_bm25, retrieve_vector_topk
from .history import license_status
from .history import ORACLE_SQL as HISTORY_SQL
from .registry import registry
from .states import _STORED, _scrubbed, gc_stats
from .states import ORACLE_SQL as STATES_SQL

QUERIES, ORACLE_SQL, query = registry()


@query("with captured as (select distinct l_orderkey, l_partkey from lineitem where l_returnflag <> 'R'), declared as (select distinct l_orderkey, l_partkey from lineitem where l_linestatus = 'F') select coalesce(c.l_orderkey, d.l_orderkey) l_orderkey, coalesce(c.l_partkey, d.l_partkey) l_partkey, c.l_orderkey is not null was_read, d.l_orderkey is not null was_declared from captured c full join declared d on c.l_orderkey = d.l_orderkey and c.l_partkey = d.l_partkey")
def read_set(spark, sf_dir):
    """What an action has read: everything that the engine saw, and what it declared itself."""
    l = table(spark, sf_dir, "lineitem")
    sides = l.select("l_orderkey", "l_partkey", (F.col("l_returnflag") != "R").alias("r"), (F.col("l_linestatus") == "F").alias("d")).where("r or d")
    return sides.groupBy("l_orderkey", "l_partkey").agg(F.bool_or("r").alias("was_read"), F.bool_or("d").alias("was_declared"))


@query(f"with {ORDER_BRANCHES} select k, 'order ' || k || ': was ' || coalesce(base, 'absent') || ', one branch has ' || coalesce(a, 'absent') || ', the other ' || coalesce(b, 'absent') report from c where class = 'Conflict'")
def conflict_report(spark, sf_dir):
    s = order_branches(spark, sf_dir)
    said = [F.coalesce(F.col(x), F.lit("absent")) for x in ("base", "a", "b")]
    found = versions.diff3(s["base"], s["a"], s["b"], "k", "v").where("class = 'Conflict'")
    return found.select("k", F.format_string("order %d: was %s, one branch has %s, the other %s", "k", *said).alias("report"))


_POLICY = "(values ('BUILDING', 'allow', 'deny'), ('MACHINERY', 'allow', 'allow'), ('AUTOMOBILE', 'deny', 'allow')) p(segment, at_fork, at_merge)"


@query(f"with {ORDER_BRANCHES} select k, c_mktsegment, coalesce(at_fork, 'deny') at_fork, coalesce(at_merge, 'deny') at_merge, coalesce(at_merge, 'deny') = 'allow' merged from c join orders on o_orderkey = k join customer on c_custkey = o_custkey left join {_POLICY} on segment = c_mktsegment where class = 'AOnly'")
def policy_at_merge(spark, sf_dir):
    """A branch's changes under the policy that holds when they are merged; what held when it forked is only reported."""
    s = order_branches(spark, sf_dir)
    changes = versions.diff3(s["base"], s["a"], s["b"], "k", "v").where("class = 'AOnly'").select("k")
    owner = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c_custkey"))
    rules = spark.createDataFrame([("BUILDING", "allow", "deny"), ("MACHINERY", "allow", "allow"), ("AUTOMOBILE", "deny", "allow")], "c_mktsegment string, at_fork string, at_merge string")
    rows = changes.join(owner, "k").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_custkey").join(F.broadcast(rules), "c_mktsegment", "left")
    rows = rows.withColumns({x: F.coalesce(x, F.lit("deny")) for x in ("at_fork", "at_merge")})
    return rows.select("k", "c_mktsegment", "at_fork", "at_merge", (F.col("at_merge") == "allow").alias("merged"))


_NEW_EDGES = "proposed as (select doc_id parent, doc_id // 4 child from documents where doc_id % 50 = 0 and doc_id > 0 union all select doc_id, doc_id + 1 from documents where doc_id % 50 = 0)"


@query(f"with recursive edges as (select doc_id parent, 2 * doc_id + k child from documents, (values (0), (1)) v(k) where doc_id > 0 and 2 * doc_id + k in (select doc_id from documents)), {_NEW_EDGES}, up(root, node) as (select parent, parent from proposed union select root, e.parent from up join edges e on e.child = node) select parent, child, exists (select 1 from up where root = p.parent and node = p.child) refused from proposed p")
def cycle_refusal(spark, sf_dir):
    """New derivations, from each 50th document: one that would make a document its own source is refused."""
    d = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("doc_id")
    proposed = d.where("doc_id > 0").select(F.col("doc_id").alias("parent"), F.expr("doc_id div 4").alias("child")).union(d.select("doc_id", F.col("doc_id") + 1))
    up = versions.closure(_edges(spark, sf_dir), proposed.select("parent").distinct(), None, "child", "parent")
    found = up.select(F.col("root").alias("parent"), F.col("node").alias("child"), F.lit(True).alias("r"))
    return proposed.join(found, ["parent", "child"], "left").select("parent", "child", F.coalesce("r", F.lit(False)).alias("refused"))


@query("with recursive edges as (select doc_id parent, 2 * doc_id + k child from documents, (values (0), (1)) v(k) where doc_id > 0 and 2 * doc_id + k in (select doc_id from documents)), f(node) as (select doc_id from documents where doc_id % 50 = 0 union select child from f join edges on parent = node) select node doc_id, node % 50 = 0 tampered from f")
def tamper_flags(spark, sf_dir):
    """Documents whose bytes are not those of their digest, and all that is derived from them."""
    o = objects(spark, sf_dir)
    bad = o.where(F.sha2("bytes", 256) != F.col("page_id")).select("doc_id")
    found = versions.flood(_edges(spark, sf_dir), bad, "parent", "child").select(F.col("node").alias("doc_id"))
    return found.join(bad.withColumn("t", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("t", F.lit(False)).alias("tampered"))


@query("select o_orderkey, o_custkey asked, x.c_custkey found from orders left join customer x on x.c_custkey = o_custkey and x.c_nationkey = o_orderkey % 25")
def tenant_lookup(spark, sf_dir):
    """Customers asked for by a tenant: another tenant's are not found, just like those that do not exist."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("asked"), (F.col("o_orderkey") % 25).cast("int").alias("tenant"))
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("found"), F.col("c_nationkey").alias("tenant"))
    return asked.join(own, [asked["tenant"] == own["tenant"], F.col("asked") == F.col("found")], "left").select("o_orderkey", "asked", "found")


@query(f"with recursive {_DERIVED}, s as (select node, min(distance) distance from taint group by node having min(distance) > 0) select node, distance::bigint distance, row_number() over (order by distance, node)::bigint place from s")
def recalculation_queue(spark, sf_dir):
    """Stale documents in the order in which they have to be made again: what lies nearest to a source first."""
    stale = _tainted(spark, sf_dir).where("distance > 0").select(F.col("node").alias("page_no"), F.col("distance").alias("txn"))
    return logs.numbered(stale).select(F.col("page_no").alias("node"), F.col("txn").alias("distance"), F.col("lsn").alias("place"))


@query("select user_id agent, event_type skill, count(*) attempts, count(*) filter (value < 100) successes from events group by 1, 2")
def skill_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("agent"), F.col("event_type").alias("skill")).agg(F.count("*").alias("attempts"), F.count_if(F.col("value") < 100).alias("successes"))


_FEATURES = "(values (0, ['scan', 'merge']), (1, ['scan']), (2, ['merge']), (3, ['scan', 'merge']), (4, ['merge']), (5, ['scan', 'merge'])) f(id, features)"


@query(f"with s as ({HISTORY_SQL['license_status']}) select event_id, list_contains(features, 'merge') and status <> 'Degraded' may_merge from s join {_FEATURES} on event_id % 6 = id")
def feature_entitlement(spark, sf_dir):
    terms = spark.createDataFrame([(0, ["scan", "merge"]), (1, ["scan"]), (2, ["merge"]), (3, ["scan", "merge"]), (4, ["merge"]), (5, ["scan", "merge"])], "id int, features array<string>")
    s = license_status(spark, sf_dir).join(F.broadcast(terms), F.col("event_id") % 6 == F.col("id"))
    return s.select("event_id", (F.array_contains("features", "merge") & (F.col("status") != "Degraded")).alias("may_merge"))


_SCOPES = "(values ('view', 'read'), ('click', 'read'), ('signup', 'write'), ('purchase', 'write'), ('purchase', 'read')) g(branch, capability)"


@query(f"select event_id, exists (select 1 from {_SCOPES} where branch = event_type and capability = case when event_id % 2 = 0 then 'write' else 'read' end) allowed from events")
def capability_scope(spark, sf_dir):
    """Operations of a token on a branch: allowed only if its scope names both."""
    scopes = spark.createDataFrame([("view", "read"), ("click", "read"), ("signup", "write"), ("purchase", "write"), ("purchase", "read")], "event_type string, capability string")
    asked = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("event_id") % 2 == 0, "write").otherwise("read").alias("capability"))
    return asked.join(F.broadcast(scopes.withColumn("ok", F.lit(True))), ["event_type", "capability"], "left").select("event_id", F.coalesce("ok", F.lit(False)).alias("allowed"))


@query("select event_id, coalesce((props::json->>'k')::bigint, 0) k, coalesce((props::json->>'depth')::bigint, 8) depth, coalesce(props::json->>'branch', 'main') branch from events")
def token_defaults(spark, sf_dir):
    """Tokens in JSON: fields that are missing have their defaults."""
    x = F.from_json("props", "k long, depth long, branch string")
    e = table(spark, sf_dir, "events").select("event_id", x.alias("x"))
    return e.select("event_id", F.coalesce("x.k", F.lit(0)).alias("k"), F.coalesce("x.depth", F.lit(8)).alias("depth"), F.coalesce("x.branch", F.lit("main")).alias("branch"))


@query("select sha256(text) page_id, count(*) n from documents group by 1 having bool_and(doc_id % 7 <> 3)")
def cas_remove(spark, sf_dir):
    """Objects after the removal of some by id; removing one again, or one that is not there, changes nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("page_id"))
    gone = d.where("doc_id % 7 = 3").select("page_id").union(spark.createDataFrame([("0" * 64,)], "page_id string"))
    return d.join(gone, "page_id", "left_anti").groupBy("page_id").agg(F.count("*").alias("n"))


@query("with p as (select distinct l_partkey, l_suppkey from lineitem), x as (select distinct q.l_partkey part, n.l_partkey neighbour from p q join p n using (l_suppkey) where q.l_partkey % 50 = 0 and n.l_partkey <> q.l_partkey) select part, count(*) n, min(neighbour) first_neighbour from x group by 1")
def retrieve_expand(spark, sf_dir):
    """One hop from each 50th part: other parts of the same suppliers."""
    p = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    q = p.where("l_partkey % 50 = 0").select(F.col("l_partkey").alias("part"), "l_suppkey")
    found = retrieval.neighbours(q, p, "l_suppkey", "part", "l_partkey")
    return found.groupBy("part").agg(F.count("*").alias("n"), F.min("l_partkey").alias("first_neighbour"))


@query("with recursive c as (select source, doc_id, ceil(n_chars / 4.0)::bigint tokens, row_number() over (partition by source order by n_chars desc, doc_id) r from documents), f(source, r, used, doc_id, tokens, taken) as (select source, r, case when tokens <= 4000 then tokens else 0 end, doc_id, tokens, tokens <= 4000 from c where r = 1 union all select c.source, c.r, f.used + case when f.used + c.tokens <= 4000 then c.tokens else 0 end, c.doc_id, c.tokens, f.used + c.tokens <= 4000 from f join c on c.source is not distinct from f.source and c.r = f.r + 1 where c.r <= 100) select source, doc_id, tokens, used, coalesce(source, '') || ':' || doc_id citation from f where taken")
def retrieve_pack_greedy(spark, sf_dir):
    """Of the hundred longest documents of each source those that fit 4,000 tokens, longest first, passing over what does not fit; with their citations."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 4).alias("tokens"), "n_chars")
    found = retrieval.packed(d, "source", F.struct(-F.col("n_chars"), "doc_id"), "tokens", 4000, 100)
    return found.select("source", "doc_id", "tokens", "used", F.concat_ws(":", F.coalesce("source", F.lit("")), F.col("doc_id").cast("string")).alias("citation"))


@query(f"with {CLAIMS}, o as (select subject, count(*) n, max(id) newest from claims where predicate in ('view', 'click') group by 1), c as (select subject, count(*) n from claims where predicate not in ('view', 'click') group by 1) select subject, o.n observations, coalesce(c.n, 0) claims, newest from o left join c using (subject)")
def observations(spark, sf_dir):
    """Observations are appended and never count as claims."""
    seen = F.col("predicate").isin("view", "click")
    c = claims(spark, sf_dir).groupBy("subject").agg(F.count_if(seen).alias("observations"), F.count_if(~seen).alias("claims"), F.max(F.when(seen, F.col("id"))).alias("newest"))
    return c.where("observations > 0")


@query(f"with {CLAIMS} select subject, predicate, count(distinct \"method\") > 1 refused, case when count(distinct \"method\") = 1 then sum(object::decimal(18, 4))::double / count(*) end confidence from claims group by 1, 2")
def confidence_same_method(spark, sf_dir):
    """Mean confidence by subject and predicate; refused where claims come from different methods."""
    c = claims(spark, sf_dir).groupBy("subject", "predicate").agg(F.min("method").alias("lo"), F.max("method").alias("hi"), F.sum(F.col("object").cast("decimal(18,4)")).alias("s"), F.count("*").alias("n"))
    one = F.col("lo") == F.col("hi")
    return c.select("subject", "predicate", (~one).alias("refused"), F.when(one, F.col("s").cast("double") / F.col("n")).alias("confidence"))


@query(f"select 'swept ' || swept || ', kept ' || retained report from ({STATES_SQL['gc_stats']})")
def gc_report(spark, sf_dir):
    return gc_stats(spark, sf_dir).select(F.format_string("swept %d, kept %d", "swept", "retained").alias("report"))


@query(f"with {_STORED} select page_id, state in ('corrupt', 'missing') is_corruption, 'page ' || substr(page_id, 1, 12) || ' is ' || state report from st")
def scrub_lines(spark, sf_dir):
    """Every scrubbed page in a line to read, and whether its state is corruption."""
    line = F.format_string("page %s is %s", F.substring("page_id", 1, 12), "state")
    return _scrubbed(spark, sf_dir).select("page_id", F.col("state").isin("corrupt", "missing").alias("is_corruption"), line.alias("report"))


_COMBINED = f"""with recursive {_DERIVED},
v as ({AGENTS_SQL['retrieve_vector_topk']}), b as ({AGENTS_SQL['retrieve_bm25']}),
newest as (select doc_id, row_number() over (order by doc_id desc) place from documents),
candidates as (select query_id, vec_id doc_id, place from v union all select query_id, doc_id, place from b
  union all select q.doc_id, newest.doc_id, place from documents q, newest where q.doc_id % 50 = 0 and place <= 10
  union all select parent, child, 1 from edges where parent % 50 = 0),
summed as (select query_id, doc_id, sum(1::double / (60 + place)) s from candidates where doc_id in (select doc_id from documents) group by 1, 2),
scored as (select query_id, doc_id, s * case when doc_id in (select node from taint where distance > 0) then 0.5::double else 1 end * case when doc_id in (select doc_id from labels where quality = 0) then 0.5::double else 1 end s from summed),
ranked as (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) place from scored)
select query_id, doc_id, place, round(s, 6) score from ranked where place <= 10"""


@query(_COMBINED)
def retrieve_combined(spark, sf_dir):
    """The ten best candidates for each 50th document, by reciprocal places in four lists: nearest vectors, BM25, the newest, what is derived from it. Stale and badly rated ones count for half."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    newest = d.orderBy(F.desc("doc_id")).limit(10).withColumn("place", F.row_number().over(Window.orderBy(F.desc("doc_id"))).cast("long"))
    lists = [
        retrieve_vector_topk(spark, sf_dir).select("query_id", F.col("vec_id").alias("doc_id"), "place"),
        retrieve_bm25(spark, sf_dir).select("query_id", "doc_id", "place"),
        d.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id")).join(F.broadcast(newest), F.lit(True)),
        _edges(spark, sf_dir).where("parent % 50 = 0").select(F.col("parent").alias("query_id"), F.col("child").alias("doc_id"), F.lit(1).cast("long").alias("place")),
    ]
    summed = reduce(DataFrame.unionByName, lists).groupBy("query_id", "doc_id").agg(F.sum(1 / (60 + F.col("place"))).alias("s")).join(d, "doc_id", "left_semi")
    stale = _stale(spark, sf_dir).withColumn("stale", F.lit(0.5))
    poor = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id").distinct().withColumn("poor", F.lit(0.5))
    scored = summed.join(stale, "doc_id", "left").join(poor, "doc_id", "left")
    scored = scored.select("query_id", "doc_id", (F.col("s") * F.coalesce("stale", F.lit(1.0)) * F.coalesce("poor", F.lit(1.0))).alias("s"))
    found = retrieval.best(scored, 10, "query_id", "s", "doc_id")
    return found.select("query_id", "doc_id", F.col("place").cast("long").alias("place"), F.round("s", 6).alias("score"))
