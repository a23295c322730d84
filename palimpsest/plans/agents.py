"""Queries on claims with provenance: time travel on two axes, merges by trust, taint, policy, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import retrieval, versions
from ..sources.tables import CLAIMS, claims, table
from .registry import registry

QUERIES, ORACLE_SQL, query = registry()

_MIDDLE = "m as (select min(ts) + (max(ts) - min(ts)) / 2 t from events)"


def _middle(spark, sf_dir):
    return table(spark, sf_dir, "events").agg((F.min("ts") + (F.max("ts") - F.min("ts")) / 2).alias("t"))


#: Claims with the ends of both intervals: a later one about the same subject and predicate closes them.
_INTERVALS = f"{CLAIMS}, iv as (select *, lead(valid_from) over (partition by subject, predicate order by valid_from, id) valid_to, lead(known_from) over (partition by subject, predicate order by known_from, id) known_to from claims)"


def _intervals(spark, sf_dir):
    ends = {f"{x}_to": F.lead(f"{x}_from").over(Window.partitionBy("subject", "predicate").orderBy(f"{x}_from", "id")) for x in ("valid", "known")}
    return claims(spark, sf_dir).withColumns(ends)


@query(f"with {_INTERVALS}, {_MIDDLE} select id, subject, predicate, object, t valid_at, t + to_days(2) known_at from iv, m where valid_from <= t and (valid_to is null or t < valid_to) and known_from <= t + to_days(2) and (known_to is null or t + to_days(2) < known_to)")
def claims_as_of(spark, sf_dir):
    """What held at one time as it was known at another: half-open intervals on both axes, both bounds in the answer."""
    at = _middle(spark, sf_dir).select(F.col("t").alias("valid_at"), (F.col("t") + F.make_dt_interval(F.lit(2))).alias("known_at"))
    c = _intervals(spark, sf_dir).join(F.broadcast(at), F.lit(True))
    held = lambda x: (F.col(f"{x}_from") <= F.col(f"{x}_at")) & (F.col(f"{x}_to").isNull() | (F.col(f"{x}_at") < F.col(f"{x}_to")))
    return c.where(held("valid") & held("known")).select("id", "subject", "predicate", "object", "valid_at", "known_at")


@query(f"with {_INTERVALS} select q.id question, c.id answer from iv q join iv c on c.subject = q.subject and c.predicate = q.predicate and c.valid_from <= q.known_from and (c.valid_to is null or q.known_from < c.valid_to) where q.id % 50 = 0")
def claims_at_question(spark, sf_dir):
    """For each 50th claim the one that held when it became known: an interval join within subject and predicate."""
    c = _intervals(spark, sf_dir)
    q = c.where("id % 50 = 0").select(F.col("id").alias("question"), "subject", "predicate", F.col("known_from").alias("at"))
    held = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    return c.join(q, ["subject", "predicate"]).where(held).select("question", F.col("id").alias("answer"))


@query(f"with {CLAIMS} select id, subject, predicate, known_from, lead(known_from) over (partition by subject, predicate order by known_from, id) known_to from claims")
def claims_supersession(spark, sf_dir):
    w = Window.partitionBy("subject", "predicate").orderBy("known_from", "id")
    return claims(spark, sf_dir).select("id", "subject", "predicate", "known_from", F.lead("known_from").over(w).alias("known_to"))


@query(f"with {CLAIMS} select id, date_diff('day', valid_from, known_from)::bigint late_days from claims where known_from > valid_from")
def claims_late_arrival(spark, sf_dir):
    return claims(spark, sf_dir).where("known_from > valid_from").select("id", F.datediff(F.to_date("known_from"), F.to_date("valid_from")).cast("long").alias("late_days"))


@query(f"with {CLAIMS} select id, evidence_n > 0 and trust > 0 eligible from claims")
def claims_unsupported(spark, sf_dir):
    return claims(spark, sf_dir).select("id", ((F.col("evidence_n") > 0) & (F.col("trust") > 0)).alias("eligible"))


@query(f"with {CLAIMS} select subject, \"method\", avg(object::decimal(18, 4))::double confidence, count(*) n from claims group by 1, 2")
def confidence_by_method(spark, sf_dir):
    c = claims(spark, sf_dir).groupBy("subject", "method").agg(F.sum(F.col("object").cast("decimal(18,4)")).alias("s"), F.count("*").alias("n"))
    return c.select("subject", "method", (F.col("s").cast("double") / F.col("n")).alias("confidence"), "n")


@query(f"with {CLAIMS}, r as (select *, row_number() over (partition by subject, predicate order by trust desc, known_from desc, id desc) r from claims) select id, case when r = 1 then 'Accepted' else 'Contradicted' end status from r")
def merge_provenance_rank(spark, sf_dir):
    w = Window.partitionBy("subject", "predicate").orderBy(F.desc("trust"), F.desc("known_from"), F.desc("id"))
    return claims(spark, sf_dir).withColumn("r", F.row_number().over(w)).select("id", F.when(F.col("r") == 1, "Accepted").otherwise("Contradicted").alias("status"))


_DERIVED = "edges as (select doc_id parent, 2 * doc_id + k child from documents, (values (0), (1)) v(k) where doc_id > 0 and 2 * doc_id + k in (select doc_id from documents)), roots as (select doc_id node from documents where source = 'src3' and doc_id % 7 = 0), taint(node, distance) as (select node, 0 from roots union select child, distance + 1 from taint join edges on parent = node)"


def _edges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    pairs = d.where("doc_id > 0").select(F.col("doc_id").alias("parent"), F.explode(F.array(2 * F.col("doc_id"), 2 * F.col("doc_id") + 1)).alias("child"))
    return pairs.join(d.select(F.col("doc_id").alias("child")), "child", "left_semi")


def _tainted(spark, sf_dir):
    roots = table(spark, sf_dir, "documents").where("source = 'src3' and doc_id % 7 = 0").select("doc_id")
    return versions.flood(_edges(spark, sf_dir), roots, "parent", "child").select("node", F.col("distance").cast("long").alias("distance"))


def _stale(spark, sf_dir):
    """Documents derived from a tainted one: roots too, where they are derived from others."""
    tainted = _tainted(spark, sf_dir).select(F.col("node").alias("parent"))
    return _edges(spark, sf_dir).join(tainted, "parent", "left_semi").select(F.col("child").alias("doc_id")).distinct()


@query(f"with recursive {_DERIVED} select node, min(distance)::bigint distance from taint group by node")
def taint_closure(spark, sf_dir):
    return _tainted(spark, sf_dir)


@query(f"with recursive {_DERIVED}, x as (select node, min(distance) distance from taint group by node) select node, case when node % 5 = 0 then 'irreversible' when node % 5 < 3 then 'compensate' else 'invalidate' end action, (case when node % 5 = 0 then 0 when node % 5 < 3 then 1 else 2 end)::bigint section, distance::bigint distance from x")
def taint_recall_plan(spark, sf_dir):
    n = F.col("node") % 5
    action = F.when(n == 0, "irreversible").when(n < 3, "compensate").otherwise("invalidate")
    section = F.when(n == 0, 0).when(n < 3, 1).otherwise(2)
    return _tainted(spark, sf_dir).select("node", action.alias("action"), section.cast("long").alias("section"), "distance")


@query(f"with recursive {_DERIVED} select doc_id, case when doc_id in (select node from taint where distance > 0) then 'Stale' else 'Fresh' end status from documents")
def staleness(spark, sf_dir):
    stale = _stale(spark, sf_dir).withColumn("s", F.lit("Stale"))
    return table(spark, sf_dir, "documents").select("doc_id").join(stale, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit("Fresh")).alias("status"))


@query("with recursive edges as (select doc_id parent, 2 * doc_id + k child from documents, (values (0), (1)) v(k) where doc_id > 0 and 2 * doc_id + k in (select doc_id from documents)), up(root, node, d) as (select doc_id, doc_id, 0 from documents union all select root, parent, d + 1 from up join edges on child = node) select root doc_id, max(coalesce(toxic, 0))::int label from up left join labels on labels.doc_id = node group by root")
def label_propagation(spark, sf_dir):
    marked = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    below = versions.flood(_edges(spark, sf_dir), marked, "parent", "child").select(F.col("node").alias("doc_id")).withColumn("label", F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id").join(below, "doc_id", "left").select("doc_id", F.coalesce("label", F.lit(0)).alias("label"))


@query("select c_custkey, case when bool_or(coalesce(p.effect, '') = 'deny') then 'deny' when bool_or(coalesce(p.effect, '') = 'allow') then 'allow' else 'deny' end decision, count(p.effect) n_rules from customer left join (values ('BUILDING', 'allow'), ('BUILDING', 'deny'), ('MACHINERY', 'allow'), ('AUTOMOBILE', 'allow')) p(segment, effect) on c_mktsegment = segment group by 1")
def policy_deny_overrides(spark, sf_dir):
    rules = spark.createDataFrame([("BUILDING", "allow"), ("BUILDING", "deny"), ("MACHINERY", "allow"), ("AUTOMOBILE", "allow")], "segment string, effect string")
    j = table(spark, sf_dir, "customer").join(F.broadcast(rules), F.col("c_mktsegment") == F.col("segment"), "left")
    deny, allow = F.bool_or(F.coalesce(F.col("effect") == "deny", F.lit(False))), F.bool_or(F.coalesce(F.col("effect") == "allow", F.lit(False)))
    return j.groupBy("c_custkey").agg(F.when(deny, "deny").when(allow, "allow").otherwise("deny").alias("decision"), F.count("effect").alias("n_rules"))


@query(f"with {CLAIMS} select id, case when trust = 0 then 'Denied' when evidence_n = 0 then 'Denied' when \"method\" = 2 and trust < 2 then 'Indeterminate' else 'Authorised' end outcome from claims")
def action_eligibility(spark, sf_dir):
    outcome = F.when(F.col("trust") == 0, "Denied").when(F.col("evidence_n") == 0, "Denied").when((F.col("method") == 2) & (F.col("trust") < 2), "Indeterminate").otherwise("Authorised")
    return claims(spark, sf_dir).select("id", outcome.alias("outcome"))


@query("select user_id || ':' || event_type idempotency_key, min(event_id) executed, count(*) - 1 suppressed from events group by 1")
def action_idempotency(spark, sf_dir):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type")
    return table(spark, sf_dir, "events").groupBy(key.alias("idempotency_key")).agg(F.min("event_id").alias("executed"), (F.count("*") - 1).alias("suppressed"))


@query(f"with {CLAIMS} select id, subject, predicate from claims where subject % 10 = 3 and predicate in ('purchase', 'click') and trust >= 2")
def aql_filter(spark, sf_dir):
    return claims(spark, sf_dir).where("subject % 10 = 3 and predicate in ('purchase', 'click') and trust >= 2").select("id", "subject", "predicate")


@query("with e as (select vec_id, embedding::double[] v from embeddings), s as (select q.vec_id query_id, e.vec_id, list_cosine_similarity(e.v, q.v) s from e, e q where q.vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(s, 9) desc, vec_id) place from s) select query_id, vec_id, place, round(s, 6) score from r where place <= 10")
def retrieve_vector_topk(spark, sf_dir):
    """The ten nearest vectors to each 50th one."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    found = retrieval.nearest(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v"), 10)
    return found.select("query_id", "vec_id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


_BM25 = "w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) t from documents), n as (select doc_id, count(*) n from w group by 1), a as (select avg(n) a, (select count(*) from documents) c from n), f as (select doc_id, t, count(*) f from w group by 1, 2), df as (select t, count(*) d from f group by 1), q as (select doc_id query_id, t, d from (select f.doc_id, t, d, row_number() over (partition by f.doc_id order by d, t) r from f join df using (t) where f.doc_id % 50 = 0) where r <= 10)"


@query(f"with {_BM25}, s as (select query_id, doc_id, sum(ln(1 + (c - d + 0.5::double) / (d + 0.5::double)) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * n / a))) s from q join f using (t) join n using (doc_id), a group by 1, 2), r as (select *, row_number() over (partition by query_id order by round(s, 9) desc, doc_id) place from s) select query_id, doc_id, place, round(s, 6) score from r where place <= 10")
def retrieve_bm25(spark, sf_dir):
    """The ten documents that fit the ten rarest words of each 50th document best."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w"))
    found = retrieval.bm25(d, "doc_id % 50 = 0", 10, 10)
    return found.select("query_id", "doc_id", F.col("place").cast("long").alias("place"), F.round("score", 6).alias("score"))


@query("with r as (select source, doc_id, ceil(n_chars / 4.0)::bigint tokens, sum(ceil(n_chars / 4.0)) over (partition by source order by doc_id)::bigint used from documents) select source, doc_id, tokens, used from r where used <= 4000")
def retrieve_pack(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.ceil(F.col("n_chars") / 4).alias("tokens"))
    return d.withColumn("used", F.sum("tokens").over(Window.partitionBy("source").orderBy("doc_id"))).where("used <= 4000")


@query("select d.doc_id, n_chars from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1)")
def retrieve_influence_filter(spark, sf_dir):
    denied = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(denied, "doc_id", "left_anti")


@query("with recursive edges as (select doc_id parent, 2 * doc_id + k child from documents, (values (0), (1)) v(k) where doc_id > 0 and 2 * doc_id + k in (select doc_id from documents)), f(node, d) as (select 5::bigint, 0 union all select child, d + 1 from f join edges on parent = node) select case when d = 0 then 'direct' else 'derived' end kind, count(*) n from f group by 1")
def forgetting_report(spark, sf_dir):
    roots = spark.range(5, 6).select(F.col("id").alias("doc_id"))
    found = versions.flood(_edges(spark, sf_dir), roots, "parent", "child")
    return found.groupBy(F.when(F.col("distance") == 0, "direct").otherwise("derived").alias("kind")).agg(F.count("*").alias("n"))
