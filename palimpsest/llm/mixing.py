"""Mixing sources to target weights by hierarchical budgeting.

A token budget is propagated from the root of a tree (say domain, language, source) to its
leaves by weight. A node can take at most its tokens times the number of epochs allowed;
what it cannot take goes to its siblings first, and to its parent's siblings only when all
of those are full. Each leaf then repeats its documents for its whole epochs and takes a
prefix, by tokens, of one more epoch in an order seeded by that epoch.

DataFrame functions only. All arithmetic is on integers, so results do not depend on the
order of rows; a split loses less than a token a child to rounding.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, materialize

#: What a null in a level's column is called.
NONE = "(none)"
TOKENS_PER_BYTE = 4


def tokens_of(text: Column) -> Column:
    """A quarter of the bytes, rounded up; 0 for null."""
    return F.coalesce(F.ceil(F.octet_length(text) / TOKENS_PER_BYTE), F.lit(0)).cast("long")


def weight_of(column: Column, weights: Mapping[str, int]) -> Column:
    """Weights by name; ``*`` is that of any other name (1 without it)."""
    if min(weights.values(), default=0) < 0:
        raise ValueError("weights can't be negative")
    out = F.lit(weights.get("*", 1))
    for name, weight in weights.items():
        if name != "*":
            out = F.when(column == name, F.lit(weight)).otherwise(out)
    return out.cast("long")


def allocate(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int, epochs: int) -> DataFrame:
    """``leaves`` (levels and ``supply``, unique) with ``tokens``: each leaf's share of the budget.

    A node of weight 0 gets what is left when all siblings with a weight are full, in equal
    parts with others of weight 0.
    """
    caps = leaves.withColumn("_cap", F.col("supply") * epochs)
    whole = caps.groupBy().agg(F.least(F.coalesce(F.sum("_cap"), F.lit(0)), F.lit(budget)).cast("long").alias("_a"))
    given = whole.withColumn("_root", F.lit(0))
    for k, level in enumerate(levels):
        path = ["_root", *levels[: k + 1]]
        nodes = caps.withColumn("_root", F.lit(0)).groupBy(*path).agg(F.sum("_cap").alias("_cap"))
        nodes = nodes.withColumn("_w", weight_of(F.col(level), weights.get(level, {}))).join(given, path[:-1])
        nodes = nodes.withColumns({"_z": F.col("_w") == 0, "_w": F.greatest("_w", F.lit(1).cast("long"))})
        weighty = F.coalesce(F.sum(F.when(~F.col("_z"), F.col("_cap"))).over(Window.partitionBy(*path[:-1])), F.lit(0))
        nodes = nodes.withColumn("_a", F.when(F.col("_z"), F.greatest(F.col("_a") - weighty, F.lit(0))).otherwise(F.col("_a")).cast("long"))
        parent = Window.partitionBy(*path[:-1], "_z")
        order = parent.orderBy(F.col("_cap").cast("double") / F.col("_w"), level)
        nodes = nodes.withColumns(
            {
                "_before": F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)),
                "_left": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
            }
        ).withColumn("_before", F.coalesce("_before", F.lit(0)))
        nodes = nodes.withColumn("_full", F.col("_cap") * F.col("_left") <= (F.col("_a") - F.col("_before")) * F.col("_w"))
        rest = F.min(F.when(~F.col("_full"), F.col("_before"))).over(parent)
        among = F.max(F.when(~F.col("_full"), F.col("_left"))).over(parent)
        nodes = nodes.withColumns({"_rest": rest, "_among": among})
        share = F.when(F.col("_full"), F.col("_cap")).otherwise(F.expr("(_a - _rest) * _w div _among"))
        given = nodes.select(*path, share.cast("long").alias("_a"))
    return leaves.join(given, list(levels)).select(*levels, "supply", F.col("_a").alias("tokens"))


def _order(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def plan(rows: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], budget: int | float, epochs: int, seed: int) -> DataFrame:
    """For each leaf of ``rows`` (levels, doc_id, n_tokens): ``tokens``, ``whole`` (whole epochs) and ``cutoff``.

    A document belongs to the partial epoch if its order key is at most ``cutoff`` (null: none
    does), that is, if the tokens before it fall short of what is left for that epoch. A
    float budget is a share of the supply. The prefix is found through sums for 4096 ranges
    of keys, so no leaf is sorted as a whole, however large.
    """
    leaves = materialize(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("supply")))
    if isinstance(budget, float):
        budget = int((leaves.agg(F.sum("supply")).first()[0] or 0) * budget)
    given = allocate(leaves, levels, weights, budget, epochs)
    given = materialize(given.withColumn("whole", F.expr("if(supply > 0, tokens div supply, 0)")).withColumn("_r", F.expr("tokens - whole * supply")))
    keyed = rows.join(given.where("_r > 0").select(*levels, "whole", "_r"), list(levels)).withColumn("_h", _order(seed, F.col("whole"), F.col("doc_id"))).withColumn("_b", F.substring("_h", 1, 3))
    run = Window.partitionBy(*levels).orderBy("_b")
    ranges = keyed.groupBy(*levels, "_b", "_r").agg(F.sum("n_tokens").alias("_n")).withColumn("_base", F.sum("_n").over(run) - F.col("_n"))
    # the last range that starts before the end of the prefix holds its end
    last = materialize(ranges.where("_base < _r").groupBy(*levels).agg(F.max(F.struct("_b", "_base")).alias("_x")).select(*levels, "_x._b", "_x._base"))
    inside = keyed.join(last, [*levels, "_b"]).groupBy(*levels, "_b", "_base", "_r", "_h").agg(F.sum("n_tokens").alias("_n"))
    run = Window.partitionBy(*levels, "_b").orderBy("_h")
    inside = inside.withColumn("_before", F.col("_base") + F.sum("_n").over(run) - F.col("_n"))
    cutoff = inside.where("_before < _r").groupBy(*levels).agg(F.max("_h").alias("cutoff"))
    return materialize(given.join(cutoff, list(levels), "left").select(*levels, "tokens", "whole", "cutoff"))


def mix(docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], budget: int | float, epochs: int = 4, seed: int = 17, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``repeats`` (columns of these names are replaced), 0 for documents that are not drawn.

    ``levels`` names the tree's levels from the root and says how a document's node is found.
    Null nodes are called ``(none)``; rows of the same doc_id in a leaf stand or fall
    together. A document of no tokens is drawn if it stands before the end of the prefix.
    """
    *names, whole, cutoff = fresh(docs, *[f"_l_{k}" for k in levels], "_whole", "_cutoff")
    own = {n: F.coalesce(c.cast("string"), F.lit(NONE)) for n, c in zip(names, levels.values(), strict=True)}
    rows = docs.select([c for c in docs.columns if c not in ("n_tokens", "repeats")]).withColumns(own | {"n_tokens": tokens_of(F.col(text))})
    slim = materialize(rows.select(*names, "doc_id", "n_tokens"))
    found = plan(slim, names, {n: weights.get(k, {}) for n, k in zip(names, levels, strict=True)}, budget, epochs, seed)
    found = found.select(*names, F.col("whole").alias(whole), F.col("cutoff").alias(cutoff))
    out = rows.join(found, names).withColumn("repeats", F.col(whole) + F.coalesce((_order(seed, F.col(whole), F.col("doc_id")) <= F.col(cutoff)).cast("long"), F.lit(0)))
    return out.drop(*names, whole, cutoff)


#: The tree of the query and the pipeline.
WEIGHTS = {"domain": {"web": 50, "books": 30, "forums": 15, "*": 5}, "lang": {"en": 60, "de": 15, "fr": 15, "*": 10}, "source": {"*": 1}}
BUDGET, EPOCHS, SEED = 1.0, 4, 17


def domain(source: Column) -> Column:
    """A domain by the last digit of a source's name."""
    last = F.substring(source, -1, 1)
    return F.when(last.isin("0", "3", "6", "9"), "web").when(last.isin("1", "4", "7"), "books").when(last.isin("2", "5", "8"), "forums").otherwise("other")


def mix_corpus(docs: DataFrame) -> DataFrame:
    levels = {"domain": domain(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}
    return mix(docs, levels, WEIGHTS, BUDGET, EPOCHS, SEED)


def op1(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    return mix_corpus(docs).select("doc_id", domain(F.col("source")).alias("domain"), "lang", "source", "n_tokens", "repeats")


def _level_sql(k: int, levels: Sequence[str], given: str) -> str:
    """One level of the budget in SQL."""
    path, level = ", ".join(levels[: k + 1]), levels[k]
    up = "".join(f" and n.{x} = g.{x}" for x in levels[:k])
    parent = ", ".join(levels[:k]) or "0"
    cases = " ".join(f"when {level} = '{n}' then {w}" for n, w in WEIGHTS[level].items() if n != "*")
    weight = f"case {cases} else {WEIGHTS[level]['*']} end" if cases else str(WEIGHTS[level]["*"])
    return f"""
n{k} as (select {path}, sum(cap) cap, {weight} w from leaves group by {path}),
o{k} as (select n.*, g.a, coalesce(sum(cap) over (partition by {", ".join(f"n.{x}" for x in levels[:k]) or "0"} order by cap::double / w, n.{level} rows between unbounded preceding and 1 preceding), 0) b,
  sum(w) over (partition by {", ".join(f"n.{x}" for x in levels[:k]) or "0"} order by cap::double / w, n.{level} rows between current row and unbounded following) l from n{k} n join {given} g on true{up}),
f{k} as (select *, cap * l <= (a - b) * w f from o{k}),
r{k} as (select *, min(case when not f then b end) over (partition by {parent}) r, max(case when not f then l end) over (partition by {parent}) m from f{k}),
g{k} as (select {path}, case when f then cap else (a - r) * w // m end a from r{k}),"""


_LEVELS = ["domain", "lang", "source"]
OP1_SQL = f"""
with d as (select doc_id, lang lang0, source source0, coalesce(lang, '{NONE}') lang, coalesce(source, '{NONE}') source,
  case when right(source, 1) in ('0', '3', '6', '9') then 'web' when right(source, 1) in ('1', '4', '7') then 'books' when right(source, 1) in ('2', '5', '8') then 'forums' else 'other' end as domain,
  coalesce((strlen(text) + {TOKENS_PER_BYTE - 1}) // {TOKENS_PER_BYTE}, 0) n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens) supply, sum(n_tokens) * {EPOCHS} cap from d group by all),
root as (select least(sum(cap), sum(supply)) a from leaves),{_level_sql(0, _LEVELS, "root")}{_level_sql(1, _LEVELS, "g0")}{_level_sql(2, _LEVELS, "g1")}
p as (select l.*, g.a // nullif(l.supply, 0) e, g.a from leaves l join g2 g using (domain, lang, source)),
q as (select domain, lang, source, coalesce(e, 0) e, a - coalesce(e, 0) * supply r from p),
k as (select d.*, q.e, q.r, md5('{SEED}:' || q.e::bigint || ':' || coalesce(doc_id::varchar, '')) h from d join q using (domain, lang, source)),
s as (select domain, lang, source, h, sum(n_tokens) n from k group by all),
c as (select domain, lang, source, h, sum(n) over (partition by domain, lang, source order by h) - n before from s)
select doc_id, domain, lang0 as lang, source0 as source, n_tokens::bigint n_tokens, (e + case when before < r then 1 else 0 end)::bigint repeats from k join c using (domain, lang, source, h)
"""
