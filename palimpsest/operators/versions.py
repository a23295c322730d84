"""Table states: overlays, diffs, merges, the commit graph, garbage collection, scrubbing.

A map is a DataFrame (page_no, page_id); changes have a null page_id for a removed page and
no row for one that they say nothing about.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MAX_OVERLAY_DEPTH
from ..errors import Truncated


def resolve(chain: DataFrame, *keys: str) -> DataFrame:
    """The map of a chain of changes (page_no, page_id, hop; 0 is the newest): the newest opinion on each page, without removed pages.

    One partial aggregation; a page's history is never gathered.
    """
    newest = F.min_by(F.struct("page_id"), "hop")
    return chain.groupBy(*keys, "page_no").agg(newest.alias("_x")).select(*keys, "page_no", "_x.page_id").where("page_id is not null")


def lookup(chain: DataFrame, pages: DataFrame) -> DataFrame:
    """``resolve`` for some pages only, null for those that are not there."""
    found = resolve(chain.join(pages.select("page_no").distinct(), "page_no", "left_semi"))
    return pages.join(found, "page_no", "left")


def derive(base: DataFrame, changes: DataFrame) -> DataFrame:
    """Staged changes against a map: ``effect`` (none, change, add, remove) and ``delta`` of the page count."""
    old = base.select("page_no", F.col("page_id").alias("_old"))
    out = changes.join(old, "page_no", "left")
    new = F.col("page_id")
    effect = F.when(new.eqNullSafe(F.col("_old")), "none").when(F.col("_old").isNull(), "add").when(new.isNull(), "remove").otherwise("change")
    delta = F.when(effect == "add", 1).when(effect == "remove", -1).otherwise(0)
    return out.select("page_no", "page_id", effect.alias("effect"), delta.cast("long").alias("delta"))


def applied(base: DataFrame, changes: DataFrame) -> DataFrame:
    """The map after the changes."""
    kept = base.join(changes.select("page_no"), "page_no", "left_anti")
    return kept.unionByName(changes.where("page_id is not null").select("page_no", "page_id"))


def next_depth(depth: Column) -> Column:
    """A commit on ``MAX_OVERLAY_DEPTH`` overlays is flat, any other one deeper than its base."""
    return F.when(depth >= MAX_OVERLAY_DEPTH, 0).otherwise(depth + 1)


def diff(old: DataFrame, new: DataFrame, key: str = "page_no", value: str = "page_id") -> DataFrame:
    """Keys whose values differ: Added, Removed or Modified, with both values."""
    a, b = old.select(key, F.col(value).alias("from_id")), new.select(key, F.col(value).alias("to_id"))
    both = a.join(b, key, "full").where(~F.col("from_id").eqNullSafe(F.col("to_id")))
    kind = F.when(F.col("from_id").isNull(), "Added").when(F.col("to_id").isNull(), "Removed").otherwise("Modified")
    return both.select(key, kind.alias("change"), "from_id", "to_id")


def classify(base: Column, a: Column, b: Column) -> Column:
    """Null is absence. Null for unchanged."""
    return F.when(a.eqNullSafe(b), F.when(~a.eqNullSafe(base), "BothSame")).when(a.eqNullSafe(base), "BOnly").when(b.eqNullSafe(base), "AOnly").otherwise("Conflict")


def diff3(base: DataFrame, a: DataFrame, b: DataFrame, key: str = "page_no", value: str = "page_id") -> DataFrame:
    """Keys that changed on a branch: key, class (AOnly, BOnly, BothSame, Conflict) and the three values.

    The three sides are stacked and pivoted by one aggregation: one shuffle, where two full
    joins would need their own.
    """
    sides = [side.select(key, F.lit(name).alias("_s"), F.col(value).alias("_v")) for name, side in (("base", base), ("a", a), ("b", b))]
    stacked = sides[0].union(sides[1]).union(sides[2])
    wide = stacked.groupBy(key).agg(*[F.max(F.when(F.col("_s") == name, F.col("_v"))).alias(name) for name in ("base", "a", "b")])
    return wide.withColumn("class", classify(F.col("base"), F.col("a"), F.col("b"))).where("class is not null").select(key, "class", "base", "a", "b")


def page_hashes(records: DataFrame, page: Column, key: str, content: Column) -> DataFrame:
    """(page_no, page_id) of records: the digest of each page's record digests in order of their keys."""
    digests = records.select(page.alias("page_no"), F.struct(F.col(key).alias("k"), F.sha2(content, 256).alias("h")).alias("r"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["h"]), ",")
    return digests.groupBy("page_no").agg(F.sha2(joined, 256).alias("page_id"))


def ranges(pages: DataFrame, key: str = "page_no", *groups: str, buckets: int = 1024) -> DataFrame:
    """Changed pages as contiguous ranges: first, last and how many.

    Runs are found within ``buckets`` equal stretches of the keys; what touches the ends of
    stretches, a run of each at most, is then joined. No task sorts all pages.
    """
    pages = pages.select(*groups, key).distinct()
    bounds = pages.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    placed = pages.join(bounds, F.lit(True)).withColumn("_b", F.expr(f"({key} - _lo) * {buckets} div (_hi - _lo + 1)"))
    parts = _runs(placed, key, key, F.lit(1), *groups, "_b").select(*groups, "first_page", "last_page", "n_pages")
    # pieces follow each other as their pages do: the number of pages before a piece's end tells them apart
    last = Window.partitionBy(*groups).orderBy("first_page")
    edge = parts.join(bounds, F.lit(True))
    edge = edge.withColumns({"_b": F.expr(f"(first_page - _lo) * {buckets} div (_hi - _lo + 1)"), "_p": F.expr(f"(first_page - 1 - _lo) * {buckets} div (_hi - _lo + 1)"), "_n": F.expr(f"(last_page + 1 - _lo) * {buckets} div (_hi - _lo + 1)")})
    inner = edge.where("_p = _b and _n = _b").select(*groups, "first_page", "last_page", "n_pages")
    outer = edge.where("_p <> _b or _n <> _b").withColumn("_new", (F.coalesce(F.lag("last_page").over(last), F.lit(-2)) + 1 != F.col("first_page")).cast("int"))
    outer = outer.withColumn("_g", F.sum("_new").over(last)).groupBy(*groups, "_g").agg(F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"), F.sum("n_pages").alias("n_pages")).drop("_g")
    return inner.unionByName(outer)


def _runs(rows: DataFrame, first: str, last: str, size: Column, *groups: str) -> DataFrame:
    """Rows whose keys follow each other, as first_page, last_page and n_pages for each run of a group."""
    runs = rows.withColumn("_g", F.col(first) - F.row_number().over(Window.partitionBy(*groups).orderBy(first)))
    return runs.groupBy(*groups, "_g").agg(F.min(first).alias("first_page"), F.max(last).alias("last_page"), F.sum(size).alias("n_pages")).drop("_g")


def merge(changes: DataFrame, policy: Column) -> DataFrame:
    """Values of a three-way diff after a merge: the side that changed, or ``policy`` for conflicts (null: stays in conflict)."""
    value = F.when(F.col("class") == "BOnly", F.col("b")).when(F.col("class").isin("AOnly", "BothSame"), F.col("a")).otherwise(policy)
    return changes.withColumn("merged", value)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder (``spark.checkpoint.dir``; a temporary one in local mode)."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return df.checkpoint()


def closure(edges: DataFrame, roots: DataFrame, steps: int | None = None, source: str = "child", target: str = "parent") -> DataFrame:
    """(root, node, distance) for all nodes that edges lead to, by shortest distance; ``Truncated`` if ``steps`` rounds don't reach all.

    A frontier loop: only nodes reached for the first time go on, so cycles end it. Without
    ``steps`` it goes on until nothing is new; where no node has two targets each round
    doubles the distance, so a long history takes few rounds.
    """
    edges = edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_s is not null and _t is not null")
    seen = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("distance")).distinct()
    if steps is None:
        edges = checkpointed(edges.distinct())
        if edges.groupBy("_s").count().where("count > 1").isEmpty():
            return _chains(edges, seen)
    front = seen
    for k in itertools.count(1):
        reached = front.join(edges, F.col("node") == F.col("_s")).select("root", F.col("_t").alias("node")).distinct()
        front = reached.join(seen, ["root", "node"], "left_anti").withColumn("distance", F.lit(k))
        front = checkpointed(front)
        if front.isEmpty():
            return seen
        if k == steps:
            more = front.join(edges, F.col("node") == F.col("_s")).select("root", F.col("_t").alias("node"))
            if not more.join(seen.unionByName(front), ["root", "node"], "left_anti").isEmpty():
                raise Truncated(f"more than {steps} steps")
            return seen.unionByName(front)
        seen = seen.unionByName(front)


def flood(edges: DataFrame, roots: DataFrame, source: str = "child", target: str = "parent") -> DataFrame:
    """(node, distance) for all nodes that edges lead to from any root, by shortest distance.

    One flood for all roots: a node is reached once, however many roots lead to it. It ends
    when nothing is new, so cycles end it too. Where no node has two targets each round
    doubles the distance, so a long history takes few rounds.
    """
    edges = checkpointed(edges.select(F.col(source).alias("_s"), F.col(target).alias("_t")).where("_s is not null and _t is not null").distinct())
    if edges.groupBy("_s").count().where("count > 1").isEmpty():
        return _chains(edges, roots.select(F.lit(0).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("distance")).distinct()).drop("root")
    front = checkpointed(roots.select(F.col(roots.columns[0]).alias("node"), F.lit(0).alias("distance")).distinct())
    seen = front
    for k in itertools.count(1):
        reached = edges.join(front, F.col("node") == F.col("_s"), "left_semi").select(F.col("_t").alias("node")).distinct()
        front = checkpointed(reached.join(seen, "node", "left_anti").withColumn("distance", F.lit(k)))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        if k % 16 == 0:
            seen = checkpointed(seen)


def digest(entries: DataFrame, width: int = 4096) -> str:
    """One digest of a map's entries (page_no, h): digests of stretches of ``width`` numbers, of stretches of those, and so on."""
    while True:
        rows = entries.agg(F.count("*").alias("n")).first()["n"]
        if rows <= width:
            ordered = sorted((r["page_no"], r["h"]) for r in entries.select("page_no", "h").collect())  # at most width rows
            return hashlib.sha256("|".join(f"{k}:{h}" for k, h in ordered).encode()).hexdigest()
        each = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "h"))), lambda r: F.concat_ws(":", r["page_no"].cast("string"), r["h"]))
        entries = checkpointed(entries.groupBy(F.floor(F.col("page_no") / width).alias("_p")).agg(F.sha2(F.array_join(each, "|"), 256).alias("h")).select(F.col("_p").alias("page_no"), "h"))


def _chains(jumps: DataFrame, seen: DataFrame) -> DataFrame:
    """``closure`` over at most one target a node: ``jumps`` leads 1, 2, 4, ... steps on, and ``seen`` has all nearer nodes."""
    far = 1
    while True:
        reached = seen.join(jumps, F.col("node") == F.col("_s")).select("root", F.col("_t").alias("node"), (F.col("distance") + far).alias("distance"))
        reached = reached.groupBy("root", "node").agg(F.min("distance").alias("distance"))
        new = checkpointed(reached.join(seen, ["root", "node"], "left_anti"))
        if new.isEmpty():
            return seen
        seen = checkpointed(seen.unionByName(new))
        jumps = checkpointed(jumps.alias("a").join(jumps.alias("b"), F.col("a._t") == F.col("b._s")).select("a._s", "b._t"))
        far *= 2


def merge_base(ancestors_a: DataFrame, ancestors_b: DataFrame) -> DataFrame:
    """The common ancestor nearest to b of each pair (node, distance for one commit each)."""
    both = ancestors_a.select("node", F.col("distance").alias("from_a")).join(ancestors_b.select("node", F.col("distance").alias("from_b")), "node")
    return both.agg(F.min_by("node", F.struct("from_b", "node")).alias("merge_base"), F.min(F.struct("from_b", "node"))["from_b"].alias("from_b"))


def scrub(referenced: DataFrame, objects: DataFrame) -> DataFrame:
    """Each id that is referred to or stored: healthy, corrupt, missing or unreferenced."""
    stored = objects.select("page_id", (F.sha2("bytes", 256) == F.col("page_id")).alias("ok"))
    out = referenced.select("page_id", F.lit(True).alias("used")).distinct().join(stored, "page_id", "full")
    state = F.when(F.col("used").isNull(), "unreferenced").when(F.col("ok").isNull(), "missing").when(F.col("ok"), "healthy").otherwise("corrupt")
    return out.select("page_id", state.alias("state"))


def repair(damaged: DataFrame, remote: DataFrame) -> DataFrame:
    """Damaged ids with the remote's bytes where those have the id: repaired or unrepairable."""
    good = remote.where(F.sha2("bytes", 256) == F.col("page_id")).select("page_id", "bytes").dropDuplicates(["page_id"])
    return damaged.select("page_id").join(good, "page_id", "left").withColumn("state", F.when(F.col("bytes").isNotNull(), "repaired").otherwise("unrepairable"))


def sweep(live: DataFrame, pins: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored ids with ``swept``: neither in a live state nor pinned."""
    keep = live.select("page_id").union(pins.select("page_id")).distinct().withColumn("_k", F.lit(True))
    return stored.select("page_id").distinct().join(keep, "page_id", "left").select("page_id", F.col("_k").isNull().alias("swept"))
