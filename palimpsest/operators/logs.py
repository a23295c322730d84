"""The write-ahead log and tiers as data: transactions, recovery, eviction, warm sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def before(totals: DataFrame, key: str, value: str, name: str, join=F.sum, buckets: int = 1024) -> DataFrame:
    """``totals`` with ``name``: ``value`` of all rows with a smaller ``key`` (unique), summed up or otherwise ``join``ed; null for the first.

    By way of ``buckets`` equal stretches of the keys, so that no task sees all rows however many there are.
    """
    bounds = totals.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    placed = totals.join(bounds, F.lit(True)).withColumn("_q", F.expr(f"({key} - _lo) * {buckets} div (_hi - _lo + 1)")).drop("_lo", "_hi")
    whole = placed.groupBy("_q").agg(join(value).alias("_w"))
    earlier = whole.select("_q", join("_w").over(Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)).alias("_e"))  # at most ``buckets`` rows
    inside = placed.withColumn("_i", join(value).over(Window.partitionBy("_q").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)))
    both = F.array_compact(F.array("_e", "_i"))
    found = F.array_max(both) if join is F.max else F.when(F.size(both) > 0, F.coalesce("_e", F.lit(0)) + F.coalesce("_i", F.lit(0)))
    return inside.join(earlier, "_q").withColumn(name, found).drop("_q", "_i", "_e")


def readable(log: DataFrame) -> DataFrame:
    """Each segment's records before its first bad one; a tear ends its own segment only."""
    first = log.where("bad").groupBy("segment").agg(F.min("lsn").alias("_bad"))
    return log.join(first, "segment", "left").where("_bad is null or lsn < _bad").drop("_bad")


def after_checkpoint(log: DataFrame) -> DataFrame:
    """Records that the last checkpoint has not captured."""
    last = log.where("is_checkpoint").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("_c"))
    return log.join(last, F.col("lsn") > F.col("_c")).drop("_c")


def transactions(log: DataFrame) -> DataFrame:
    """``log`` with ``txn``: commits before the record. Segment totals first, so that no task sorts the whole log."""
    per = log.groupBy("segment").agg(F.count_if("is_commit").alias("_n"))
    earlier = before(per, "segment", "_n", "_b").select("segment", F.coalesce("_b", F.lit(0)).alias("_b"))
    inside = Window.partitionBy("segment").orderBy("lsn").rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(F.col("is_commit").cast("long")).over(inside), F.lit(0))
    return log.withColumn("_r", run).join(earlier, "segment").withColumn("txn", F.col("_b") + F.col("_r")).drop("_r", "_b")


def committed(log: DataFrame) -> DataFrame:
    """Records of transactions that have their commit."""
    last = log.where("is_commit").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("_c"))
    return log.join(last, F.col("lsn") <= F.col("_c")).drop("_c")


def head_state(log: DataFrame) -> DataFrame:
    """The map after all committed writes: the last write of each page, without removed ones."""
    last = committed(log).where("not is_commit and not is_checkpoint").groupBy("page_no").agg(F.max_by(F.struct("page_id"), "lsn").alias("_x"))
    return last.select("page_no", "_x.page_id").where("page_id is not null")


def numbered(records: DataFrame, buckets: int = 1024) -> DataFrame:
    """``records`` (page_no, txn) with ``lsn``, from 1 in order of txn and page_no. Counts of ranges of txn first; the order within a range is a window of its own."""
    bounds = records.agg(F.min("txn").alias("_lo"), F.max("txn").alias("_hi"))
    placed = records.join(bounds, F.lit(True)).withColumn("_b", F.expr(f"(txn - _lo) * {buckets} div (_hi - _lo + 1)"))
    sizes = placed.groupBy("_b").agg(F.count("*").alias("_n"))
    base = sizes.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("txn", "page_no"))
    return placed.withColumn("_i", inside).join(base, "_b").select("page_no", "txn", (F.col("_base") + F.col("_i")).alias("lsn"))


def evictions(pages: DataFrame, budget: int, buckets: int = 1024) -> DataFrame:
    """Pages to evict, coldest first among the durable ones, until the rest fits ``budget`` bytes.

    Sizes are summed for ranges of touch times first; the order within a range is a window of
    its own, so the cache is not sorted in one task.
    """
    bounds = pages.agg(F.min("touched").alias("_lo"), F.max("touched").alias("_hi"), F.sum("size").alias("_all"))
    cold = pages.where("durable").join(bounds, F.lit(True)).withColumn("_b", F.expr(f"(touched - _lo) * {buckets} div (_hi - _lo + 1)"))
    sums = cold.groupBy("_b").agg(F.sum("size").alias("_n"))
    base = sums.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_base"))
    run = F.sum("size").over(Window.partitionBy("_b").orderBy("touched", "page")) - F.col("size")
    placed = cold.withColumn("_r", run).join(base, "_b").withColumn("_colder", F.col("_base") + F.col("_r"))
    return placed.where(F.col("_all") - F.col("_colder") > budget).select("page", "size", "touched")


def warm_set(accesses: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` different pages by their first access, with their place."""
    first = accesses.groupBy("page").agg(F.min("seq").alias("seq")).orderBy("seq", "page").limit(cap)
    return first.withColumn("place", F.row_number().over(Window.orderBy("seq", "page")).cast("long"))


def batch(ids: DataFrame, store: DataFrame) -> DataFrame:
    """(pos, page) requests answered in their order, repeats included; missing pages have null contents. Each page is looked up once."""
    found = store.join(ids.select("page").distinct(), "page", "left_semi")
    return ids.join(found, "page", "left")
