"""Queries over many databases: labels, pruning, partial and final aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Unsupported

MERGEABLE = ("count", "sum", "min", "max", "avg")


def check(aggregates: Sequence[str], joins_databases: bool = False, distinct: bool = False, window: bool = False) -> None:
    """Refuses what cannot be merged from partial results."""
    for name in aggregates:
        if name not in MERGEABLE:
            raise Unsupported(f"{name} has no partial form; export the rows and aggregate them in one database")
    for wrong, what in ((joins_databases, "a join across databases"), (distinct, "DISTINCT across databases"), (window, "a window across databases")):
        if wrong:
            raise Unsupported(f"{what} is not supported; copy the rows into one database first")


def labelled(registry: DataFrame, **labels: str) -> DataFrame:
    """Databases with all of these labels (a map column)."""
    out = registry
    for name, value in labels.items():
        out = out.where(F.col("labels")[name] == value)
    return out


def prune(stats: DataFrame, low: Column, high: Column) -> DataFrame:
    """Databases whose range of values meets [low, high]; never leaves out one that has a match."""
    return stats.where((F.col("max_value") >= low) & (F.col("min_value") <= high))


def fan_out(rows: DataFrame, database: str, groups: Sequence[str], value: str) -> DataFrame:
    """count, sum, min, max and avg of a decimal column by way of one partial result for each database."""
    partial = rows.groupBy(database, *groups).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    final = partial.groupBy(*groups).agg(F.sum("n").alias("n"), F.sum("s").alias("total"), F.min("lo").alias("lowest"), F.max("hi").alias("highest"))
    return final.withColumn("mean", F.col("total").cast("double") / F.col("n"))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows: each task keeps ``k``, one merges them."""
    return rows.orderBy(*order).limit(k)
