"""What several operators of this subpackage share: materialising, bounded samples, word patterns."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a temporary folder serves, but only in local mode: on a cluster
    executors would not see each other's files.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="palimpsest-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that ``materialize`` has written and ``release`` not yet removed.
_written: list[str] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    Cuts lineage: a lost executor costs the rereading of a file, not the recomputation of
    everything before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/t-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """The folders of ``materialize`` that are still there, oldest first."""
    return list(_written)


def release(spark: SparkSession, paths: list[str]) -> None:
    """Remove folders of ``materialize`` that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _written.remove(path)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names like ``stems`` that ``df`` has in no spelling."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """At most ``n`` rows, the first by a hash of ``order``: the same rows on every run.

    A threshold on the hash leaves about ``4 n`` rows before they are sorted, so what the last
    task merges does not grow with the input.
    """
    total = df.count()
    h = F.xxhash64(*order)
    if total > 4 * n:
        df = df.where(F.pmod(h, F.lit(1 << 40)) < F.lit((1 << 40) * 4 * n // total))
    return df.orderBy(F.pmod(h, F.lit(1 << 40)), *order).limit(n)


def within(sample: DataFrame, text: str, longest: int, most: int, *order: Column) -> DataFrame:
    """Of a bounded sample the rows with texts of at most ``longest`` characters, as far as they have ``most`` characters in all."""
    [total] = fresh(sample, "total")
    size = F.length(text)
    rows = sample.where(size <= longest)
    return rows.withColumn(total, F.sum(F.length(text)).over(Window.orderBy(F.xxhash64(*order), *order))).where(F.col(total) <= most).drop(total)


def fit_in_task(sample: DataFrame, fit, schema: str) -> DataFrame:
    """``fit`` (an iterator of Arrow batches to an iterator of Arrow batches) over a bounded sample, in one task."""
    return materialize(sample.repartition(1).mapInArrow(fit, schema))
