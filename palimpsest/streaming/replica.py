"""A replica that follows sealed log segments and moves only at commit boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import logs

SCHEMA = "segment long, lsn long, page_no long, page_id long, is_commit boolean, is_checkpoint boolean, bad boolean"


def follow(spark: SparkSession, segments: str, out: str, checkpoint: str) -> StreamingQuery:
    """Applies every new segment file under ``segments`` (Parquet, ``SCHEMA``) and writes the records of whole transactions under ``out``.

    A batch holds back what comes after its last commit: those records are read again with
    the next batch from ``out/pending``. A batch that is run again after a failure writes the
    same folder again, so nothing is applied twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        rows = logs.readable(batch)
        if number:
            rows = rows.unionByName(batch.sparkSession.read.schema(SCHEMA).parquet(f"{out}/pending/{number - 1}"))
        last = rows.where("is_commit").agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("_c"))
        marked = rows.join(F.broadcast(last), F.lit(True))
        marked.where("lsn <= _c").drop("_c").write.mode("overwrite").parquet(f"{out}/applied/{number}")
        marked.where("lsn > _c").drop("_c").write.mode("overwrite").parquet(f"{out}/pending/{number}")

    source = spark.readStream.schema(SCHEMA).parquet(segments)
    return source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible(spark: SparkSession, out: str) -> DataFrame:
    """The map that readers of the replica see."""
    applied = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{out}/applied")
    return logs.head_state(applied)


def lag(spark: SparkSession, out: str, written: int) -> int:
    """Log records between the primary's last one and the last commit applied here."""
    applied = spark.read.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{out}/applied")
    return written - (applied.agg(F.max("lsn")).first()[0] or 0)
