"""From raw documents to packed token rows: toxicity, near-duplicates, decontamination, mixing, packing.

Each stage reads what the one before wrote. The first four return the columns of documents;
the last returns packed rows (see ``palimpsest.llm.packing.SCHEMA``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontamination, mixing, near_duplicates, packing, toxicity
from palimpsest.llm.common import crc_mod, materialize, release, written
from palimpsest.session import ship


def _carried(docs: DataFrame) -> DataFrame:
    """What a stage works on, with the whole row beside it: columns of any name come through."""
    return docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity of at least 0.5 go; the model is trained on the labelled ones among ``docs``."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.detect(_carried(docs), toxicity.train(docs, labels)).where("predicted = 0").select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8."""
    return near_duplicates.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat an item of the benchmark go."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document occurs as often as it is drawn."""
    drawn = mixing.mix_corpus(_carried(docs)).where("repeats > 0")
    return drawn.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in packed rows."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("mixing", mix), ("packing", pack)]

#: Training and tokenising can't be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each but the last written to the shared folder and read again.

    What a stage wrote on its way, and its input, go as soon as its output is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = set(written())
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        release(spark, [path for path in written()[:-1] if path not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
