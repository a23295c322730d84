"""Sessions, and bringing this package to executors that do not have it installed."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch: Python workers hold one batch, its strings and their results at a time.
ARROW_ROWS = "1000"


def session(name: str = "palimpsest", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; ``conf`` (dots as ``__``) comes on top."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        _ROWS: ARROW_ROWS,
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once for each Spark context, and keeps Arrow batches small where the session says nothing about them."""
    context = spark.sparkContext
    if spark.conf.get(_ROWS, "10000") == "10000":
        spark.conf.set(_ROWS, ARROW_ROWS)
    if not getattr(context, "_palimpsest_shipped", False):
        here = Path(__file__).resolve().parent
        copy = Path(tempfile.mkdtemp(prefix="palimpsest-ship-"))
        shutil.copytree(here, copy / "tree" / here.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(str(copy / here.name), "zip", copy / "tree"))
        context._palimpsest_shipped = True
    return spark
