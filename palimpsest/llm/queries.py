"""The queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, language, licenses, mixing, near_duplicates, packing, quality_classifier, quality_rules, secrets, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1,
    "op2_language_id": language.op2,
    "op3_toxicity": toxicity.op3,
    "op4_quality_classifier": quality_classifier.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_licenses": licenses.op6,
    "op7_secrets": secrets.op7,
    "op8_packing": packing.op8,
    "op9_near_duplicates": near_duplicates.op9,
    "op10_decontamination": decontamination.op10,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op9_near_duplicates": near_duplicates.OP9_SQL,
    "op10_decontamination": decontamination.OP10_SQL,
}
