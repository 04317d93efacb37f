"""The pN_ queries on training text and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordweave.llm import leakage, names, packing, residue
from recordweave.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.resolve(table(spark, d, "resolutions"), table(spark, d, "companies"))


def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "containers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p3_found": p3_found,
    "p7_packing": p7_packing,
    "p8_found": p8_found,
    "p9_found": p9_found,
}

ORACLE_SQL: dict[str, str] = {}
