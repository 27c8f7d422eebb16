"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("extraction", "strings", "types", "validation", "records", "access", "reports", "code")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in importlib.import_module(f"quernstone.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in importlib.import_module(f"quernstone.plans.{m}").ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.extraction import chunk_documents

    return chunk_documents(spark, sf_dir)
