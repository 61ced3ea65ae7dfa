"""Catalog tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def refresh(spark: SparkSession, tables: Iterable[str]) -> None:
    """Forget cached file listings and metadata of ``tables``."""
    for table in tables:
        spark.catalog.refreshTable(table)


def project(spark: SparkSession, table: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of a catalog table."""
    return spark.table(table).select(*columns)


def schema_of(spark: SparkSession, table: str) -> StructType:
    """The schema of a catalog table, for parsing rows bound for it."""
    return spark.table(table).schema
