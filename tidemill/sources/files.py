"""Parquet and CSV inputs."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)


def read_parquet_tables(
    spark: SparkSession,
    folder: str,
    tables: Iterable[str],
    suffix: str = "",
    skipped: list[str] | None = None,
) -> dict[str, DataFrame]:
    """One DataFrame per table under ``folder``, read from ``<table><suffix>``.

    A table that cannot be opened raises. With a list for ``skipped`` it is left out
    instead, and its name added to the list.
    """
    frames = {}
    for table in tables:
        try:
            frames[table] = spark.read.parquet(f"{folder}/{table}{suffix}")
        except AnalysisException as error:
            if skipped is None:
                raise
            log.warning("skipping %s: %s", table, error)
            skipped.append(table)
    return frames


def read_csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """Headerless comma-separated text; every column is a string named ``_c0``, ``_c1``, …"""
    return spark.read.csv(path, sep=",", header=False, inferSchema=False)


def table_name_of(file_name: str) -> str:
    """The table a landed file belongs to: its name up to the first dot."""
    return PurePosixPath(file_name).name.split(".")[0]
