"""Config-driven loads between the landing, bronze and silver zones."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.config import LoadConfig
from tidemill.functions import castable_to_int, size_letter
from tidemill.operators.cleanse import (
    cast_columns,
    column_types,
    drop_columns,
    fill_nulls,
    rename_columns,
)
from tidemill.operators.profile import profile, store_part, stored_profile
from tidemill.sinks.files import (
    LoadAudit,
    append_managed,
    append_parquet,
    append_to_zones,
    overwrite_parquet,
    write_profile_csv,
)
from tidemill.sources.files import read_csv_strings, read_parquet_tables, table_name_of
from tidemill.tables.snapshot import SnapshotTable

# What the source system's tables need.
CASTS = {"SalesOrderDetail": {"SalesOrderID": "bigint"}}
RENAMES = {"Address": {"AddressLine1": "AddressL1", "AddressLine2": "AddressL2"}}
SIZED_TABLE = "Product"
SIZE_COLUMN = "Size"
MANAGED_SUFFIX = "Table"
INCREMENT_SUFFIX = "_part.parquet"
INCREMENT_FOLDER = "incremental"
FULL_LOAD = "full"

TableEdit = Callable[[SnapshotTable], object]


def size_check(products: DataFrame) -> DataFrame:
    """Sizes and whether each is a number."""
    size = F.col(SIZE_COLUMN)
    return products.select(size, castable_to_int(size).alias("Value"))


def of_size(products: DataFrame, letter: str) -> DataFrame:
    return products.where(F.col(SIZE_COLUMN) == letter)


def clean(table: str, frame: DataFrame, config: LoadConfig) -> DataFrame:
    """One table through every cleaning step. Full and incremental loads share it,
    so what they write has one schema."""
    frame = cast_columns(frame, CASTS.get(table, {}))
    types = column_types(frame)
    frame = fill_nulls(frame, config.fill_columns.get(table, ()), config.fill_values, types)
    frame = drop_columns(frame, config.drop_columns.get(table, ()))
    frame = rename_columns(frame, RENAMES.get(table, {}))
    if table == SIZED_TABLE:
        frame = frame.withColumn(SIZE_COLUMN, size_letter(F.col(SIZE_COLUMN)))
    return frame


def full_load(
    spark: SparkSession,
    config: LoadConfig,
    file_based: bool = False,
    managed_dir: str | None = None,
    keys: Mapping[str, str] | None = None,
    edits: Mapping[str, TableEdit] | None = None,
    skipped: list[str] | None = None,
    parts: str | None = None,
) -> dict[str, DataFrame]:
    """Clean every configured table and replace its silver dataset.

    With ``managed_dir`` each table is first kept there as ``<table>Table``, keyed by
    ``keys[table]`` or its first column, and ``edits`` change rows in it before the
    silver dataset is written from it. A configured table that is missing raises, unless
    there is a list for ``skipped`` to add its name to. With ``parts``, what a profile needs
    to know of the rows is stored there, for :func:`profile_loads`.
    """
    if edits and managed_dir is None:
        raise ValueError("edits need managed tables")
    frames = read_parquet_tables(spark, config.input_dir(file_based), config.tables, skipped=skipped)
    silver = {}
    for table, frame in frames.items():
        cleaned = clean(table, frame, config)
        if managed_dir is not None:
            key = (keys or {}).get(table, cleaned.columns[0])
            managed = SnapshotTable.create(cleaned, f"{managed_dir}/{table}{MANAGED_SUFFIX}", key)
            edit = (edits or {}).get(table)
            if edit is not None:
                edit(managed)
            cleaned = managed.read()
        path = f"{config.sink_dir}/{table}"
        overwrite_parquet(cleaned, path)
        silver[table] = spark.read.parquet(path)
        if parts is not None:
            store_part(silver[table], f"{parts}/{table}", FULL_LOAD)
    return silver


def incremental_load(
    spark: SparkSession, config: LoadConfig, increments: str, skipped: list[str] | None = None,
    parts: str | None = None, load: str = INCREMENT_FOLDER,
) -> dict[str, DataFrame]:
    """Clean the increments under ``increments`` and append them to silver.

    Returns the whole silver tables, read back. A table without an increment raises, unless
    there is a list for ``skipped`` to add its name to. With ``parts``, what a profile needs to
    know of the increment is stored there as ``load``; silver is not read for that.
    """
    frames = read_parquet_tables(spark, increments, config.tables, INCREMENT_SUFFIX, skipped)
    for table, frame in frames.items():
        cleaned = clean(table, frame, config)
        append_parquet(cleaned, f"{config.sink_dir}/{table}")
        if parts is not None:
            store_part(cleaned, f"{parts}/{table}", load)
    return read_parquet_tables(spark, config.sink_dir, config.tables, skipped=None if skipped is None else [])


def land_increment(
    spark: SparkSession,
    config: LoadConfig,
    increments: str,
    landing: str,
    bronze: str,
    skipped: list[str] | None = None,
) -> None:
    """Append each increment, as it is, to the landing and the bronze zone. ``skipped`` as
    for :func:`incremental_load`."""
    frames = read_parquet_tables(spark, increments, config.tables, INCREMENT_SUFFIX, skipped)
    for table, frame in frames.items():
        append_to_zones(frame, [f"{landing}/{table}", f"{bronze}/{table}"])


def profile_tables(
    tables: Mapping[str, DataFrame], folder: str, run_at: datetime, file_based: bool = False
) -> dict[str, str]:
    """Profile every table into a CSV of its own; returns where each went."""
    return {
        table: write_profile_csv(profile(frame), folder, table, run_at, file_based)
        for table, frame in tables.items()
    }


def profile_loads(
    tables: Mapping[str, DataFrame], parts: str, folder: str, run_at: datetime, file_based: bool = False
) -> dict[str, str]:
    """As :func:`profile_tables`, from the parts stored by the loads instead of the rows."""
    return {
        table: write_profile_csv(
            stored_profile(frame.sparkSession, f"{parts}/{table}", frame.schema), folder, table, run_at, file_based
        )
        for table, frame in tables.items()
    }


def load_csv(
    spark: SparkSession,
    folder: str,
    file_name: str,
    table: str | None = None,
    path: str | None = None,
) -> LoadAudit:
    """Append a headerless CSV file to the table named after it."""
    rows = read_csv_strings(spark, f"{folder}/{file_name}")
    return append_managed(rows, table or table_name_of(file_name), path)
