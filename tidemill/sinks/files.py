"""Parquet, managed-table and CSV outputs."""

from __future__ import annotations

import threading
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tidemill.operators.changes import SLOT, with_slot

_one_mode = threading.Lock()  # the session has one overwrite mode
RUN_STAMP_FORMAT = "%m-%d-%Y, %H:%M:%S"


def overwrite_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").parquet(path)


def append_parquet(frame: DataFrame, path: str) -> None:
    frame.write.mode("append").parquet(path)


def append_to_zones(frame: DataFrame, paths: Sequence[str], keep: bool = False) -> None:
    """Append the same rows to several datasets.

    A frame that is only a scan is cheaper to read again than to cache. Set
    ``keep`` when it carries joins or aggregates worth computing once; the
    storage level spills to disk.
    """
    if keep:
        frame.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for path in paths:
            append_parquet(frame, path)
    finally:
        if keep:
            frame.unpersist()


def overwrite_managed(frame: DataFrame, table: str, path: str | None = None) -> None:
    """Replace a catalog table; ``path`` makes it external."""
    writer = frame.write.format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def save_bucketed(frame: DataFrame, table: str, key: str, buckets: int | None = None, path: str | None = None) -> None:
    """Replace a catalog table with ``frame``, bucketed by a hash of its key that it keeps next
    to its columns: :func:`tidemill.operators.changes.merge_once` joins it without a shuffle.
    As many buckets as the session's shuffles have, unless given."""
    slotted = with_slot(frame, key)
    count = buckets or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = slotted.repartition(count, SLOT, key).write.format("parquet").mode("overwrite").bucketBy(count, SLOT, key).sortBy(SLOT, key)
    (writer.option("path", path) if path else writer).saveAsTable(table)


@dataclass(frozen=True)
class LoadAudit:
    """What one load did to a table."""

    inserted: int
    total: int


def append_managed(frame: DataFrame, table: str, path: str | None = None) -> LoadAudit:
    """Append to a catalog table, creating it if need be, and count what was added.

    Both counts come from parquet footers, so the audit does not re-read the rows.
    """
    spark = frame.sparkSession
    before = _count(spark, table) if spark.catalog.tableExists(table) else 0
    writer = frame.write.format("parquet").mode("append")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    total = _count(spark, table)
    return LoadAudit(total - before, total)


def _count(spark: SparkSession, table: str) -> int:
    return spark.table(table).agg(F.count(F.lit(1))).first()[0]


def spread_by(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bring equal ``columns`` together for a partitioned write.

    A rebalance rather than a fixed repartition: AQE cuts a group too large for
    one task into several and merges small ones, so a hot group costs more files,
    not a straggler.
    """
    return frame.hint("rebalance", *[F.col(c) for c in columns])


def overwrite_partitioned(
    frame: DataFrame,
    path: str,
    columns: Sequence[str],
    only_touched: bool = False,
    table: str | None = None,
) -> None:
    """Replace a Hive-partitioned dataset, or just the partitions present in ``frame``.

    With ``table`` the dataset is known to the catalog by that name. If only the touched
    partitions are replaced, the table must be there, and may have columns added before.
    """
    if table is not None and only_touched:
        overwrite_partitions(spread_by(frame, columns), table)
        return
    mode = "dynamic" if only_touched else "static"
    writer = spread_by(frame, columns).write.mode("overwrite").partitionBy(*columns)
    if table is None:
        writer.option("partitionOverwriteMode", mode).parquet(path)
    else:  # a table would keep the mode as its own
        writer.format("parquet").option("path", path).saveAsTable(table)


def overwrite_partitions(frame: DataFrame, table: str) -> None:
    """Replace the partitions of a catalog table that ``frame`` has rows for, and leave the
    others. Columns are matched by name; new partitions become known to the catalog.

    The rows may come from the table itself: new files are moved into place only when all of
    them are written.
    """
    spark = frame.sparkSession
    columns = spark.table(table).columns
    lacking = [c for c in columns if c not in frame.columns]
    if lacking:
        raise ValueError(f"{table} has columns the rows lack: {lacking}")
    mode = "spark.sql.sources.partitionOverwriteMode"
    with _one_mode:
        before = spark.conf.get(mode)
        spark.conf.set(mode, "dynamic")
        try:
            frame.select(*(f"`{c}`" for c in columns)).write.mode("overwrite").insertInto(table)
        finally:
            spark.conf.set(mode, before)


def write_profile_csv(
    profile: DataFrame, folder: str, table: str, run_at: datetime, file_based: bool = False
) -> str:
    """One CSV file with a header per table and run; returns the directory written.

    A profile has one row per column of the profiled table, so a single file is safe.
    """
    stamp = run_at.strftime(RUN_STAMP_FORMAT) + (" - File" if file_based else "")
    path = f"{folder}/Profile Statistics/{table}/{stamp}"
    as_text = profile.select([F.col(c).cast(StringType()).alias(c) for c in profile.columns])
    as_text.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
