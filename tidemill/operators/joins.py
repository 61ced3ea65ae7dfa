"""Helpers for star joins: when a dimension may be broadcast, and whether its key is one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_ROWS = 1_000_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
WORTH_MEASURING_BYTES = 10 * 1024 * 1024 * 1024
SURELY_SMALL_BYTES = 256 * 1024


def _estimated_bytes(frame: DataFrame) -> int:
    return int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _auto_broadcast_bytes(frame: DataFrame) -> int:
    jconf = frame._jdf.sparkSession().sessionState().conf()
    return int(jconf.autoBroadcastJoinThreshold())


def row_width(columns: Iterable[str]) -> Column:
    """Approximate bytes of a row."""
    return sum(
        F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) + 8 for c in columns
    )


def measured_size(frame: DataFrame) -> tuple[int, int]:
    """Rows and approximate bytes, from one aggregate that shuffles a row per task."""
    total = F.coalesce(F.sum(row_width(frame.columns)), F.lit(0))
    row = frame.agg(F.count(F.lit(1)).alias("rows"), total.alias("bytes")).first()
    return row.rows, row.bytes


def dimension(
    frame: DataFrame,
    max_rows: int = MAX_BROADCAST_ROWS,
    max_bytes: int = MAX_BROADCAST_BYTES,
    worth_measuring: int = WORTH_MEASURING_BYTES,
) -> DataFrame:
    """Prepare the small side of a star join.

    A tiny table needs nothing. One that Catalyst sees as small may be so only as compressed
    files, and take a hundred times as much when sent: it is measured, and kept from being
    sent if it is too large. A side that comes out of a filter or an aggregate is estimated at up to the size of its input, so the planner
    would shuffle the facts to meet it; such a side is measured, and hinted only when
    it really fits. Anything larger is left to a shuffled join, where AQE splits hot
    keys; so is a side whose input is too large to read once more for the measuring.
    """
    estimate = _estimated_bytes(frame)
    if estimate <= min(SURELY_SMALL_BYTES, _auto_broadcast_bytes(frame)) or estimate > worth_measuring:
        return frame
    held = frame.persist()  # so that the join does not compute it again
    rows, size = measured_size(held)
    if rows <= max_rows and size <= max_bytes:
        return F.broadcast(held)
    held.unpersist()
    return frame.hint("merge") if estimate <= _auto_broadcast_bytes(frame) else frame


def require_unique(frame: DataFrame, key: str) -> DataFrame:
    """Return ``frame`` if ``key`` identifies its rows, else raise.

    NULL keys match nothing in a join, so they may repeat.
    """
    repeated = (
        frame.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
        .head(1)
    )
    if repeated:
        raise ValueError(f"{key} repeats: {repeated[0][key]!r} has {repeated[0].copies} rows")
    return frame
