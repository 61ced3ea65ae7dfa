"""Rows that remember their changes' order, so that changes may come in any order.

Next to its columns such a row keeps when its last change, its last delete and its last
insert were made, and whether the row was there before any change. All four are greatest
values, so what changes add up to doesn't depend on how they are dealt to batches, on the
order of the batches, or on whether a batch comes twice. A deleted row stays, unseen, as long
as an older change may still come.
"""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.changes import INSERT_CREATED

#: When the last change, delete and insert were made; whether the row was there at first; and
#: what tells rows without a key apart.
CHANGED, DELETED, INSERTED, FIRST, LONE = "_changed_at", "_deleted_at", "_inserted_at", "_was_there", "_lone"
MARKS = (CHANGED, DELETED, INSERTED, FIRST, LONE)
MARK_TYPES = {CHANGED: "struct<basetime:double,sequence:bigint,tie:bigint>", FIRST: "boolean", LONE: "string"}
MARK_TYPES |= {DELETED: MARK_TYPES[CHANGED], INSERTED: MARK_TYPES[CHANGED]}


def unchanged(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a table before any change. Rows without a key are each their own."""
    never = F.lit(None).cast(MARK_TYPES[CHANGED])
    lone = F.when(F.col(key).isNull(), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    return rows.select("*", *(never.alias(c) for c in (CHANGED, DELETED, INSERTED)), F.lit(True).alias(FIRST), lone.alias(LONE))


def _marked(changes: DataFrame, key: str, columns: Sequence[str], insert_ops: Collection[str]) -> DataFrame:
    row = [F.col(f"`{c}`") for c in columns]
    sequence = F.col("sequence").cast("bigint") if "sequence" in changes.columns else F.lit(None).cast("bigint")
    at = F.struct(F.col("basetime").cast("double").alias("basetime"), sequence.alias("sequence"), F.xxhash64("op", *row).alias("tie"))
    event = F.concat_ws(" ", F.lit("event"), F.col("basetime").cast("string"), sequence.cast("string"), F.xxhash64("op", *row).cast("string"))
    kinds = {DELETED: F.col("op") == "d", INSERTED: F.col("op").isin(*insert_ops)}
    return changes.select(
        *row, at.alias(CHANGED), *(F.when(of, at).alias(c) for c, of in kinds.items()),
        F.lit(False).alias(FIRST), F.when(F.col(key).isNull(), event).alias(LONE),
    )


def combined(rows: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """One row for each key out of marked rows. ``by`` are columns that the key decides."""
    columns = [c for c in rows.columns if c not in (*MARKS, *by)]
    newest = F.struct(F.col(CHANGED).isNotNull(), CHANGED)
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    return (
        rows.groupBy(*by, F.col(f"`{key}`").alias("_key"), LONE)
        .agg(
            F.max_by(row, newest).alias("_row"),
            *(F.max(c).alias(c) for c in (CHANGED, DELETED, INSERTED, FIRST)),
        )
        .select("_row.*", CHANGED, DELETED, INSERTED, FIRST, LONE, *by)
    )


def summary(changes: DataFrame, key: str, columns: Sequence[str], insert_ops: Collection[str] = INSERT_CREATED) -> DataFrame:
    """What a batch of changes comes to: one marked row for each key, and for each event
    without a key. An event that comes twice (the same commit time, sequence and content)
    counts once."""
    return combined(_marked(changes, key, columns, insert_ops), key)


def is_there() -> Column:
    """Whether a marked row is seen: it was there or something inserted it, and no delete
    came after."""
    inserted, deleted = F.col(INSERTED), F.col(DELETED)
    return F.when(deleted.isNull(), F.col(FIRST) | inserted.isNotNull()).otherwise(F.coalesce(inserted > deleted, F.lit(False)))
