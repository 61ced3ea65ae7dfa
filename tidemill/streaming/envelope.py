"""Change events: JSON text to typed change rows. Works on batches and streams alike."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

# Columns a change row keeps next to the row itself.
CARRIED = ("op", "basetime", "sequence")


def decode(bodies: DataFrame) -> DataFrame:
    """Envelope fields of each ``Body``.

    Gives ``before``, ``after``, ``op``, ``schemaname`` (``schema.table``) and
    ``basetime`` (commit time as a double) next to the columns ``bodies`` brings. The
    row images stay text; their schema depends on the table named in the source. They
    tell events apart, but numbers in them have been through a double: typed rows are
    parsed from ``Body``, which is kept. A body that is not JSON gives NULL in all of them.

    NULL is given to the parser as empty text: for NULL itself it may repeat the fields of
    the row before. The text is parsed by generators, not by expressions: a filter on what they give
    stays above them, where an expression would be copied into the filter and every
    body parsed once more per mention.
    """
    carried = bodies.columns
    outer = bodies.select(
        *carried,
        F.json_tuple(F.coalesce("Body", F.lit("")), "before", "after", "op", "source").alias(
            "before", "after", "op", "_source"
        ),
    )
    inner = outer.select(
        *carried,
        "before",
        "after",
        "op",
        F.json_tuple(F.coalesce("_source", F.lit("")), "schema", "table", "ts_ms").alias("_schema", "_table", "_ts_ms"),
    )
    return inner.select(
        *carried,
        "before",
        "after",
        "op",
        F.concat("_schema", F.lit("."), "_table").alias("schemaname"),
        F.col("_ts_ms").try_cast("double").alias("basetime"),
    )


def row_image(changes: DataFrame) -> DataFrame:
    """``data``: the row as it was for a delete, as it is now otherwise."""
    image = F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after"))
    return changes.withColumn("data", image).drop("before", "after")


def _parse_schema(schema: StructType, epoch_millis: Collection[str]) -> StructType:
    return StructType(
        [
            StructField(f.name, LongType() if f.name in epoch_millis else f.dataType, True)
            for f in schema
        ]
    )


def typed_changes(
    images: DataFrame,
    schema: StructType,
    table: str | None = None,
    epoch_millis: Collection[str] = (),
) -> DataFrame:
    """Change rows with the target's columns next to ``op``, ``basetime`` and ``sequence``.

    With ``table`` only that table's events are taken, and only theirs are parsed.
    Timestamp columns sent as integers of milliseconds are named in
    ``epoch_millis``. Rows in which everything is NULL, tombstones above all, are
    dropped; a sequence number alone does not save a row.
    """
    if table is not None:
        images = images.where(F.col("schemaname") == table)
    carried = [c for c in CARRIED if c in images.columns]
    wanted = _parse_schema(schema, epoch_millis)
    images_of = StructType([StructField("before", wanted), StructField("after", wanted)])
    body = F.inline(F.array(F.from_json("Body", images_of))).alias("_before", "_after")
    both = images.select(*carried, body)
    row = F.when(F.col("op") == "d", F.col("_before")).otherwise(F.col("_after"))
    parsed = both.select(*carried, *(row.getField(f.name).alias(f"_{f.name}") for f in schema))
    columns = [
        (
            F.timestamp_millis(F.col(f"`_{f.name}`")).cast(f.dataType)
            if f.name in epoch_millis
            else F.col(f"`_{f.name}`")
        ).alias(f.name)
        for f in schema
    ]
    rows = parsed.select(*carried, *columns)
    return rows.na.drop("all", subset=[c for c in rows.columns if c != "sequence"])


def with_event_time(
    changes: DataFrame, column: str = "ModifiedDate", delay: str = "20 minutes"
) -> DataFrame:
    """Event time from a modification stamp, with a bound on how late it may be.

    Text that is no timestamp gives NULL.
    """
    stamp = F.try_to_timestamp(F.col(column).cast("string"))
    return changes.withColumn("modified_date_timestamp", stamp).withWatermark(
        "modified_date_timestamp", delay
    )
