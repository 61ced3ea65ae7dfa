"""Change events parsed once, into VARIANT, for any number of target tables.

A target takes its columns out of the parsed row image by path, as its own types; numbers keep
the digits they were sent with. What it has no column for can be kept beside them.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.streaming.envelope import CARRIED

IMAGE = "image"


def parsed(bodies: DataFrame) -> DataFrame:
    """Row images as VARIANT next to ``op``, ``schemaname``, ``basetime`` and what ``bodies``
    bring but the ``Body``: the row as it was for a delete, as it is now otherwise. A body
    that is no JSON gives NULL in all of them.

    The body is parsed by a generator: expressions on what it gives, filters above all,
    aren't copied below it, where each would parse the body again.
    """
    carried = [c for c in bodies.columns if c != "Body"]
    event = F.explode(F.array(F.try_parse_json("Body"))).alias("_event")

    def at(path: str, kind: str) -> Column:
        return F.try_variant_get("_event", f"$.{path}", kind)

    op = at("op", "string")
    image = F.when(op == "d", at("before", "variant")).otherwise(at("after", "variant"))
    return bodies.select(*carried, event).select(
        *carried,
        op.alias("op"),
        F.concat(at("source.schema", "string"), F.lit("."), at("source.table", "string")).alias("schemaname"),
        at("source.ts_ms", "double").alias("basetime"),
        F.when(~F.is_variant_null(image), image).alias(IMAGE),
    )


def _path(name: str) -> str:
    if '"' in name:
        raise ValueError(f"no path leads to a field named {name}")
    return f'$["{name}"]'


def variant_changes(
    events: DataFrame, schema: StructType, table: str | None = None, epoch_millis: Collection[str] = (), rest: str | None = None,
) -> DataFrame:
    """Change rows with the target's columns next to ``op``, ``basetime`` and ``sequence``, from
    :func:`parsed` events. ``table``, ``epoch_millis`` and which rows are dropped are as in
    :func:`tidemill.streaming.envelope.typed_changes`, but text is cast where a field should
    be a number or a time. ``rest`` names a column for the fields that the target lacks, as
    JSON text; NULL if there are none.
    """
    if table is not None:
        events = events.where(F.col("schemaname") == table)
    carried = [c for c in CARRIED if c in events.columns]

    def field(name: str, kind: str) -> Column:
        if name in epoch_millis:
            return F.timestamp_millis(F.try_variant_get(IMAGE, _path(name), "bigint")).cast(kind)
        return F.try_variant_get(IMAGE, _path(name), kind)

    columns = [field(f.name, f.dataType.simpleString()).alias(f.name) for f in schema]
    if rest is not None:
        fields = F.try_variant_get(IMAGE, "$", "map<string,variant>")
        others = F.map_filter(fields, lambda k, _: ~k.isin(*schema.names))
        columns.append(F.when(F.size(others) > 0, F.to_json(others)).alias(rest))
    rows = events.select(*carried, *columns)
    return rows.na.drop("all", subset=[c for c in rows.columns if c != "sequence"])
