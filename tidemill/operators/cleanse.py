"""Type-directed cleaning of a whole table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.config import FillValues

NOT_FILLABLE = ("binary", "date", "array", "map", "struct", "variant")


def column_types(frame: DataFrame) -> dict[str, str]:
    return dict(frame.dtypes)


def cast_columns(frame: DataFrame, types: Mapping[str, str]) -> DataFrame:
    return frame.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


def fill_nulls(
    frame: DataFrame,
    columns: Sequence[str],
    values: FillValues,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """Replace NULL in ``columns`` by the value configured for each column's type.

    Strings, timestamps and booleans have their own value; every other type takes
    the numeric one. ``types`` are the column types before any other cleaning.
    """
    types = column_types(frame) if types is None else types
    fills = {}
    for column in columns:
        if column not in types:
            raise ValueError(f"no column {column!r} to fill")
        kind = types[column]
        if kind.startswith(NOT_FILLABLE):
            raise ValueError(f"column {column!r} of type {kind} takes none of the fill values")
        if kind == "string":
            fills[column] = values.string
        elif kind.startswith("timestamp"):
            fills[column] = values.timestamp
        elif kind == "boolean":
            fills[column] = values.boolean
        else:
            fills[column] = values.numeric
    return frame.na.fill(fills) if fills else frame


def drop_columns(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop columns; a name the table does not have is ignored."""
    return frame.drop(*columns)


def rename_columns(frame: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; a name the table does not have is ignored."""
    return frame.withColumnsRenamed(dict(names))
