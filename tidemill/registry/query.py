"""What a registered query is made of."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, DecimalType

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    sql: str | None = None


def plain(frame: DataFrame) -> DataFrame:
    """The same rows with decimals as doubles and binary as hex, which any engine can
    compare. Sums are exact until here."""
    columns = []
    for f in frame.schema:
        name = f"`{f.name}`"
        shown = name
        if isinstance(f.dataType, DecimalType):
            exact = f"cast({name} as decimal(38,4))" if f.dataType.scale > 4 else name
            shown = f"cast({exact} as double)"
        elif isinstance(f.dataType, BinaryType):
            shown = f"lower(hex({name}))"
        columns.append(f"{shown} as {name}")
    return frame.selectExpr(*columns)
