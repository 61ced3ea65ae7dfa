"""Unbounded event input: whatever the connector, one string column ``Body``."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Positions:
    """The part of a stream from ``start`` on and before ``end``, by a column that numbers or
    times its events, for connectors that have no such option of their own (few have one for
    the end). It is a filter, which reaches the scan of a columnar source.
    """

    column: str
    start: Any = None
    end: Any = None

    def of(self, events: DataFrame) -> DataFrame:
        at = F.col(self.column)
        events = events if self.start is None else events.where(at >= F.lit(self.start))
        return events if self.end is None else events.where(at < F.lit(self.end))


@dataclass(frozen=True)
class EventSource:
    """A streaming connector with its options.

    ``starting`` and ``ending`` name positions in the connector's own option
    names, e.g. ``{"startingOffsets": "earliest"}`` for Kafka; ``within`` bounds any
    connector by a column of its events. To stop at "now" rather than at a named
    position, start the stream with ``available_now``.
    """

    format: str
    path: str | None = None
    options: Mapping[str, str] = field(default_factory=dict)
    starting: Mapping[str, str] = field(default_factory=dict)
    ending: Mapping[str, str] = field(default_factory=dict)
    schema: StructType | str | None = None
    within: Positions | None = None

    def stream(self, spark: SparkSession) -> DataFrame:
        reader = spark.readStream.format(self.format)
        reader = reader.options(**{**self.options, **self.starting, **self.ending})
        if self.schema is not None:
            reader = reader.schema(self.schema)
        events = reader.load(self.path) if self.path else reader.load()
        return events if self.within is None else self.within.of(events)


def event_bodies(
    events: DataFrame, body: str = "body", sequence: str | Column | None = None
) -> DataFrame:
    """Event payloads as text, with the connector's sequence number when it has one."""
    columns = [F.col(body).cast("string").alias("Body")]
    if sequence is not None:
        number = F.col(sequence) if isinstance(sequence, str) else sequence
        columns.append(number.cast("bigint").alias("sequence"))
    return events.select(*columns)
