"""Streaming outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery


def _start(writer: DataStreamWriter, available_now: bool) -> StreamingQuery:
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def start_batches(
    stream: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Hand every micro-batch to ``apply(batch, batch_id)``.

    ``available_now`` drains what the source holds at the start and then stops.
    """
    writer = (
        stream.writeStream.foreachBatch(apply)
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, available_now)


def archive_bodies(
    bodies: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> StreamingQuery:
    """Keep the raw event text as parquet. Needs a checkpoint of its own."""
    writer = (
        bodies.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return _start(writer, available_now)
