"""Streams whose events are delivered more than once, or long after their time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT_TIME, DIGEST = "event_time", "digest"


def first_deliveries(images: DataFrame, delay: str = "20 minutes", same: Sequence[str] = ("sequence", "schemaname", "op")) -> DataFrame:
    """Each event once, however often and in whichever batches it is delivered.

    Events are the same if their commit time, the columns ``same`` and, with a ``Body``, its
    digest are. What has been seen is kept in Spark's state store until the watermark is
    ``delay`` past it, so state doesn't grow with the stream; an event that comes later than
    that is dropped, and counted by :func:`late_events`. Events without a commit time, which
    cannot be early or late, are left out.
    """
    at = F.timestamp_millis(F.col("basetime").cast("bigint"))
    timed = images.withColumn(EVENT_TIME, at).where(F.col(EVENT_TIME).isNotNull())
    known = [c for c in same if c in images.columns]
    if "Body" in images.columns:
        timed, known = timed.withColumn(DIGEST, F.md5("Body")), [*known, DIGEST]
    told = timed.withWatermark(EVENT_TIME, delay).dropDuplicatesWithinWatermark([EVENT_TIME, *known])
    return told.drop(EVENT_TIME, DIGEST)


def late_events(query: StreamingQuery) -> int:
    """How many events came too late since the query was started, as far as its recent
    progress reaches back (``spark.sql.streaming.numRecentProgressUpdates``)."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )
