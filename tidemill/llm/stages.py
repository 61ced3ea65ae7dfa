"""Intermediate tables, and the Arrow batch settings that Python operators rely on."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import delete, workspace

# Text columns make wide rows: batches are cut by size as well as by count.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepared(spark: SparkSession) -> SparkSession:
    """``spark`` with batches small enough for text columns."""
    for name, value in ARROW_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def trim() -> None:
    """Memory that this Python process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    of_libc = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if of_libc is not None:  # glibc only
        of_libc(0)


def trim_driver(spark: SparkSession) -> None:
    """Memory outside of the heap that the driver's JVM has freed goes back to the system, and
    so does that of the driver's Python. What planning and compiling hundreds of jobs takes and
    frees there is kept by the C library otherwise, and counts as the driver's for good."""
    trim()
    jvm, made = spark._jvm, spark.sparkContext._gateway.new_array
    try:
        # by reflection: the server's class is not public, its interface is
        method = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        values = made(jvm.java.lang.Object, 4)
        values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        method.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # JDK 17.0.9 on Linux is the first that has it
        pass


def staged(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written to the shared folder and read back: cuts the lineage, and
    survives a lost executor. What the driver used for it is given back."""
    path = workspace(frame.sparkSession, name)
    frame.write.parquet(path)
    trim_driver(frame.sparkSession)
    read = frame.sparkSession.read.schema(frame.schema).parquet(path)
    read.staged_at = path
    return read


def unstage(*frames: DataFrame) -> None:
    """Delete the tables behind frames from :func:`staged` that nothing reads any more."""
    for frame in frames:
        delete(frame.sparkSession, frame.staged_at)


def columns_or_null(frame: DataFrame, wanted: Iterable[tuple[str, str]]) -> DataFrame:
    """Just the ``(column, type)`` pairs wanted, cast, with NULL for those missing."""
    return frame.select(
        *(
            (F.col(f"`{name}`") if name in frame.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in wanted
        )
    )


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for Arrow batches, giving freed memory back when a task ends: Python workers
    live on, and what one stage has used would count against the next."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task
