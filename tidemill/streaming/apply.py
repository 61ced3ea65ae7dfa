"""Change streams that keep snapshot tables up to date."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemill.operators.changes import (
    INSERT_CREATED,
    INSERT_CREATED_OR_UPDATED,
    latest_per_key,
    net_changes,
)
from tidemill.sinks.streams import start_batches
from tidemill.streaming.envelope import decode, row_image, typed_changes, with_event_time
from tidemill.tables.keyed import KeyedTable
from tidemill.tables.snapshot import SnapshotTable


@dataclass(frozen=True)
class Target:
    """A table that a change stream feeds: by ``path`` one that applies batches in the order
    they come, by ``table``, its name in the catalog, one that changes may reach in any
    order."""

    name: str  # schema.table, as the events call it
    path: str | None
    key: str
    epoch_millis: Collection[str] = field(default_factory=tuple)
    table: str | None = None

    def schema(self, spark: SparkSession) -> StructType:
        return KeyedTable(spark, self.table).schema if self.table else SnapshotTable(spark, self.path).schema


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """What identifies a stream: the id in its checkpoint, not the checkpoint's path. A
    new checkpoint at an old path is another stream, whose batches count from 0 again."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def apply_batch(
    changes: DataFrame,
    batch_id: int,
    target: Target,
    stream: str,
    insert_ops: Collection[str],
    op_first: bool = False,
) -> None:
    """Apply a batch's changes to ``target`` in order, once per batch.

    With ``op_first`` the one change of each key with the greatest operation is applied
    instead, and rows without a key count as one key; otherwise each is a row of its own.

    A target in the catalog takes changes by commit time and sequence, whatever batch they
    come in; a batch that comes again changes nothing.
    """
    if target.table:
        if op_first:
            raise ValueError("changes in any order are applied by time, not by operation")
        KeyedTable(changes.sparkSession, target.table).merge(changes, insert_ops)
        return
    table = SnapshotTable(changes.sparkSession, target.path)
    if op_first:
        changes = changes.drop("sequence")
        net = latest_per_key(changes, target.key, op_first=True)
    else:
        order = [c for c in ("basetime", "sequence") if c in changes.columns]
        net = net_changes(changes, target.key, insert_ops, order)
    table.merge(net, insert_ops, stream, batch_id)


def side_by_side(spark: SparkSession, tasks: Mapping[str, Callable[[], None]], workers: int) -> None:
    """Run named tasks, up to ``workers`` at a time, each with jobs in a scheduler pool of its
    name. The first failure cancels the jobs of the others, and is raised when all have
    ended; tasks that have not begun by then do not."""
    if workers <= 1 or len(tasks) <= 1:
        for task in tasks.values():
            task()
        return
    context, failed, run = spark.sparkContext, threading.Event(), uuid.uuid4().hex
    groups = {name: f"{name} {run}" for name in tasks}

    def one(name: str, task: Callable[[], None]) -> None:
        if failed.is_set():
            return
        context.setJobGroup(groups[name], name, interruptOnCancel=False)
        context.setLocalProperty("spark.scheduler.pool", name)
        try:
            task()
        except BaseException:
            failed.set()
            raise

    with ThreadPoolExecutor(min(workers, len(tasks))) as pool:
        started = {pool.submit(inheritable_thread_target(spark)(one), name, task): name for name, task in tasks.items()}
        done, rest = wait(started, return_when=FIRST_EXCEPTION)
        errors = [f.exception() for f in done if f.exception() is not None]
        if errors:
            for future in rest:
                future.cancel()
            while rest:  # a task may be between two jobs
                for future in rest:
                    context.cancelJobGroup(groups[started[future]])
                _, rest = wait(rest, timeout=0.2)
            raise errors[0]


def _images(bodies: DataFrame) -> DataFrame:
    return row_image(decode(bodies))


def stream_into_one(
    bodies: DataFrame,
    target: Target,
    checkpoint: str,
    modified: str | None = "ModifiedDate",
    insert_ops: Collection[str] = INSERT_CREATED,
    available_now: bool = False,
) -> StreamingQuery:
    """Apply a stream that carries a single table's changes."""
    schema = target.schema(bodies.sparkSession)
    changes = typed_changes(_images(bodies), schema, epoch_millis=target.epoch_millis)
    if modified is not None:
        changes = with_event_time(changes, modified)

    def apply(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, target, stream_id(batch.sparkSession, checkpoint), insert_ops)

    return start_batches(changes, apply, checkpoint, available_now)


def stream_into_many(
    bodies: DataFrame,
    targets: Sequence[Target],
    checkpoint: str,
    insert_ops: Collection[str] = INSERT_CREATED_OR_UPDATED,
    op_first: bool = False,
    available_now: bool = False,
    workers: int = 1,
) -> StreamingQuery:
    """Apply one stream that carries the changes of several tables.

    Each batch is cached once and split; a table already holding the batch, after a
    failure between two tables, skips it. Up to ``workers`` tables are written at a time; the
    first that fails cancels the others' jobs and fails the batch, which then comes again.
    """
    schemas = {t.name: t.schema(bodies.sparkSession) for t in targets}

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        stream = stream_id(batch.sparkSession, checkpoint)

        def into(t: Target) -> None:
            changes = typed_changes(batch, schemas[t.name], t.name, t.epoch_millis)
            apply_batch(changes, batch_id, t, stream, insert_ops, op_first)

        try:
            side_by_side(batch.sparkSession, {t.name: lambda t=t: into(t) for t in targets}, workers)
        finally:
            batch.unpersist()

    return start_batches(_images(bodies), apply, checkpoint, available_now)


def stream_per_table(
    bodies: Callable[[], DataFrame],
    targets: Sequence[Target],
    checkpoint_root: str,
    insert_ops: Collection[str] = INSERT_CREATED,
    available_now: bool = False,
) -> list[StreamingQuery]:
    """One independent stream, with its own read and checkpoint, for each table."""
    queries = []
    for target in targets:
        stream = bodies()
        schema = target.schema(stream.sparkSession)
        changes = typed_changes(_images(stream), schema, target.name, target.epoch_millis)
        checkpoint = f"{checkpoint_root}/{target.name}"

        def apply(
            batch: DataFrame, batch_id: int, target: Target = target, checkpoint: str = checkpoint
        ) -> None:
            stream = stream_id(batch.sparkSession, checkpoint)
            apply_batch(batch, batch_id, target, stream, insert_ops)

        queries.append(start_batches(changes, apply, checkpoint, available_now))
    return queries
