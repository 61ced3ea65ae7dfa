"""Tables that take inserts, updates, deletes and merges, kept as parquet.

Parquet datasets in open Spark cannot change rows, so a table is a set of hash buckets and
the batches of changes merged since these were written:

    <path>/base/gen=<g>/_bucket=<b>/part-….parquet
    <path>/changes/gen=<g>/batch=<n>/part-….parquet
    <path>/_table.json

A merge writes its net changes and nothing else. Reading folds the batches per key and
applies them to the buckets; every so many batches they are folded into new buckets, and
what is no longer read is deleted. Updates and deletes rewrite the buckets that hold a row
they change. The small file says which generation of each bucket counts and up to which
batch; it is replaced last, so readers never see half a change. A table has one writer.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from tidemill.operators.changes import (
    DELETED,
    INSERT_CREATED,
    INSERTS,
    folded,
    merge_parts,
)
from tidemill.operators.joins import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, measured_size
from tidemill.sinks.files import spread_by

BUCKET, GENERATION, BATCH = "_bucket", "gen", "batch"
COMPACT_AFTER = 32


@dataclass(frozen=True)
class State:
    """What of the files under a table's path counts."""

    schema: str
    key: str
    buckets: int
    generation: int = 0  # the newest
    parts: Mapping[int, int] = field(default_factory=dict)  # bucket -> its generation
    since: int = 0  # the generation that the batches of changes are based on
    batches: int = 0
    applied: Mapping[str, int] = field(default_factory=dict)  # stream -> last batch

    def to_json(self) -> str:
        return json.dumps(vars(self) | {"parts": {str(b): g for b, g in self.parts.items()}})

    @classmethod
    def from_json(cls, text: str) -> State:
        raw = json.loads(text)
        return cls(**raw | {"parts": {int(b): g for b, g in raw["parts"].items()}})

    @property
    def struct(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))


class SnapshotTable:
    """A hash-bucketed parquet table identified by its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # -- state --------------------------------------------------------------------

    def _hadoop(self, relative: str) -> tuple[Any, Any]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{relative}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        fs, path = self._hadoop("_table.json")
        return fs.exists(path)

    @property
    def state(self) -> State:
        fs, path = self._hadoop("_table.json")
        if not fs.exists(path):
            raise FileNotFoundError(f"no table at {self.path}")
        stream = fs.open(path)
        try:
            return State.from_json(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, state: State) -> State:
        fs, draft = self._hadoop(f".{uuid.uuid4().hex}.json")
        _, path = self._hadoop("_table.json")
        stream = fs.create(draft)
        try:
            stream.write(bytearray(state.to_json(), "utf-8"))
        finally:
            stream.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        files.rename(draft, path, options)
        return state

    # -- reading ------------------------------------------------------------------

    @property
    def schema(self) -> StructType:
        return self.state.struct

    @property
    def applied(self) -> Mapping[str, int]:
        """The last batch that was merged from each stream."""
        return self.state.applied

    def read(self) -> DataFrame:
        """The table's rows."""
        state = self.state
        rows = self._base(state).drop(BUCKET)
        changes = self._changes(state)
        if changes is None:
            return rows
        kept, new = merge_parts(rows, changes, state.key)
        return kept.unionByName(new)

    def _base(self, state: State, buckets: Collection[int] | None = None) -> DataFrame:
        """The rows of the buckets as they were last written, with their bucket, which is
        known from the directory: a filter on it opens no other file."""
        by_generation: dict[int, list[int]] = {}
        for bucket, generation in state.parts.items():
            if buckets is None or bucket in buckets:
                by_generation.setdefault(generation, []).append(bucket)
        wanted = F.lit(False)
        for generation, own in by_generation.items():
            wanted |= (F.col(GENERATION) == generation) & F.col(BUCKET).isin(own)
        layout = StructType([*state.struct.fields, StructField(GENERATION, IntegerType()), StructField(BUCKET, IntegerType())])
        return self.spark.read.schema(layout).parquet(f"{self.path}/base").where(wanted).drop(GENERATION)

    def _changes(self, state: State) -> DataFrame | None:
        """The net changes since the buckets were written, if there are any."""
        if not state.batches:
            return None
        marks = [StructField(DELETED, BooleanType()), StructField(INSERTS, BooleanType()), StructField(BATCH, IntegerType())]
        rows = self.spark.read.schema(StructType([*state.struct.fields, *marks]))
        rows = rows.parquet(f"{self.path}/changes/{GENERATION}={state.since}").where(F.col(BATCH) <= state.batches)
        return folded(rows, state.key, BATCH)

    # -- writing ------------------------------------------------------------------

    @staticmethod
    def _bucket(frame: DataFrame, key: str, buckets: int) -> Column:
        """Bucket of a row. Rows without a key match nothing, so they are scattered."""
        rest = F.xxhash64(*[F.col(c) for c in frame.columns])
        return F.pmod(
            F.when(F.col(key).isNull(), rest).otherwise(F.xxhash64(F.col(key))), F.lit(buckets)
        ).cast("int")

    def _write(self, rows: DataFrame, parts: Mapping[int, int]) -> None:
        """Add rows that know their bucket to the generation of each bucket."""
        generation = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col(BUCKET)]
        rows.withColumn(GENERATION, generation).write.mode("append").partitionBy(GENERATION, BUCKET).parquet(f"{self.path}/base")

    def _spread(self, rows: DataFrame, state: State) -> DataFrame:
        return spread_by(rows.withColumn(BUCKET, self._bucket(rows, state.key, state.buckets)), [BUCKET])

    @classmethod
    def create(
        cls, frame: DataFrame, path: str, key: str, buckets: int | None = None
    ) -> SnapshotTable:
        """Write ``frame`` as the rows of the table at ``path``, replacing those it has.

        ``buckets`` defaults to the session's shuffle width, which is already sized
        to the cluster. More buckets make a small change rewrite less.
        """
        table = cls(frame.sparkSession, path)
        count = buckets or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        old = table.state if table.exists() else None
        generation = old.generation + 1 if old else 1
        parts = dict.fromkeys(range(count), generation)
        state = State(frame.schema.json(), key, count, generation, parts, since=generation)
        table._write(table._spread(frame, state), parts)
        table._commit(state)
        table._tidy(old)
        return table

    def insert(self, rows: DataFrame) -> None:
        """Add rows, matched to the table's columns by name. Nothing is rewritten."""
        state = self._settled()
        typed = rows.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in state.struct])
        self._write(self._spread(typed, state), state.parts)

    def insert_values(self, *values: Any) -> None:
        """Add one row given in column order; a value may be a Column."""
        names = self.schema.fieldNames()
        if len(values) != len(names):
            raise ValueError(f"{len(values)} values for {len(names)} columns")
        columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
        row = self.spark.range(1).select([c.alias(n) for n, c in zip(names, columns)])
        self.insert(row)

    def update(self, condition: Column, values: Mapping[str, Any], keys: Sequence[Any] | None = None) -> None:
        """Set columns where ``condition`` holds. ``keys``, if the condition implies them,
        say which buckets to open."""
        self._rewrite(condition, lambda rows: updated(rows, condition, values), keys)

    def delete(self, condition: Column, keys: Sequence[Any] | None = None) -> None:
        """Remove the rows where ``condition`` holds. ``keys`` as for :meth:`update`."""
        self._rewrite(condition, lambda rows: without(rows, condition), keys)

    def _rewrite(self, condition: Column, change: Callable[[DataFrame], DataFrame], keys: Sequence[Any] | None) -> None:
        state = self._settled()
        opened = None if keys is None else self._buckets_of(keys, state)
        hit = self._base(state, opened).where(condition)
        touched = {row[0] for row in hit.select(BUCKET).distinct().collect()}
        if touched:
            self._replace(change(self._base(state, touched)), touched, state)

    def _replace(self, rows: DataFrame, touched: Collection[int], state: State) -> None:
        """Write the buckets ``touched`` anew; rows from a few buckets each need no shuffle."""
        generation = state.generation + 1
        parts = dict(state.parts) | dict.fromkeys(touched, generation)
        self._write(rows, parts)
        self._commit(replace(state, generation=generation, parts=parts))

    def _buckets_of(self, keys: Sequence[Any], state: State) -> set[int]:
        kind = state.struct[state.key].dataType
        values = self.spark.createDataFrame([(k,) for k in keys], StructType([StructField(state.key, kind)]))
        return {r[0] for r in values.select(self._bucket(values, state.key, state.buckets)).collect()}

    def merge(
        self,
        changes: DataFrame,
        insert_ops: Collection[str] = INSERT_CREATED,
        stream: str | None = None,
        batch_id: int | None = None,
        keys_repeat: bool = False,
        few_rows: int = MAX_BROADCAST_ROWS,
        few_bytes: int = MAX_BROADCAST_BYTES,
    ) -> None:
        """Apply change rows by key. See ``merge_parts`` for what each ``op`` does.

        A batch already recorded for ``stream`` is skipped, so a replay is harmless.
        Only the changes are written, unless they lack some of the table's columns, or
        may repeat a key: then they are applied at once, and measured first, which says
        whether they are few enough to send to the table instead of shuffling it.
        """
        state = self.state
        if stream is not None and state.applied.get(stream, -1) >= batch_id:
            return
        applied = dict(state.applied) if stream is None else {**state.applied, stream: batch_id}
        changes = self._typed(changes, state.struct)
        if keys_repeat or not set(state.struct.names) <= set(changes.columns):
            rows, size = measured_size(changes)
            few = rows <= few_rows and size <= few_bytes
            kept, new = merge_parts(self.read(), changes, state.key, insert_ops, keys_repeat, few)
            self._compacted(kept.unionByName(new), replace(state, applied=applied))
            return
        if DELETED not in changes.columns:
            op = F.coalesce("op", F.lit(""))
            changes = changes.withColumns({DELETED: op == "d", INSERTS: op.isin(*insert_ops)})
        number = state.batches + 1
        path = f"{self.path}/changes/{GENERATION}={state.since}/{BATCH}={number}"
        changes.select(*state.struct.names, DELETED, INSERTS).write.mode("overwrite").parquet(path)
        self._commit(replace(state, batches=number, applied=applied))
        if number >= COMPACT_AFTER:
            self.compact()

    @staticmethod
    def _typed(changes: DataFrame, schema: StructType) -> DataFrame:
        """Changes with the target's own types, so that equal keys hash alike."""
        given = set(changes.columns)
        return changes.withColumns(
            {f.name: F.col(f.name).cast(f.dataType) for f in schema if f.name in given}
        )

    # -- upkeep -------------------------------------------------------------------

    def compact(self) -> None:
        """Fold all batches into new buckets, and delete what is no longer read.

        What was read until now stays until the next time, for readers at work.
        """
        self._compacted(self.read(), self.state)

    def _compacted(self, rows: DataFrame, old: State) -> None:
        generation = old.generation + 1
        parts = dict.fromkeys(range(old.buckets), generation)
        self._write(self._spread(rows, old), parts)
        self._commit(replace(old, generation=generation, parts=parts, since=generation, batches=0))
        self._tidy(old)

    def _settled(self) -> State:
        """The state without batches to fold."""
        if self.state.batches:
            self.compact()
        return self.state

    def _tidy(self, old: State | None) -> None:
        """Delete directories that neither ``old`` nor the present state reads."""
        now = self.state
        states = [now] if old is None else [now, old]
        live = {f"{GENERATION}={g}/{BUCKET}={b}" for s in states for b, g in s.parts.items()}
        fs, base = self._hadoop("base")
        for generation in fs.listStatus(base):
            if generation.isDirectory():
                name = generation.getPath().getName()
                inside = [f for f in fs.listStatus(generation.getPath()) if f.isDirectory()]
                dead = [f.getPath() for f in inside if f"{name}/{f.getPath().getName()}" not in live]
                for path in [generation.getPath()] if len(dead) == len(inside) else dead:
                    fs.delete(path, True)
        fs, changes = self._hadoop("changes")
        kept = {f"{GENERATION}={s.since}" for s in states}
        for folder in fs.listStatus(changes) if fs.exists(changes) else ():
            if folder.getPath().getName() not in kept:
                fs.delete(folder.getPath(), True)

    def publish(self, name: str) -> None:
        """Make the rows readable as ``name`` in the catalog, as they are now."""
        state = self._settled()
        if len(set(state.parts.values())) > 1:
            self.compact()
            state = self.state
        columns = ", ".join(f"`{c}`" for c in state.struct.names)
        generation = next(iter(state.parts.values()))
        fs, folder = self._hadoop(f"base/{GENERATION}={generation}")
        nothing = ", ".join(f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in state.struct)
        rows = f"select {columns} from parquet.`{self.path}/base/{GENERATION}={generation}`" if fs.exists(folder) else f"select {nothing} where false"
        self.spark.sql(f"create or replace view {name} as {rows}")


def updated(rows: DataFrame, condition: Column, values: Mapping[str, Any]) -> DataFrame:
    """``rows`` with columns set where ``condition`` is true."""
    hit = F.coalesce(condition, F.lit(False))
    changes = {}
    for name, value in values.items():
        new = value if isinstance(value, Column) else F.lit(value)
        kind = rows.schema[name].dataType
        changes[name] = F.when(hit, new.cast(kind)).otherwise(F.col(name))
    return rows.withColumns(changes)


def without(rows: DataFrame, condition: Column) -> DataFrame:
    """``rows`` except those where ``condition`` is true; unknown is not true."""
    return rows.where(~F.coalesce(condition, F.lit(False)))


def describe_extended(spark: SparkSession, table: str) -> DataFrame:
    """Columns and storage facts of a catalog table."""
    return spark.sql(f"describe extended {table}")
