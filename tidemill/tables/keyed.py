"""Catalog tables that change streams keep up to date, whatever order changes come in.

A table is an ordinary partitioned parquet table in the catalog. A row's partition is a hash
of its key; next to its columns it keeps the marks of :mod:`tidemill.operators.marks`. A merge
reads the partitions its changes fall into, combines them with the changes in one shuffle by
partition, and overwrites these partitions. As marks only grow, a batch that is repeated, after
a failure in the middle of one too, leaves what it left the first time.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.operators.changes import INSERT_CREATED, SLOT
from tidemill.operators.marks import DELETED, LONE, MARK_TYPES, MARKS, combined, is_there, summary, unchanged

KEY_PROPERTY, SLOTS_PROPERTY = "tidemill.key", "tidemill.slots"


class KeyedTable:
    """A table of the catalog, by name."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        facts = {r[0]: r[1] for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
        self.key, self.slots = facts[KEY_PROPERTY], int(facts[SLOTS_PROPERTY])

    @classmethod
    def create(cls, rows: DataFrame, name: str, key: str, slots: int | None = None, path: str | None = None) -> KeyedTable:
        """A table of ``rows``, which must not repeat a key; rows without one are kept as they
        are. ``slots``, the number of partitions, is the session's shuffle width if not given."""
        spark = rows.sparkSession
        slots = slots or int(spark.conf.get("spark.sql.shuffle.partitions"))
        clash = {*MARKS, SLOT} & set(rows.columns)
        if clash:
            raise ValueError(f"columns {sorted(clash)} are the table's own")
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema]
        marks = [f"{c} {MARK_TYPES[c]}" for c in MARKS]
        location = f" LOCATION '{path}'" if path else ""
        spark.sql(
            f"CREATE TABLE {name} ({', '.join([*columns, *marks, f'{SLOT} int'])}) USING parquet "
            f"OPTIONS ('partitionOverwriteMode' = 'dynamic') PARTITIONED BY ({SLOT}){location} "
            f"TBLPROPERTIES ('{KEY_PROPERTY}' = '{key}', '{SLOTS_PROPERTY}' = '{slots}')"
        )
        table = cls(spark, name)
        table._write(table._slotted(unchanged(rows, key)).repartition(SLOT))
        return table

    @property
    def schema(self) -> StructType:
        return StructType([f for f in self.spark.table(self.name).schema if f.name not in (*MARKS, SLOT)])

    def read(self) -> DataFrame:
        """The rows that are there."""
        return self.spark.table(self.name).where(is_there()).select(*(f"`{c}`" for c in self.schema.names))

    def _slot(self) -> Column:
        whole = F.when(F.col(f"`{self.key}`").isNull(), F.xxhash64(LONE)).otherwise(F.xxhash64(f"`{self.key}`"))
        return F.pmod(whole, F.lit(self.slots)).cast("int")

    def _slotted(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(SLOT, self._slot())

    def _write(self, rows: DataFrame) -> None:
        """Replace the partitions that the rows fall into; the table's own option says so, so
        that writers of other tables may run beside this one."""
        columns = self.spark.table(self.name).columns
        rows.select(*(f"`{c}`" for c in columns)).write.mode("overwrite").insertInto(self.name)

    def merged(self, changes: DataFrame, touched: Collection[int]) -> DataFrame:
        """The touched partitions with the slotted summary of a batch in them. Rows are
        shuffled once, by partition, which the combination and the write both keep to."""
        old = self.spark.table(self.name).where(F.col(SLOT).isin(*touched))
        return combined(old.unionByName(changes).repartition(SLOT), self.key, by=[SLOT])

    def merge(self, changes: DataFrame, insert_ops: Collection[str] = INSERT_CREATED) -> None:
        """Apply change rows (the table's columns with ``op``, ``basetime`` and, if there is one,
        ``sequence``): a row is there in the end if, in commit order, it was at first or
        something inserts it, and nothing deletes it after that; its values are those of its
        last change."""
        schema = self.schema
        lacking = [c for c in (*schema.names, "op", "basetime") if c not in changes.columns]
        if lacking:
            raise ValueError(f"changes lack {lacking}")
        typed = changes.withColumns({f.name: F.col(f"`{f.name}`").cast(f.dataType) for f in schema})
        batch = self._slotted(summary(typed, self.key, schema.names, insert_ops)).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            touched = [r[0] for r in batch.select(SLOT).distinct().collect()]  # as many as slots at most
            if touched:
                self._write(self.merged(batch, touched))
        finally:
            batch.unpersist()

    def forget(self, before_basetime: float) -> None:
        """Drop what is left of rows deleted before a commit time, once no older change can
        come. An older insert that does come would bring its row back."""
        gone = ~is_there() & (F.col(f"{DELETED}.basetime") < before_basetime)
        rows = self.spark.table(self.name)
        of_slot = rows.groupBy(SLOT).agg(F.count_if(gone).alias("gone"), F.count(F.lit(1)).alias("n")).where("gone > 0").collect()
        touched = [r[SLOT] for r in of_slot if r["gone"] < r["n"]]
        if touched:
            self._write(rows.where(F.col(SLOT).isin(*touched) & ~gone).repartition(SLOT))
        for r in of_slot:
            if r["gone"] == r["n"]:
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION ({SLOT} = {r[SLOT]})")
