from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan, rows
from tidemill.tables import SnapshotTable, describe_extended
from tidemill.tables.snapshot import COMPACT_AFTER

CHANGE = "op string, k long, v string"


@pytest.fixture
def table(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"v{i}") for i in range(20)] + [(None, "n")], "k long, v string")
    return SnapshotTable.create(frame, str(tmp_path / "t"), "k", buckets=4)


def test_create_read_and_schema(table):
    assert table.read().count() == 21
    assert table.schema.simpleString() == "struct<k:bigint,v:string>"


def test_insert_values_update_delete(spark, tmp_path):
    stamp = datetime(2024, 1, 1)
    base = spark.createDataFrame([(1, 1, "Shipping", stamp)], "CustomerId int, AddressId int, AddressType string, ModifiedDate timestamp")
    table = SnapshotTable.create(base, str(tmp_path / "t"), "CustomerId", buckets=3)
    table.insert_values(12345, 567, "Main Office", F.lit(stamp))
    assert table.read().count() == 2
    table.update(F.col("CustomerId") == 12345, {"AddressType": "Airport"})
    assert rows(table.read(), "CustomerId", "AddressType") == [(1, "Shipping"), (12345, "Airport")]
    table.delete(F.col("CustomerId") == 12345)
    assert rows(table.read(), "CustomerId") == [(1,)]
    with pytest.raises(ValueError, match="2 values for 4 columns"):
        table.insert_values(1, 2)


def test_unknown_condition_changes_nothing(table):
    before = rows(table.read())
    table.delete(F.col("k") > 100)
    table.delete(F.lit(None).cast("boolean"))
    assert rows(table.read()) == before and table.state.generation == 1
    table.delete(F.col("k") >= 0)
    assert rows(table.read()) == [(None, "n")]


def files(table):
    return {str(p) for p in Path(table.path).rglob("*.parquet")}


def test_an_update_rewrites_only_the_buckets_it_touches(table):
    before = dict(table.state.parts)
    table.update(F.col("k") == 3, {"v": "changed"})
    after = table.state.parts
    assert sum(before[b] != after[b] for b in before) == 1
    assert rows(table.read().where("k = 3")) == [(3, "changed")]


def test_keys_open_their_buckets_only(table):
    table.update(F.col("k") == 3, {"v": "changed"}, keys=[3])
    table.delete(F.col("k") == 4, keys=[4])
    got = dict(r for r in rows(table.read()) if r[0] is not None)
    assert got[3] == "changed" and 4 not in got and len(got) == 19
    assert len(table._buckets_of([3], table.state)) == 1


def test_looking_for_rows_reads_the_condition_only(spark, tmp_path):
    wide = spark.range(50).selectExpr("id as k", "id % 5 as flag", "uuid() as wide1", "uuid() as wide2")
    table = SnapshotTable.create(wide, str(tmp_path / "w"), "k", buckets=3)
    hit = table._base(table.state).where(F.col("flag") == 3).select("_bucket").distinct()
    schema = executed_plan(hit).split("ReadSchema: ")[1].split(">")[0]
    assert schema == "struct<flag:bigint"


def test_a_merge_writes_its_batch_only(table):
    before = files(table)
    table.merge(table.spark.createDataFrame([("u", 4, "merged")], CHANGE))
    new = files(table) - before
    assert new and before <= files(table)
    written = table.spark.read.parquet(*new)
    assert rows(written, "k", "v") == [(4, "merged")]
    assert rows(table.read().where("k = 4")) == [(4, "merged")]


def test_files_and_state_stay_bounded(spark, table):
    counts = []
    for n in range(2 * COMPACT_AFTER + 3):
        change = spark.createDataFrame([("u", n % 7, f"b{n}"), ("c", 100 + n, "new")], CHANGE).coalesce(1)
        table.merge(change, {"c"}, stream="s", batch_id=n)
        counts.append(len(files(table)))
    assert table.state.batches == 3 and table.applied == {"s": 2 * COMPACT_AFTER + 2}
    assert table.read().count() == 21 + 2 * COMPACT_AFTER + 3
    table.compact()
    table.compact()
    assert len(files(table)) <= 3 * table.state.buckets
    assert len(Path(table.path, "_table.json").read_text()) < 2000


def test_publish(spark, table):
    table.merge(spark.createDataFrame([("d", 1, None), ("c", 30, "new")], CHANGE), {"c"})
    table.publish("published_rows")
    assert rows(spark.table("published_rows")) == rows(table.read())
    table.delete(F.lit(True))
    table.publish("published_rows")
    assert spark.table("published_rows").columns == ["k", "v"] and spark.table("published_rows").count() == 0
    spark.sql("drop view published_rows")


@pytest.mark.parametrize("few", [1_000_000, 0])
@pytest.mark.parametrize("repeat", [False, True])
def test_merge(table, few, repeat):
    changes = table.spark.createDataFrame(
        [("d", 1, None), ("u", 2, "two"), ("c", 50, "fifty"), ("u", 51, "no"), ("c", None, "m")], CHANGE
    )
    # An integer key has another hash than the table's bigint key.
    changes = changes.withColumn("k", F.col("k").cast("int"))
    table.merge(changes, {"c"}, few_rows=few, keys_repeat=repeat)
    got = dict(r for r in rows(table.read()) if r[0] is not None)
    assert 1 not in got and got[2] == "two" and got[50] == "fifty" and 51 not in got
    assert len(got) == 20
    assert rows(table.read().where("k is null")) == [(None, "m"), (None, "n")]


def test_replayed_batch_is_skipped(table):
    change = table.spark.createDataFrame([("c", 99, "once")], CHANGE)
    table.merge(change, {"c"}, stream="s", batch_id=0)
    table.delete(F.col("k") == 99)
    table.merge(change, {"c"}, stream="s", batch_id=0)
    assert table.read().where("k = 99").count() == 0
    table.merge(change, {"c"}, stream="other", batch_id=0)
    assert table.read().where("k = 99").count() == 1
    assert table.applied == {"s": 0, "other": 0}


def test_empty_batch_is_recorded(table):
    table.merge(table.spark.createDataFrame([], CHANGE), {"c"}, stream="s", batch_id=4)
    assert table.applied == {"s": 4} and table.read().count() == 21


def test_replace_and_empty(spark, table):
    SnapshotTable.create(table.read().where("k < 2"), table.path, "k", buckets=2)
    assert rows(table.read()) == [(0, "v0"), (1, "v1")]
    SnapshotTable.create(table.read().where("k > 100"), table.path, "k", buckets=2)
    assert rows(table.read()) == [] and table.read().columns == ["k", "v"]
    table.insert_values(1, "again")
    assert rows(table.read()) == [(1, "again")]


def test_missing_table(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "none"))
    assert not table.exists()
    with pytest.raises(FileNotFoundError):
        table.read()


def test_describe(spark, tmp_path):
    spark.range(3).write.option("path", str(tmp_path / "d")).saveAsTable("described")
    facts = {r.col_name: r.data_type for r in describe_extended(spark, "described").collect()}
    assert facts["id"] == "bigint" and "Location" in facts
    spark.sql("drop table described")
