import json
import shutil
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.sinks import archive_bodies
from tidemill.sources import EventSource, event_bodies
from tidemill.streaming import (
    Target,
    decode,
    row_image,
    stream_into_many,
    stream_into_one,
    stream_per_table,
    typed_changes,
    with_event_time,
)
from tidemill.tables import SnapshotTable

ADDRESS_SCHEMA = "AddressID int, City string, ModifiedDate timestamp"
STAMP = "2024-01-01 10:00:00"


def event(op, row, table="Address", at=0):
    image = None if row is None else {"AddressID": row[0], "City": row[1], "ModifiedDate": STAMP}
    if table == "Culture" and row is not None:
        image = {"CultureId": row[0], "Name": row[1]}
    deleted = op == "d"
    return json.dumps(
        {
            "before": image if deleted else None,
            "after": None if deleted else image,
            "op": op,
            "source": {
                "schema": "Person" if table == "Address" else "Production",
                "table": table,
                "ts_ms": 1700000000000 + at,
            },
        }
    )


EVENTS = [
    event("c", (10, "created")),
    event("u", (1, "updated"), at=1),
    event("u", (11, "unknown update"), at=2),
    event("d", (2, "gone"), at=3),
    event("d", (12, "unknown delete"), at=4),
    event("r", (3, "snapshot"), at=5),
    event("u", (1, "updated again"), at=6),
    event("c", (13, "short life"), at=7),
    event("d", (13, "short life"), at=8),
    None,
    "not json {",
    event("c", ("cs", "Czech"), "Culture", at=9),
    event("u", ("en", "English!"), "Culture", at=10),
    event("c", (None, "null key"), at=11),
]


@pytest.fixture
def workdir(spark, tmp_path):
    address = spark.createDataFrame([(i, f"old {i}") for i in range(1, 5)], "AddressID int, City string")
    address = address.withColumn("ModifiedDate", F.expr("timestamp '2023-01-01 00:00:00'"))
    SnapshotTable.create(address, str(tmp_path / "address"), "AddressID", buckets=2)
    culture = spark.createDataFrame([("en", "English"), ("fr", "French")], "CultureId string, Name string")
    SnapshotTable.create(culture, str(tmp_path / "culture"), "CultureId", buckets=2)
    return tmp_path


def targets(workdir):
    return [
        Target("Person.Address", str(workdir / "address"), "AddressID"),
        Target("Production.Culture", str(workdir / "culture"), "CultureId"),
    ]


def publish(spark, folder, events, first=0):
    """Write events as one file; later files carry later events."""
    data = [(first + i, None if e is None else bytearray(e, "utf-8")) for i, e in enumerate(events)]
    spark.createDataFrame(data, "offset long, body binary").coalesce(1).write.mode("append").parquet(
        str(folder)
    )


def stream(spark, folder, files_per_batch=None):
    options = {} if files_per_batch is None else {"maxFilesPerTrigger": str(files_per_batch)}
    source = EventSource("parquet", str(folder), options, schema="offset long, body binary")
    return event_bodies(source.stream(spark), sequence="offset")


def state(spark, path, *columns):
    return rows(SnapshotTable(spark, str(path)).read(), *columns)


def batch(spark, events):
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(events)], "sequence long, Body string")
    return row_image(decode(frame))


def test_decode(spark):
    got = {r.sequence: r for r in batch(spark, EVENTS).collect()}
    assert got[0].op == "c" and got[0].schemaname == "Person.Address"
    assert got[0].basetime == 1700000000000.0
    assert json.loads(got[0].data)["City"] == "created"
    assert json.loads(got[3].data)["City"] == "gone"
    for tombstone in (9, 10):
        assert (got[tombstone].op, got[tombstone].schemaname, got[tombstone].data) == (None,) * 3


def test_one_parse_per_event(spark):
    frame = spark.createDataFrame([(0, "{}")], "sequence long, Body string")
    changes = typed_changes(row_image(decode(frame.repartition(1))), _schema(spark), "Person.Address")
    plan = changes._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("json_tuple(") == 2 and plan.count("from_json(") == 1


def _schema(spark):
    return spark.createDataFrame([], ADDRESS_SCHEMA).schema


def test_typed_changes_drop_tombstones_but_keep_unparseable_images(spark):
    odd = event("u", (1, "x")).replace('"City": "x"', '"City": "x", "extra": 1')
    broken = json.dumps({"op": "c", "after": "no object", "source": {"schema": "Person", "table": "Address"}})
    changes = typed_changes(batch(spark, [odd, None, "junk", broken]), _schema(spark))
    assert rows(changes, "sequence", "op", "AddressID", "City") == [(0, "u", 1, "x"), (3, "c", None, None)]


def test_epoch_milliseconds(spark):
    body = event("c", (1, "x")).replace(f'"{STAMP}"', "1700000000123")
    changes = typed_changes(
        batch(spark, [body]), _schema(spark), "Person.Address", epoch_millis=["ModifiedDate"]
    )
    assert changes.select(F.col("ModifiedDate").cast("string")).first()[0] == "2023-11-14 22:13:20.123"
    assert changes.schema["ModifiedDate"].dataType.simpleString() == "timestamp"


def test_event_time_survives_bad_text(spark):
    frame = spark.createDataFrame([("2024-01-01 00:00:00",), ("soon",), (None,)], "ModifiedDate string")
    got = [r.modified_date_timestamp for r in with_event_time(frame).collect()]
    assert got == [datetime(2024, 1, 1), None, None]


def test_one_table(spark, workdir):
    publish(spark, workdir / "in", [e for e in EVENTS if e is None or "Culture" not in e])
    query = stream_into_one(
        stream(spark, workdir / "in"), targets(workdir)[0], str(workdir / "cp"), available_now=True
    )
    query.awaitTermination()
    assert state(spark, workdir / "address", "AddressID", "City") == [
        (None, "null key"), (1, "updated again"), (3, "snapshot"), (4, "old 4"), (10, "created"),
    ]


def test_many_tables_from_one_stream(spark, workdir):
    publish(spark, workdir / "in", EVENTS)
    stream_into_many(
        stream(spark, workdir / "in"), targets(workdir), str(workdir / "cp"), available_now=True
    ).awaitTermination()
    assert state(spark, workdir / "address", "AddressID", "City") == [
        (None, "null key"), (1, "updated again"), (3, "snapshot"), (4, "old 4"), (10, "created"),
        (11, "unknown update"),
    ]
    assert state(spark, workdir / "culture") == [("cs", "Czech"), ("en", "English!"), ("fr", "French")]


def test_op_first_lets_an_update_outrank_a_later_delete(spark, workdir):
    publish(spark, workdir / "in", [event("u", (1, "kept"), at=1), event("d", (1, "x"), at=2)])
    stream_into_many(
        stream(spark, workdir / "in"), targets(workdir), str(workdir / "cp"), op_first=True,
        available_now=True,
    ).awaitTermination()
    assert (1, "kept") in state(spark, workdir / "address", "AddressID", "City")


def test_batches_in_order_equal_one_batch(spark, workdir):
    for i, e in enumerate(EVENTS):
        publish(spark, workdir / "in", [e], first=i)
        time.sleep(0.01)
    query = stream_into_many(
        stream(spark, workdir / "in", files_per_batch=4), targets(workdir), str(workdir / "cp"),
        available_now=True,
    )
    query.awaitTermination()
    table = SnapshotTable(spark, str(workdir / "address"))
    assert list(table.applied.values()) == [3]
    # Key 13 lives and dies in different batches, key 11 is an upsert.
    assert rows(table.read(), "AddressID", "City") == [
        (None, "null key"), (1, "updated again"), (3, "snapshot"), (4, "old 4"), (10, "created"),
        (11, "unknown update"),
    ]


def test_restart_continues_from_the_checkpoint(spark, workdir):
    def run():
        streams = stream_per_table(
            lambda: stream(spark, workdir / "in"), targets(workdir), str(workdir / "cp"),
            available_now=True,
        )
        for query in streams:
            query.awaitTermination()

    publish(spark, workdir / "in", EVENTS[:4])
    run()
    before = SnapshotTable(spark, str(workdir / "address")).state
    run()
    assert SnapshotTable(spark, str(workdir / "address")).state == before
    publish(spark, workdir / "in", EVENTS[4:], first=4)
    run()
    assert state(spark, workdir / "address", "AddressID", "City") == [
        (None, "null key"), (1, "updated again"), (3, "snapshot"), (4, "old 4"), (10, "created"),
    ]
    assert state(spark, workdir / "culture") == [("cs", "Czech"), ("en", "English!"), ("fr", "French")]


def test_archive(spark, workdir):
    publish(spark, workdir / "in", EVENTS)
    archive_bodies(
        stream(spark, workdir / "in"), str(workdir / "raw"), str(workdir / "cp2"), available_now=True
    ).awaitTermination()
    stored = spark.read.parquet(str(workdir / "raw"))
    assert rows(stored, "sequence", "Body") == list(enumerate(EVENTS))


def test_a_fresh_checkpoint_at_an_old_path_is_another_stream(spark, workdir):
    def run():
        stream_into_one(
            stream(spark, workdir / "in"), targets(workdir)[0], str(workdir / "cp"), available_now=True
        ).awaitTermination()

    publish(spark, workdir / "in", [event("c", (70, "first"))])
    run()
    shutil.move(workdir / "cp", workdir / "old")
    publish(spark, workdir / "in", [event("c", (71, "second"))], first=1)
    run()
    assert {(70, "first"), (71, "second")} <= set(state(spark, workdir / "address", "AddressID", "City"))


def test_null_body_after_a_full_one(spark):
    frame = spark.createDataFrame([(0, event("c", (1, "x"))), (1, None)], "sequence long, Body string").coalesce(1)
    got = {r.sequence: r.op for r in decode(frame).collect()}
    assert got == {0: "c", 1: None}


def test_start_position_is_honoured(spark):
    """Positions are the connector's own options; here the time its first row stands for."""
    source = EventSource(
        "rate-micro-batch", options={"rowsPerBatch": "3"}, starting={"startTimestamp": "1700000000000"}
    )
    query = source.stream(spark).writeStream.format("memory").queryName("positions").start()
    try:
        deadline = time.time() + 60
        while not spark.table("positions").count() and time.time() < deadline:
            time.sleep(0.2)
    finally:
        query.stop()
    first = spark.sql("select min(unix_millis(timestamp)), min(value) from positions").first()
    assert tuple(first) == (1700000000000, 0)
