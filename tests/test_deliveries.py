from tests.conftest import rows
from tests.test_streaming import event, publish, stream
from tidemill.sinks import archive_bodies
from tidemill.sources import EventSource, Positions, event_bodies
from tidemill.streaming import decode, first_deliveries, late_events, row_image

HOUR = 3_600_000


def told(spark, folder, delay="1 hour"):
    images = row_image(decode(stream(spark, folder / "log", files_per_batch=1)))
    query = (
        first_deliveries(images, delay).select("sequence", "op").writeStream.format("parquet")
        .option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start(str(folder / "told"))
    )
    query.awaitTermination()
    return query


def test_replays_are_dropped_across_batches_and_restarts(spark, tmp_path):
    first = [event("c", (1, "a"), at=0), event("c", (2, "b"), at=1000), None]
    publish(spark, tmp_path / "log", first)
    publish(spark, tmp_path / "log", first + [event("u", (2, "c"), at=2000)])
    told(spark, tmp_path)
    publish(spark, tmp_path / "log", first)  # the same offsets, after a restart
    publish(spark, tmp_path / "log", [event("c", (1, "a"), at=0)], first=9)  # another event
    query = told(spark, tmp_path)
    assert rows(spark.read.parquet(str(tmp_path / "told"))) == [(0, "c"), (1, "c"), (3, "u"), (9, "c")]
    assert late_events(query) == 0


def test_late_events_are_counted(spark, tmp_path):
    for k in range(4):
        publish(spark, tmp_path / "log", [event("c", (k, "x"), at=k * 3 * HOUR)], first=k)
    publish(spark, tmp_path / "log", [event("c", (50, "late"), at=1), event("c", (51, "in time"), at=9 * HOUR)], first=50)
    query = told(spark, tmp_path)
    assert [r[0] for r in rows(spark.read.parquet(str(tmp_path / "told")))] == [0, 1, 2, 3, 51]
    assert late_events(query) == 1


def test_positions_bound_a_stream(spark, tmp_path):
    def run(within):
        source = EventSource("parquet", str(tmp_path / "log"), {"maxFilesPerTrigger": "1"}, schema="offset long, body binary", within=within)
        bodies = event_bodies(source.stream(spark), sequence="offset")
        archive_bodies(bodies, str(tmp_path / "out"), str(tmp_path / "cp"), available_now=True).awaitTermination()
        return [r[0] for r in rows(spark.read.parquet(str(tmp_path / "out")), "sequence")]

    for k in range(3):
        publish(spark, tmp_path / "log", ["{}"] * 10, first=10 * k)
    assert run(Positions("offset", 5, 25)) == list(range(5, 25))
    publish(spark, tmp_path / "log", ["{}"] * 10, first=18)
    assert run(Positions("offset", 5, 25)) == sorted([*range(5, 25), *range(18, 25)])  # goes on from its checkpoint


def test_positions_reach_the_scan(spark, tmp_path):
    publish(spark, tmp_path / "log", ["{}"] * 10)
    frame = spark.read.parquet(str(tmp_path / "log"))
    plan = Positions("offset", end=3).of(frame)._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(offset,3)" in plan.replace("...", "")
    assert Positions("offset").of(frame).count() == 10


def test_events_are_written_in_order_in_as_many_files_for_each_part(spark, tmp_path):
    from tidemill.registry.changes import write_in_order

    events = spark.range(103).selectExpr("id % 7 as ts", "102 - id as event_id")
    log = str(tmp_path / "log")
    assert write_in_order(events, ["ts", "event_id"], 5, log, str(tmp_path / "cut"), file_rows=8) == 3
    files = sorted((p.stat().st_mtime_ns, str(p)) for p in (tmp_path / "log").glob("part-*"))
    assert len(files) == 15
    parts = [[tuple(r) for r in spark.read.parquet(*(f for _, f in files[k : k + 3])).collect()] for k in range(0, 15, 3)]
    assert [len(p) for p in parts] == [21, 21, 21, 20, 20]
    assert sum(map(sorted, parts), []) == sorted(tuple(r) for r in events.collect())
