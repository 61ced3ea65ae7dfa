from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import executed_plan, rows
from tidemill import session, sinks, sources


def test_parquet_tables_skip_what_is_missing(spark, tmp_path, caplog):
    spark.range(2).write.parquet(str(tmp_path / "A"))
    spark.range(3).write.parquet(str(tmp_path / "B_part.parquet"))
    skipped = []
    assert set(sources.read_parquet_tables(spark, str(tmp_path), ["A", "Nope"], skipped=skipped)) == {"A"}
    assert skipped == ["Nope"] and "Nope" in caplog.text
    got = sources.read_parquet_tables(spark, str(tmp_path), ["B"], "_part.parquet")
    assert got["B"].count() == 3
    with pytest.raises(AnalysisException):
        sources.read_parquet_tables(spark, str(tmp_path), ["Nope"])


def test_csv_is_read_as_text(spark, tmp_path):
    (tmp_path / "people.v1.csv").write_text('1,"a,b",\n2,c,3.50\n')
    frame = sources.read_csv_strings(spark, str(tmp_path / "people.v1.csv"))
    assert frame.dtypes == [("_c0", "string"), ("_c1", "string"), ("_c2", "string")]
    assert rows(frame) == [("1", "a,b", None), ("2", "c", "3.50")]
    assert sources.table_name_of("/landing/people.v1.csv") == "people"


def test_catalog(spark, tmp_path):
    spark.range(2).withColumn("x", F.lit(1)).write.option("path", str(tmp_path / "c")).saveAsTable("cat")
    assert sources.project(spark, "cat", ["x"]).columns == ["x"]
    assert sources.schema_of(spark, "cat").fieldNames() == ["id", "x"]
    # Another writer adds a file behind the catalog's back.
    assert spark.table("cat").count() == 2
    spark.range(5).withColumn("x", F.lit(1)).write.mode("append").parquet(str(tmp_path / "c"))
    sources.refresh(spark, ["cat"])
    assert spark.table("cat").count() == 7


def test_event_source_passes_positions_to_the_connector(spark):
    source = sources.EventSource(
        "rate", options={"rowsPerSecond": "1"}, starting={"numPartitions": "2"}
    )
    assert source.stream(spark).isStreaming


def test_append_to_zones(spark, tmp_path):
    frame = spark.range(3)
    for keep in (False, True):
        sinks.append_to_zones(frame, [str(tmp_path / "l"), str(tmp_path / "b")], keep)
    assert spark.read.parquet(str(tmp_path / "l")).count() == 6
    assert spark.read.parquet(str(tmp_path / "b")).count() == 6
    assert not frame.is_cached


def test_audit_counts_rows(spark, tmp_path):
    first = sinks.append_managed(spark.range(3), "audited", str(tmp_path / "audited"))
    second = sinks.append_managed(spark.range(4), "audited")
    assert first == sinks.LoadAudit(3, 3) and second == sinks.LoadAudit(4, 7)


def test_managed_overwrite(spark, tmp_path):
    sinks.overwrite_managed(spark.range(3), "replaced", str(tmp_path / "r"))
    sinks.overwrite_managed(spark.range(1), "replaced", str(tmp_path / "r"))
    assert spark.table("replaced").count() == 1


def test_partitioned_overwrite(spark, tmp_path):
    path = str(tmp_path / "p")
    frame = spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int")
    sinks.overwrite_partitioned(frame, path, ["g"])
    new = spark.createDataFrame([("b", 3)], "g string, v int")
    sinks.overwrite_partitioned(new, path, ["g"], only_touched=True)
    assert rows(spark.read.parquet(path), "g", "v") == [("a", 1), ("b", 3)]
    sinks.overwrite_partitioned(new, path, ["g"])
    assert rows(spark.read.parquet(path), "g", "v") == [("b", 3)]
    assert "REBALANCE_PARTITIONS_BY_COL" in executed_plan(sinks.spread_by(frame, ["g"]))


def test_hot_partition_is_split_between_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        hot = spark.range(60000).selectExpr("if(id % 3 = 0, id, 0) as g", "uuid() as v").repartition(4)
        hot = hot.withColumn("g", F.when(F.col("g") == 0, 0).otherwise(1))
        sinks.overwrite_partitioned(hot, str(tmp_path / "h"), ["g"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    # A repartition by column would leave each value to one task, and one file.
    assert len(list(Path(tmp_path, "h", "g=0").glob("*.parquet"))) == 4
    assert spark.read.parquet(str(tmp_path / "h")).count() == 60000


def test_profile_csv(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1.5), ("b", None)], "column_names string, mean double")
    at = datetime(2024, 1, 31, 9, 5, 7)
    path = sinks.write_profile_csv(frame.repartition(4), str(tmp_path), "T", at, file_based=True)
    assert path.endswith("Profile Statistics/T/01-31-2024, 09:05:07 - File")
    files = list(Path(path).glob("part-*.csv"))
    assert len(files) == 1 and files[0].read_text().splitlines()[0] == "column_names,mean"


def test_shared_folder(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    one, two = session.workspace(spark, "x"), session.workspace(spark, "x")
    assert one != two and one.startswith(session.shared_folder(spark))
