from datetime import datetime
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.config import FillValues, LoadConfig
from tidemill.plans import synth
from tidemill.plans.alerts import connector_alerts
from tidemill.plans.loads import (
    clean,
    full_load,
    incremental_load,
    land_increment,
    load_csv,
    profile_tables,
    size_check,
)


@pytest.fixture
def config(spark, tmp_path):
    folder = str(tmp_path / "bronze")
    synth.generate_and_land(
        spark, folder, {"Address": 20, "Product": 30, "CustomerAddress": 10, "SalesOrderDetail": 10}
    )
    return LoadConfig(
        tables=["Address", "Product", "CustomerAddress", "SalesOrderDetail", "Missing"],
        source_dir=folder,
        sink_dir=str(tmp_path / "silver"),
        file_based_dir=folder,
        fill_columns={"Address": ["City"]},
        drop_columns={"Address": ["rowguid"], "Product": ["ThumbNailPhoto"]},
        fill_values=FillValues("n/a", "1900-01-01 00:00:00", False, 0),
    )


def test_full_load(spark, config):
    with pytest.raises(AnalysisException, match="Missing"):
        full_load(spark, config)
    skipped = []
    silver = full_load(spark, config, skipped=skipped)
    assert skipped == ["Missing"]
    assert set(silver) == {"Address", "Product", "CustomerAddress", "SalesOrderDetail"}
    assert {"AddressL1", "AddressL2"} <= set(silver["Address"].columns)
    assert "rowguid" not in silver["Address"].columns
    assert silver["SalesOrderDetail"].schema["SalesOrderID"].dataType.simpleString() == "bigint"
    assert silver["Product"].count() == 30 and "ThumbNailPhoto" not in silver["Product"].columns


def test_edits_go_through_the_managed_table(spark, config, tmp_path):
    def edit(table):
        table.insert_values(
            12345, 567, "Main Office", "g", F.expr("timestamp '2024-01-01 00:00:00'")
        )
        table.update(F.col("CustomerId") == 12345, {"AddressType": "Airport"})
        table.delete(F.col("CustomerId") == 1000)

    silver = full_load(
        spark, config, managed_dir=str(tmp_path / "managed"), edits={"CustomerAddress": edit}, skipped=[]
    )["CustomerAddress"]
    assert silver.count() == 10
    assert rows(silver.where("AddressType = 'Airport'"), "CustomerId") == [(12345,)]
    assert (tmp_path / "managed" / "CustomerAddressTable").exists()
    with pytest.raises(ValueError, match="managed"):
        full_load(spark, config, edits={"CustomerAddress": edit})


def test_increments_have_the_schema_of_the_full_load(spark, config, tmp_path):
    before = full_load(spark, config, skipped=[])
    increments = str(tmp_path / "incremental")
    for table, count in (("Address", 5), ("Product", 7)):
        synth.generate(spark, table, count, seed=1).write.parquet(f"{increments}/{table}_part.parquet")
    after = incremental_load(spark, config, increments, skipped=[])
    assert after["Address"].schema == before["Address"].schema
    assert (after["Address"].count(), after["Product"].count()) == (25, 37)
    assert after["CustomerAddress"].count() == 10
    assert after["Address"].where("AddressL1 is null").count() == 0


def test_increment_reaches_both_zones(spark, config, tmp_path):
    synth.generate(spark, "Address", 5).write.parquet(str(tmp_path / "i" / "Address_part.parquet"))
    for _ in range(2):
        land_increment(
            spark, config, str(tmp_path / "i"), str(tmp_path / "landing"), str(tmp_path / "bz"), skipped=[]
        )
    for zone in ("landing", "bz"):
        assert spark.read.parquet(str(tmp_path / zone / "Address")).count() == 10


def test_cleaning_fills_before_it_recodes(spark, config):
    frame = spark.createDataFrame([("39", None), (None, "x"), ("M", "y")], "Size string, Color string")
    config = LoadConfig(["Product"], "/a", "/b", fill_columns={"Product": ["Size", "Color"]},
                        fill_values=FillValues("45", "1900-01-01", False, 0))
    assert rows(clean("Product", frame, config)) == [("M", "x"), ("M", "y"), ("S", "45")]
    assert rows(size_check(frame), "Value") == [(False,), (False,), (True,)]


def test_profiles_are_written_per_table(spark, config, tmp_path):
    silver = full_load(spark, config, file_based=True, skipped=[])
    paths = profile_tables(silver, str(tmp_path), datetime(2024, 1, 1), file_based=True)
    assert set(paths) == set(silver)
    stored = spark.read.csv(paths["Product"], header=True)
    assert stored.count() == len(silver["Product"].columns)
    assert Path(paths["Product"]).name == "01-01-2024, 00:00:00 - File"


def test_csv_load(spark, tmp_path):
    (tmp_path / "visits.csv").write_text("1,a\n2,b\n")
    audit = load_csv(spark, str(tmp_path), "visits.csv", path=str(tmp_path / "visits_table"))
    assert (audit.inserted, audit.total) == (2, 2)
    assert rows(spark.table("visits")) == [("1", "a"), ("2", "b")]


def test_alerts(spark):
    statuses = [
        '{"error_code": 404, "message": "no"}',
        '{"name": "a", "tasks": [{"id": 0, "state": "FAILED"}]}',
        '{"name": "b", "tasks": [{"id": 0, "state": "RUNNING"}, {"id": 1, "state": "FAILED"}]}',
        '{"name": "c", "tasks": []}',
        "junk",
        None,
    ]
    frame = spark.createDataFrame([(s,) for s in statuses], "status string")
    assert {r.status for r in connector_alerts(frame).collect()} == set(statuses[:2])
