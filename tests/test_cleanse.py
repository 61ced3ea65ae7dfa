from datetime import datetime
from decimal import Decimal

import pytest

from tests.conftest import rows
from tidemill.config import FillValues
from tidemill.operators import (
    cast_columns,
    column_types,
    drop_columns,
    fill_nulls,
    rename_columns,
    tagged,
    union_all_by_name,
)

FILLS = FillValues("n/a", "1900-01-01 00:00:00", True, -1)
SCHEMA = "s string, t timestamp, b boolean, i int, l long, d double, m decimal(19,4), x string"


def test_every_kind_takes_its_own_value(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    frame = spark.createDataFrame([(None,) * 8], SCHEMA)
    got = fill_nulls(frame, ["s", "t", "b", "i", "l", "d", "m"], FILLS)
    assert got.schema == frame.schema or column_types(got) == column_types(frame)
    assert tuple(got.first()) == (
        "n/a", datetime(1900, 1, 1), True, -1, -1, -1.0, Decimal("-1.0000"), None
    )


def test_timestamp_without_zone_is_a_timestamp(spark):
    frame = spark.createDataFrame([(None,)], "t timestamp_ntz")
    assert fill_nulls(frame, ["t"], FILLS).first().t == datetime(1900, 1, 1)


@pytest.mark.parametrize("kind", ["binary", "date", "array<int>"])
def test_kinds_without_a_value_are_rejected(spark, kind):
    frame = spark.createDataFrame([], f"c {kind}")
    with pytest.raises(ValueError, match="fill values"):
        fill_nulls(frame, ["c"], FILLS)


def test_unknown_column_is_rejected(spark):
    with pytest.raises(ValueError, match="nope"):
        fill_nulls(spark.range(1), ["nope"], FILLS)


def test_drop_and_rename_ignore_missing_names(spark):
    frame = spark.createDataFrame([(1, 2)], "a int, b int")
    got = rename_columns(drop_columns(frame, ["b", "zzz"]), {"a": "A1", "yyy": "Y"})
    assert got.columns == ["A1"]


def test_cast(spark):
    frame = spark.createDataFrame([(7,)], "SalesOrderID int")
    assert column_types(cast_columns(frame, {"SalesOrderID": "bigint"})) == {"SalesOrderID": "bigint"}


def test_union_by_name_pads_with_null_and_tags(spark):
    a = spark.createDataFrame([(1, "x")], "i int, s string")
    b = spark.createDataFrame([(2.0, 3)], "d double, i int")
    assert rows(union_all_by_name([a, b]), "i", "s", "d") == [(1, "x", None), (3, None, 2.0)]
    assert rows(tagged({"one": a, "two": b}, "source"), "i", "source") == [(1, "one"), (3, "two")]
