import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tests.test_streaming import EVENTS, STAMP, _schema, event
from tidemill.streaming import decode, parsed, row_image, typed_changes, variant_changes


def bodies(spark, events):
    return spark.createDataFrame(list(enumerate(events)), "sequence long, Body string")


def test_same_rows_as_by_schema(spark):
    frame, schema = bodies(spark, EVENTS), _schema(spark)
    by_schema = typed_changes(row_image(decode(frame)), schema, "Person.Address")
    by_variant = variant_changes(parsed(frame), schema, "Person.Address")
    assert by_variant.columns == by_schema.columns
    assert rows(by_variant) == rows(by_schema)


def test_one_parse_for_any_number_of_targets(spark):
    events, schema = parsed(bodies(spark, EVENTS).repartition(2)), _schema(spark)
    plan = variant_changes(events, schema, "Person.Address")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("parse_json(") + plan.count("parseJson") == 1
    held = events.persist()
    try:
        held.count()
        both = [variant_changes(held, schema, t) for t in ("Person.Address", "Production.Culture")]
        plans = [b._jdf.queryExecution().executedPlan().toString() for b in both]
        assert all("InMemoryTableScan" in p for p in plans)
        assert both[0].count() == 10
    finally:
        held.unpersist()


def test_digits_and_unknown_fields_are_kept(spark):
    body = json.dumps({"op": "u", "after": {"Amount": 0, "a b": "x", "New": [1, {"y": None}]}, "source": {"schema": "S", "table": "T", "ts_ms": 7}})
    body = body.replace('"Amount": 0', '"Amount": 123456789012345.6789')
    schema = spark.createDataFrame([], "Amount decimal(19,4), `a b` string").schema
    (row,) = variant_changes(parsed(bodies(spark, [body])), schema, "S.T", rest="rest").collect()
    assert row.Amount == Decimal("123456789012345.6789") and row["a b"] == "x" and row.basetime == 7.0
    assert json.loads(row.rest) == {"New": [1, {"y": None}]}
    known = variant_changes(parsed(bodies(spark, [body])), spark.createDataFrame([], "Amount decimal(19,4), `a b` string, New string").schema, rest="rest")
    assert known.first().rest is None


def test_odd_bodies(spark):
    odd = [None, "", "no json {", "[1]", "3", json.dumps({"op": "c", "after": None}), json.dumps({"op": "d", "before": {"AddressID": "x"}}), event("d", (4, "gone"))]
    found = variant_changes(parsed(bodies(spark, odd)), _schema(spark))
    assert rows(found, "sequence", "op", "AddressID", "City") == [(5, "c", None, None), (6, "d", None, None), (7, "d", 4, "gone")]
    with pytest.raises(ValueError):
        variant_changes(parsed(bodies(spark, odd)), spark.createDataFrame([], '`a"b` int').schema)


def test_epoch_milliseconds(spark):
    body = event("c", (1, "x")).replace(f'"{STAMP}"', "1700000000123")
    found = variant_changes(parsed(bodies(spark, [body])), _schema(spark), "Person.Address", ["ModifiedDate"])
    assert found.select(F.col("ModifiedDate").cast("string")).first()[0] == "2023-11-14 22:13:20.123"
