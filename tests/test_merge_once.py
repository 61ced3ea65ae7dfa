import random
import uuid

import pytest

from tests.conftest import executed_plan
from tests.test_changes import CASES, CHANGE, TARGET, applied, sorted_rows
from tidemill.operators.changes import merge_changes, merge_once, net_changes
from tidemill.sinks.files import overwrite_partitioned, save_bucketed


@pytest.mark.parametrize("ops", [{"c"}, {"c", "u"}])
def test_every_clause(spark, ops):
    before = [(k, f"old {k}") for k in (1, 2, 3, 4, 5, 6)] + [(None, "no key"), (None, "no key")]
    merged = merge_once(spark.createDataFrame(before, TARGET), spark.createDataFrame(CASES, CHANGE), "k", ops)
    assert merged.columns == ["k", "v"] and sorted_rows(merged) == applied(before, CASES, ops)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_net_changes_as_in_two_parts(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["c", "u", "d", "r", None]), float(rng.randint(0, 9)), i, rng.choice([1, 2, 3, 4, 5, 9, 10, None]), f"v{i}") for i in range(40)]
    target = spark.createDataFrame([(k, f"old {k}") for k in range(1, 7)] + [(None, "x")], TARGET)
    net = net_changes(spark.createDataFrame(rows, CHANGE), "k", {"c"})
    assert sorted_rows(merge_once(target, net, "k", {"c"})) == sorted_rows(merge_changes(target, net, "k", {"c"}))


def test_columns_by_name_and_types_of_the_target(spark):
    target = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k long, v string, kept int")
    changes = spark.createDataFrame([("u", "z", 1, 0), ("c", "n", 3, 0)], "op string, v string, k int, extra int")
    merged = merge_once(target, changes, "k")
    assert merged.columns == ["k", "v", "kept"] and merged.schema["k"].dataType.simpleString() == "bigint"
    assert {tuple(r) for r in merged.collect()} == {(1, "z", 5), (2, "b", 6), (3, "n", None)}


def test_a_bucketed_target_is_read_once_and_not_shuffled(spark):
    name = f"bucketed_{uuid.uuid4().hex}"
    save_bucketed(spark.createDataFrame([(k, f"old {k}") for k in range(50)] + [(None, "x")], TARGET), name, "k")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        merged = merge_once(spark.table(name), spark.createDataFrame(CASES, CHANGE), "k")
        plan = executed_plan(merged)
        assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") == 1 and "FullOuter" in plan
        changed = plan.index("Scan ExistingRDD")
        assert plan.index("FileScan parquet") < plan.index("Exchange") < changed  # the exchange is above the changes only
        expected = applied([(k, f"old {k}") for k in range(50)] + [(None, "x")], CASES, {"c"})
        assert sorted_rows(merged) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP TABLE {name}")


def test_partitions_of_a_catalog_table(spark, tmp_path):
    name = f"parts_{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(k, k % 4) for k in range(12)], "v int, p int")
    overwrite_partitioned(rows, str(tmp_path / "t"), ["p"], table=name)
    try:
        spark.sql(f"ALTER TABLE {name} ADD COLUMNS (note string)")
        fixed = spark.createDataFrame([("x", 1, 100), ("y", 7, 101)], "note string, p int, v int")
        overwrite_partitioned(fixed, str(tmp_path / "t"), ["p"], only_touched=True, table=name)
        overwrite_partitioned(spark.table(name).where("p = 2 and v > 2"), str(tmp_path / "t"), ["p"], only_touched=True, table=name)
        got = sorted((r.p, r.v, r.note) for r in spark.table(name).collect())
        assert got == [(0, 0, None), (0, 4, None), (0, 8, None), (1, 100, "x"), (2, 6, None), (2, 10, None), (3, 3, None), (3, 7, None), (3, 11, None), (7, 101, "y")]
        assert sorted(r.partition for r in spark.sql(f"SHOW PARTITIONS {name}").collect()) == ["p=0", "p=1", "p=2", "p=3", "p=7"]
        with pytest.raises(ValueError, match="note"):
            overwrite_partitioned(rows, str(tmp_path / "t"), ["p"], only_touched=True, table=name)
    finally:
        spark.sql(f"DROP TABLE {name}")
