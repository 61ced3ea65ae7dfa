import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan
from tidemill.operators import dimension, joins, require_unique
from tidemill.operators.joins import measured_size


@pytest.fixture
def no_auto_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_small_aggregate_is_broadcast_after_measuring(spark, no_auto_broadcast):
    facts = spark.range(1000).withColumn("k", F.col("id") % 5)
    side = facts.groupBy("k").agg(F.count("*").alias("n"))
    assert "BroadcastHashJoin" in executed_plan(facts.join(dimension(side), "k"))


def test_large_side_is_left_to_a_shuffled_join(spark, no_auto_broadcast):
    facts = spark.range(1000).withColumn("k", F.col("id") % 500)
    side = facts.groupBy("k").agg(F.count("*").alias("n"))
    plan = executed_plan(facts.join(dimension(side, max_rows=100), "k"))
    assert "BroadcastHashJoin" not in plan
    plan = executed_plan(facts.join(dimension(side, max_bytes=100), "k"))
    assert "BroadcastHashJoin" not in plan


def test_a_side_too_large_to_measure_is_left_alone(spark, no_auto_broadcast):
    side = spark.range(5).groupBy("id").agg(F.count("*").alias("n"))
    assert dimension(side, worth_measuring=1) is side
    assert dimension(side) is not side


def test_measuring(spark):
    frame = spark.createDataFrame([("abc", 1), (None, 22)], "s string, i int")
    assert measured_size(frame) == (2, 3 + 1 + 2 + 4 * 8)
    assert measured_size(spark.range(0)) == (0, 0)


def test_unique_key(spark):
    good = spark.createDataFrame([("a",), (None,), (None,)], "k string")
    assert require_unique(good, "k") is good
    with pytest.raises(ValueError, match="'b' has 2 rows"):
        require_unique(spark.createDataFrame([("b",), ("b",), ("c",)], "k string"), "k")


def test_small_files_of_many_rows_are_not_sent(spark, tmp_path):
    wide = [F.concat(F.lit("the same long text in every row "), (F.col("id") % 2).cast("string")).alias(f"c{i}") for i in range(9)]
    spark.range(400_000).select("id", *wide).write.parquet(str(tmp_path / "wide"))
    small = spark.read.parquet(str(tmp_path / "wide"))
    assert joins._estimated_bytes(small) <= joins._auto_broadcast_bytes(small)
    joined = spark.range(10).join(joins.dimension(small), "id", "left")
    assert "BroadcastHashJoin" not in executed_plan(joined)
    few = joins.dimension(small.where("id < 100"))
    assert "BroadcastHashJoin" in executed_plan(spark.range(10).join(few, "id", "left"))
