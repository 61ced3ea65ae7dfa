import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import profile
from tidemill.operators.profile import PROFILE_COLUMNS


def by_column(frame):
    return {r.column_names: r.asDict() for r in profile(frame).collect()}


def test_counts_of_every_kind(spark):
    frame = spark.createDataFrame(
        [
            ("a", 1, 1.5, None, True),
            ("a", 1, float("nan"), bytearray(b"\xff"), True),
            ("", 2, 2.5, bytearray(b"\xff"), None),
            ("  ", None, None, bytearray(b"\x00"), False),
            ("NaN", 3, 2.5, bytearray(b"\x01"), False),
            (None, 4, 0.0, None, False),
        ],
        "s string, i int, d double, y binary, b boolean",
    )
    got = by_column(frame)
    assert list(profile(frame).columns) == list(PROFILE_COLUMNS)
    s, i, d, y, b = (got[c] for c in "sidyb")
    assert (s["num_rows"], s["num_null"], s["num_spaces"], s["num_blank"]) == (6, 2, 1, 1)
    assert (s["num_distinct"], s["most_freq_value"], s["most_freq_value_count"]) == (5, "a", 2)
    assert (s["least_freq_value"], s["least_freq_value_count"]) == ("", 1)
    assert (i["count"], i["mean"], i["num_null"], i["num_distinct"]) == (5, 2.2, 1, 5)
    assert i["stddev"] == pytest.approx(1.3038404810405297)
    assert (d["num_null"], d["count"]) == (2, 5)
    assert (y["num_null"], y["count"], y["mean"], y["most_freq_value"]) == (2, None, None, "FF")
    assert (b["num_null"], b["num_distinct"], b["most_freq_value"]) == (1, 3, "false")


def test_text_moments_use_the_numbers_among_the_text(spark):
    data = [" 1", "+1.5e0", "-.5", "2d", "x1", "1x", "", " ", "-", "in", "n", "0x10", None]
    frame = spark.createDataFrame([(v,) for v in data], "s string")
    cast = frame.agg(F.avg(F.col("s").try_cast("double")), F.stddev_samp(F.col("s").try_cast("double")))
    s = by_column(frame)["s"]
    assert s["count"] == 12
    assert (s["mean"], s["stddev"]) == tuple(cast.first())
    special = ["NaN", "nan", "+NaN", "inf", "Infinity", "-inf", "\x01nan"]
    frame = spark.createDataFrame([(v,) for v in special], "s string")
    nans = frame.where(F.isnan(F.col("s").try_cast("double"))).count()
    assert nans > 0 and by_column(frame)["s"]["num_null"] == nans


def test_empty_table_has_a_row_per_column(spark):
    got = by_column(spark.createDataFrame([], "a int, b string"))
    assert set(got) == {"a", "b"}
    for row in got.values():
        assert row["num_rows"] == row["num_null"] == row["num_distinct"] == 0
        assert row["most_freq_value"] is None and row["most_freq_value_count"] == 0


def test_all_null_column_and_awkward_names(spark):
    frame = spark.createDataFrame([(None, 1), (None, 1)], "`a.b` string, `c d` int")
    got = by_column(frame)
    assert (got["a.b"]["num_null"], got["a.b"]["num_distinct"]) == (2, 1)
    assert got["a.b"]["most_freq_value"] is None and got["a.b"]["most_freq_value_count"] == 2
    assert got["c d"]["most_freq_value"] == "1"


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([None, "", "a", "b", " "]), st.integers(0, 3)), min_size=1))
def test_does_not_depend_on_partitioning(spark, data):
    frame = spark.createDataFrame(data, "s string, i int")
    one, many = by_column(frame.repartition(1)), by_column(frame.repartition(5))
    for column in one:
        # The last digits of the moments depend on the order of summation.
        for moment in ("mean", "stddev"):
            assert one[column].pop(moment) == pytest.approx(many[column].pop(moment), nan_ok=True)
    assert one == many
    values = [v for v, _ in data]
    top = min(set(values), key=lambda v: (-values.count(v), v is None, v or ""))
    assert by_column(frame)["s"]["most_freq_value"] == top
