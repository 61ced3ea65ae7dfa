from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemill import functions as fn


@pytest.mark.parametrize(
    ("size", "letter"),
    [
        ("37", "37"), ("38", "S"), ("42", "S"), ("43", "43"), ("44", "M"), ("48", "M"),
        ("50", "L"), ("54", "L"), ("56", "XL"), ("62", "XL"), ("63", "63"),
        ("M", "M"), ("", ""), (None, None), ("40.5", "S"), ("42.5", "S"), ("43.9", "43.9"), ("4.5.6", "4.5.6"),
    ],
)
def test_size_letter(spark, size, letter):
    frame = spark.createDataFrame([(size,)], "s string")
    assert frame.select(fn.size_letter(F.col("s"))).first()[0] == letter


def test_castable(spark):
    frame = spark.createDataFrame([("12",), ("x",), (None,), (" \t",), ("",), ("40.5",), (" -3. ",)], "s string")
    got = [r[0] for r in frame.select(fn.castable_to_int(F.col("s"))).collect()]
    assert got == [True, False, False, False, False, True, True]


def test_any_nonzero_ignores_null(spark):
    frame = spark.createDataFrame([(0, 0), (None, 0), (None, 3), (-1, 0)], "a int, b int")
    kept = frame.where(fn.any_nonzero([F.col("a"), F.col("b")])).collect()
    assert [tuple(r) for r in kept] == [(None, 3), (-1, 0)]


def test_window_includes_both_ends_and_handles_leap_day(spark):
    days = [date(2022, 2, 27), date(2022, 2, 28), date(2024, 2, 29), date(2024, 3, 1), None]
    frame = spark.createDataFrame([(d,) for d in days], "d date")
    kept = frame.where(fn.in_two_year_window(F.col("d"), date(2024, 2, 29))).collect()
    assert [r.d for r in kept] == [date(2022, 2, 28), date(2024, 2, 29)]


@pytest.mark.parametrize(
    ("day", "label"),
    [(date(2024, 1, 31), "2023-12"), (date(2024, 3, 31), "2024-02"), (date(2024, 12, 1), "2024-11")],
)
def test_previous_month_label(spark, day, label):
    frame = spark.createDataFrame([(day,)], "d date")
    assert frame.select(fn.previous_month_label(F.col("d"))).first()[0] == label
