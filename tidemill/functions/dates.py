"""Date expressions. Nothing here reads the clock: callers pass the reference date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_two_year_window(column: Column, as_of: date) -> Column:
    """Dates from two years before ``as_of`` up to ``as_of``, both included."""
    end = F.lit(as_of)
    return column.between(F.add_months(end, -24), end)


def month_label(column: Column) -> Column:
    """``YYYY-MM``."""
    return F.date_format(column, "yyyy-MM")


def previous_month_label(column: Column) -> Column:
    """``YYYY-MM`` of the month before the date's own."""
    return month_label(F.add_months(F.trunc(column, "month"), -1))
