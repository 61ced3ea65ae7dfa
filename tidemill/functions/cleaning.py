"""Column expressions for cleaning. All of them are safe under ANSI mode."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed size ranges and the letter each stands for.
SIZE_LETTERS = (
    (38, 42, "S"),
    (44, 48, "M"),
    (50, 54, "L"),
    (56, 62, "XL"),
)


def whole_number(column: Column) -> Column:
    """The integer that text stands for, a fraction cut off; NULL where it is no number."""
    return F.regexp_replace(column, r"^(\s*[+-]?[0-9]+)\.[0-9]*(\s*)$", "$1$2").try_cast("int")


def castable_to_int(column: Column) -> Column:
    """True where the text is a number."""
    return whole_number(column).isNotNull()


def size_letter(column: Column) -> Column:
    """Letter for a numeric size; anything outside the ranges is kept as it is."""
    number = whole_number(column)
    rest = column
    for low, high, letter in reversed(SIZE_LETTERS):
        rest = F.when(number.between(low, high), F.lit(letter)).otherwise(rest)
    return rest


def null_to(column: Column, default: Any) -> Column:
    return F.coalesce(column, F.lit(default))


def any_nonzero(columns: Iterable[Column]) -> Column:
    """True where at least one measure differs from zero; a NULL measure does not count."""
    return reduce(lambda a, b: a | b, [c != F.lit(0) for c in columns])
