"""Unions by name."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames; a column one of them lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged(frames: Mapping[str, DataFrame], tag: str) -> DataFrame:
    """Union of named frames with the name in column ``tag``."""
    return union_all_by_name(f.withColumn(tag, F.lit(name)) for name, f in frames.items())
