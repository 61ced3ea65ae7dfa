"""Column profile of a table: one row per column, computed without collecting.

Every column is read twice, whatever their number. A single wide aggregate gives the
counts and moments and shuffles one row per task. Then the columns of each type are
turned into (column, value) pairs and counted; keeping the types apart keeps numbers
as numbers, and a columnar source is asked for each column by one of the passes only.
The counts are reduced per column by aggregates that combine inside each task, so
neither a hot value nor a column with billions of distinct values lands in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DoubleType,
    FloatType,
    IntegralType,
    MapType,
    NumericType,
    StringType,
    StructType,
)

PROFILE_COLUMNS = (
    "column_names",
    "data_types",
    "num_rows",
    "num_null",
    "num_spaces",
    "num_blank",
    "count",
    "mean",
    "stddev",
    "num_distinct",
    "most_freq_value",
    "most_freq_value_count",
    "least_freq_value",
    "least_freq_value_count",
)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _how_many(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


# How any text that casts to a double begins. Trying the cast on other text costs an
# exception per row inside the cast.
NUMBER_START = r"(?i)^[\x00-\x20]*[-+]?([.0-9]|inf|nan)"


def _as_number(column: Column, kind: DataType) -> Column:
    """The value as a number where it is one; NULL for other text."""
    if isinstance(kind, StringType):
        return F.when(column.rlike(NUMBER_START), column.try_cast("double"))
    return column


def _facts(column: Column, number: Column, kind: DataType, name: str) -> Column:
    """The aggregates of one column as a struct."""
    nothing = F.lit(0).cast("bigint")
    text = isinstance(kind, StringType)
    described = _described(kind)
    missing = column.isNull()
    if isinstance(kind, (StringType, FloatType, DoubleType)):
        # The text NaN is as little a value as the number.
        missing = missing | F.isnan(number)
    return F.struct(
        F.lit(name).alias("column_names"),
        F.lit(kind.simpleString()).alias("data_types"),
        F.count(F.lit(1)).alias("num_rows"),
        _how_many(missing).alias("num_null"),
        (_how_many(column.rlike(r"^\s+$")) if text else nothing).alias("num_spaces"),
        (_how_many(column == F.lit("")) if text else nothing).alias("num_blank"),
        (F.count(column) if described else F.lit(None).cast("bigint")).alias("count"),
        (F.avg(number) if described else F.lit(None)).cast("double").alias("mean"),
        (F.stddev_samp(number) if described else F.lit(None)).cast("double").alias("stddev"),
    )


def _described(kind: DataType) -> bool:
    return isinstance(kind, (StringType, NumericType))


def _counted_as(kind: DataType) -> str:
    """The type a column's values are counted in; whole numbers of any width share one."""
    if isinstance(kind, IntegralType):
        return "bigint"
    return "string" if isinstance(kind, (MapType, StringType)) else kind.simpleString()


def _as_text(value: Column, counted_as: str) -> Column:
    return F.hex(value) if counted_as == "binary" else value.cast("string")


def _value_counts(frame: DataFrame, columns: dict[int, Column], counted_as: str) -> DataFrame:
    """``position, value, copies`` of columns counted in one type."""
    values = frame.select(*[c.cast(counted_as).alias(str(i)) for i, c in columns.items()])
    names = [F.col(_quoted(c)) for c in values.columns]
    counted = values.unpivot([], names, "position", "value").groupBy("position", "value")
    return counted.agg(F.count(F.lit(1)).alias("copies"))


def _extremes(counted: DataFrame, counted_as: str) -> DataFrame:
    """Distinct values and extreme frequencies of columns whose values are counted."""
    absent = F.col("value").isNull().alias("absent")
    fewest = F.struct(F.col("copies"), absent, F.col("value"))
    most = F.struct((-F.col("copies")).alias("copies"), absent, F.col("value"))
    reduced = counted.groupBy(F.col("position").cast("int").alias("position")).agg(
        F.count(F.lit(1)).alias("num_distinct"),
        F.min(most).alias("most"),
        F.min(fewest).alias("least"),
    )
    return reduced.select(
        "position",
        "num_distinct",
        _as_text(F.col("most.value"), counted_as).alias("most_freq_value"),
        (-F.col("most.copies")).alias("most_freq_value_count"),
        _as_text(F.col("least.value"), counted_as).alias("least_freq_value"),
        F.col("least.copies").alias("least_freq_value_count"),
    )


def _moments(number: Column, kind: DataType) -> Column:
    """How many numbers there are, and their squared deviations from the mean."""
    described = _described(kind)
    n = F.count(number) if described else F.lit(0)
    spread = (F.var_pop(number) * F.count(number)) if described else F.lit(None)
    return F.struct(n.cast("bigint").alias("numbers"), spread.cast("double").alias("spread"))


def _column_facts(frame: DataFrame, moments: bool = False) -> DataFrame:
    """``position`` and the facts of every column, from one aggregate."""
    fields = frame.schema.fields
    columns = [F.col(_quoted(f.name)) for f in fields]
    numbered = frame.select(
        *[c.alias(f"c{i}") for i, c in enumerate(columns)],
        *[_as_number(c, f.dataType).alias(f"n{i}") for i, (c, f) in enumerate(zip(columns, fields))],
    )
    facts = numbered.agg(
        *[_facts(F.col(f"c{i}"), F.col(f"n{i}"), f.dataType, f.name).alias(f"f{i}") for i, f in enumerate(fields)],
        *[_moments(F.col(f"n{i}"), f.dataType).alias(f"m{i}") for i, f in enumerate(fields) if moments],
    )
    each = [
        F.struct(F.lit(i).alias("position"), F.col(f"f{i}.*"), *([F.col(f"m{i}.*")] if moments else []))
        for i in range(len(fields))
    ]
    return facts.select(F.explode(F.array(*each)).alias("fact")).select("fact.*")


def _by_type(schema: StructType) -> dict[str, dict[int, Column]]:
    """Columns by the type their values are counted in."""
    by_type: dict[str, dict[int, Column]] = {}
    for i, field in enumerate(schema):
        by_type.setdefault(_counted_as(field.dataType), {})[i] = F.col(_quoted(field.name))
    return by_type


def _profiled(facts: DataFrame, extremes: list[DataFrame]) -> DataFrame:
    joined = facts.join(reduce(DataFrame.unionByName, extremes), "position", "left")
    counts = ("num_distinct", "most_freq_value_count", "least_freq_value_count")
    return joined.fillna(0, subset=list(counts)).select(*PROFILE_COLUMNS)


def profile(frame: DataFrame) -> DataFrame:
    """Counts, moments, distinct values and extreme frequencies of every column.

    Values are reported as text. Ties between frequencies go to the smaller value,
    NULL last. NULL is one of the distinct values. The rows are read once for each
    type among the columns, so profile a stored table rather than a long computation.
    """
    extremes = [_extremes(_value_counts(frame, group, kind), kind) for kind, group in _by_type(frame.schema).items()]
    return _profiled(_column_facts(frame), extremes)


# -- profiles from stored parts ---------------------------------------------------------


def _counts_folder(folder: str, index: int) -> str:
    return f"{folder}/values/type={index}"


def store_part(frame: DataFrame, folder: str, load: str) -> None:
    """Store what a profile needs to know of one load's rows: the facts of each column with its
    moments, and how often each value occurs. A load stored again replaces itself."""
    _column_facts(frame, moments=True).write.mode("overwrite").parquet(f"{folder}/facts/load={load}")
    for index, (kind, group) in enumerate(_by_type(frame.schema).items()):
        counts = _value_counts(frame, group, kind)
        counts.write.mode("overwrite").parquet(f"{_counts_folder(folder, index)}/load={load}")


def stored_profile(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The profile of all loads stored under ``folder``, of tables with one schema: what
    :func:`profile` gives of all their rows, from the parts alone. Counts are added; moments
    are merged by the formula of Chan, Golub and LeVeque, from each part's own mean."""
    parts = spark.read.parquet(f"{folder}/facts").drop("load")
    weight = F.when(F.col("numbers") > 0, F.col("numbers"))
    column = Window.partitionBy("position")
    whole = F.sum(weight * F.col("mean")).over(column) / F.sum(weight).over(column)
    apart = F.col("mean") - F.col("whole")
    merged = parts.withColumn("whole", whole).groupBy("position").agg(
        F.first("column_names").alias("column_names"),
        F.first("data_types").alias("data_types"),
        *(F.sum(c).alias(c) for c in ("num_rows", "num_null", "num_spaces", "num_blank", "count")),
        F.first("whole").alias("mean"),
        F.sum("numbers").alias("numbers"),
        F.sum(F.when(F.col("numbers") > 0, F.col("spread") + F.col("numbers") * apart * apart)).alias("spread"),
    )
    deviation = F.when(F.col("numbers") > 1, F.sqrt(F.col("spread") / (F.col("numbers") - 1)))
    facts = merged.withColumn("stddev", deviation).drop("numbers", "spread")
    extremes = []
    for index, kind in enumerate(_by_type(schema)):
        counts = spark.read.schema(f"position string, value {kind}, copies bigint").parquet(_counts_folder(folder, index))
        extremes.append(_extremes(counts.groupBy("position", "value").agg(F.sum("copies").alias("copies")), kind))
    return _profiled(facts, extremes)
