"""Column profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import adapters
from tidemill.operators.profile import profile, store_part, stored_profile
from tidemill.registry import sales
from tidemill.registry.query import Query
from tidemill.session import workspace

# Moments are rounded: their last digits depend on the order of summation.
DIGITS = 4


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.round(c, DIGITS) for c in ("mean", "stddev")})


def profile_table(name: str):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(profile(adapters.table(spark, folder, name)))

    return build


def profile_sales_table(name: str):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        return _rounded(profile(adapters.sales_tables(spark, folder)[name]))

    return build


def profile_in_parts(name: str):
    """The profile from what was stored of each of three loads."""

    def build(spark: SparkSession, folder: str) -> DataFrame:
        rows, root = adapters.table(spark, folder, name), workspace(spark, "profile_parts")
        first = rows.columns[0]
        for load in range(3):
            store_part(rows.where(F.pmod(F.xxhash64(first), F.lit(3)) == load), root, str(load))
        return _rounded(stored_profile(spark, root, rows.schema))

    return build


def profile_sql(source: str, columns: dict[str, str]) -> str:
    """One row per column; ``columns`` gives each column's type."""
    rows = []
    for name, kind in columns.items():
        text = kind == "string"
        described = text or kind in ("int", "bigint", "double") or kind.startswith("decimal")
        number = f"TRY_CAST({name} AS DOUBLE)" if text else f"CAST({name} AS DOUBLE)"
        can_be_nan = text or kind == "double"
        missing = f"{name} IS NULL" + (
            f" OR coalesce(isnan(TRY_CAST({name} AS DOUBLE)), false)" if can_be_nan else ""
        )
        freq = f"SELECT {name} AS v, count(*) AS n FROM src GROUP BY {name}"
        most = f"SELECT {{}} FROM ({freq}) ORDER BY n DESC, v ASC NULLS LAST LIMIT 1"
        least = f"SELECT {{}} FROM ({freq}) ORDER BY n ASC, v ASC NULLS LAST LIMIT 1"
        rows.append(
            f"""SELECT '{name}' AS column_names, '{kind}' AS data_types, count(*) AS num_rows,
            count(*) FILTER ({missing}) AS num_null,
            {f"count(*) FILTER (regexp_full_match({name}, '[[:space:]]+'))" if text else 0} AS num_spaces,
            {f"count(*) FILTER ({name} = '')" if text else 0} AS num_blank,
            {f"count({name})" if described else "NULL"} AS "count",
            {f"round(avg({number}), {DIGITS})" if described else "NULL"} AS mean,
            {f"round(stddev_samp({number}), {DIGITS})" if described else "NULL"} AS stddev,
            count(DISTINCT {name}) + max(CASE WHEN {name} IS NULL THEN 1 ELSE 0 END) AS num_distinct,
            ({most.format("CAST(v AS VARCHAR)")}) AS most_freq_value,
            ({most.format("n")}) AS most_freq_value_count,
            ({least.format("CAST(v AS VARCHAR)")}) AS least_freq_value,
            ({least.format("n")}) AS least_freq_value_count
            FROM src"""
        )
    return f"WITH src AS ({source}) " + " UNION ALL ".join(rows)


def column_types(ddl: str) -> dict[str, str]:
    return dict(part.strip().split(" ") for part in ddl.split(", "))


QUERIES = {
    **{
        f"profile_{name}": Query(
            profile_table(name),
            profile_sql(f"SELECT * FROM {name}", column_types(adapters.SCHEMAS[name])),
        )
        for name in ("part", "customer", "orders", "lineitem", "events")
    },
    **{
        f"profile_parts_{name}": Query(
            profile_in_parts(name),
            profile_sql(f"SELECT * FROM {name}", column_types(adapters.SCHEMAS[name])),
        )
        for name in ("orders", "events")
    },
    "profile_address": Query(
        profile_sales_table("Address"),
        profile_sql(
            sales.ADDRESS,
            column_types(
                "AddressId bigint, AddressLine1 string, AddressLine2 string, City string, Balance double"
            ),
        ),
    ),
    "profile_product": Query(
        profile_sales_table("Product"),
        profile_sql(
            sales.PRODUCT,
            column_types(
                "ProductId bigint, Name string, Size string, Color string, ListPrice double, Bulky boolean"
            ),
        ),
    ),
}
