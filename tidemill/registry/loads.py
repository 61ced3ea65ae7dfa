"""Loads between zones: the tables are landed, loaded and read back."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import adapters
from tidemill.config import LoadConfig
from tidemill.plans import synth
from tidemill.plans.loads import (
    full_load,
    incremental_load,
    land_increment,
    load_csv,
    profile_loads,
    profile_tables,
)
from tidemill.registry import profiles, sales
from tidemill.registry.query import Query, plain
from tidemill.session import scratch_table, workspace
from tidemill.sinks.files import overwrite_managed, overwrite_parquet
from tidemill.sources.catalog import refresh
from tidemill.sources.files import table_name_of
from tidemill.tables.snapshot import SnapshotTable

RUN_AT = datetime(2024, 1, 31, 12, 0, 0)


def _config(root: str, *tables: str) -> LoadConfig:
    return LoadConfig(
        tables=tables,
        source_dir=f"{root}/bronze",
        file_based_dir=f"{root}/files",
        sink_dir=f"{root}/silver",
        fill_columns={t: sales.FILLED[t] for t in tables},
        drop_columns={t: sales.DROPPED.get(t, ()) for t in tables},
        fill_values=sales.FILLS,
    )


def loaded(table: str) -> Callable[[SparkSession, str], DataFrame]:
    def build(spark: SparkSession, folder: str) -> DataFrame:
        config = _config(workspace(spark, "full_load"), table)
        overwrite_parquet(adapters.sales_tables(spark, folder)[table], f"{config.source_dir}/{table}")
        return plain(full_load(spark, config)[table])

    return build


def loaded_and_edited(spark: SparkSession, folder: str) -> DataFrame:
    table = "CustomerAddress"
    root = workspace(spark, "full_load_edited")
    config = _config(root, table)
    overwrite_parquet(adapters.sales_tables(spark, folder)[table], f"{config.file_based_dir}/{table}")
    stamp = F.expr("timestamp '2024-01-01 00:00:00'")

    def edit(managed: SnapshotTable) -> None:
        managed.insert_values(-70, 8, "Depot", stamp)
        managed.update(F.col("CustomerId") == -70, {"AddressType": "Harbour"}, keys=[-70])
        managed.delete(F.col("AddressType") == "Shipping")

    silver = full_load(
        spark, config, file_based=True, managed_dir=f"{root}/managed", edits={table: edit}
    )
    return silver[table]


ALL = ("Product", "CustomerAddress", "Address", "SalesOrderDetail")


def _profiles(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Stored profiles of all tables, in one."""
    parts = [
        spark.read.csv(path, header=True, inferSchema=False).select(F.lit(table).alias("table_name"), "*")
        for table, path in paths.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    counts = [f"cast({c} as bigint) as {c}" for c in ("num_rows", "num_null", "num_distinct", "most_freq_value_count")]
    return whole.selectExpr("table_name", "column_names", "data_types", *counts)


def full_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All configured tables: read, cleaned, managed, changed, stored, profiled to CSV."""
    root = workspace(spark, "full_pipeline")
    config = _config(root, *ALL)
    for table, rows in adapters.sales_tables(spark, folder).items():
        if table in ALL:
            overwrite_parquet(rows, f"{config.source_dir}/{table}")

    def edit(managed: SnapshotTable) -> None:
        managed.delete(F.col("AddressType") == "Shipping")

    silver = full_load(spark, config, managed_dir=f"{root}/managed", edits={"CustomerAddress": edit})
    return _profiles(spark, profile_tables(silver, root, RUN_AT))


def incremental_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All configured tables in two loads, the first of half the rows, then profiled from what
    each load stored of its rows."""
    root = workspace(spark, "incremental_pipeline")
    config = _config(root, *ALL)
    for table, rows in adapters.sales_tables(spark, folder).items():
        if table in ALL:
            first = F.pmod(F.xxhash64(rows.columns[0]), F.lit(2)) == 0
            overwrite_parquet(rows.where(first), f"{config.source_dir}/{table}")
            overwrite_parquet(rows.where(~first), f"{root}/incremental/{table}_part.parquet")
    full_load(spark, config, parts=f"{root}/parts")
    silver = incremental_load(spark, config, f"{root}/incremental", parts=f"{root}/parts")
    return _profiles(spark, profile_loads(silver, f"{root}/parts", root, RUN_AT))


def incremented(spark: SparkSession, folder: str) -> DataFrame:
    """Closed orders loaded first, the others as an increment."""
    table = "CustomerAddress"
    root = workspace(spark, "incremental_load")
    config = _config(root, table)
    rows = adapters.sales_tables(spark, folder)[table]
    closed = F.coalesce(F.col("AddressType") == "Main Office", F.lit(False))
    overwrite_parquet(rows.where(closed), f"{config.source_dir}/{table}")
    overwrite_parquet(rows.where(~closed), f"{root}/incremental/{table}_part.parquet")
    full_load(spark, config)
    return incremental_load(spark, config, f"{root}/incremental")[table]


def fanned_out(spark: SparkSession, folder: str) -> DataFrame:
    table = "Product"
    root = workspace(spark, "fan_out")
    config = _config(root, table)
    rows = adapters.sales_tables(spark, folder)[table]
    overwrite_parquet(rows, f"{root}/incremental/{table}_part.parquet")
    land_increment(spark, config, f"{root}/incremental", f"{root}/landing", f"{root}/bronze")
    zones = [
        spark.read.parquet(f"{root}/{zone}/{table}").withColumn("zone", F.lit(zone))
        for zone in ("landing", "bronze")
    ]
    return zones[0].unionByName(zones[1])


def _csv(spark: SparkSession, folder: str) -> tuple[str, str]:
    root = workspace(spark, "csv")
    rows = adapters.table(spark, folder, "customer")
    rows.write.csv(f"{root}/customers.csv", header=False)
    return root, scratch_table(f"customers_{root.rsplit('-', 1)[1]}")


def csv_rows(spark: SparkSession, folder: str) -> DataFrame:
    root, table = _csv(spark, folder)
    load_csv(spark, root, "customers.csv", table, f"{root}/{table}")
    return spark.table(table)


def csv_audit(spark: SparkSession, folder: str) -> DataFrame:
    """The audit of the second of two loads of one file."""
    root, table = _csv(spark, folder)
    load_csv(spark, root, "customers.csv", table, f"{root}/{table}")
    audit = load_csv(spark, root, "customers.csv", table, f"{root}/{table}")
    return spark.range(1).select(
        F.lit(table_name_of("customers.csv")).alias("source"),
        F.lit(audit.inserted).cast("bigint").alias("inserted"),
        F.lit(audit.total).cast("bigint").alias("total"),
    )


def managed(spark: SparkSession, folder: str) -> DataFrame:
    root = workspace(spark, "managed")
    table = scratch_table(f"product_{root.rsplit('-', 1)[1]}")
    overwrite_managed(adapters.sales_tables(spark, folder)["Product"], table, f"{root}/{table}")
    refresh(spark, [table])
    return spark.table(table)


def profile_file(spark: SparkSession, folder: str) -> DataFrame:
    """The stored profile of a loaded table, read back from CSV."""
    root = workspace(spark, "profile")
    rows = adapters.sales_tables(spark, folder)["Product"]
    path = profile_tables({"Product": rows}, root, RUN_AT)["Product"]
    stored = spark.read.csv(path, header=True, inferSchema=False)
    return stored.selectExpr(
        "column_names",
        "data_types",
        *(
            f"cast({c} as bigint) as {c}"
            for c in ("num_rows", "num_null", "num_distinct", "most_freq_value_count")
        ),
        "most_freq_value",
    )


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Generated orders, landed as files and loaded from there."""
    root = workspace(spark, "generated")
    numbers = adapters.table(spark, folder, "orders").select("o_orderkey")
    config = LoadConfig(
        tables=["SalesOrderDetail"],
        source_dir=f"{root}/bronze",
        file_based_dir=f"{root}/files",
        sink_dir=f"{root}/silver",
    )
    from_numbers = synth.generate_from(numbers, "SalesOrderDetail", 7, "bigint")
    overwrite_parquet(from_numbers, f"{config.file_based_dir}/SalesOrderDetail")
    silver = full_load(spark, config, file_based=True)["SalesOrderDetail"]
    return silver.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.min("SalesOrderID").alias("first_order"),
        F.max("SalesOrderID").alias("last_order"),
        F.count_if(
            F.col("LineTotal") != F.expr("OrderQty * (UnitPrice - UnitPriceDiscount)")
        ).alias("wrong_totals"),
    )


# -- the same in SQL ------------------------------------------------------------------

_PROFILED = (
    "column_names, data_types, num_rows, num_null, num_distinct, most_freq_value_count, most_freq_value"
)

_SILVER = {
    "Product": (
        f"SELECT ProductId, Name, {sales.SIZE} AS Size, Color, ListPrice, Bulky FROM ({sales.FILLED_PRODUCT})",
        "ProductId bigint, Name string, Size string, Color string, ListPrice double, Bulky boolean",
    ),
    "CustomerAddress": (
        sales.FILLED_CUSTOMER_ADDRESS,
        "CustomerId bigint, AddressId bigint, AddressType string, ModifiedDate timestamp",
    ),
    "Address": (
        f"SELECT AddressId, AddressLine1 AS AddressL1, AddressLine2 AS AddressL2, City FROM ({sales.FILLED_ADDRESS})",
        "AddressId bigint, AddressL1 string, AddressL2 string, City string",
    ),
    "SalesOrderDetail": (
        f"SELECT * REPLACE (CAST(SalesOrderID AS BIGINT) AS SalesOrderID) FROM ({sales.FILLED_SALES_ORDER_DETAIL})",
        "SalesOrderID bigint, SalesOrderDetailID int, OrderQty int, UnitPrice decimal(19,4), "
        "UnitPriceDiscount decimal(19,4)",
    ),
}


def _profiles_sql(silver: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{table}' AS table_name, column_names, data_types, num_rows, num_null, num_distinct,
        most_freq_value_count FROM ({profiles.profile_sql(rows, profiles.column_types(ddl))})"""
        for table, (rows, ddl) in silver.items()
    )


_EDITED = f"SELECT * FROM ({sales.FILLED_CUSTOMER_ADDRESS}) WHERE AddressType <> 'Shipping'"

QUERIES = {
    "full_pipeline": Query(
        full_pipeline,
        _profiles_sql(_SILVER | {"CustomerAddress": (_EDITED, _SILVER["CustomerAddress"][1])}),
    ),
    "incremental_pipeline": Query(incremental_pipeline, _profiles_sql(_SILVER)),
    "full_load_product": Query(
        loaded("Product"),
        f"""SELECT ProductId, Name, {sales.SIZE} AS Size, Color, ListPrice, Bulky
        FROM ({sales.FILLED_PRODUCT})""",
    ),
    "full_load_address": Query(
        loaded("Address"),
        f"""SELECT AddressId, AddressLine1 AS AddressL1, AddressLine2 AS AddressL2, City
        FROM ({sales.FILLED_ADDRESS})""",
    ),
    "full_load_salesorderdetail": Query(
        loaded("SalesOrderDetail"),
        f"""SELECT * REPLACE (CAST(SalesOrderID AS BIGINT) AS SalesOrderID)
        FROM ({sales.FILLED_SALES_ORDER_DETAIL})""",
    ),
    "full_load_edited": Query(
        loaded_and_edited,
        f"""SELECT * FROM ({sales.FILLED_CUSTOMER_ADDRESS}) WHERE AddressType <> 'Shipping'
        UNION ALL SELECT -70, 8, 'Harbour', TIMESTAMP '2024-01-01 00:00:00'""",
    ),
    "incremental_load": Query(incremented, sales.FILLED_CUSTOMER_ADDRESS),
    "parquet_fanout": Query(
        fanned_out,
        f"""SELECT * FROM ({sales.PRODUCT}), (VALUES ('landing'), ('bronze')) z(zone)""",
    ),
    "csv_to_table": Query(
        csv_rows,
        """SELECT CAST(c_custkey AS VARCHAR) AS _c0, c_name AS _c1, CAST(c_nationkey AS VARCHAR) AS _c2,
        CAST(c_acctbal AS VARCHAR) AS _c3, c_mktsegment AS _c4 FROM customer""",
    ),
    "csv_audit": Query(
        csv_audit,
        "SELECT 'customers' AS source, count(*) AS inserted, 2 * count(*) AS total FROM customer",
    ),
    "managed_overwrite": Query(managed, sales.PRODUCT),
    "profile_csv": Query(
        profile_file, f"SELECT {_PROFILED} FROM ({profiles.QUERIES['profile_product'].sql})"
    ),
    "generate_and_load": Query(
        landed,
        """SELECT count(*) AS num_rows, min(o_orderkey) + 3000 AS first_order,
        max(o_orderkey) + 3000 AS last_order, 0 AS wrong_totals FROM orders""",
    ),
}
