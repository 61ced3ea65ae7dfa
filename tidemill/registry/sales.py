"""Cleaning steps on sales tables, and connector alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill import adapters
from tidemill.config import FillValues
from tidemill.operators.cleanse import (
    cast_columns,
    column_types,
    drop_columns,
    fill_nulls,
    rename_columns,
)
from tidemill.plans.alerts import connector_alerts
from tidemill.plans.loads import CASTS, RENAMES, of_size, size_check
from tidemill.functions import size_letter
from tidemill.registry.query import Query, plain

FILLS = FillValues(
    string="n/a", timestamp="1900-01-01 00:00:00", boolean=False, numeric=-1
)
FILLED = {
    "Product": ("Color", "ListPrice", "Bulky"),
    "CustomerAddress": ("AddressType", "ModifiedDate"),
    "Address": ("AddressLine2", "Balance"),
    "SalesOrderDetail": ("UnitPriceDiscount",),
}
DROPPED = {"Address": ("Balance", "no_such_column")}


def filled(table: str):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        frame = adapters.sales_tables(spark, folder)[table]
        return plain(fill_nulls(frame, FILLED[table], FILLS, column_types(frame)))

    return build


def cast_orders(spark: SparkSession, folder: str) -> DataFrame:
    frame = adapters.sales_tables(spark, folder)["SalesOrderDetail"]
    return plain(cast_columns(frame, CASTS["SalesOrderDetail"]))


def drop_rename(spark: SparkSession, folder: str) -> DataFrame:
    frame = adapters.sales_tables(spark, folder)["Address"]
    return rename_columns(drop_columns(frame, DROPPED["Address"]), RENAMES["Address"])


def _products(spark: SparkSession, folder: str) -> DataFrame:
    return adapters.sales_tables(spark, folder)["Product"].select("ProductId", "Size")


def size_recode(spark: SparkSession, folder: str) -> DataFrame:
    products = _products(spark, folder)
    return products.withColumn("Size", size_letter(products["Size"]))


def castable_flag(spark: SparkSession, folder: str) -> DataFrame:
    return size_check(_products(spark, folder))


def filter_size_m(spark: SparkSession, folder: str) -> DataFrame:
    return of_size(size_recode(spark, folder), "M")


def alerts(spark: SparkSession, folder: str) -> DataFrame:
    return connector_alerts(adapters.connector_statuses(spark, folder))


# -- the same in SQL ------------------------------------------------------------------

PRODUCT = """SELECT p_partkey AS ProductId, p_name AS Name,
  CASE WHEN p_type = 'PROMO' THEN 'one size' WHEN p_partkey % 5 = 0 THEN p_size || '.5'
    ELSE CAST(p_size AS VARCHAR) END AS Size,
  NULLIF(p_brand, 'Brand#7') AS Color,
  CASE WHEN p_retailprice >= 905 THEN p_retailprice END AS ListPrice,
  CASE WHEN p_size <> 1 THEN p_size > 25 END AS Bulky FROM part"""
CUSTOMER_ADDRESS = """SELECT o_orderkey AS CustomerId, o_custkey AS AddressId,
  CASE o_orderstatus WHEN 'F' THEN 'Main Office' WHEN 'O' THEN 'Shipping' END AS AddressType,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS ModifiedDate FROM orders"""
ADDRESS = """SELECT c_custkey AS AddressId, c_name AS AddressLine1,
  NULLIF(c_mktsegment, 'MACHINERY') AS AddressLine2,
  CASE c_nationkey WHEN 3 THEN '' WHEN 4 THEN '  ' ELSE 'city ' || c_nationkey END AS City,
  CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS Balance FROM customer"""
SALES_ORDER_DETAIL = """SELECT CAST(l_orderkey AS VARCHAR) AS SalesOrderID,
  l_linenumber AS SalesOrderDetailID, CAST(l_quantity AS INTEGER) AS OrderQty,
  CAST(l_extendedprice AS DECIMAL(19,4)) AS UnitPrice,
  CAST(NULLIF(l_discount, 0) AS DECIMAL(19,4)) AS UnitPriceDiscount FROM lineitem"""
SIZE = """CASE WHEN TRY_CAST(split_part(Size, '.', 1) AS INTEGER) BETWEEN 38 AND 42 THEN 'S'
  WHEN TRY_CAST(split_part(Size, '.', 1) AS INTEGER) BETWEEN 44 AND 48 THEN 'M'
  WHEN TRY_CAST(split_part(Size, '.', 1) AS INTEGER) BETWEEN 50 AND 54 THEN 'L'
  WHEN TRY_CAST(split_part(Size, '.', 1) AS INTEGER) BETWEEN 56 AND 62 THEN 'XL' ELSE Size END"""

FILLED_PRODUCT = f"""SELECT ProductId, Name, Size, coalesce(Color, 'n/a') AS Color,
  coalesce(ListPrice, -1) AS ListPrice, coalesce(Bulky, false) AS Bulky FROM ({PRODUCT})"""
FILLED_CUSTOMER_ADDRESS = f"""SELECT CustomerId, AddressId,
  coalesce(AddressType, 'n/a') AS AddressType,
  coalesce(ModifiedDate, TIMESTAMP '1900-01-01 00:00:00') AS ModifiedDate
  FROM ({CUSTOMER_ADDRESS})"""
FILLED_ADDRESS = f"""SELECT AddressId, AddressLine1, coalesce(AddressLine2, 'n/a') AS AddressLine2,
  City, coalesce(Balance, -1) AS Balance FROM ({ADDRESS})"""
FILLED_SALES_ORDER_DETAIL = f"""SELECT SalesOrderID, SalesOrderDetailID, OrderQty,
  CAST(UnitPrice AS DOUBLE) AS UnitPrice,
  CAST(coalesce(UnitPriceDiscount, -1) AS DOUBLE) AS UnitPriceDiscount FROM ({SALES_ORDER_DETAIL})"""

QUERIES = {
    "fill_nulls_product": Query(filled("Product"), FILLED_PRODUCT),
    "fill_nulls_customeraddress": Query(filled("CustomerAddress"), FILLED_CUSTOMER_ADDRESS),
    "fill_nulls_address": Query(filled("Address"), FILLED_ADDRESS),
    "fill_nulls_salesorderdetail": Query(
        filled("SalesOrderDetail"), FILLED_SALES_ORDER_DETAIL
    ),
    "cast_columns": Query(
        cast_orders,
        f"""SELECT CAST(SalesOrderID AS BIGINT) AS SalesOrderID, SalesOrderDetailID, OrderQty,
        CAST(UnitPrice AS DOUBLE) AS UnitPrice, CAST(UnitPriceDiscount AS DOUBLE) AS UnitPriceDiscount
        FROM ({SALES_ORDER_DETAIL})""",
    ),
    "drop_rename": Query(
        drop_rename,
        f"""SELECT AddressId, AddressLine1 AS AddressL1, AddressLine2 AS AddressL2, City
        FROM ({ADDRESS})""",
    ),
    "size_recode": Query(size_recode, f"SELECT ProductId, {SIZE} AS Size FROM ({PRODUCT})"),
    "castable_flag": Query(
        castable_flag,
        f"""SELECT Size, TRY_CAST(split_part(Size, '.', 1) AS INTEGER) IS NOT NULL AS "Value" FROM ({PRODUCT})""",
    ),
    "filter_size_m": Query(
        filter_size_m,
        f"SELECT * FROM (SELECT ProductId, {SIZE} AS Size FROM ({PRODUCT})) WHERE Size = 'M'",
    ),
    "connector_alerts": Query(
        alerts,
        """SELECT event_id, CASE event_type
          WHEN 'error' THEN '{"error_code": ' || (props->>'$.k') || ', "message": "no status"}'
          ELSE '{"name": "connector-' || user_id || '", "tasks": [{"id": 0, "state": "FAILED"}]}'
          END AS status
        FROM events WHERE event_type IN ('error', 'signup')""",
    ),
}
