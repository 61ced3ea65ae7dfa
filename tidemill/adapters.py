"""The library's inputs, expressed over a star-schema test set.

The test set has orders, parts and an event log; the pipelines want stock facts,
sales tables and change events. Each function maps whole tables, so whatever runs on
the result does work in proportion to the data.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemill.plans.inventory import FACT_COLUMNS, MATERIAL_GROUPING, STOCKS, Dimensions
from tidemill.sources.events import EventSource, event_bodies

AS_OF = date(2001, 7, 20)

REGION_OF_FACT = {
    "inv_fct_na": "AMERICA",
    "inv_fct_la": "AFRICA",
    "inv_fct_asia": "ASIA",
    "inv_fct_emea": "EUROPE",
}

MONEY = "decimal(19,4)"

# Which order-line figure stands in for each stock measure.
MEASURE_SOURCES = {
    "msu": ("l_discount", "l_tax", "l_discount", "l_quantity", "l_extendedprice"),
    "usd": ("l_tax", "l_discount", "l_tax", "l_extendedprice", "l_quantity"),
    "raw": ("l_extendedprice", "l_quantity", "l_extendedprice", "l_tax", "l_discount"),
}


# Declared, so that opening a table does not start a job to infer its schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    ),
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


# -- inventory ------------------------------------------------------------------------


def _stock_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines with the region their supplier is in."""
    nations = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = table(spark, folder, "supplier").join(
        nations, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return table(spark, folder, "lineitem").join(
        suppliers, F.col("l_suppkey") == F.col("s_suppkey")
    )


def _fact_columns() -> list[str]:
    day = "cast(l_shipdate as date)"
    mapping = {
        "calendar_date": day,
        "calendar_year_month": f"date_format({day}, 'yyyy-MM')",
        "complex_decomposition": (
            "case l_returnflag when 'A' then 'C' when 'R' then 'S' else 'X' end"
        ),
        "region": "r_name",
        "buom_total_plant_stock": f"cast(l_quantity as {MONEY})",
        "tdc_val": "concat('T', n_nationkey)",
        "material": "lpad(l_partkey, 12, '0')",
        "valuation_class": "concat('V', r_regionkey)",
        "currency_key": "concat('CUR', n_nationkey)",
        "plant": "concat('P', l_suppkey)",
    }
    for unit, sources in MEASURE_SOURCES.items():
        for stock, source in zip(STOCKS, sources):
            mapping[f"{unit}_{stock}"] = f"cast({source} as {MONEY})"
    # One measure is unknown rather than zero.
    mapping["msu_safety_stock"] = f"nullif({mapping['msu_safety_stock']}, 0)"
    return [f"{mapping[c]} as {c}" for c in FACT_COLUMNS]


def regional_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """One stock-fact table per region."""
    lines = _stock_lines(spark, folder)
    return {
        fact: lines.where(F.col("r_name") == region).selectExpr(*_fact_columns())
        for fact, region in REGION_OF_FACT.items()
    }


def tagged_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The facts of all regions with their table's name, read in one pass."""
    lines = _stock_lines(spark, folder)
    tags = " ".join(f"when '{region}' then '{fact}'" for fact, region in REGION_OF_FACT.items())
    known = lines.where(F.col("r_name").isin(*REGION_OF_FACT.values()))
    return known.selectExpr(*_fact_columns(), f"case r_name {tags} end as fct_type")


def material_dimension(spark: SparkSession, folder: str) -> DataFrame:
    sources = ("p_brand", "p_brand", "p_type", "p_type", "p_brand", *["p_type"] * 4, *["p_brand"] * 4)
    return table(spark, folder, "part").selectExpr(
        "lpad(p_partkey, 12, '0') as material",
        "p_name as material_text",
        *(
            f"concat('{name}:', {source}) as {name}"
            for name, source in zip(MATERIAL_GROUPING, sources)
        ),
    )


def product_line_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nation").selectExpr(
        "concat('T', n_nationkey) as tdc_val",
        "concat('line ', n_name) as tdc_val_text",
        "concat('category ', n_regionkey) as category",
        "case when n_nationkey < 9 then 'FABRICCARE' when n_nationkey < 18 then 'HOMECARE' "
        "else 'OTHER' end as subsector",
    )


def valuation_dimension(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "region").selectExpr(
        "concat('V', r_regionkey) as valuation_class",
        "concat('derived ', r_regionkey) as material_type_derived",
        "concat('derived from ', r_name) as material_type_derived_text",
    )


def conversion_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Rates, with some currencies unknown."""
    nations = table(spark, folder, "nation").where(F.col("n_nationkey") < 20)
    return nations.selectExpr(
        "concat('CUR', n_nationkey) as currency_key",
        "cast((n_nationkey + 50) * 0.01250BD as decimal(9,5)) as pyjune_factor",
    )


def plant_dimension(spark: SparkSession, folder: str) -> DataFrame:
    """Plants, with some unknown and some joint ventures."""
    return (
        table(spark, folder, "supplier")
        .where(F.col("s_acctbal") <= 9000)
        .selectExpr(
            "concat('P', s_suppkey) as plant",
            "s_name as plant_text",
            "cast(s_nationkey as string) as country",
            "concat('country ', s_nationkey) as country_text",
            "concat('group ', s_nationkey) as geographic_group",
            "case when s_acctbal < 0 then 'JV' end as joint_venture_flag",
        )
    )


def dimensions(spark: SparkSession, folder: str) -> Dimensions:
    return Dimensions(
        product_line=product_line_dimension(spark, folder),
        material=material_dimension(spark, folder),
        valuation=valuation_dimension(spark, folder),
        conversion=conversion_dimension(spark, folder),
        plant=plant_dimension(spark, folder),
    )


def product_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    """Product hierarchy entries; entries of cheap parts are outdated."""
    entries = (
        table(spark, folder, "part")
        .groupBy(F.expr("right(lpad(p_partkey, 12, '0'), 8)").alias("prod_19_id"))
        .agg(F.min("p_name").alias("name"), F.max("p_retailprice").alias("price"))
    )
    return entries.selectExpr(
        "prod_19_id",
        "'710' as prod_hier_id",
        "if(price < 950, 'N', 'Y') as curr_ind",
        "concat('long ', name) as prod_7_long_name",
    )


# -- sales tables ---------------------------------------------------------------------


def sales_tables(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """Landed sales tables, with NULL, blank and white-space values in them."""
    customer, part = table(spark, folder, "customer"), table(spark, folder, "part")
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    return {
        "Address": customer.select(
            F.col("c_custkey").alias("AddressId"),
            F.col("c_name").alias("AddressLine1"),
            F.nullif(F.col("c_mktsegment"), F.lit("MACHINERY")).alias("AddressLine2"),
            F.when(F.col("c_nationkey") == 3, F.lit(""))
            .when(F.col("c_nationkey") == 4, F.lit("  "))
            .otherwise(F.concat(F.lit("city "), F.col("c_nationkey").cast("string")))
            .alias("City"),
            F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("Balance"),
        ),
        "Product": part.select(
            F.col("p_partkey").alias("ProductId"),
            F.col("p_name").alias("Name"),
            F.when(F.col("p_type") == "PROMO", F.lit("one size"))
            .when(F.col("p_partkey") % 5 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".5")))
            .otherwise(F.col("p_size").cast("string"))
            .alias("Size"),
            F.nullif(F.col("p_brand"), F.lit("Brand#7")).alias("Color"),
            F.when(F.col("p_retailprice") >= 905, F.col("p_retailprice")).alias("ListPrice"),
            F.when(F.col("p_size") != 1, F.col("p_size") > 25).alias("Bulky"),
        ),
        "CustomerAddress": orders.select(
            F.col("o_orderkey").alias("CustomerId"),
            F.col("o_custkey").alias("AddressId"),
            F.when(F.col("o_orderstatus") == "F", F.lit("Main Office"))
            .when(F.col("o_orderstatus") == "O", F.lit("Shipping"))
            .alias("AddressType"),
            F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate"))
            .cast("timestamp")
            .alias("ModifiedDate"),
        ),
        "SalesOrderDetail": lines.select(
            F.col("l_orderkey").cast("string").alias("SalesOrderID"),
            F.col("l_linenumber").alias("SalesOrderDetailID"),
            F.col("l_quantity").cast("int").alias("OrderQty"),
            F.col("l_extendedprice").cast(MONEY).alias("UnitPrice"),
            F.nullif(F.col("l_discount"), F.lit(0.0)).cast(MONEY).alias("UnitPriceDiscount"),
        ),
    }


# -- change events --------------------------------------------------------------------

ADDRESS = "Person.Address"
CULTURE = "Production.Culture"
ADDRESS_KEY = "AddressID"
CULTURE_KEY = "CultureId"
ODD_EVERY = 37
TOMBSTONE, JUNK, NO_KEY, NO_OP, NO_TABLE, TWICE, UNKNOWN_KEY = range(7)


def change_events(events: DataFrame, one_table: bool = False) -> DataFrame:
    """The event log as change events: ``body`` in binary and ``sequence``.

    Dear events concern addresses, keyed by the user, the others cultures, keyed by
    the event's property; with ``one_table`` all concern addresses. An error is a
    delete and a purchase a snapshot read. A few of every ``ODD_EVERY`` events are odd:
    a tombstone, a body that is no JSON, a change without a key, one without an operation,
    one of a table nobody knows, one that arrives twice and a delete of an unknown key.
    """
    odd = F.pmod(F.col("event_id"), F.lit(ODD_EVERY))
    events = events.withColumn("user_id", F.when(odd == NO_KEY, None).when(odd == UNKNOWN_KEY, -F.col("event_id") - 1).otherwise(F.col("user_id")))
    stamp = F.date_format(F.col("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    k = F.get_json_object("props", "$.k")
    address = F.to_json(
        F.struct(
            F.col("user_id").alias(ADDRESS_KEY),
            F.concat_ws(" ", F.col("event_type"), F.col("value").cast("string")).alias("AddressLine1"),
            k.alias("City"),
            stamp.alias("ModifiedDate"),
        )
    )
    culture = F.to_json(
        F.struct(
            F.when(odd == UNKNOWN_KEY, F.concat(F.lit("x"), F.col("event_id").cast("string")))
            .when(odd != NO_KEY, F.concat(F.lit("c"), k))
            .alias(CULTURE_KEY),
            F.col("event_type").alias("Name"),
            stamp.alias("ModifiedDate"),
        )
    )
    is_address = F.lit(True) if one_table else F.col("value") >= 25
    deleted = (F.col("event_type") == "error") | (odd == UNKNOWN_KEY)
    op = (
        F.when(odd == NO_OP, F.lit("null"))
        .when(deleted, F.lit('"d"'))
        .when(F.col("event_type") == "signup", F.lit('"c"'))
        .when(F.col("event_type") == "purchase", F.lit('"r"'))
        .otherwise(F.lit('"u"'))
    )
    null = F.lit("null")
    image = F.when(is_address, address).otherwise(culture)
    deleted &= odd != NO_OP
    source = F.to_json(
        F.struct(
            F.when(is_address, F.lit("Person")).otherwise(F.lit("Production")).alias("schema"),
            F.when((odd == NO_TABLE) & F.lit(not one_table), F.lit("Unknown"))
            .when(is_address, F.lit("Address"))
            .otherwise(F.lit("Culture"))
            .alias("table"),
            F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        )
    )
    body = F.concat(
        F.lit('{"before": '),
        F.when(deleted, image).otherwise(null),
        F.lit(', "after": '),
        F.when(deleted, null).otherwise(image),
        F.lit(', "op": '),
        op,
        F.lit(', "source": '),
        source,
        F.lit("}"),
    )
    sent = F.when(odd == JUNK, F.lit("not json {")).when(odd != TOMBSTONE, body)
    copies = F.explode(F.when(odd == TWICE, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy")
    rows = events.select(sent.cast("binary").alias("body"), F.col("event_id").alias("sequence"), copies)
    return rows.drop("copy")


def bodies(spark: SparkSession, folder: str, one_table: bool = False) -> DataFrame:
    """All change events as a batch."""
    events = table(spark, folder, "events")
    return event_bodies(change_events(events, one_table), sequence="sequence")


def body_stream(spark: SparkSession, folder: str, one_table: bool = False) -> DataFrame:
    """The same events as a stream. The pattern lets the log be a file or a folder."""
    log = EventSource("parquet", path=f"{folder}/events.parque[t]", schema=SCHEMAS["events"])
    return event_bodies(change_events(log.stream(spark), one_table), sequence="sequence")


def address_target(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses before the changes."""
    return table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias(ADDRESS_KEY),
        F.col("s_name").alias("AddressLine1"),
        F.col("s_nationkey").cast("string").alias("City"),
        F.expr("timestamp '2023-12-31 00:00:00'").alias("ModifiedDate"),
    )


def culture_target(spark: SparkSession, folder: str) -> DataFrame:
    """Cultures before the changes."""
    return (
        table(spark, folder, "part")
        .groupBy("p_size")
        .agg(F.min("p_brand").alias("Name"))
        .select(
            F.concat(F.lit("c"), F.col("p_size").cast("string")).alias(CULTURE_KEY),
            "Name",
            F.expr("timestamp '2023-12-31 00:00:00'").alias("ModifiedDate"),
        )
    )


def target_schemas(spark: SparkSession, folder: str) -> dict[str, StructType]:
    return {
        ADDRESS: address_target(spark, folder).schema,
        CULTURE: culture_target(spark, folder).schema,
    }


def connector_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Status messages of connectors, one per event."""
    user = F.col("user_id").cast("string")
    k = F.get_json_object("props", "$.k")
    state = F.when(F.col("event_type") == "signup", F.lit("FAILED")).otherwise(F.lit("RUNNING"))
    message = F.when(
        F.col("event_type") == "error",
        F.concat(F.lit('{"error_code": '), k, F.lit(', "message": "no status"}')),
    ).otherwise(
        F.concat(
            F.lit('{"name": "connector-'), user, F.lit('", "tasks": [{"id": 0, "state": "'), state,
            F.lit('"}]}'),
        )
    )
    return table(spark, folder, "events").select("event_id", message.alias("status"))
