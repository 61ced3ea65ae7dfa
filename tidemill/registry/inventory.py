"""Inventory report queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill import adapters
from tidemill.functions import in_two_year_window
from tidemill.plans import inventory as inv
from tidemill.registry.query import Query, plain
from tidemill.session import scratch_table, workspace
from tidemill.sinks.files import overwrite_managed, overwrite_partitioned

CHECK_FACT, CHECK_MONTH = "inv_fct_na", "2001-04"
SLICE = (inv.MONTH_END, "FABRICCARE", "inv_fct_na")


def _staged(spark: SparkSession, folder: str) -> DataFrame:
    facts = adapters.tagged_facts(spark, folder)
    recent = facts.where(in_two_year_window(F.col("calendar_date"), adapters.AS_OF))
    return inv.stage(recent, adapters.AS_OF)


def regional_union(spark: SparkSession, folder: str) -> DataFrame:
    return plain(inv.regional_union(adapters.regional_facts(spark, folder), adapters.AS_OF))


def filtered(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_staged(spark, folder))


def star_join(spark: SparkSession, folder: str) -> DataFrame:
    joined = inv.star_join(_staged(spark, folder), adapters.dimensions(spark, folder))
    return plain(joined.select(*JOINED_COLUMNS))


def daily(spark: SparkSession, folder: str) -> DataFrame:
    joined = inv.star_join(_staged(spark, folder), adapters.dimensions(spark, folder))
    return plain(inv.daily_rollup(joined))


def classified(spark: SparkSession, folder: str) -> DataFrame:
    staged = _staged(spark, folder)
    return (
        staged.withColumn("data_type", inv.period_class(staged))
        .groupBy("calendar_date", "calendar_year_month", "data_type")
        .agg(F.count(F.lit(1)).alias("num_rows"))
    )


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    staged = _staged(spark, folder)
    joined = inv.star_join(staged, adapters.dimensions(spark, folder))
    return plain(inv.monthly_rollup(joined, staged))


def _report(spark: SparkSession, folder: str) -> DataFrame:
    return inv.report(_staged(spark, folder), adapters.dimensions(spark, folder))


def report(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_report(spark, folder))


def stored_report(spark: SparkSession, folder: str) -> DataFrame:
    return plain(_stored(spark, folder))


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The report as it was stored, read by its name, which is what its readers do."""
    path = workspace(spark, "inventory_report")
    name = scratch_table(f"stock_report_{path.rsplit('-', 1)[1]}")
    overwrite_partitioned(_report(spark, folder), path, inv.PARTITION_COLUMNS, table=name)
    return spark.table(name)


def from_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """The whole report from catalog tables, in a database of its own."""
    root = workspace(spark, "inventory_catalog")
    database = f"stock_{root.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {database} LOCATION '{root}/{database}'")
    dims = adapters.dimensions(spark, folder)
    tables = {
        **adapters.regional_facts(spark, folder),
        **{name: getattr(dims, field) for field, name in inv.DIMENSION_TABLES.items()},
    }
    try:
        for name, frame in tables.items():
            overwrite_managed(frame, f"{database}.{name}")
        return plain(inv.build_from_catalog(spark, database, adapters.AS_OF, f"{root}/report"))
    finally:  # the report is stored elsewhere
        spark.sql(f"DROP DATABASE {database} CASCADE")


def check(spark: SparkSession, folder: str) -> DataFrame:
    joined = inv.star_join(_staged(spark, folder), adapters.dimensions(spark, folder))
    return plain(inv.stock_check(inv.daily_rollup(joined), CHECK_FACT, CHECK_MONTH))


def one_slice(spark: SparkSession, folder: str) -> DataFrame:
    return plain(inv.slice_of(_stored(spark, folder), *SLICE))


def freshness(spark: SparkSession, folder: str) -> DataFrame:
    return inv.freshness(_stored(spark, folder))


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    return (
        _stored(spark, folder).groupBy("fct_type").agg(F.count(F.lit(1)).alias("num_rows"))
    )


def hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    facts = _staged(spark, folder).select("calendar_date", "material", "plant", "fct_type")
    return inv.with_product_hierarchy(facts, adapters.product_hierarchy(spark, folder))


# -- the same in SQL ------------------------------------------------------------------

JOINED_COLUMNS = (
    "calendar_date",
    "material",
    "plant",
    "country_text",
    "material_group",
    "sop_family_na",
    "material_type_derived",
    "tdc_val_text",
    "subsector",
    "pyjune_factor",
    "usd_total_plant_stock",
    "raw_total_plant_stock",
    "fct_type",
)

_MEASURES = ",\n".join(
    f"CAST({source} AS DECIMAL(19,4)) AS {unit}_{stock}"
    for unit, sources in adapters.MEASURE_SOURCES.items()
    for stock, source in zip(inv.STOCKS, sources)
    if (unit, stock) != ("msu", "safety_stock")
)
_TAG = " ".join(f"WHEN '{region}' THEN '{fact}'" for fact, region in adapters.REGION_OF_FACT.items())
_DECIDING = " OR ".join(f"{c} <> 0" for c in inv.DECIDING_MEASURES)

_UNION = f"""
lines AS (
  SELECT CAST(l_shipdate AS DATE) AS calendar_date,
         strftime(l_shipdate, '%Y-%m') AS calendar_year_month,
         CASE l_returnflag WHEN 'A' THEN 'C' WHEN 'R' THEN 'S' ELSE 'X' END AS complex_decomposition,
         r_name AS region,
         {_MEASURES},
         NULLIF(CAST(l_discount AS DECIMAL(19,4)), 0) AS msu_safety_stock,
         CAST(l_quantity AS DECIMAL(19,4)) AS buom_total_plant_stock,
         'T' || n_nationkey AS tdc_val,
         lpad(CAST(l_partkey AS VARCHAR), 12, '0') AS material,
         'V' || r_regionkey AS valuation_class,
         'CUR' || n_nationkey AS currency_key,
         'P' || l_suppkey AS plant,
         CASE r_name {_TAG} END AS fct_type
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
unioned AS (
  SELECT * FROM lines
  WHERE fct_type IS NOT NULL
    AND calendar_date BETWEEN DATE '1999-07-20' AND DATE '2001-07-20')"""
_STAGED = f"""{_UNION},
staged AS (
  SELECT * FROM unioned WHERE complex_decomposition IN ('C', 'S') AND ({_DECIDING}))"""

_GROUPING_SOURCES = (
    "p_brand", "p_brand", "p_type", "p_type", "p_brand", *["p_type"] * 4, *["p_brand"] * 4
)
_GROUPING = ", ".join(
    f"'{name}:' || {source} AS {name}"
    for name, source in zip(inv.MATERIAL_GROUPING, _GROUPING_SOURCES)
)
_JOINED = f"""{_STAGED},
tdc AS (
  SELECT 'T' || n_nationkey AS tdc_val, 'line ' || n_name AS tdc_val_text,
         'category ' || n_regionkey AS category,
         CASE WHEN n_nationkey < 9 THEN 'FABRICCARE' WHEN n_nationkey < 18 THEN 'HOMECARE'
              ELSE 'OTHER' END AS subsector FROM nation),
matl AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS material, p_name AS material_text, {_GROUPING}
  FROM part),
val AS (
  SELECT 'V' || r_regionkey AS valuation_class, 'derived ' || r_regionkey AS material_type_derived,
         'derived from ' || r_name AS material_type_derived_text FROM region),
conv AS (
  SELECT 'CUR' || n_nationkey AS currency_key,
         CAST((n_nationkey + 50) * 0.01250 AS DECIMAL(9,5)) AS pyjune_factor
  FROM nation WHERE n_nationkey < 20),
plants AS (
  SELECT 'P' || s_suppkey AS plant, s_name AS plant_text, CAST(s_nationkey AS VARCHAR) AS country,
         'country ' || s_nationkey AS country_text, 'group ' || s_nationkey AS geographic_group,
         CASE WHEN s_acctbal < 0 THEN 'JV' END AS joint_venture_flag
  FROM supplier WHERE s_acctbal <= 9000),
joined AS (
  SELECT f.* EXCLUDE (plant), tdc.* EXCLUDE (tdc_val), matl.* EXCLUDE (material),
         val.* EXCLUDE (valuation_class), conv.pyjune_factor, plants.* EXCLUDE (joint_venture_flag)
  FROM staged f
  JOIN tdc ON f.tdc_val = tdc.tdc_val AND tdc.subsector IN ('FABRICCARE', 'HOMECARE')
  JOIN matl ON f.material = matl.material
  JOIN val ON f.valuation_class = val.valuation_class
  JOIN matl matl_dim ON f.material = matl_dim.material
  LEFT JOIN conv ON f.currency_key = conv.currency_key
  LEFT JOIN plants ON f.plant = plants.plant
  WHERE ifnull(plants.joint_venture_flag, '') <> 'JV')"""


def _double(expression: str, name: str) -> str:
    return f"CAST({expression} AS DOUBLE) AS {name}"


_SUMS = ",\n".join(
    [
        *(
            _double(f"SUM({unit}_{stock})", f"{unit}_{stock}")
            for unit in ("msu", "usd")
            for stock in inv.STOCKS
        ),
        *(
            _double(
                f"CAST(SUM(raw_{stock} * ifnull(pyjune_factor, 1)) AS DECIMAL(38,4))",
                f"usd_{stock}{inv.RESTATED_SUFFIX}",
            )
            for stock in inv.STOCKS
        ),
        _double("SUM(buom_total_plant_stock)", "buom_total_plant_stock"),
    ]
)
_BLANK_PLANT = ", ".join(f"'' AS {c}" for c in inv.PLANT_ATTRIBUTES)
_PLACEHOLDERS = "0 AS target, 0 AS actual_usd, 0 AS ff_target_usd, '' AS ff_version"
_DAILY_KEYS = ", ".join(inv.DAILY_KEYS)
_MONTHLY_KEYS = ", ".join(inv.MONTHLY_KEYS)
_DAILY_SHOWN = ", ".join(k for k in inv.DAILY_KEYS if k != "tdc_val")
_MONTHLY_SHOWN = ", ".join(k for k in inv.MONTHLY_KEYS if k not in ("tdc_val", "material_group"))

_DAILY = f"""
  SELECT {_DAILY_SHOWN}, '' AS "fact.material", '' AS "matl.material_text",
         {_BLANK_PLANT}, 'isc_daily' AS data_type, {_SUMS}, {_PLACEHOLDERS}
  FROM joined GROUP BY {_DAILY_KEYS}"""
_PERIOD = """CASE
    WHEN calendar_date IN (SELECT max(calendar_date) FROM staged GROUP BY calendar_year_month)
      THEN 'isc_monthly'
    WHEN calendar_year_month IN (SELECT max(calendar_year_month) FROM staged)
      THEN 'isc_current_month'
    WHEN calendar_year_month IN (
      SELECT max(strftime(date_trunc('month', calendar_date) - INTERVAL 1 DAY, '%Y-%m')) FROM staged)
      THEN 'isc_previous_month' END"""
_MONTHLY = f"""
  SELECT {_MONTHLY_SHOWN}, max(period) AS data_type, {_SUMS}, {_PLACEHOLDERS}
  FROM (SELECT *, {_PERIOD} AS period FROM joined) GROUP BY {_MONTHLY_KEYS}"""
_REPORT = f"""{_JOINED},
daily AS ({_DAILY}),
monthly AS ({_MONTHLY}),
report AS (SELECT * FROM monthly UNION ALL BY NAME SELECT * FROM daily)"""
_PLAIN_FACT = ", ".join(
    f"CAST({c} AS DOUBLE) AS {c}" if c.startswith(("msu_", "usd_", "raw_", "buom_")) else c
    for c in (*inv.FACT_COLUMNS, "fct_type")
)
_PLAIN_JOINED = ", ".join(
    f"CAST(CAST({c} AS DECIMAL(38,4)) AS DOUBLE) AS {c}"
    if c.startswith(("usd_", "raw_", "pyjune"))
    else c
    for c in JOINED_COLUMNS
)

QUERIES = {
    "inventory_regional_union": Query(
        regional_union, f"WITH {_UNION} SELECT {_PLAIN_FACT} FROM unioned"
    ),
    "inventory_filtered": Query(filtered, f"WITH {_STAGED} SELECT {_PLAIN_FACT} FROM staged"),
    "inventory_star_join": Query(star_join, f"WITH {_JOINED} SELECT {_PLAIN_JOINED} FROM joined"),
    "inventory_daily": Query(daily, f"WITH {_JOINED} {_DAILY}"),
    "inventory_period_class": Query(
        classified,
        f"""WITH {_STAGED}, classified AS (SELECT *, {_PERIOD} AS data_type FROM staged)
        SELECT calendar_date, calendar_year_month, data_type, count(*) AS num_rows
        FROM classified GROUP BY ALL""",
    ),
    "inventory_monthly": Query(monthly, f"WITH {_JOINED} {_MONTHLY}"),
    "inventory_report": Query(report, f"WITH {_REPORT} SELECT * FROM report"),
    "inventory_partitioned_write": Query(stored_report, f"WITH {_REPORT} SELECT * FROM report"),
    "inventory_from_catalog": Query(from_catalog, f"WITH {_REPORT} SELECT * FROM report"),
    "inventory_check": Query(
        check,
        f"""WITH {_JOINED}
        SELECT calendar_date, CAST(sum(msu_total_plant_stock) * 1000 AS DOUBLE) AS su_total_plant_stock,
               subsector
        FROM joined WHERE fct_type = '{CHECK_FACT}' AND calendar_year_month = '{CHECK_MONTH}'
        GROUP BY calendar_date, subsector ORDER BY calendar_date""",
    ),
    "inventory_slice": Query(
        one_slice,
        f"""WITH {_REPORT} SELECT * FROM report
        WHERE data_type = '{SLICE[0]}' AND subsector = '{SLICE[1]}' AND fct_type = '{SLICE[2]}'""",
    ),
    "inventory_freshness": Query(
        freshness, f"WITH {_REPORT} SELECT max(calendar_date) AS max_calendar_date FROM report"
    ),
    "inventory_row_counts": Query(
        row_counts,
        f"WITH {_REPORT} SELECT fct_type, count(*) AS num_rows FROM report GROUP BY fct_type",
    ),
    "inventory_hierarchy": Query(
        hierarchy,
        f"""WITH {_STAGED}, h AS (
          SELECT right(lpad(CAST(p_partkey AS VARCHAR), 12, '0'), 8) AS id,
                 'long ' || min(p_name) AS prod_7_long_name
          FROM part GROUP BY 1 HAVING max(p_retailprice) >= 950)
        SELECT calendar_date, material, plant, fct_type, prod_7_long_name
        FROM staged LEFT JOIN h ON right(material, 8) = h.id""",
    ),
}
