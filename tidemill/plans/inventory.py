"""Inventory report: regional stock facts to daily and monthly rollups.

    regional facts -> tagged union -> staged -> star join -> monthly ┐
                                                  monthly -> daily  ┴-> report

The star join and the wide aggregate run once. The daily rollup groups by a subset
of the monthly keys, so it is computed from the monthly sums, which are exact
decimals; Spark reuses the monthly exchange for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import any_nonzero, in_two_year_window, null_to, previous_month_label
from tidemill.operators.joins import dimension, require_unique
from tidemill.operators.union import tagged, union_all_by_name
from tidemill.sinks.files import overwrite_partitioned
from tidemill.sources.catalog import project, refresh

# Names the report's readers depend on.
STOCKS = (
    "total_plant_stock",
    "mrp_available_csp_agg",
    "safety_stock",
    "quality_inspection",
    "stock_in_transit",
)
UNIT_OF_MEASURE = "buom_total_plant_stock"
RESTATED_SUFFIX = "_py_june_30_rate"
COMPLEX_DECOMPOSITIONS = ("C", "S")
SUBSECTORS = ("FABRICCARE", "HOMECARE")
JOINT_VENTURE = "JV"
DAILY = "isc_daily"
MONTH_END = "isc_monthly"
CURRENT_MONTH = "isc_current_month"
PREVIOUS_MONTH = "isc_previous_month"
REGIONAL_FACTS = ("inv_fct_na", "inv_fct_la", "inv_fct_asia", "inv_fct_emea")
DIMENSION_TABLES = {
    "product_line": "tdc_val_dim",
    "material": "matl_dim",
    "valuation": "val_class_dim",
    "conversion": "conversion_dim",
    "plant": "plant_dim",
}
PARTITION_COLUMNS = ("fct_type", "subsector", "data_type")

FACT_KEYS = ("tdc_val", "material", "valuation_class", "currency_key", "plant")
FACT_COLUMNS = (
    "calendar_date",
    "calendar_year_month",
    "complex_decomposition",
    "region",
    *(f"{unit}_{stock}" for unit in ("msu", "usd", "raw") for stock in STOCKS),
    UNIT_OF_MEASURE,
    *FACT_KEYS,
)
# A row is worth reporting if one of these is not zero.
DECIDING_MEASURES = tuple(f"{unit}_{stock}" for unit in ("msu", "usd") for stock in STOCKS[:3])

MATERIAL_GROUPING = (
    "material_group",
    "material_group_text",
    "material_type",
    "segment",
    "global_market_segment",
    *(f"apo_logical_product_{region}" for region in ("as", "eu", "la", "na")),
    *(f"sop_family_{region}" for region in ("as", "eu", "la", "na")),
)
VALUATION_ATTRIBUTES = ("material_type_derived", "material_type_derived_text")
PRODUCT_LINE_ATTRIBUTES = ("tdc_val_text", "category", "subsector")
PLANT_ATTRIBUTES = ("plant", "plant_text", "country", "country_text", "geographic_group")

DAILY_KEYS = (
    "calendar_date",
    "calendar_year_month",
    *MATERIAL_GROUPING,
    *VALUATION_ATTRIBUTES,
    "tdc_val",
    *PRODUCT_LINE_ATTRIBUTES,
    "complex_decomposition",
    "region",
    "fct_type",
)
MONTHLY_KEYS = (*DAILY_KEYS, "material", "material_text", *PLANT_ATTRIBUTES)
MEASURES = (
    *(f"{unit}_{stock}" for unit in ("msu", "usd") for stock in STOCKS),
    *(f"usd_{stock}{RESTATED_SUFFIX}" for stock in STOCKS),
    UNIT_OF_MEASURE,
)


@dataclass(frozen=True)
class Dimensions:
    """The five tables the facts are joined to."""

    product_line: DataFrame  # by tdc_val
    material: DataFrame  # by material
    valuation: DataFrame  # by valuation_class
    conversion: DataFrame  # by currency_key
    plant: DataFrame  # by plant

    def checked(self, subsectors: Sequence[str] = SUBSECTORS) -> Dimensions:
        """These tables, if none repeats its key among the rows that the report joins; a
        repeat would multiply stock."""
        for frame, key in (
            (self.product_line.where(F.col("subsector").isin(*subsectors)), "tdc_val"),
            (self.material, "material"),
            (self.valuation, "valuation_class"),
            (self.conversion, "currency_key"),
            (self.plant, "plant"),
        ):
            require_unique(frame, key)
        return self


def regional_union(facts: Mapping[str, DataFrame], as_of: date) -> DataFrame:
    """Facts of all regions in the two years up to ``as_of``, tagged with their table."""
    recent = {
        name: frame.where(in_two_year_window(F.col("calendar_date"), as_of)).select(*FACT_COLUMNS)
        for name, frame in facts.items()
    }
    return tagged(recent, "fct_type")


def stage(
    union: DataFrame, as_of: date, deciding: Sequence[str] = DECIDING_MEASURES
) -> DataFrame:
    """Rows of the reported decompositions with stock to report."""
    return union.where(
        F.col("complex_decomposition").isin(*COMPLEX_DECOMPOSITIONS)
        & any_nonzero(F.col(c) for c in deciding)
        & in_two_year_window(F.col("calendar_date"), as_of)
    )


def star_join(
    staged: DataFrame, dims: Dimensions, subsectors: Sequence[str] = SUBSECTORS
) -> DataFrame:
    """Facts with their dimension attributes, joint ventures left out.

    A plant or currency nobody knows keeps its facts, with NULL attributes and no
    restating; an unknown material, valuation class or product line drops them.
    Joins that only narrow the facts come first.
    """
    lines = dims.product_line.where(F.col("subsector").isin(*subsectors)).select(
        "tdc_val", *PRODUCT_LINE_ATTRIBUTES
    )
    plants = dims.plant.select(
        F.col("plant").alias("_plant"), *PLANT_ATTRIBUTES, "joint_venture_flag"
    )
    valuations = dims.valuation.select("valuation_class", *VALUATION_ATTRIBUTES)
    rates = dims.conversion.select("currency_key", "pyjune_factor")
    materials = dims.material.select("material", "material_text", *MATERIAL_GROUPING)
    facts = staged.withColumnRenamed("plant", "_plant")
    return (
        facts.join(dimension(lines), "tdc_val")
        .join(dimension(plants), "_plant", "left")
        .where(null_to(F.col("joint_venture_flag"), "") != JOINT_VENTURE)
        .drop("_plant", "joint_venture_flag")
        .join(dimension(valuations), "valuation_class")
        .join(dimension(rates), "currency_key", "left")
        .join(dimension(materials), "material")
    )


def _sums() -> list[Column]:
    plain = [f"{unit}_{stock}" for unit in ("msu", "usd") for stock in STOCKS]
    factor = null_to(F.col("pyjune_factor"), 1)
    return [
        *(F.sum(c).alias(c) for c in plain),
        *(
            F.sum(F.col(f"raw_{stock}") * factor).alias(f"usd_{stock}{RESTATED_SUFFIX}")
            for stock in STOCKS
        ),
        F.sum(UNIT_OF_MEASURE).alias(UNIT_OF_MEASURE),
    ]


PLACEHOLDERS = ("0 as target", "0 as actual_usd", "0 as ff_target_usd", "'' as ff_version")


def _daily_columns() -> list[str]:
    return [
        "calendar_date",
        "calendar_year_month",
        "'' as `fact.material`",
        "'' as `matl.material_text`",
        *MATERIAL_GROUPING,
        *VALUATION_ATTRIBUTES,
        "tdc_val_text",
        "category",
        "complex_decomposition",
        "region",
        *(f"'' as {c}" for c in PLANT_ATTRIBUTES),
        f"'{DAILY}' as data_type",
        *MEASURES,
        *PLACEHOLDERS,
        "subsector",
        "fct_type",
    ]


def daily_rollup(joined: DataFrame) -> DataFrame:
    """Stock per day and product attributes; material and plant are left blank."""
    return joined.groupBy(*DAILY_KEYS).agg(*_sums()).selectExpr(*_daily_columns())


def month_sums(joined: DataFrame) -> DataFrame:
    """Stock per day, material and plant: the grain both rollups start from."""
    return joined.groupBy(*MONTHLY_KEYS).agg(*_sums())


def daily_from_month_sums(sums: DataFrame) -> DataFrame:
    """The daily rollup, from sums already at the finer grain."""
    totals = [F.sum(c).cast(sums.schema[c].dataType).alias(c) for c in MEASURES]
    return sums.groupBy(*DAILY_KEYS).agg(*totals).selectExpr(*_daily_columns())


def period_class(staged: DataFrame) -> Column:
    """Which period a row belongs to, from its date and month label.

    The last loaded date of a month is that month's closing; other rows of the
    latest loaded month are current, of the month before it previous, and the rest
    have none. The three facts come from one aggregate over ``staged`` as scalar
    subqueries: at most one date per day of the window, never a join.
    """
    days = staged.groupBy("calendar_year_month").agg(F.max("calendar_date").alias("last_date"))
    facts = days.agg(
        F.struct(
            F.collect_set("last_date").alias("closings"),
            F.max("calendar_year_month").alias("current"),
            previous_month_label(F.max("last_date")).alias("previous"),
        )
    ).scalar()
    month = F.col("calendar_year_month")
    return (
        F.when(F.array_contains(facts["closings"], F.col("calendar_date")), F.lit(MONTH_END))
        .when(month == facts["current"], F.lit(CURRENT_MONTH))
        .when(month == facts["previous"], F.lit(PREVIOUS_MONTH))
    )


def monthly_from_sums(sums: DataFrame, staged: DataFrame) -> DataFrame:
    """The monthly rollup. The period depends on the group keys alone, so it is
    attached after aggregating."""
    material = [c for c in MATERIAL_GROUPING if c != "material_group"]
    return sums.withColumn("data_type", period_class(staged)).selectExpr(
        "calendar_date",
        "calendar_year_month",
        "material",
        "material_text",
        *material,
        *VALUATION_ATTRIBUTES,
        "tdc_val_text",
        "category",
        "complex_decomposition",
        "region",
        *PLANT_ATTRIBUTES,
        "data_type",
        *MEASURES,
        *PLACEHOLDERS,
        "subsector",
        "fct_type",
    )


def monthly_rollup(joined: DataFrame, staged: DataFrame) -> DataFrame:
    """Stock per day, material and plant, with the period each day falls into."""
    return monthly_from_sums(month_sums(joined), staged)


def report(staged: DataFrame, dims: Dimensions) -> DataFrame:
    """Both rollups in one table; a column only one of them has is NULL in the other.

    Refuses dimensions that repeat a key.
    """
    sums = month_sums(star_join(staged, dims.checked()))
    return union_all_by_name([monthly_from_sums(sums, staged), daily_from_month_sums(sums)])


def stock_check(report: DataFrame, fct_type: str, month: str) -> DataFrame:
    """Daily stock of one region and month in single units, for comparing by eye."""
    chosen = report.where(
        (F.col("fct_type") == fct_type)
        & (F.col("calendar_year_month") == month)
        & (F.col("data_type") == DAILY)
    )
    stock = (F.sum("msu_total_plant_stock") * F.lit(1000)).alias("su_total_plant_stock")
    return (
        chosen.groupBy("calendar_date", "subsector")
        .agg(stock)
        .select("calendar_date", "su_total_plant_stock", "subsector")
        .orderBy("calendar_date")
    )


def slice_of(report: DataFrame, data_type: str, subsector: str, fct_type: str) -> DataFrame:
    """One partition of the stored report."""
    return report.where(
        (F.col("data_type") == data_type)
        & (F.col("subsector") == subsector)
        & (F.col("fct_type") == fct_type)
    )


def freshness(report: DataFrame) -> DataFrame:
    """The latest date in the report."""
    return report.agg(F.max("calendar_date").alias("max_calendar_date"))


def with_product_hierarchy(
    facts: DataFrame, hierarchy: DataFrame, hierarchy_id: str = "710"
) -> DataFrame:
    """Facts with the long product name of the current hierarchy, by the material's
    last eight characters."""
    current = hierarchy.where(
        (F.col("prod_hier_id") == hierarchy_id) & (F.col("curr_ind") == "Y")
    ).select(F.col("prod_19_id").alias("_id"), "prod_7_long_name")
    return facts.join(
        dimension(current), F.expr("right(material, 8)") == F.col("_id"), "left"
    ).drop("_id")


def build_from_catalog(
    spark: SparkSession,
    database: str,
    as_of: date,
    path: str | None = None,
    regions: Sequence[str] = REGIONAL_FACTS,
) -> DataFrame:
    """The report from catalog tables, stored at ``path`` by region, subsector and period."""
    refresh(spark, [f"{database}.{t}" for t in (*regions, *DIMENSION_TABLES.values())])
    dims = Dimensions(
        **{field: spark.table(f"{database}.{t}") for field, t in DIMENSION_TABLES.items()}
    )
    facts = {t: project(spark, f"{database}.{t}", FACT_COLUMNS) for t in regions}
    result = report(stage(regional_union(facts, as_of), as_of), dims)
    if path is None:
        return result
    overwrite_partitioned(result, path, PARTITION_COLUMNS)
    return spark.read.parquet(path)
