from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import executed_plan, rows
from tidemill import adapters
from tidemill.session import configure
from tidemill.plans import inventory as inv

AS_OF = date(2024, 3, 10)
SF = "/root/testdata/sf0.001"


def fact(spark, **given):
    """One fact row; measures are 1 unless given."""
    row = {
        "calendar_date": date(2024, 3, 5),
        "calendar_year_month": None,
        "complex_decomposition": "C",
        "region": "NA",
        "tdc_val": "T1",
        "material": "M1",
        "valuation_class": "V1",
        "currency_key": "EUR",
        "plant": "P1",
    }
    row.update({c: Decimal(1) for c in inv.FACT_COLUMNS if c not in row})
    row.update(given)
    if row["calendar_year_month"] is None:
        row["calendar_year_month"] = row["calendar_date"].strftime("%Y-%m")
    return tuple(row[c] for c in inv.FACT_COLUMNS)


def facts(spark, *given):
    kinds = {"calendar_date": "date"}
    measures = [c for c in inv.FACT_COLUMNS if c.startswith(("msu_", "usd_", "raw_", "buom_"))]
    schema = ", ".join(
        f"{c} {'decimal(19,4)' if c in measures else kinds.get(c, 'string')}" for c in inv.FACT_COLUMNS
    )
    return spark.createDataFrame([fact(spark, **g) for g in given], schema)


@pytest.fixture(scope="module")
def dims(spark):
    grouping = ", ".join(f"{c} string" for c in inv.MATERIAL_GROUPING)
    materials = [
        (m, f"text {m}", *[f"{m[0]}-{c}" for c in inv.MATERIAL_GROUPING]) for m in ("M1", "M2")
    ]
    return inv.Dimensions(
        product_line=spark.createDataFrame(
            [("T1", "line", "cat", "FABRICCARE"), ("T2", "line", "cat", "OTHER")],
            "tdc_val string, tdc_val_text string, category string, subsector string",
        ),
        material=spark.createDataFrame(materials, f"material string, material_text string, {grouping}"),
        valuation=spark.createDataFrame(
            [("V1", "d", "dt"), ("V2", "d", "dt")],
            "valuation_class string, material_type_derived string, material_type_derived_text string",
        ),
        conversion=spark.createDataFrame(
            [("EUR", Decimal("1.10000"))], "currency_key string, pyjune_factor decimal(9,5)"
        ),
        plant=spark.createDataFrame(
            [("P1", "p", "DE", "Germany", "EU", None), ("P2", "p", "DE", "Germany", "EU", "JV"),
             ("P3", "p", "FR", "France", "EU", "")],
            "plant string, plant_text string, country string, country_text string, "
            "geographic_group string, joint_venture_flag string",
        ),
    )


def test_union_is_tagged_and_limited_to_the_window(spark):
    frames = {
        "inv_fct_na": facts(spark, {"calendar_date": date(2022, 3, 10)}, {"calendar_date": date(2022, 3, 9)}),
        "inv_fct_la": facts(spark, {"calendar_date": AS_OF}, {"calendar_date": date(2024, 3, 11)}),
    }
    got = inv.regional_union(frames, AS_OF)
    assert rows(got, "fct_type", "calendar_date") == [
        ("inv_fct_la", AS_OF), ("inv_fct_na", date(2022, 3, 10)),
    ]


def test_stage(spark):
    zero = {c: Decimal(0) for c in inv.DECIDING_MEASURES}
    unknown = {c: None for c in inv.DECIDING_MEASURES}
    got = inv.stage(
        facts(
            spark,
            {"region": "kept"},
            {"region": "wrong kind", "complex_decomposition": "X"},
            {"region": "all zero", **zero},
            {"region": "all unknown", **unknown},
            {"region": "one left", **zero, "usd_safety_stock": Decimal("-0.0001")},
            {"region": "unknown and zero", **zero, "msu_safety_stock": None},
        ),
        AS_OF,
    )
    assert rows(got, "region") == [("kept",), ("one left",)]


def test_star_join_keeps_and_drops(spark, dims):
    staged = facts(
        spark,
        {"region": "ok"},
        {"region": "joint venture", "plant": "P2"},
        {"region": "blank flag", "plant": "P3"},
        {"region": "unknown plant", "plant": "P9"},
        {"region": "no plant", "plant": None},
        {"region": "unknown currency", "currency_key": "USD"},
        {"region": "unknown material", "material": "M9"},
        {"region": "unknown class", "valuation_class": "V9"},
        {"region": "other subsector", "tdc_val": "T2"},
    ).withColumn("fct_type", F.lit("f"))
    got = inv.star_join(staged, dims)
    assert {r[0] for r in rows(got, "region")} == {
        "ok", "blank flag", "unknown plant", "no plant", "unknown currency"
    }
    assert rows(got.where("region = 'unknown plant'"), "plant", "country") == [(None, None)]
    assert rows(got.where("region = 'unknown currency'"), "pyjune_factor") == [(None,)]


def test_joining_the_unique_material_dimension_twice_changes_nothing(spark, dims):
    staged = facts(spark, {}, {"material": "M2"}).withColumn("fct_type", F.lit("f"))
    once = inv.star_join(staged, dims)
    twice = once.join(dims.material.select("material"), "material")
    assert twice.count() == once.count() == 2


def test_repeated_material_is_refused(spark, dims):
    doubled = inv.Dimensions(
        dims.product_line, dims.material.union(dims.material), dims.valuation, dims.conversion, dims.plant
    )
    with pytest.raises(ValueError, match="material repeats"):
        doubled.checked()
    with pytest.raises(ValueError, match="material repeats"):
        inv.report(facts(spark, {}).withColumn("fct_type", F.lit("f")), doubled)
    assert dims.checked() is dims


def test_a_key_may_repeat_outside_the_reported_subsectors(spark, dims):
    line = dims.product_line.where("subsector is not null").limit(1)
    other = inv.Dimensions(
        line.union(line.withColumn("subsector", F.lit("NOT REPORTED"))),
        dims.material, dims.valuation, dims.conversion, dims.plant,
    )
    assert other.checked() is other


def test_daily_rollup(spark, dims):
    staged = facts(
        spark, {}, {"material": "M2"}, {"plant": "P3", "currency_key": "USD"}, {"valuation_class": "V2"}
    ).withColumn("fct_type", F.lit("inv_fct_na"))
    got = inv.daily_rollup(inv.star_join(staged, dims)).collect()
    assert len(got) == 1
    (row,) = got
    assert row["fact.material"] == row["matl.material_text"] == row.plant == row.ff_version == ""
    assert (row.data_type, row.target, row.subsector) == ("isc_daily", 0, "FABRICCARE")
    assert row.msu_total_plant_stock == 4
    assert row.usd_total_plant_stock_py_june_30_rate == Decimal("4.3")


def test_periods(spark):
    staged = facts(
        spark,
        {"calendar_date": date(2024, 3, 5)},
        {"calendar_date": date(2024, 3, 8)},
        {"calendar_date": date(2024, 2, 27)},
        {"calendar_date": date(2024, 2, 28)},
        {"calendar_date": date(2024, 1, 30)},
        {"calendar_date": date(2024, 1, 31)},
    )
    got = staged.withColumn("data_type", inv.period_class(staged))
    assert rows(got, "calendar_date", "data_type") == [
        (date(2024, 1, 30), None),
        (date(2024, 1, 31), "isc_monthly"),
        (date(2024, 2, 27), "isc_previous_month"),
        (date(2024, 2, 28), "isc_monthly"),
        (date(2024, 3, 5), "isc_current_month"),
        (date(2024, 3, 8), "isc_monthly"),
    ]


def test_report_pads_columns_and_feeds_the_checks(spark, dims):
    staged = facts(spark, {}, {"material": "M2"}).withColumn("fct_type", F.lit("inv_fct_na"))
    report = inv.report(staged, dims)
    monthly, daily = report.where("data_type != 'isc_daily'"), report.where("data_type = 'isc_daily'")
    assert rows(monthly, "material", "`fact.material`", "material_group") == [
        ("M1", None, None), ("M2", None, None)
    ]
    assert rows(daily, "material", "`fact.material`", "material_group") == [(None, "", "M-material_group")]
    assert rows(inv.stock_check(report, "inv_fct_na", "2024-03")) == [
        (date(2024, 3, 5), Decimal(2000), "FABRICCARE")
    ]
    assert rows(inv.freshness(report)) == [(date(2024, 3, 5),)]
    assert inv.slice_of(report, "isc_monthly", "FABRICCARE", "inv_fct_na").count() == 2


def test_daily_from_monthly_sums_equals_the_direct_rollup(spark):
    staged = inv.stage(adapters.tagged_facts(spark, SF), adapters.AS_OF)
    joined = inv.star_join(staged, adapters.dimensions(spark, SF))
    direct = inv.daily_rollup(joined)
    derived = inv.daily_from_month_sums(inv.month_sums(joined))
    assert derived.schema == direct.schema or derived.dtypes == direct.dtypes
    assert direct.count() > 0
    assert direct.exceptAll(derived).count() == 0 and derived.exceptAll(direct).count() == 0


def test_one_pass_facts_equal_the_union_of_regions(spark):
    union = inv.regional_union(adapters.regional_facts(spark, SF), adapters.AS_OF)
    single = inv.regional_union({"x": adapters.tagged_facts(spark, SF).drop("fct_type")}, adapters.AS_OF)
    assert union.drop("fct_type").exceptAll(single.drop("fct_type")).count() == 0
    assert union.count() == single.count()


def test_plan_reads_the_facts_once_for_both_rollups(spark):
    staged = inv.stage(adapters.tagged_facts(spark, SF), adapters.AS_OF)
    report = inv.report(staged, adapters.dimensions(spark, SF))
    report.collect()
    final = executed_plan(report).split("Initial Plan")
    assert any("ReusedExchange [calendar_date" in part for part in final)


def test_window_reaches_the_scan(spark):
    staged = inv.stage(adapters.tagged_facts(spark, SF), adapters.AS_OF)
    plan = executed_plan(staged)
    assert "GreaterThanOrEqual(l_shipdate,1999-07-20" in plan


def test_no_dimension_is_broadcast_beyond_its_bound(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        facts = adapters.tagged_facts(spark, SF)
        small = inv.dimension(adapters.material_dimension(spark, SF), max_rows=10)
        assert "BroadcastHashJoin" not in executed_plan(facts.join(small, "material")).split("lineitem")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_hierarchy_matches_on_the_last_eight_characters(spark):
    facts = spark.createDataFrame([("000000000007",), ("000000000008",), ("9",)], "material string")
    hierarchy = spark.createDataFrame(
        [("00000007", "710", "Y", "seven"), ("00000008", "710", "N", "old"), ("00000008", "711", "Y", "no")],
        "prod_19_id string, prod_hier_id string, curr_ind string, prod_7_long_name string",
    )
    got = inv.with_product_hierarchy(facts, hierarchy)
    assert rows(got) == [("000000000007", "seven"), ("000000000008", None), ("9", None)]


def test_build_from_catalog(spark, dims, tmp_path):
    spark.sql("create database if not exists stock")
    for name, frame in {
        "tdc_val_dim": dims.product_line, "matl_dim": dims.material, "val_class_dim": dims.valuation,
        "conversion_dim": dims.conversion, "plant_dim": dims.plant,
        **{t: facts(spark, {"region": t}) for t in inv.REGIONAL_FACTS},
    }.items():
        frame.write.mode("overwrite").option("path", str(tmp_path / name)).saveAsTable(f"stock.{name}")
    got = inv.build_from_catalog(spark, "stock", AS_OF, str(tmp_path / "report"))
    assert got.count() == 8
    assert {r[0] for r in rows(got, "fct_type")} == set(inv.REGIONAL_FACTS)
    assert (tmp_path / "report" / "fct_type=inv_fct_na" / "subsector=FABRICCARE").exists()


def test_hot_material_is_split_between_tasks(spark):
    """A third of the facts are of one material, and its dimension is too large to send."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    larger = SF.replace("0.001", "0.01")
    staged = inv.stage(adapters.tagged_facts(spark, larger), adapters.AS_OF)
    hot = F.when(F.crc32("plant") % 3 == 0, F.lit("000000000007")).otherwise(F.col("material"))
    staged = staged.withColumn("material", hot).repartition(8)
    materials = adapters.material_dimension(spark, larger)

    def stock():
        joined = staged.join(inv.dimension(materials, max_rows=10), "material")
        return joined.groupBy("material").agg(F.sum("msu_stock_in_transit"), F.count("*"))

    expected = rows(stock())
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        split = stock()
        assert rows(split) == expected
        split.collect()
        assert "skew=true" in executed_plan(split)
        spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "false")
        whole = stock()
        whole.collect()
        assert "skew=true" not in executed_plan(whole)
    finally:
        for name in settings:
            spark.conf.unset(name)
        configure(spark)


def test_tasks_read_little_unless_the_session_says_otherwise(spark):
    names = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name in names:
            spark.conf.unset(name)
        configure(spark)
        assert [spark.conf.get(name) for name in names] == ["16MB", "16MB"]
        for name in names:
            spark.conf.set(name, "32m")
        configure(spark)
        assert [spark.conf.get(name) for name in names] == ["32m", "32m"]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
