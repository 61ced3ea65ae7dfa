import math
import random
from datetime import datetime
from decimal import Decimal

import pytest

from tests.conftest import executed_plan
from tidemill.config import LoadConfig
from tidemill.operators.profile import profile, store_part, stored_profile
from tidemill.plans.loads import full_load, incremental_load, profile_loads

SCHEMA = "a int, b double, c string, d decimal(19,4), e boolean, f timestamp, g binary, `h.i` bigint"


def values(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        rows.append((
            rng.choice([None, 1, 2, 3]), rng.choice([None, 0.5, 1e9 + rng.random(), float("nan"), -3.25]),
            rng.choice([None, "", "  ", "x", "1.5", "NaN", "7"]), rng.choice([None, Decimal("123456789012345.6789"), Decimal("1.0000")]),
            rng.choice([None, True, False]), rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 2)]),
            rng.choice([None, b"\x00", b"ab"]), rng.randint(0, 5),
        ))
    return rows


def same(got, expected):
    assert [r[:7] for r in got] == [r[:7] for r in expected]
    for g, e in zip(got, expected, strict=True):
        for x, y in zip(g[7:9], e[7:9], strict=True):
            if x is None or y is None or math.isnan(y):
                assert (x is None) == (y is None) and (y is None or math.isnan(x))
            else:
                assert x == pytest.approx(y, rel=1e-9, abs=1e-9)
        assert g[9:] == e[9:]


def by_name(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("sizes", [(30, 1, 0, 12), (1, 1), (0, 0), (2, 40)])
def test_parts_come_to_the_profile_of_all_rows(spark, tmp_path, sizes):
    rows = values(sum(sizes), sum(sizes))
    at = 0
    for load, n in enumerate(sizes):
        store_part(spark.createDataFrame(rows[at : at + n], SCHEMA), str(tmp_path / "parts"), str(load))
        at += n
    frame = spark.createDataFrame(rows, SCHEMA)
    same(by_name(stored_profile(spark, str(tmp_path / "parts"), frame.schema)), by_name(profile(frame)))


def test_a_load_stored_again_replaces_itself(spark, tmp_path):
    frame = spark.createDataFrame(values(1, 20), SCHEMA)
    for load in ("a", "b", "a"):
        store_part(frame, str(tmp_path / "p"), load)
    assert {r.num_rows for r in stored_profile(spark, str(tmp_path / "p"), frame.schema).collect()} == {40}


def test_the_second_load_reads_its_increment_only(spark, tmp_path):
    config = LoadConfig(tables=["T"], source_dir=str(tmp_path / "bronze"), file_based_dir="", sink_dir=str(tmp_path / "silver"), fill_columns={}, drop_columns={}, fill_values={})
    spark.range(100).selectExpr("id", "cast(id % 7 as string) as v").write.parquet(str(tmp_path / "bronze/T"))
    spark.range(100, 130).selectExpr("id", "cast(id % 5 as string) as v").write.parquet(str(tmp_path / "inc/T_part.parquet"))
    full_load(spark, config, parts=str(tmp_path / "parts"))
    silver = incremental_load(spark, config, str(tmp_path / "inc"), parts=str(tmp_path / "parts"))
    plan = executed_plan(stored_profile(spark, str(tmp_path / "parts/T"), silver["T"].schema))
    assert "silver" not in plan and plan.count("FileScan") == 3  # facts, and counts of each type
    path = profile_loads(silver, str(tmp_path / "parts"), str(tmp_path), datetime(2024, 1, 1))["T"]
    stored = {r.column_names: r for r in spark.read.option("header", True).csv(path).collect()}
    assert stored["id"].num_rows == "130" and float(stored["id"].mean) == pytest.approx(64.5) and stored["v"].num_distinct == "7"
