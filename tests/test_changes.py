import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import rows
from tidemill.operators.changes import folded, latest_per_key, merge_changes, merge_parts, net_changes

CHANGE = "op string, basetime double, sequence long, k int, v string"
TARGET = "k int, v string"


def applied(target, changes, ops):
    """The merge in plain Python; changes hold one row per key at most."""
    known = {k for k, _ in target if k is not None}
    by_key = {c[3]: c for c in changes if c[3] is not None}
    result = []
    for k, v in target:
        change = by_key.get(k) if k is not None else None
        if change is None:
            result.append((k, v))
        elif change[0] != "d":
            result.append((k, change[4]))
    result += [(c[3], c[4]) for c in changes if c[3] not in known and c[0] in ops]
    return sorted(result, key=lambda r: tuple((v is not None, str(v)) for v in r))


def all_merges(target, changes, ops):
    def parts(**options):
        kept, new = merge_parts(target, changes, "k", ops, **options)
        return kept.unionByName(new)

    return {
        "plain": merge_changes(target, changes, "k", ops),
        "few": parts(few=True),
        "checked": parts(keys_repeat=True),
        "few checked": parts(keys_repeat=True, few=True),
    }


def sorted_rows(frame):
    return sorted(
        (tuple(r) for r in frame.select("k", "v").collect()),
        key=lambda r: tuple((v is not None, str(v)) for v in r),
    )


CASES = [
    ("c", 1.0, 1, 10, "insert"),
    ("u", 1.0, 2, 1, "update of a known key"),
    ("u", 1.0, 3, 11, "update of an unknown key"),
    ("d", 1.0, 4, 2, "delete of a known key"),
    ("d", 1.0, 5, 12, "delete of an unknown key"),
    ("r", 1.0, 6, 3, "snapshot read of a known key"),
    ("r", 1.0, 7, 13, "snapshot read of an unknown key"),
    ("c", 1.0, 8, None, "null key"),
    (None, 1.0, 9, 4, "null op on a known key"),
    (None, 1.0, 10, 14, "null op on an unknown key"),
    ("c", 1.0, 11, 5, "create of a known key"),
]


@pytest.mark.parametrize("ops", [{"c"}, {"c", "u"}])
def test_every_clause(spark, ops):
    before = [(k, f"old {k}") for k in (1, 2, 3, 4, 5, 6)] + [(None, "no key")]
    target = spark.createDataFrame(before, TARGET)
    changes = spark.createDataFrame(CASES, CHANGE)
    expected = applied(before, CASES, ops)
    for name, merged in all_merges(target, changes, ops).items():
        assert sorted_rows(merged) == expected, name


def test_columns_are_matched_by_name(spark):
    target = spark.createDataFrame([(1, "a", 5)], "k int, v string, kept int")
    changes = spark.createDataFrame([("u", "b", 1, 0), ("c", "n", 2, 0)], "op string, v string, k int, extra int")
    for merged in all_merges(target, changes, {"c"}).values():
        assert merged.columns == ["k", "v", "kept"]
        assert rows(merged, "k", "v", "kept") == [(1, "b", 5), (2, "n", None)]


def test_repeated_key_raises_only_when_it_meets_a_row(spark):
    target = spark.createDataFrame([(1, "a")], TARGET)
    unknown = [("c", 1.0, 1, 7, "x"), ("c", 1.0, 2, 7, "y"), ("u", 1.0, 3, 1, "b")]
    merged = merge_changes(target, spark.createDataFrame(unknown, CHANGE), "k", {"c"}, keys_repeat=True)
    assert rows(merged) == [(1, "b"), (7, "x"), (7, "y")]
    clash = spark.createDataFrame([("u", 1.0, 1, 1, "x"), ("d", 1.0, 2, 1, "y")], CHANGE)
    with pytest.raises(Exception, match="several changes match one row: k = 1"):
        merge_changes(target, clash, "k", {"c"}, keys_repeat=True).collect()


def test_latest_is_by_time_then_sequence(spark):
    changes = spark.createDataFrame(
        [("u", 1.0, 5, 1, "early"), ("d", 2.0, 6, 1, "late"), ("c", 3.0, 1, 2, "a"), ("u", 3.0, 2, 2, "b")],
        CHANGE,
    )
    assert rows(latest_per_key(changes, "k"), "k", "op", "v") == [(1, "d", "late"), (2, "u", "b")]


def test_op_first_ranks_the_operation_above_the_time(spark):
    changes = spark.createDataFrame(
        [("u", 1.0, 1, "early"), ("d", 2.0, 1, "late"), ("c", 9.0, 2, "x"), ("d", 1.0, 2, "y")],
        "op string, basetime double, k int, v string",
    )
    got = rows(latest_per_key(changes, "k", op_first=True), "k", "op", "v")
    assert got == [(1, "u", "early"), (2, "d", "y")]


def test_hot_key_is_reduced_before_the_shuffle(spark):
    hot = spark.range(6000).selectExpr(
        "'u' as op", "cast(id as double) as basetime", "id as sequence",
        "cast(if(id % 3 = 0, 0, id) as int) as k", "cast(id as string) as v",
    )
    latest = latest_per_key(hot.repartition(4), "k")
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_max_by") == 1 and "Window" not in plan
    assert latest.count() == 4001
    assert latest.where("k = 0").first().v == "5997"


def test_target_rows_sharing_a_key_are_split_between_tasks(spark):
    """A third of the target has one key, a third has none."""
    target = spark.range(30000).selectExpr(
        "cast(case id % 3 when 0 then 7 when 1 then null else id end as int) as k", "uuid() as v"
    )
    target = target.repartition(8)
    changes = spark.createDataFrame([("u", 1.0, 1, 7, "new"), ("c", 1.0, 2, -1, "x")], CHANGE)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "50KB",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        merged = merge_changes(target, changes, "k", {"c"})
        got = merged.groupBy("k").agg(F.count("*"), F.count_if(F.col("v") == "new"))
        assert dict((r[0], (r[1], r[2])) for r in got.collect() if r[0] in (None, 7, -1)) == {
            None: (10000, 0), 7: (10000, 10000), -1: (1, 0)
        }
        merged.collect()
        assert "SortMergeJoin(skew=true)" in merged._jdf.queryExecution().executedPlan().toString()
    finally:
        for name in settings:
            spark.conf.unset(name)


keys = st.one_of(st.none(), st.integers(0, 6))
ops = st.sampled_from(["c", "u", "d", "r", None])


def applied_in_order(target, changes, ops):
    """Each change in turn, against what the changes before it left."""
    state = list(target)
    for op, _, _, k, v in changes:
        hit = [i for i, (key, _) in enumerate(state) if k is not None and key == k]
        if not hit:
            state += [(k, v)] if op in ops else []
        elif op == "d":
            state = [row for i, row in enumerate(state) if i not in hit]
        else:
            state = [(k, v) if i in hit else row for i, row in enumerate(state)]
    return sorted(state, key=lambda r: tuple((v is not None, str(v)) for v in r))


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.tuples(keys, st.sampled_from("ab")), max_size=8),
    st.lists(st.tuples(ops, keys), max_size=14),
    st.sampled_from([{"c"}, {"c", "u"}]),
    st.integers(1, 5),
)
def test_merges_agree_with_applying_change_by_change(spark, before, raw, insert_ops, size):
    changes = [(op, float(i), i, k, f"new {i}") for i, (op, k) in enumerate(raw)]
    target = spark.createDataFrame(before, TARGET).coalesce(1)
    expected = applied_in_order(before, changes, insert_ops)
    rows = spark.createDataFrame(changes, CHANGE).coalesce(1)
    net = net_changes(rows, "k", insert_ops)
    assert sorted_rows(merge_changes(target, net, "k", insert_ops)) == expected
    # cut into batches, each reduced by itself
    batches = None
    for n, start in enumerate(range(0, len(changes), size)):
        part = spark.createDataFrame(changes[start : start + size], CHANGE).coalesce(1)
        part = net_changes(part, "k", insert_ops).withColumn("n", F.lit(n))
        batches = part if batches is None else batches.unionByName(part)
    if batches is not None:
        merged = merge_changes(target, folded(batches, "k", "n"), "k", insert_ops)
        assert sorted_rows(merged) == expected


def test_created_then_updated_in_one_batch_stays(spark):
    changes = [("c", 1.0, 1, 9, "made"), ("u", 2.0, 2, 9, "changed"), ("d", 1.0, 3, 8, "x"), ("u", 2.0, 4, 8, "y")]
    target = spark.createDataFrame([(8, "old")], TARGET)
    net = net_changes(spark.createDataFrame(changes, CHANGE), "k")
    assert rows(merge_changes(target, net, "k")) == [(9, "changed")]
