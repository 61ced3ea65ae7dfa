"""Change rows: the latest one per key, and applying them to a target."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSERT_CREATED = frozenset({"c"})
INSERT_CREATED_OR_UPDATED = frozenset({"c", "u"})
DELETED, INSERTS = "_deleted", "_inserts"
SLOT = "_slot"


def latest_per_key(
    changes: DataFrame,
    key: str,
    order: Sequence[str] = ("basetime", "sequence"),
    op_first: bool = False,
) -> DataFrame:
    """One row per key: the last by ``order``. Rows without a key count as one key.

    With ``op_first`` rows are compared field by field in the order the columns
    stand, operation first, so that within a batch an update outranks a delete and
    a delete a create whatever their times. An aggregate rather than a ranking
    window: each task reduces its own rows first, so a key holding a third of the
    batch still reaches the shuffle as one row per task.
    """
    row = F.struct(*[F.col(c) for c in changes.columns])
    if op_first:
        chosen = F.max(row)
    else:
        chosen = F.max_by(row, F.struct(*[F.col(c) for c in order]))
    return changes.groupBy(F.col(key).alias("_key")).agg(chosen.alias("_row")).select("_row.*")


def net_changes(
    changes: DataFrame,
    key: str,
    insert_ops: Collection[str] = INSERT_CREATED,
    order: Sequence[str] = ("basetime", "sequence"),
) -> DataFrame:
    """What applying all changes of each key, in order, comes to.

    One row per key, the last, with ``_deleted`` (some change deletes, so no older row is
    left) and ``_inserts`` (whether the last change that deletes or inserts does the
    latter; NULL without one). Rows without a key match nothing: they stay as they are.
    """
    deletes, inserts = _is(F.col("op"), {"d"}), _is(F.col("op"), insert_ops)
    at = F.struct(*[F.col(c) for c in order])
    row = F.struct(*[F.col(c) for c in changes.columns])
    reduced = (
        changes.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(
            F.max_by(row, at).alias("_row"),
            F.max(deletes).alias(DELETED),
            F.max_by(inserts, F.when(deletes | inserts, at)).alias(INSERTS),
        )
        .select("_row.*", DELETED, INSERTS)
    )
    keyless = changes.where(F.col(key).isNull()).select("*", F.lit(False).alias(DELETED), inserts.alias(INSERTS))
    return reduced.unionByName(keyless)


def folded(batches: DataFrame, key: str, batch: str) -> DataFrame:
    """The net changes of several batches of net changes, numbered by ``batch``."""
    columns = [c for c in batches.columns if c not in (batch, DELETED, INSERTS)]
    row = F.struct(*[F.col(c) for c in columns])
    by_key = (
        batches.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(
            F.max_by(row, F.col(batch)).alias("_row"),
            F.max(DELETED).alias(DELETED),
            F.max_by(F.col(INSERTS), F.when(F.col(INSERTS).isNotNull(), F.col(batch))).alias(INSERTS),
        )
        .select("_row.*", DELETED, INSERTS)
    )
    return by_key.unionByName(batches.where(F.col(key).isNull()).select(*columns, DELETED, INSERTS))


def _is(op: Column, wanted: Collection[str]) -> Column:
    return F.coalesce(op.isin(*wanted), F.lit(False))


def _once(changes: DataFrame, key: str) -> DataFrame:
    """One of the changes of each key, with how many the key has."""
    row = F.struct(*[F.col(c) for c in changes.columns])
    return (
        changes.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_key"))
        .agg(F.any_value(row).alias("_row"), F.count(F.lit(1)).alias("_copies"))
        .select("_row.*", "_copies")
    )


def _replaced(target: DataFrame, changes: DataFrame, matched: Column) -> list[Column]:
    """Target columns by name, taken from the change where there is one.

    A target column the changes do not carry keeps its value.
    """
    given = set(changes.columns)
    return [
        (
            F.when(matched, F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`"))
            if c in given
            else F.col(f"t.`{c}`")
        ).alias(c)
        for c in target.columns
    ]


def merge_parts(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    insert_ops: Collection[str] = INSERT_CREATED,
    keys_repeat: bool = False,
    few: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``target`` after ``changes``: rows that remain, and new rows.

    A matched row is deleted by ``op = 'd'`` and updated by anything else; an
    unmatched change is inserted if its ``op`` is one of ``insert_ops`` and ignored
    otherwise. Net changes say so themselves, and may do both: delete what is there and
    insert. ``changes`` hold one row per key unless ``keys_repeat``: then a target
    row that several changes match raises, and changes to an unknown key are inserts
    of their own.

    The target is the left side of every join it is in, where AQE can split a key,
    or the rows without one, that many target rows share; a full outer join could not.
    With ``few`` the changes must fit in memory, and the target is not shuffled.
    """
    if DELETED not in changes.columns:
        op = F.col("op")
        changes = changes.withColumns({DELETED: _is(op, {"d"}), INSERTS: _is(op, insert_ops)})
    single = _once(changes, key) if keys_repeat else changes
    sent = F.broadcast(single) if few else single
    t = target.alias("t")
    s = sent.withColumn("_s", F.lit(True)).alias("s")
    changed = F.col("_s").isNotNull()
    stays = ~(changed & F.coalesce(F.col(f"s.{DELETED}"), F.lit(False)))
    if keys_repeat:
        shown = F.col(f"t.{key}").cast("string")
        clash = F.raise_error(
            F.concat(F.lit(f"several changes match one row: {key} = "), shown)
        )
        stays = F.when(F.col("s._copies") > 1, clash.cast("boolean")).otherwise(stays)
    kept = (
        t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "left")
        .where(stays)
        .select(*_replaced(target, changes, changed))
    )
    keys = single.select(key)
    known = target.select(key).join(F.broadcast(keys) if few else keys, key, "left_semi").distinct()
    absent = [f for f in target.schema if f.name not in changes.columns]
    # an insert after a delete is new whether or not its key was known
    matched = F.when(~F.col(DELETED), F.col(key))
    new = (
        changes.where(F.coalesce(F.col(INSERTS), F.lit(False)))
        .withColumn("_known", matched)
        .join(known.select(F.col(key).alias("_known")), "_known", "left_anti")
        .withColumns({f.name: F.lit(None).cast(f.dataType) for f in absent})
        .select(*target.columns)
    )
    return kept, new


def merge_changes(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    insert_ops: Collection[str] = INSERT_CREATED,
    keys_repeat: bool = False,
) -> DataFrame:
    """``target``, whose rows may share a key, after ``changes``; see ``merge_parts``."""
    kept, new = merge_parts(target, changes, key, insert_ops, keys_repeat)
    return kept.unionByName(new)


def with_slot(frame: DataFrame, key: str) -> DataFrame:
    """``frame`` with a hash of each row's key; of the row itself where it has none, so that
    such rows are scattered."""
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in frame.columns])
    slot = F.when(F.col(f"`{key}`").isNull(), whole).otherwise(F.xxhash64(f"`{key}`"))
    return frame.withColumn(SLOT, slot)


def merge_once(
    target: DataFrame, changes: DataFrame, key: str, insert_ops: Collection[str] = INSERT_CREATED
) -> DataFrame:
    """``target`` after ``changes`` in a single join, which reads each side once.

    No two rows of ``target`` share a key, and ``changes`` hold one row per key. What each
    change does is as in :func:`merge_parts`. A full outer join gives both the rows that
    remain and those that are new; a key that is deleted and then inserted again takes part
    twice, the second time with nothing to match. Where ``target`` is a table from
    :func:`tidemill.sinks.files.save_bucketed`, it is neither shuffled nor hashed again.
    """
    if DELETED not in changes.columns:
        op = F.col("op")
        changes = changes.withColumns({DELETED: _is(op, {"d"}), INSERTS: _is(op, insert_ops)})
    if SLOT not in target.columns:
        target = with_slot(target, key)
    kinds = {f.name: f.dataType for f in target.schema}
    given = [c for c in changes.columns if c in kinds and c != SLOT]
    deleted, inserts = (F.coalesce(F.col(c), F.lit(False)) for c in (DELETED, INSERTS))
    typed = changes.select(*(F.col(f"`{c}`").cast(kinds[c]).alias(c) for c in given), deleted.alias(DELETED), inserts.alias(INSERTS))
    again = F.explode(F.when(F.col(DELETED) & F.col(INSERTS), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    sent = with_slot(typed.withColumn("_again", again), key)
    sent = sent.withColumn("_key", F.when(~F.col("_again"), F.col(f"`{key}`")))
    t, s = target.alias("t"), sent.alias("s")
    held, changed = F.col(f"t.{SLOT}").isNotNull(), F.col(f"s.{SLOT}").isNotNull()
    stays = F.when(held, ~F.coalesce(F.col(f"s.{DELETED}"), F.lit(False))).otherwise(
        F.col(f"s.{INSERTS}") & (F.col("s._again") | ~F.col(f"s.{DELETED}"))
    )
    columns = [
        (F.when(changed, F.col(f"s.`{c}`")).otherwise(F.col(f"t.`{c}`")) if c in given else F.col(f"t.`{c}`")).alias(c)
        for c in target.columns
        if c != SLOT
    ]
    matched = (F.col(f"t.{SLOT}") == F.col(f"s.{SLOT}")) & (F.col(f"t.`{key}`") == F.col("s._key"))
    return t.join(s, matched, "full_outer").where(stays).select(*columns)
