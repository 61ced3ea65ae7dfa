"""Row changes, change events and change streams."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill import adapters
from tidemill.adapters import ADDRESS, ADDRESS_KEY, CULTURE, CULTURE_KEY
from tidemill.operators.changes import (
    INSERT_CREATED,
    INSERT_CREATED_OR_UPDATED,
    latest_per_key,
    merge_changes,
    merge_once,
    net_changes,
)
from tidemill.registry import sales
from tidemill.registry.query import Query
from tidemill.session import scratch_table, workspace
from tidemill.sinks.files import overwrite_partitioned, save_bucketed
from tidemill.sinks.streams import archive_bodies
from tidemill.sources.events import EventSource, Positions, event_bodies
from tidemill.streaming.apply import Target, stream_into_many, stream_into_one, stream_per_table
from tidemill.streaming.deliveries import first_deliveries, late_events
from tidemill.streaming.envelope import decode, row_image, typed_changes, with_event_time
from tidemill.streaming.variant import parsed, variant_changes
from tidemill.tables.keyed import KeyedTable
from tidemill.tables.snapshot import SnapshotTable, describe_extended

PARTS = 6  # of an event log that is delivered out of order
NEW_YEAR = "timestamp '2024-01-01 00:00:00'"


# -- row changes on a table -----------------------------------------------------------


def _customer_addresses(spark: SparkSession, folder: str) -> SnapshotTable:
    rows = adapters.sales_tables(spark, folder)["CustomerAddress"]
    return SnapshotTable.create(rows, workspace(spark, "customer_address"), "CustomerId")


def insert(spark: SparkSession, folder: str) -> DataFrame:
    table = _customer_addresses(spark, folder)
    new = adapters.table(spark, folder, "supplier").selectExpr(
        "s_suppkey as CustomerId",
        "s_nationkey as AddressId",
        "'Warehouse' as AddressType",
        f"{NEW_YEAR} as ModifiedDate",
    )
    table.insert(new)
    table.insert_values(-40, 7, "Depot", F.expr(NEW_YEAR))
    return table.read()


def update(spark: SparkSession, folder: str) -> DataFrame:
    table = _customer_addresses(spark, folder)
    table.update(F.col("AddressType") == "Shipping", {"AddressType": "Harbour"})
    table.update(F.col("CustomerId") == 7, {"AddressId": -1}, keys=[7])
    return table.read()


def delete(spark: SparkSession, folder: str) -> DataFrame:
    table = _customer_addresses(spark, folder)
    table.delete(F.col("AddressType") == "Main Office")
    return table.read()


def described(spark: SparkSession, folder: str) -> DataFrame:
    """Column names and types that the catalog gives for a table kept by name."""
    table = _customer_addresses(spark, folder)
    with _database(spark) as database:
        table.publish(f"{database}.customer_address")
        facts = describe_extended(spark, f"{database}.customer_address").collect()
    columns = [(r.col_name, r.data_type) for r in facts[: len(table.schema)]]
    keys = table.read().select(F.count("CustomerId").alias("n_rows"))
    return spark.createDataFrame(columns, "col_name string, data_type string").crossJoin(F.broadcast(keys))


@contextlib.contextmanager
def _database(spark: SparkSession) -> Iterator[str]:
    """A database that is dropped with what is in it."""
    root = workspace(spark, "database")
    name = f"changes_{root.rsplit('-', 1)[1]}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{root}'")
    try:
        yield name
    finally:
        spark.sql(f"DROP DATABASE {name} CASCADE")


# -- change events as a batch ---------------------------------------------------------


def extract(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decode(adapters.bodies(spark, folder))
    return decoded.select(
        "sequence",
        "op",
        "schemaname",
        "basetime",
        F.col("before").isNotNull().alias("has_before"),
        F.col("after").isNotNull().alias("has_after"),
    )


def image(spark: SparkSession, folder: str) -> DataFrame:
    images = row_image(decode(adapters.bodies(spark, folder)))
    key = F.coalesce(
        F.get_json_object("data", f"$.{ADDRESS_KEY}"), F.get_json_object("data", f"$.{CULTURE_KEY}")
    )
    return images.select(
        "sequence", "op", key.alias("row_key"), F.get_json_object("data", "$.ModifiedDate").alias("modified")
    )


def _images(spark: SparkSession, folder: str, one_table: bool = False) -> DataFrame:
    return row_image(decode(adapters.bodies(spark, folder, one_table)))


def _address_changes(spark: SparkSession, folder: str, one_table: bool = False) -> DataFrame:
    schema = adapters.target_schemas(spark, folder)[ADDRESS]
    return typed_changes(_images(spark, folder, one_table), schema, ADDRESS)


def _culture_changes(spark: SparkSession, folder: str) -> DataFrame:
    schema = adapters.target_schemas(spark, folder)[CULTURE]
    return typed_changes(_images(spark, folder), schema, CULTURE)


def typed(spark: SparkSession, folder: str) -> DataFrame:
    schema = adapters.target_schemas(spark, folder)[ADDRESS]
    return with_event_time(typed_changes(_images(spark, folder, one_table=True), schema))


def latest(spark: SparkSession, folder: str) -> DataFrame:
    return latest_per_key(_address_changes(spark, folder), ADDRESS_KEY)


def latest_op_first(spark: SparkSession, folder: str) -> DataFrame:
    changes = _culture_changes(spark, folder).drop("sequence")
    return latest_per_key(changes, CULTURE_KEY, op_first=True)


def merged(insert_ops: frozenset[str]):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        changes = net_changes(_address_changes(spark, folder), ADDRESS_KEY, insert_ops)
        return merge_once(adapters.address_target(spark, folder), changes, ADDRESS_KEY, insert_ops)

    return build


def merged_repeated(spark: SparkSession, folder: str) -> DataFrame:
    """Changes to a target in which rows share keys: each row of a key is changed."""
    target = adapters.address_target(spark, folder)
    target = target.unionByName(target.where(F.col(ADDRESS_KEY) % 2 == 0).withColumn("City", F.lit("second")))
    changes = net_changes(_address_changes(spark, folder), ADDRESS_KEY, INSERT_CREATED)
    return merge_changes(target, changes, ADDRESS_KEY, INSERT_CREATED)


def merged_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The merge into a bucketed table of the catalog, which is not shuffled."""
    root = workspace(spark, "merged_bucketed")
    name = scratch_table(f"changes_bucketed_{root.rsplit('-', 1)[1]}")
    save_bucketed(adapters.address_target(spark, folder), name, ADDRESS_KEY, path=f"{root}/{name}")
    changes = net_changes(_address_changes(spark, folder), ADDRESS_KEY, INSERT_CREATED)
    return staged_copy(merge_once(spark.table(name), changes, ADDRESS_KEY, INSERT_CREATED), f"{root}/result")


def _merged_table(spark: SparkSession, folder: str) -> SnapshotTable:
    table = SnapshotTable.create(
        adapters.address_target(spark, folder), workspace(spark, "address"), ADDRESS_KEY
    )
    table.merge(net_changes(_address_changes(spark, folder), ADDRESS_KEY), INSERT_CREATED)
    return table


def merged_table(spark: SparkSession, folder: str) -> DataFrame:
    return _merged_table(spark, folder).read()


def merged_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """The merged rows, read by their name in the catalog."""
    table = _merged_table(spark, folder)
    with _database(spark) as database:
        table.publish(f"{database}.address")
        rows = spark.table(f"{database}.address").where("City is not null").select("*")
        return staged_copy(rows, workspace(spark, "merged_by_name"))


def replaced_partitions(spark: SparkSession, folder: str) -> DataFrame:
    """Two months of a partitioned table replaced by name, with a column the table got after
    it was written, and a new partition; the other months stay."""
    root = workspace(spark, "partitions")
    name = scratch_table(f"changes_orders_{root.rsplit('-', 1)[1]}")
    orders = adapters.table(spark, folder, "orders").select("o_orderkey", "o_totalprice", F.month("o_orderdate").alias("month"))
    overwrite_partitioned(orders, f"{root}/{name}", ["month"], table=name)
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS (note string)")
    fixed = orders.where(F.col("month").isin(2, 5) & (F.col("o_totalprice") >= 100000)).withColumn("note", F.lit("corrected"))
    added = orders.where("o_orderkey < 100").withColumns({"month": F.lit(13), "note": F.lit("new")})
    overwrite_partitioned(fixed.unionByName(added), f"{root}/{name}", ["month"], only_touched=True, table=name)
    return spark.table(name).select("o_orderkey", "o_totalprice", "note", "month")


def staged_copy(frame: DataFrame, path: str) -> DataFrame:
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def decimals(spark: SparkSession, folder: str) -> DataFrame:
    """Amounts of many digits, through change events and back."""
    lines = adapters.table(spark, folder, "orders").selectExpr(
        "o_orderkey as sequence",
        "cast(o_orderkey as decimal(15,0)) * 100000000 + 12345678 + cast(o_custkey as decimal(19,4)) / 10000 as Amount",
    )
    lines = lines.select("sequence", F.col("Amount").cast("decimal(19,4)").alias("Amount"))
    source = '"source": {"schema": "Sales", "table": "Order", "ts_ms": 1}'
    body = F.concat(F.lit('{"before": null, "after": {"Amount": '), F.col("Amount").cast("string"), F.lit(f'}}, "op": "c", {source}}}'))
    bodies = lines.select("sequence", body.alias("Body"))
    changes = typed_changes(row_image(decode(bodies)), lines.select("Amount").schema, "Sales.Order")
    return changes.select("sequence", F.col("Amount").cast("string").alias("amount"))


def decimals_by_variant(spark: SparkSession, folder: str) -> DataFrame:
    """The amounts, by VARIANT, with the field that the target lacks."""
    lines = adapters.table(spark, folder, "orders").selectExpr(
        "o_orderkey as sequence",
        "cast(cast(o_orderkey as decimal(15,0)) * 100000000 + 12345678 + cast(o_custkey as decimal(19,4)) / 10000 as decimal(19,4)) as Amount",
        "o_orderstatus as status",
    )
    fields = F.concat(F.lit('{"Amount": '), F.col("Amount").cast("string"), F.lit(', "status": "'), F.col("status"), F.lit('"}'))
    source = '"source": {"schema": "Sales", "table": "Order", "ts_ms": 1}'
    bodies = lines.select("sequence", F.concat(F.lit('{"before": null, "after": '), fields, F.lit(f', "op": "c", {source}}}')).alias("Body"))
    changes = variant_changes(parsed(bodies), lines.select("Amount").schema, "Sales.Order", rest="rest")
    return changes.select("sequence", F.col("Amount").cast("string").alias("amount"), "rest")


def demultiplexed(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of both tables out of events parsed once."""
    events = staged_copy(parsed(adapters.bodies(spark, folder)), workspace(spark, "parsed"))
    schemas = adapters.target_schemas(spark, folder)
    addresses = variant_changes(events, schemas[ADDRESS], ADDRESS)
    cultures = variant_changes(events, schemas[CULTURE], CULTURE)
    named = (ADDRESS, addresses, ADDRESS_KEY, "AddressLine1"), (CULTURE, cultures, CULTURE_KEY, "Name")
    first, second = (
        rows.select(F.lit(target).alias("target"), "op", "basetime", "sequence", F.col(key).cast("string").alias("row_key"), F.col(name).alias("name"), "ModifiedDate")
        for target, rows, key, name in named
    )
    return first.unionByName(second)


# -- change events as streams ---------------------------------------------------------


def _targets(spark: SparkSession, folder: str, root: str) -> list[Target]:
    targets = [
        Target(ADDRESS, f"{root}/{ADDRESS}", ADDRESS_KEY),
        Target(CULTURE, f"{root}/{CULTURE}", CULTURE_KEY),
    ]
    SnapshotTable.create(adapters.address_target(spark, folder), targets[0].path, ADDRESS_KEY)
    SnapshotTable.create(adapters.culture_target(spark, folder), targets[1].path, CULTURE_KEY)
    return targets


def stream_one(spark: SparkSession, folder: str) -> DataFrame:
    root = workspace(spark, "stream_one")
    target = _targets(spark, folder, root)[0]
    stream = adapters.body_stream(spark, folder, one_table=True)
    stream_into_one(stream, target, f"{root}/checkpoint", available_now=True).awaitTermination()
    return SnapshotTable(spark, target.path).read()


def write_in_order(events: DataFrame, order: list[str], parts: int, path: str, cut: str, file_rows: int = 500_000) -> int:
    """Write equal parts of the events to ``path``, one after the other in ``order``; returns the
    number of files, which is the same for each. Events are sorted in slices, side by side, and
    numbered by what the slices before hold."""
    slices = staged_copy(events.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), f"{cut}/slices")
    sizes = slices.groupBy("_slice").agg(F.count("*").alias("n")).orderBy("_slice").collect()  # a row per slice
    before, total = {}, 0
    for size in sizes:
        before[size._slice], total = total, total + size.n
    offsets = events.sparkSession.createDataFrame(list(before.items()), "_slice int, _before long")
    at = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    numbered = slices.join(F.broadcast(offsets), "_slice").withColumn("_at", F.col("_before") + at - 1)
    numbered = staged_copy(numbered.select(*events.columns, "_at"), f"{cut}/numbered")
    base, more = divmod(total, parts)
    files, start = 1 + base // file_rows, 0
    for part in range(parts):
        size = base + (part < more)
        own = numbered.where(F.col("_at").between(start, start + size - 1))
        place = F.expr(f"cast((_at - {start}) * {files} div {max(size, 1)} as int)")
        own.repartitionById(files, place).select(*events.columns).write.mode("append").parquet(path)
        start += size
    return files


def stream_batches(spark: SparkSession, folder: str) -> DataFrame:
    """The events in many batches: rows and order are those of one."""
    root = workspace(spark, "stream_batches")
    target = _targets(spark, folder, root)[0]
    events = adapters.table(spark, folder, "events")
    files = write_in_order(events, ["ts", "event_id"], 5, f"{root}/log", f"{root}/cut")
    log = EventSource("parquet", f"{root}/log", {"maxFilesPerTrigger": str(files)}, schema=adapters.SCHEMAS["events"])
    bodies = event_bodies(adapters.change_events(log.stream(spark), one_table=True), sequence="sequence")
    stream_into_one(bodies, target, f"{root}/checkpoint", available_now=True).awaitTermination()
    return SnapshotTable(spark, target.path).read()


def null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Rows without a key, after a stream has brought some."""
    return stream_one(spark, folder).where(F.col(ADDRESS_KEY).isNull())


def _both(spark: SparkSession, targets: list[Target]) -> DataFrame:
    return _named(*(SnapshotTable(spark, t.path).read() for t in targets))


def _named(addresses: DataFrame, cultures: DataFrame) -> DataFrame:
    return addresses.selectExpr(
        f"'{ADDRESS}' as target", f"cast({ADDRESS_KEY} as string) as row_key",
        "AddressLine1 as name", "ModifiedDate",
    ).unionByName(
        cultures.selectExpr(
            f"'{CULTURE}' as target", f"{CULTURE_KEY} as row_key", "Name as name", "ModifiedDate"
        )
    )


def stream_many(op_first: bool = False):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        root = workspace(spark, "stream_many")
        targets = _targets(spark, folder, root)
        stream = adapters.body_stream(spark, folder)
        stream_into_many(
            stream, targets, f"{root}/checkpoint", op_first=op_first, available_now=True
        ).awaitTermination()
        return _both(spark, targets)

    return build


def streams_per_table(spark: SparkSession, folder: str) -> DataFrame:
    root = workspace(spark, "streams_per_table")
    targets = _targets(spark, folder, root)
    queries = stream_per_table(
        lambda: adapters.body_stream(spark, folder), targets, f"{root}/checkpoint", available_now=True
    )
    for query in queries:
        query.awaitTermination()
    return _both(spark, targets)


def _log(spark: SparkSession, folder: str, root: str, deliver, order, one_table: bool = True, within: Positions | None = None) -> DataFrame:
    """The event log cut by time into ``PARTS``, and delivered in files of one batch each:
    ``deliver`` says in which files a row comes, ``order`` which file comes when."""
    events = adapters.table(spark, folder, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(micros), F.max(micros)).first()
    part = F.least(F.floor(PARTS * (micros - first) / (last - first + 1)), F.lit(PARTS - 1)).cast("int")
    cut = events.withColumn("part", part).withColumn("file", F.explode(deliver(F.col("part"), F.col("event_id")))).drop("part")
    cut = staged_copy(cut, f"{root}/cut")
    for number in order:
        cut.where(F.col("file") == number).drop("file").coalesce(1).write.mode("append").parquet(f"{root}/log")
    log = EventSource("parquet", f"{root}/log", {"maxFilesPerTrigger": "1"}, schema=adapters.SCHEMAS["events"], within=within)
    return event_bodies(adapters.change_events(log.stream(spark), one_table), sequence="sequence")


def _keyed(spark: SparkSession, folder: str, root: str) -> list[Target]:
    """Targets that take changes in any order."""
    run = root.rsplit("-", 1)[1]
    targets = []
    for name, key, rows in ((ADDRESS, ADDRESS_KEY, adapters.address_target), (CULTURE, CULTURE_KEY, adapters.culture_target)):
        table = scratch_table(f"changes_{name.replace('.', '_').lower()}_{run}")
        KeyedTable.create(rows(spark, folder), table, key, path=f"{root}/{table}")
        targets.append(Target(name, None, key, table=table))
    return targets


def stream_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The events in batches that come out of order, some of them twice."""
    root = workspace(spark, "stream_shuffled")
    target = _keyed(spark, folder, root)[0]
    bodies = _log(
        spark, folder, root, order=(3, 0, 5, 1, 4, 2),
        deliver=lambda part, event: F.when(event % 9 == 4, F.array(part, F.pmod(part + 3, F.lit(PARTS)))).otherwise(F.array(part)),
    )
    stream_into_one(bodies, target, f"{root}/checkpoint", available_now=True).awaitTermination()
    return staged_copy(KeyedTable(spark, target.table).read(), f"{root}/result")


def stream_side_by_side(spark: SparkSession, folder: str) -> DataFrame:
    """Two tables fed by one stream whose batches come out of order, written side by side."""
    root = workspace(spark, "stream_side_by_side")
    targets = _keyed(spark, folder, root)
    bodies = _log(spark, folder, root, lambda part, event: F.array(part), (4, 1, 0, 3, 2, 5), one_table=False)
    stream_into_many(bodies, targets, f"{root}/checkpoint", available_now=True, workers=2).awaitTermination()
    addresses, cultures = (KeyedTable(spark, t.table).read() for t in targets)
    return staged_copy(_named(addresses, cultures), f"{root}/result")


def deduplicated(spark: SparkSession, folder: str) -> DataFrame:
    """Events of which some are delivered again a batch later, and some of the first come last:
    each once but for those, and how many came too late."""
    root = workspace(spark, "deduplicated")
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    span = adapters.table(spark, folder, "events").agg(F.max(at) - F.min(at)).first()[0]
    bodies = _log(
        spark, folder, root, order=range(PARTS),
        deliver=lambda part, event: F.when((part == 0) & (event % 50 == 7), F.array(F.lit(PARTS - 1)))
        .when((event % 10 == 3) & (part < PARTS - 1), F.array(part, part + 1)).otherwise(F.array(part)),
    )
    told = first_deliveries(row_image(decode(bodies)), f"{max(1, span // 3)} seconds").select("sequence", "op", "schemaname", "basetime")
    query = told.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/told")
    query.awaitTermination()
    late = spark.range(1).select(F.lit(late_events(query)).cast("bigint").alias("late"))
    return spark.read.parquet(f"{root}/told").unionByName(late, allowMissingColumns=True)


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """The second quarter of the events, by their numbers, out of a stream of all."""
    root = workspace(spark, "positions")
    first, last = adapters.table(spark, folder, "events").agg(F.min("event_id"), F.max("event_id")).first()
    within = Positions("event_id", first + (last - first) // 4, first + (last - first) // 2)
    bodies = _log(spark, folder, root, lambda part, event: F.array(part), range(PARTS), within=within)
    archive_bodies(bodies, f"{root}/bodies", f"{root}/checkpoint", available_now=True).awaitTermination()
    return decode(spark.read.parquet(f"{root}/bodies")).select("sequence", "op", "schemaname")


def archive(spark: SparkSession, folder: str) -> DataFrame:
    root = workspace(spark, "archive")
    stream = adapters.body_stream(spark, folder)
    archive_bodies(stream, f"{root}/bodies", f"{root}/checkpoint", available_now=True).awaitTermination()
    return decode(spark.read.parquet(f"{root}/bodies")).select("sequence", "op", "schemaname")


# -- the same in SQL ------------------------------------------------------------------


def _changes(one_table: bool = False) -> str:
    is_address = "true" if one_table else "value >= 25"
    odd = f"event_id % {adapters.ODD_EVERY}"
    table = f"CASE WHEN {is_address} THEN 'Person.Address' ELSE 'Production.Culture' END"
    if not one_table:
        table = f"""CASE WHEN {odd} <> {adapters.NO_TABLE} THEN {table}
              WHEN {is_address} THEN 'Person.Unknown' ELSE 'Production.Unknown' END"""
    return f"""
readable AS (
  SELECT event_id AS sequence,
         CASE WHEN {odd} = {adapters.NO_OP} THEN NULL
              WHEN {odd} = {adapters.UNKNOWN_KEY} OR event_type = 'error' THEN 'd'
              WHEN event_type = 'signup' THEN 'c' WHEN event_type = 'purchase' THEN 'r'
              ELSE 'u' END AS op,
         {is_address} AS is_address,
         {table} AS schemaname,
         CAST(epoch_us(ts) // 1000 AS DOUBLE) AS basetime,
         CASE {odd} WHEN {adapters.NO_KEY} THEN NULL WHEN {adapters.UNKNOWN_KEY} THEN -event_id - 1
              ELSE user_id END AS AddressID,
         event_type || ' ' || value AS AddressLine1, props->>'$.k' AS City,
         CASE {odd} WHEN {adapters.NO_KEY} THEN NULL WHEN {adapters.UNKNOWN_KEY} THEN 'x' || event_id
              ELSE 'c' || (props->>'$.k') END AS CultureId, event_type AS Name, ts AS ModifiedDate
  FROM events WHERE {odd} NOT IN ({adapters.TOMBSTONE}, {adapters.JUNK})),
changes AS (
  SELECT * FROM readable UNION ALL
  SELECT * FROM readable WHERE sequence % {adapters.ODD_EVERY} = {adapters.TWICE}),
unreadable AS (
  SELECT event_id AS sequence FROM events WHERE {odd} IN ({adapters.TOMBSTONE}, {adapters.JUNK})),
address_changes AS (
  SELECT op, basetime, sequence, AddressID, AddressLine1, City, ModifiedDate
  FROM changes WHERE schemaname = 'Person.Address'),
culture_changes AS (
  SELECT op, basetime, sequence, CultureId, Name, ModifiedDate FROM changes
  WHERE schemaname = 'Production.Culture'),
latest_address AS (
  SELECT * FROM address_changes
  QUALIFY row_number() OVER (PARTITION BY AddressID ORDER BY basetime DESC, sequence DESC) = 1),
op_first_address AS (
  SELECT * EXCLUDE (sequence) FROM address_changes
  QUALIFY row_number() OVER (PARTITION BY AddressID
    ORDER BY op DESC NULLS LAST, basetime DESC, AddressLine1 DESC, City DESC, ModifiedDate DESC) = 1),
op_first_culture AS (
  SELECT * EXCLUDE (sequence) FROM culture_changes
  QUALIFY row_number() OVER (PARTITION BY CultureId
    ORDER BY op DESC NULLS LAST, basetime DESC, Name DESC, ModifiedDate DESC) = 1),
address AS (
  SELECT s_suppkey AS AddressID, s_name AS AddressLine1, CAST(s_nationkey AS VARCHAR) AS City,
         TIMESTAMP '2023-12-31 00:00:00' AS ModifiedDate FROM supplier),
culture AS (
  SELECT 'c' || p_size AS CultureId, min(p_brand) AS Name,
         TIMESTAMP '2023-12-31 00:00:00' AS ModifiedDate FROM part GROUP BY p_size)"""


def _merged(target: str, changes: str, key: str, columns: tuple[str, ...], ops: frozenset[str]) -> str:
    """One change for each key."""
    inserting = ", ".join(f"'{op}'" for op in sorted(ops))
    shown = ", ".join(
        f"CASE WHEN s.{key} IS NOT NULL OR t.{key} IS NULL THEN s.{c} ELSE t.{c} END AS {c}" for c in (key, *columns)
    )
    return f"""SELECT {shown} FROM {target} t FULL OUTER JOIN {changes} s ON t.{key} = s.{key}
      WHERE (t.{key} IS NOT NULL AND coalesce(s.op, '') <> 'd')
         OR (t.{key} IS NULL AND s.op IN ({inserting}))"""


def _in_order(target: str, changes: str, key: str, columns: tuple[str, ...], ops: frozenset[str]) -> str:
    """Every change in commit order. A key is there at the end if it was and nothing deletes
    it, or if something inserts it after the last delete; its row is the last one sent."""
    inserting = ", ".join(f"'{op}'" for op in sorted(ops))
    names = ", ".join((key, *columns))
    last = ", ".join(f"s.{c}" for c in (key, *columns))
    return f"""SELECT {names} FROM {changes} WHERE {key} IS NULL AND op IN ({inserting})
      UNION ALL
      SELECT {", ".join(f"t.{c}" for c in (key, *columns))} FROM {target} t
      WHERE NOT EXISTS (SELECT 1 FROM {changes} s WHERE s.{key} = t.{key})
      UNION ALL
      SELECT {last} FROM (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY basetime, sequence) AS pos
        FROM {changes} WHERE {key} IS NOT NULL) s
      JOIN (
        SELECT {key}, max(pos) AS last_pos, max(pos) FILTER (op = 'd') AS last_d,
               max(pos) FILTER (op IN ({inserting})) AS last_i
        FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY basetime, sequence) AS pos
              FROM {changes} WHERE {key} IS NOT NULL) GROUP BY {key}) e
        ON e.{key} = s.{key} AND e.last_pos = s.pos
      WHERE coalesce(last_i > coalesce(last_d, 0), false)
         OR (last_d IS NULL AND EXISTS (SELECT 1 FROM {target} t WHERE t.{key} = s.{key}))"""


def _once_each(target: str, changes: str, key: str, columns: tuple[str, ...], ops: frozenset[str]) -> str:
    """As :func:`_in_order`, with events that come twice counted once."""
    return _in_order(target, f"(SELECT DISTINCT * FROM {changes})", key, columns, ops)


_ADDRESS_COLUMNS = ("AddressLine1", "City", "ModifiedDate")
_CULTURE_COLUMNS = ("Name", "ModifiedDate")


def _both_sql(how, addresses: str, cultures: str, ops: frozenset[str]) -> str:
    return f"""WITH {_changes()}
      SELECT 'Person.Address' AS target, CAST(AddressID AS VARCHAR) AS row_key,
             AddressLine1 AS name, ModifiedDate
      FROM ({how("address", addresses, "AddressID", _ADDRESS_COLUMNS, ops)})
      UNION ALL
      SELECT 'Production.Culture', CultureId, Name, ModifiedDate
      FROM ({how("culture", cultures, "CultureId", _CULTURE_COLUMNS, ops)})"""


def _address_sql(ops: frozenset[str], one_table: bool = False) -> str:
    merge = _in_order("address", "address_changes", "AddressID", _ADDRESS_COLUMNS, ops)
    return f"WITH {_changes(one_table)} {merge}"


QUERIES = {
    "table_insert": Query(
        insert,
        f"""{sales.CUSTOMER_ADDRESS}
        UNION ALL SELECT s_suppkey, s_nationkey, 'Warehouse',
                         TIMESTAMP '2024-01-01 00:00:00' FROM supplier
        UNION ALL SELECT -40, 7, 'Depot', TIMESTAMP '2024-01-01 00:00:00'""",
    ),
    "table_update": Query(
        update,
        f"""SELECT CustomerId, CASE WHEN CustomerId = 7 THEN -1 ELSE AddressId END AS AddressId,
        CASE WHEN AddressType = 'Shipping' THEN 'Harbour' ELSE AddressType END AS AddressType,
        ModifiedDate FROM ({sales.CUSTOMER_ADDRESS})""",
    ),
    "table_delete": Query(
        delete,
        f"""SELECT * FROM ({sales.CUSTOMER_ADDRESS})
        WHERE AddressType <> 'Main Office' OR AddressType IS NULL""",
    ),
    "describe_extended": Query(
        described,
        f"""SELECT col_name, data_type, n_rows FROM (VALUES ('CustomerId', 'bigint'), ('AddressId', 'bigint'),
        ('AddressType', 'string'), ('ModifiedDate', 'timestamp')) AS c(col_name, data_type),
        (SELECT count(CustomerId) AS n_rows FROM ({sales.CUSTOMER_ADDRESS}))""",
    ),
    "cdc_extract": Query(
        extract,
        f"""WITH {_changes()} SELECT sequence, op, schemaname, basetime,
        coalesce(op, '') = 'd' AS has_before, coalesce(op, '') <> 'd' AS has_after FROM changes
        UNION ALL SELECT sequence, NULL, NULL, NULL, false, false FROM unreadable""",
    ),
    "cdc_row_image": Query(
        image,
        f"""WITH {_changes()} SELECT sequence, op,
        CASE WHEN is_address THEN CAST(AddressID AS VARCHAR) ELSE CultureId END AS row_key,
        strftime(ModifiedDate, '%Y-%m-%d %H:%M:%S.%f') AS modified FROM changes
        UNION ALL SELECT sequence, NULL, NULL, NULL FROM unreadable""",
    ),
    "cdc_typed": Query(
        typed,
        f"""WITH {_changes(one_table=True)}
        SELECT *, ModifiedDate AS modified_date_timestamp FROM address_changes""",
    ),
    "cdc_demux_address": Query(
        _address_changes, f"WITH {_changes()} SELECT * FROM address_changes"
    ),
    "cdc_demux_culture": Query(
        _culture_changes, f"WITH {_changes()} SELECT * FROM culture_changes"
    ),
    "cdc_latest": Query(latest, f"WITH {_changes()} SELECT * FROM latest_address"),
    "cdc_latest_op_first": Query(
        latest_op_first, f"WITH {_changes()} SELECT * FROM op_first_culture"
    ),
    "merge_strict": Query(merged(INSERT_CREATED), _address_sql(INSERT_CREATED)),
    "merge_upsert": Query(
        merged(INSERT_CREATED_OR_UPDATED), _address_sql(INSERT_CREATED_OR_UPDATED)
    ),
    "merge_bucketed": Query(merged_bucketed, _address_sql(INSERT_CREATED)),
    "merge_repeated_keys": Query(
        merged_repeated,
        f"""WITH {_changes()}, doubled AS (
          SELECT * FROM address UNION ALL SELECT * REPLACE ('second' AS City) FROM address WHERE AddressID % 2 = 0),
        once AS ({_in_order("address", "address_changes", "AddressID", _ADDRESS_COLUMNS, INSERT_CREATED)}),
        kept AS (SELECT s.* FROM once s WHERE AddressID IN (SELECT AddressID FROM address_changes) OR AddressID IS NULL)
        SELECT * FROM doubled WHERE AddressID NOT IN (SELECT AddressID FROM address_changes WHERE AddressID IS NOT NULL)
        UNION ALL SELECT * FROM kept
        UNION ALL SELECT kept.* FROM kept JOIN address a USING (AddressID) WHERE AddressID % 2 = 0
          AND AddressID NOT IN (SELECT AddressID FROM address_changes WHERE op = 'd' AND AddressID IS NOT NULL)""",
    ),
    "partitions_replaced": Query(
        replaced_partitions,
        """SELECT o_orderkey, o_totalprice, CASE WHEN extract(month FROM o_orderdate) IN (2, 5) THEN 'corrected' END AS note,
        CAST(extract(month FROM o_orderdate) AS INTEGER) AS month FROM orders
        WHERE extract(month FROM o_orderdate) NOT IN (2, 5) OR o_totalprice >= 100000
        UNION ALL SELECT o_orderkey, o_totalprice, 'new', 13 FROM orders WHERE o_orderkey < 100""",
    ),
    "merge_table": Query(merged_table, _address_sql(INSERT_CREATED)),
    "merge_by_name": Query(
        merged_by_name, f"SELECT * FROM ({_address_sql(INSERT_CREATED)}) WHERE City IS NOT NULL"
    ),
    "cdc_decimals": Query(
        decimals,
        """SELECT o_orderkey AS sequence, CAST(CAST(CAST(o_orderkey AS DECIMAL(15,0)) * 100000000 + 12345678
        + CAST(o_custkey AS DECIMAL(14,0)) * 0.0001::DECIMAL(5,4) AS DECIMAL(19,4)) AS VARCHAR) AS amount FROM orders""",
    ),
    "cdc_variant_decimals": Query(
        decimals_by_variant,
        """SELECT o_orderkey AS sequence, CAST(CAST(CAST(o_orderkey AS DECIMAL(15,0)) * 100000000 + 12345678
        + CAST(o_custkey AS DECIMAL(14,0)) * 0.0001::DECIMAL(5,4) AS DECIMAL(19,4)) AS VARCHAR) AS amount,
        '{"status":"' || o_orderstatus || '"}' AS rest FROM orders""",
    ),
    "cdc_variant_demux": Query(
        demultiplexed,
        f"""WITH {_changes()}
        SELECT 'Person.Address' AS target, op, basetime, sequence, CAST(AddressID AS VARCHAR) AS row_key, AddressLine1 AS name, ModifiedDate
        FROM address_changes
        UNION ALL SELECT 'Production.Culture', op, basetime, sequence, CultureId, Name, ModifiedDate FROM culture_changes""",
    ),
    "cdc_stream_batches": Query(stream_batches, _address_sql(INSERT_CREATED, one_table=True)),
    "cdc_null_keys": Query(
        null_keys, f"SELECT * FROM ({_address_sql(INSERT_CREATED, one_table=True)}) WHERE AddressID IS NULL"
    ),
    "cdc_stream_one": Query(stream_one, _address_sql(INSERT_CREATED, one_table=True)),
    "cdc_stream_multi": Query(
        stream_many(),
        _both_sql(_in_order, "address_changes", "culture_changes", INSERT_CREATED_OR_UPDATED),
    ),
    "cdc_stream_multi_op_first": Query(
        stream_many(op_first=True),
        _both_sql(_merged, "op_first_address", "op_first_culture", INSERT_CREATED_OR_UPDATED),
    ),
    "cdc_stream_per_table": Query(
        streams_per_table,
        _both_sql(_in_order, "address_changes", "culture_changes", INSERT_CREATED),
    ),
    "cdc_stream_shuffled": Query(stream_shuffled, _address_sql(INSERT_CREATED, one_table=True)),
    "cdc_stream_side_by_side": Query(
        stream_side_by_side, _both_sql(_once_each, "address_changes", "culture_changes", INSERT_CREATED_OR_UPDATED)
    ),
    "cdc_first_deliveries": Query(
        deduplicated,
        f"""WITH {_changes(one_table=True)},
        bounds AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events),
        timed AS (SELECT c.*, c.sequence % 50 = 7 AND (epoch_us(ModifiedDate) - a) * {PARTS} // (b - a + 1) = 0 AS late
                  FROM changes c, bounds)
        SELECT DISTINCT sequence, op, schemaname, basetime, NULL::BIGINT AS late FROM timed WHERE NOT late
        UNION ALL SELECT NULL, NULL, NULL, NULL, count(*) FILTER (late) FROM timed""",
    ),
    "cdc_positions": Query(
        positions,
        f"""WITH {_changes(one_table=True)}, bounds AS (SELECT min(event_id) AS a, max(event_id) AS b FROM events),
        listed AS (SELECT sequence, op, schemaname FROM changes UNION ALL SELECT sequence, NULL, NULL FROM unreadable)
        SELECT listed.* FROM listed, bounds WHERE sequence >= a + (b - a) // 4 AND sequence < a + (b - a) // 2""",
    ),
    "cdc_archive": Query(
        archive,
        f"""WITH {_changes()} SELECT sequence, op, schemaname FROM changes
        UNION ALL SELECT sequence, NULL, NULL FROM unreadable""",
    ),
}
