"""Run a registered query in Spark and its SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.astimezone(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _rows(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        Counter(tuple(_value(row[i]) for i in order) for row in rows),
    )


def spark_rows(frame):
    return _rows(frame.columns, frame.collect())


def sql_rows(connection, sql):
    result = connection.execute(sql)
    return _rows([d[0] for d in result.description], result.fetchall())


def difference(mine, theirs) -> str | None:
    """What differs, or None."""
    if mine[0] != theirs[0]:
        return f"columns {set(mine[0]) ^ set(theirs[0])}"
    if mine[1] != theirs[1]:
        only_mine, only_theirs = mine[1] - theirs[1], theirs[1] - mine[1]
        return (
            f"rows {sum(mine[1].values())} and {sum(theirs[1].values())}; "
            f"only Spark {list(only_mine.items())[:2]}; only SQL {list(only_theirs.items())[:2]}"
        )
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    connection = connect(folder)
    for name in names or queries:
        start = time.time()
        try:
            mine = spark_rows(queries[name](spark, folder))
            took = time.time() - start
            problem = difference(mine, sql_rows(connection, oracles[name])) if name in oracles else "no SQL"
            print(f"{name:32} {sum(mine[1].values()):8} rows {took:6.2f}s {problem or 'ok'}", flush=True)
        except Exception as error:  # noqa: BLE001
            print(f"{name:32} FAILED {str(error)[:1500]}", flush=True)
