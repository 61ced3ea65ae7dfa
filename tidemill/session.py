"""Session settings the plans rely on, and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import SparkSession

# Runtime settings only, so they can be applied to a session somebody else built.
# forceOptimizeSkewedJoin matters here: a rollup grouped by its join key would
# otherwise reuse the join's partitioning and keep AQE from splitting a hot key.
RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}

# How much a task reads, as (Spark's default, ours); a session that names another size keeps
# it. Sizes are of compressed bytes: the wide rows of the report's rollups take many times as
# much in the memory of an aggregate.
READ_SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("64MB", "16MB"),
    "spark.sql.files.maxPartitionBytes": ("128MB", "16MB"),
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to ``spark`` and return it."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    for name, (default, value) in READ_SIZES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or the context's
    checkpoint directory where the setting is absent."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


_made: set[str] = set()
_named: set[str] = set()


def workspace(spark: SparkSession, name: str) -> str:
    """A new, empty path under the shared folder for one run of ``name``. It is deleted
    by :func:`clean`, at the latest when the driver exits."""
    path = f"{shared_folder(spark)}/tidemill/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean_at_exit)
    _made.add(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a workspace, wherever the shared folder is."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made.discard(path)


def scratch_table(name: str) -> str:
    """``name``, of a catalog table that :func:`clean` drops."""
    _named.add(name)
    return name


def clean(spark: SparkSession) -> None:
    """Remove every workspace and scratch table this driver made."""
    for name in list(_named):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _named.discard(name)
    for path in list(_made):
        delete(spark, path)


def _clean_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None:
        clean(spark)
