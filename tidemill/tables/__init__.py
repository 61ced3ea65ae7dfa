from tidemill.tables.keyed import KeyedTable
from tidemill.tables.snapshot import SnapshotTable, describe_extended

__all__ = ["KeyedTable", "SnapshotTable", "describe_extended"]
