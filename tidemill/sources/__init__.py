from tidemill.sources.events import EventSource, Positions, event_bodies
from tidemill.sources.files import read_csv_strings, read_parquet_tables, table_name_of
from tidemill.sources.catalog import project, refresh, schema_of

__all__ = [
    "EventSource",
    "Positions",
    "event_bodies",
    "project",
    "read_csv_strings",
    "read_parquet_tables",
    "refresh",
    "schema_of",
    "table_name_of",
]
