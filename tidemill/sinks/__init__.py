from tidemill.sinks.files import (
    LoadAudit,
    append_managed,
    append_parquet,
    append_to_zones,
    overwrite_managed,
    overwrite_parquet,
    overwrite_partitioned,
    spread_by,
    write_profile_csv,
)
from tidemill.sinks.streams import archive_bodies, start_batches

__all__ = [
    "LoadAudit",
    "append_managed",
    "append_parquet",
    "append_to_zones",
    "archive_bodies",
    "overwrite_managed",
    "overwrite_parquet",
    "overwrite_partitioned",
    "spread_by",
    "start_batches",
    "write_profile_csv",
]
