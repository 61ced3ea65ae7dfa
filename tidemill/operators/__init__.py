from tidemill.operators.changes import folded, latest_per_key, merge_changes, merge_parts, net_changes
from tidemill.operators.cleanse import (
    cast_columns,
    column_types,
    drop_columns,
    fill_nulls,
    rename_columns,
)
from tidemill.operators.joins import dimension, require_unique
from tidemill.operators.profile import profile
from tidemill.operators.union import tagged, union_all_by_name

__all__ = [
    "cast_columns",
    "column_types",
    "dimension",
    "drop_columns",
    "fill_nulls",
    "folded",
    "latest_per_key",
    "merge_changes",
    "merge_parts",
    "net_changes",
    "profile",
    "rename_columns",
    "require_unique",
    "tagged",
    "union_all_by_name",
]
