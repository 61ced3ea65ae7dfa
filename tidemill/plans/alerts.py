"""Connector status messages that need attention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connector_alerts(statuses: DataFrame, status: str = "status") -> DataFrame:
    """Messages that are an error payload, or whose first task has failed."""
    error = F.get_json_object(status, "$.error_code")
    state = F.get_json_object(status, "$.tasks[0].state")
    return statuses.where(error.isNotNull() | (state == "FAILED"))
