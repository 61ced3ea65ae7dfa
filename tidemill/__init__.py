"""Lakehouse pipelines on plain PySpark: cleaning, profiling, star-join reports,
change-data capture and generated tables, all as DataFrame-to-DataFrame operators."""

__version__ = "0.1.0"
