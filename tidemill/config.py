"""The configuration document a load runs from."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class FillValues:
    """Replacement for NULL, by the kind of column it stands in."""

    string: str = ""
    timestamp: str = "1900-01-01 00:00:00"
    boolean: bool = False
    numeric: float = 0

    @classmethod
    def from_document(cls, document: Mapping[str, Any]) -> FillValues:
        boolean = document["boolean"]
        if isinstance(boolean, str):
            boolean = boolean.strip().lower() == "true"
        numeric = document["numeric"]
        if isinstance(numeric, str):
            numeric = float(numeric) if "." in numeric else int(numeric)
        return cls(document["string"], document["timestamp"], boolean, numeric)


@dataclass(frozen=True)
class LoadConfig:
    """Which tables to load, from where, and how to clean them."""

    tables: Sequence[str]
    source_dir: str
    sink_dir: str
    file_based_dir: str | None = None
    fill_columns: Mapping[str, Sequence[str]] = field(default_factory=dict)
    drop_columns: Mapping[str, Sequence[str]] = field(default_factory=dict)
    fill_values: FillValues = field(default_factory=FillValues)

    def __post_init__(self) -> None:
        known = set(self.tables)
        for section in (self.fill_columns, self.drop_columns):
            unknown = set(section) - known
            if unknown:
                raise ValueError(f"configured for tables that are not loaded: {sorted(unknown)}")

    def input_dir(self, file_based: bool = False) -> str:
        if not file_based:
            return self.source_dir
        if not self.file_based_dir:
            raise ValueError("a file-based load needs fileBasedDir")
        return self.file_based_dir

    @classmethod
    def from_document(cls, document: Mapping[str, Any]) -> LoadConfig:
        """Build from the JSON document's own key names."""
        return cls(
            tables=list(document["tablenames"]),
            source_dir=document["sourceDir"],
            sink_dir=document["sinkDir"],
            file_based_dir=document.get("fileBasedDir"),
            fill_columns=document.get("nullHandling", {}),
            drop_columns=document.get("dropColumns", {}),
            fill_values=FillValues.from_document(document["replaceNullValue"]),
        )

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> LoadConfig:
        """Read the JSON document from any path Spark can open."""
        text = spark.read.text(path, wholetext=True).first()
        if text is None:
            raise ValueError(f"{path} is empty")
        return cls.from_document(json.loads(text.value))
