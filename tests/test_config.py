import json

import pytest

from tidemill.config import FillValues, LoadConfig

DOCUMENT = {
    "tablenames": ["Address", "Product"],
    "sourceDir": "/bronze",
    "fileBasedDir": "/files",
    "sinkDir": "/silver",
    "nullHandling": {"Address": ["City"], "Product": []},
    "dropColumns": {"Address": ["rowguid"], "Product": []},
    "replaceNullValue": {
        "string": "n/a", "timestamp": "1900-01-01", "boolean": "True", "numeric": "0"
    },
}


def test_document_keys():
    config = LoadConfig.from_document(DOCUMENT)
    assert config.tables == ["Address", "Product"]
    assert config.input_dir() == "/bronze"
    assert config.input_dir(file_based=True) == "/files"
    assert config.fill_values == FillValues("n/a", "1900-01-01", True, 0)


def test_read_from_path(spark, tmp_path):
    path = tmp_path / "config.json"
    path.write_text(json.dumps(DOCUMENT, indent=2))
    assert LoadConfig.read(spark, str(path)) == LoadConfig.from_document(DOCUMENT)


def test_rejects_unknown_tables_and_missing_folder():
    with pytest.raises(ValueError, match="Order"):
        LoadConfig(["Address"], "/a", "/b", fill_columns={"Order": ["x"]})
    with pytest.raises(ValueError, match="fileBasedDir"):
        LoadConfig(["Address"], "/a", "/b").input_dir(file_based=True)
