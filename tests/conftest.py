import pytest
from pyspark.sql import SparkSession

from tidemill.session import clean, configure


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    clean(session)
    made = ("customers_", "product_", "stock_", "changes_")  # by registered queries
    names = [t.name for t in session.catalog.listTables()] + [d.name for d in session.catalog.listDatabases()]
    assert not [n for n in names if n.startswith(made)]
    session.stop()


def rows(frame, *columns):
    """Rows as a sorted list of tuples, NULL first."""
    chosen = frame.select(*columns) if columns else frame
    return sorted(
        (tuple(r) for r in chosen.collect()),
        key=lambda r: tuple((v is not None, str(type(v)), v) for v in r),
    )


def executed_plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()
