import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def rows(df, *names):
    """Rows as a sorted list of tuples, NULLs first."""
    found = [tuple(r) for r in (df.select(*names) if names else df).collect()]
    return sorted(found, key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
