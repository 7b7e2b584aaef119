import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture()
def rows(spark):
    """Rows of a frame as sorted tuples, floats rounded."""

    def take(df, *columns, digits=6):
        picked = df.select(*columns) if columns else df
        out = [tuple(round(v, digits) if isinstance(v, float) else v for v in r) for r in picked.collect()]
        return sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) if not isinstance(v, bool) else (False, "", v) for v in r))

    return take
