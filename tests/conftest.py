import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import types as T  # noqa: E402

from tidemark.sources.files import inline_values  # noqa: E402

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="tidemark-tests-")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"{folder}/shared")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return SMALL


@pytest.fixture(scope="session")
def rows(spark):
    """DataFrame of literal rows: ``rows(ddl, (..), (..))``."""

    def build(schema, *values):
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        return inline_values(spark, list(values), schema)

    return build


@pytest.fixture(scope="session")
def one(rows):
    """Evaluate one Column over one row."""

    def evaluate(column, schema="x INT", *values):
        df = rows(schema, values or (0,))
        return df.select(column.alias("v")).first().v

    return evaluate


@pytest.fixture(scope="session")
def plan_of(spark):
    """Physical plan text of a DataFrame."""
    import contextlib
    import io

    def text(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("simple")
        return out.getvalue()

    return text
