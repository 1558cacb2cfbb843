import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__  # noqa: E402, F401

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rolecall-tests-")).config("spark.driver.memory", "8g")
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def texts(spark):
    """Apply a text expression to a list of values and return the results in order."""
    def run(values, expression, schema="i int, t string"):
        rows = spark.createDataFrame(list(enumerate(values)), schema)
        out = rows.select("i", expression("t").alias("r")).collect()
        return [r["r"] for r in sorted(out, key=lambda r: r["i"])]
    return run
