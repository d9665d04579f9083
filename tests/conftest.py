import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from motorgrid.session import build_session  # noqa: E402

SHARED = tempfile.mkdtemp(prefix="spark-", dir="/tmp")


# Started on import: column expressions at module level need a running session.
SESSION = build_session(
    "tests", master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
    spark__driver__memory="8g", spark__ui__showConsoleProgress="false",
    spark__checkpoint__dir=SHARED,
)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    return SESSION


@pytest.fixture
def evaluate(spark):
    """Values of a column expression over a list of inputs."""

    def run(expression, values, schema="v string"):
        from pyspark.sql import functions as F

        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "i int, " + schema)
        return [r["out"] for r in df.select("i", expression.alias("out")).orderBy("i").collect()]

    return run
