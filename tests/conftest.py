import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftlines import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    built = session.build("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints"))})
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Value of an expression over one row of string columns."""
    def value(expression, **columns):
        names = list(columns) or ["_"]
        row = tuple(columns.values()) or ("",)
        return spark.createDataFrame([row], ", ".join(f"{n} string" for n in names)).select(
            expression.alias("v")).collect()[0]["v"]
    return value


@pytest.fixture
def files(spark):
    def build(*rows):
        """files from (path, content) pairs, language by extension."""
        from pyspark.sql import functions as F

        from siftlines.functions import text
        named = spark.createDataFrame(list(rows), "path string, content string")
        return named.withColumn("language", text.language_of(F.col("path")))
    return build
