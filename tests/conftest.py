import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALLEST = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from checks.compare import local_session

    return local_session(4)


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(SMALLEST):
        pytest.skip("test tables are absent")
    return SMALLEST


@pytest.fixture
def apply(spark):
    """Results of a column function over a list of values, in order."""
    from pyspark.sql import functions as F

    def run(function, values, kind="string"):
        rows = spark.createDataFrame(list(enumerate(values)), f"n INT, x {kind}")
        # Spread, so that the expression runs in generated code and is not folded away.
        got = rows.repartition(2).select("n", function(F.col("x")).alias("y")).orderBy("n").collect()
        return [r.y for r in got]

    return run
