"""Missing inputs."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def load_or_empty(spark: SparkSession, load, schema, missing: str) -> DataFrame:
    """Run `load`; where the path does not exist, raise or give an empty table of the schema."""
    if missing not in ("error", "empty"):
        raise ValueError(f"unknown missing: {missing}")
    try:
        return load()
    except AnalysisException as problem:
        if missing == "error" or problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
