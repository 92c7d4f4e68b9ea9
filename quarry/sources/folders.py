"""Parquet folders that runs add to: what none has written yet is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table in a folder, its partition columns among the ``ddl``'s, or no rows."""
    try:
        return spark.read.schema(ddl).option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)
