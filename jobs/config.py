"""Config files of the jobs: a JSON object, read by Spark, so it may lie anywhere."""

from __future__ import annotations

from pyspark.sql import SparkSession


def read_config(spark: SparkSession, path: str | None, defaults: dict) -> dict:
    """The defaults, overridden by the file's settings; unknown settings are an error."""
    if path is None:
        return dict(defaults)
    found = spark.read.json(path, multiLine=True).first().asDict(recursive=True)
    if unknown := set(found) - set(defaults):
        raise ValueError(f"unknown settings in {path}: {', '.join(sorted(unknown))}")
    return defaults | {k: v for k, v in found.items() if v is not None}
