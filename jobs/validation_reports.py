"""Job: daily validation reports from a stream of check results.

Check results arrive as Parquet files in a folder. A file stream takes what is new since its
checkpoint and stops when it has caught up. Each micro-batch adds its results, rolled
up by day, file and check, under its own number, and then writes the reports of the days it
touched from all batches so far:

    checks/batch=N/day=D   (file_path, check, status, n_issues)
    reports/day=D          (file_path, status, can_write, summary, n_checks, n_issues)

A batch that is repeated after a failure has the same number and the same files, so it writes the
same folders again. Late results reopen their day. Checkpoint and output belong together.

    python jobs/validation_reports.py --config jobs/validation_reports.json --results events --output reports --checkpoint reports/checkpoint
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.config import read_config  # noqa: E402
from quarry.functions import diagnostics  # noqa: E402
from quarry.sources.folders import read_or_empty  # noqa: E402

LOG = logging.getLogger("jobs.validation_reports")
DEFAULTS = {"file_column": "user_id", "check_column": "event_type", "severity_column": "value", "time_column": "ts", "error_above": 90.0, "warning_above": 50.0, "files_per_batch": 1000}
CHECKS = "file_path string, check string, status string, n_issues long, batch long, day string"
REPORTS = "file_path string, status string, can_write boolean, summary string, n_checks long, n_issues long, day string"
KEYS = ["day", "file_path"]


def issues_of(results: DataFrame, config: dict) -> DataFrame:
    """(day, file_path, check, severity): a null severity for a result that is no issue.

    Results without a time are of the day ``unknown``, those without a check of the check ``unknown``."""
    score = F.col(config["severity_column"])
    severity = F.when(score > config["error_above"], "error").when(score > config["warning_above"], "warning")
    unknown = F.lit("unknown")
    return results.select(
        F.coalesce(F.date_format(config["time_column"], "yyyy-MM-dd"), unknown).alias("day"), F.col(config["file_column"]).cast("string").alias("file_path"),
        F.coalesce(F.col(config["check_column"]).cast("string"), unknown).alias("check"), severity.alias("severity"),
    )


def report_of(checks: DataFrame) -> DataFrame:
    """REPORTS rows from partial (day, file_path, check, status, n_issues)."""
    whole = diagnostics.merge_checks(checks, KEYS)
    counts = whole.groupBy(*KEYS).agg(F.count("*").alias("n_checks"), F.sum("n_issues").alias("n_issues"))
    both = diagnostics.report(whole, KEYS).alias("r").join(counts.alias("c"), F.expr("r.day = c.day and r.file_path <=> c.file_path"))
    return both.select("r.file_path", "status", "can_write", "summary", "n_checks", "n_issues", "r.day")


def update(spark: SparkSession, results_path: str, output: str, checkpoint: str, config: dict | None = None) -> dict[str, int]:
    """Takes all results that arrived since the last call; returns what was read and written.

    Repeated results count again, as the results of a check run twice. Other columns are ignored,
    whatever their names. An empty table gives no reports."""
    config = DEFAULTS | (config or {})
    wanted = [config[c] for c in ("file_column", "check_column", "severity_column", "time_column")]
    known = spark.read.parquet(results_path).select(*wanted).schema
    folder, _, name = results_path.rstrip("/").rpartition("/")
    pattern = f"{folder}/{{{name}}}"  # as a pattern, the path of a stream may be a single file
    results = spark.readStream.schema(known).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(pattern)
    n = {"batches": 0, "results": 0, "checks": 0, "reports": 0}

    def take(batch: DataFrame, number: int) -> None:
        own = f"{output}/checks/batch={number}"
        diagnostics.check_status(issues_of(batch, config), KEYS).write.mode("overwrite").partitionBy("day").parquet(own)
        added = spark.read.schema(CHECKS).option("basePath", f"{output}/checks").parquet(own)
        days = added.select("day").distinct()
        every = spark.read.schema(CHECKS).parquet(f"{output}/checks").where(F.col("batch") <= number)
        reports = report_of(every.join(days, "day", "left_semi").drop("batch"))
        reports.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{output}/reports")
        written = spark.read.schema(REPORTS).parquet(f"{output}/reports").join(days, "day", "left_semi")
        got = {"batches": 1, "results": batch.count(), "checks": added.count(), "reports": written.count()}
        LOG.info("batch %d: read %d results, wrote %d checks and %d reports of %d days", number, got["results"], got["checks"], got["reports"], days.count())
        for k, v in got.items():
            n[k] += v

    stream = results.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    LOG.info("read %d results of %s in %d batches; wrote %d reports to %s", n["results"], results_path, n["batches"], n["reports"], output)
    return n


def current(spark: SparkSession, output: str) -> DataFrame:
    """All reports as they stand; an output that no batch has written is empty."""
    return read_or_empty(spark, f"{output}/reports", REPORTS)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Brings daily validation reports up to date.")
    parser.add_argument("--config", help="JSON with the settings of DEFAULTS")
    parser.add_argument("--results", required=True, help="folder or file of check results in Parquet")
    parser.add_argument("--output", required=True, help="folder of the reports")
    parser.add_argument("--checkpoint", required=True, help="folder of the stream's checkpoint")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("validation_reports").getOrCreate()
    try:
        update(spark, args.results, args.output, args.checkpoint, read_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
