"""The jobs as queries: each runs twice into a new folder, and its whole output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import reference_index, validation_reports
from quarry.plans.staging import shared_dir


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/jobs/{name}-{uuid.uuid4().hex}"


def job1_reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _new_folder(spark, "reference_index")
    for _ in range(2):
        reference_index.refresh(spark, f"{sf_dir}/documents.parquet", output)
    return reference_index.current(spark, output)


def job2_validation_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = _new_folder(spark, "validation_reports")
    for _ in range(2):
        validation_reports.update(spark, f"{sf_dir}/events.parquet", output, f"{output}/checkpoint")
    return validation_reports.current(spark, output)


QUERIES = {"job1_reference_index": job1_reference_index, "job2_validation_reports": job2_validation_reports}
SQL = {
    "job1_reference_index": r"""
WITH f AS (SELECT coalesce(source, 'none') || '/' || doc_id AS file_path, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents WHERE doc_id IS NOT NULL),
l AS (SELECT file_path, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS n FROM f),
m AS (SELECT file_path, n, unnest(regexp_extract_all(line, '[\p{L}_][\p{L}\p{N}_]*')) AS name FROM l)
SELECT file_path, name, count(*) AS mentions, CAST(min(n) AS INTEGER) AS first_line FROM m WHERE length(name) >= 3 GROUP BY file_path, name""",
    "job2_validation_reports": """
WITH i AS (SELECT coalesce(strftime(ts, '%Y-%m-%d'), 'unknown') AS day, CAST(user_id AS VARCHAR) AS file_path, coalesce(event_type, 'unknown') AS chk, value > 90 AS e, value > 50 AS w FROM events),
c AS (SELECT day, file_path, chk, coalesce(bool_or(e), false) AS e, coalesce(bool_or(w), false) AS w, count(*) FILTER (WHERE w) AS n FROM i GROUP BY ALL),
r AS (SELECT day, file_path, count(*) AS n_checks, CAST(sum(n) AS BIGINT) AS n_issues, count(*) FILTER (WHERE e) AS fails, count(*) FILTER (WHERE w AND NOT e) AS warns FROM c GROUP BY ALL)
SELECT file_path, CASE WHEN fails > 0 THEN 'fail' WHEN warns > 0 THEN 'warn' ELSE 'pass' END AS status, fails = 0 AS can_write,
  CASE WHEN fails + warns > 0 THEN fails || ' error(s), ' || warns || ' warning(s)' ELSE 'All checks passed' END AS summary, n_checks, n_issues, day FROM r""",
}
