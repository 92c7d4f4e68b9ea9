"""Validation of code: checks as rows of issues, rolled up to reports by file."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import diagnostics
from quarry.functions.schemas import ISSUE, ISSUES
from quarry.sources import python_code

#: Checks whose issues only ever warn.
NEVER_FAIL = ("imports", "lint")


def _python_check(files: DataFrame, check: str, judge: Callable[[str], list[dict]]) -> DataFrame:
    @F.pandas_udf(f"array<{ISSUE}>")
    def run(code: pd.Series) -> pd.Series:
        return pd.Series([judge(c or "") for c in code], dtype=object)

    return files.select("file_path", F.lit(check).alias("check"), run("content").alias("issues"))


def syntax(files: DataFrame) -> DataFrame:
    """(file_path, check, issues) of Python files that don't parse."""
    return _python_check(files, "syntax", python_code.syntax_issues)


def imports(files: DataFrame) -> DataFrame:
    """Modules that can't be found; their finders are asked, nothing is imported."""
    return _python_check(files, "imports", python_code.import_issues)


def lint(files: DataFrame) -> DataFrame:
    """Our own few rules, where no linter's output is at hand."""
    return _python_check(files, "lint", python_code.lint_issues)


def from_tool(outputs: DataFrame, check: str, tool: str) -> DataFrame:
    """(file_path, check, issues) from (file_path, output) of mypy, tsc, ruff or eslint.
    An output that can't be read as the tool's gives no issues; a null output means that
    the tool didn't run: a SKIP warning."""
    parse = {"mypy": lambda c: diagnostics.issues_of_lines(c, lambda line: diagnostics.mypy_issue(line)), "tsc": lambda c: diagnostics.issues_of_lines(c, diagnostics.tsc_issue), "ruff": diagnostics.ruff_issues, "eslint": diagnostics.eslint_issues}[tool]
    skipped = F.array(diagnostics.issue(F.lit(None), F.lit(None), F.lit("SKIP"), F.lit(f"{tool} not available"), F.lit("warning"))).cast(f"array<{ISSUE}>")
    empty = F.array().cast(f"array<{ISSUE}>")
    return outputs.select("file_path", F.lit(check).alias("check"), F.when(F.col("output").isNull(), skipped).otherwise(F.coalesce(parse(F.col("output")).cast(f"array<{ISSUE}>"), empty)).alias("issues"))


def issue_rows(results: DataFrame) -> DataFrame:
    """ISSUES rows, one for each issue; checks without issues have none."""
    return results.select("file_path", "check", F.inline("issues")).select(*(c.split()[0] for c in ISSUES.split(", ")))


def statuses(results: DataFrame) -> DataFrame:
    """(file_path, check, status, issues): error fails (where the check can), else warn."""
    errors = F.exists("issues", lambda i: i["severity"] == "error") & ~F.col("check").isin(*NEVER_FAIL)
    status = F.when(errors, "fail").when(F.size("issues") > 0, "warn").otherwise("pass")
    return results.select("file_path", "check", status.alias("status"), "issues")


def reports(results: DataFrame) -> DataFrame:
    """One row per file: status, can_write, summary, and the checks with their issues."""
    judged = statuses(results)
    rolled = diagnostics.report(judged, ["file_path"])
    listed = judged.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct("check", "status", "issues"))).alias("results"))
    return rolled.join(listed, "file_path")


#: What each language's checks are by default, and the tools that run those
#: that aren't run here.
CHECKS = {"python": ("syntax", "imports"), "typescript": ("syntax", "lint", "types"), "javascript": ("syntax", "lint", "types")}
TOOLS = {("python", "types"): "mypy", **{(lang, check): tool for lang in ("typescript", "javascript") for check, tool in (("syntax", "tsc"), ("lint", "eslint"), ("types", "tsc"))}}
_SAID = {"types": "type"}


def skipped(files: DataFrame, asked: tuple[str, ...] | None, results: DataFrame | None) -> DataFrame:
    """(file_path, check, issues): a SKIP warning for each asked check of a file that has no result."""
    wanted = [(lang, c) for lang, own in CHECKS.items() for c in dict.fromkeys(own if asked is None else asked)]
    why = [(lang, c, f"{TOOLS[lang, c]} not available, skipping {_SAID.get(c, c)} check" if (lang, c) in TOOLS else f"no {c} check for {lang}") for lang, c in wanted]
    if not why:
        why = [(None, None, None)]
    listed = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for x, n in zip(row, ("language", "check", "message"), strict=True))) for row in why))
    due = files.select("file_path", F.inline(F.filter(listed, lambda x: x["language"] == F.col("language")))).drop("language")
    if results is not None:
        due = due.join(results.select("file_path", "check"), ["file_path", "check"], "left_anti")
    one = diagnostics.issue(F.lit(None), F.lit(None), F.lit("SKIP"), F.col("message"), F.lit("warning"))
    return due.select("file_path", "check", F.array(one).cast(f"array<{ISSUE}>").alias("issues"))


def validate(files: DataFrame, checks: tuple[str, ...] | None = None, tool_outputs: dict[str, DataFrame] | None = None) -> DataFrame:
    """Reports of FILES rows. Python files take the checks here; outputs of tools that
    ran elsewhere (``{"types:mypy": DataFrame, "lint:eslint": ...}``) join in. Without
    ``checks``, those of each file's language. A check that is asked for and has no result is a
    warning that it was skipped, never a pass."""
    own = {"syntax": syntax, "imports": imports, "lint": lint}
    python = files.where("language = 'python'")
    parts = [own[c](python) for c in (CHECKS["python"] if checks is None else checks) if c in own]
    parts += [from_tool(df, *name.split(":")) for name, df in (tool_outputs or {}).items() if checks is None or name.split(":")[0] in checks]
    if checks is not None and not checks:
        raise ValueError("no check to run")
    done = reduce(DataFrame.unionByName, parts) if parts else None
    missing = skipped(files, checks, done)
    return reports(missing if done is None else done.unionByName(missing))
