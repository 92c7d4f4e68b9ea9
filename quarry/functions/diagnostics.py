"""Diagnostics of compilers and linters, as issue structs; native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.schemas import ISSUE


def issue(line: Column, column: Column, code: Column, message: Column, severity: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), column.cast("int").alias("column"), code.alias("code"), message.alias("message"), severity.alias("severity"))


def _number(text: Column) -> Column:
    return F.when(F.trim(text).rlike("^[0-9]+$"), F.trim(text)).try_cast("int")


def tsc_issue(line: Column) -> Column:
    """``file(line,column): ... message``; null unless exactly two parts stand between
    the first brackets. An error if it says error and not warning, anywhere."""
    inside = F.when(F.instr(line, "(") > 0, F.substr(line, F.instr(line, "(") + 1))
    parts = F.when(F.instr(inside, ")") > 0, F.split(F.substring_index(inside, ")", 1), ","))
    message = F.when(F.instr(line, ": ") > 0, F.trim(F.substr(line, F.instr(line, ": ") + 2))).otherwise("")
    severity = F.when(F.lower(line).contains("error") & ~F.lower(line).contains("warning"), "error").otherwise("warning")
    return F.when(F.size(parts) == 2, issue(_number(F.get(parts, 0)), _number(F.get(parts, 1)), F.lit("tsc"), message, severity))


def mypy_issue(line: Column, by_severity_field: bool = False) -> Column:
    """``path:line:column-or-severity: message``. The severity is read from the message
    part, as the reference tool does, or (``by_severity_field``) from the part before."""
    parts = F.split(line, ":", 5)
    message = F.concat(F.trim(F.get(parts, 3)), F.when(F.size(parts) > 4, F.concat(F.lit(": "), F.get(parts, 4))).otherwise(""))
    judged = F.get(parts, 2) if by_severity_field else F.get(parts, 3)
    severity = F.when(F.lower(judged).contains("error"), "error").otherwise("warning")
    return F.when((line != "") & (F.size(parts) >= 4), issue(_number(F.get(parts, 1)), _number(F.get(parts, 2)), F.lit("mypy"), message, severity))


def ruff_issues(json: Column) -> Column:
    """A linter's JSON array; the location is an object (row or line, column or col) or
    a bare line number. All are warnings. Null if it isn't such an array."""
    rows = F.from_json(json, "array<struct<code:string,message:string,text:string,location:string>>")

    def one(x: Column) -> Column:
        place = F.from_json(x["location"], "struct<row:int,line:int,column:int,col:int>")
        line = F.coalesce(F.nullif(place["row"], F.lit(0)), place["line"], _number(x["location"]))
        return issue(line, F.coalesce(F.nullif(place["column"], F.lit(0)), place["col"]), F.coalesce(x["code"], F.lit("RUFF")), F.coalesce(x["message"], x["text"], F.lit("")), F.lit("warning"))

    return F.transform(rows, one)


def eslint_issues(json: Column) -> Column:
    """Messages of all files in a linter's JSON; severity 2 is an error. A null rule
    stays null, a missing one can't be told from it in a typed row and is null too."""
    files = F.from_json(json, "array<struct<messages:array<struct<line:int,column:int,ruleId:string,message:string,severity:int>>>>")
    messages = F.flatten(F.transform(files, lambda f: F.coalesce(f["messages"], F.array().cast("array<struct<line:int,column:int,ruleId:string,message:string,severity:int>>"))))
    return F.transform(messages, lambda m: issue(m["line"], m["column"], m["ruleId"], F.coalesce(m["message"], F.lit("")), F.when(m["severity"] == 2, "error").otherwise("warning")))


def issues_of_lines(output: Column, parser) -> Column:
    """The issues of a tool's output, a line each, unreadable lines left out."""
    return F.filter(F.transform(F.split(output, "\n"), parser), lambda x: x.isNotNull()).cast(f"array<{ISSUE}>")


def check_status(issues: DataFrame, keys: list[str], never_fails: tuple[str, ...] = ()) -> DataFrame:
    """(keys, check, status, n_issues): fail if a check has an error, else warn."""
    errors = F.count_if((F.col("severity") == "error") & ~F.col("check").isin(*never_fails) if never_fails else F.col("severity") == "error")
    return issues.groupBy(*keys, "check").agg(F.when(errors > 0, "fail").when(F.count("severity") > 0, "warn").otherwise("pass").alias("status"), F.count("severity").alias("n_issues"))


def merge_checks(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, check, status, n_issues) of partial rows of the same kind, in any order."""
    worst = F.max(F.when(F.col("status") == "fail", 2).when(F.col("status") == "warn", 1).otherwise(0))
    status = F.when(worst == 2, "fail").when(worst == 1, "warn").otherwise("pass")
    return checks.groupBy(*keys, "check").agg(status.alias("status"), F.sum("n_issues").alias("n_issues"))


def report(checks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status, can_write, summary) from (keys, check, status): counts are of
    checks, and fail goes before warn before pass."""
    n, fails, warns = F.count("*"), F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warn")
    rolled = checks.groupBy(*keys).agg(n.alias("n"), fails.alias("fails"), warns.alias("warns"))
    status = F.when(F.col("fails") > 0, "fail").when(F.col("warns") > 0, "warn").otherwise("pass")
    counted = F.format_string("%d error(s), %d warning(s)", "fails", "warns")
    summary = F.when(F.col("fails") + F.col("warns") > 0, counted).otherwise("All checks passed")
    return rolled.select(*keys, status.alias("status"), (F.col("fails") == 0).alias("can_write"), summary.alias("summary"))
