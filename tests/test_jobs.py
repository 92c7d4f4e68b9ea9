"""The jobs over growing input, after failures, and from the command line."""

import datetime
import json
import os
import re
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from jobs import config, reference_index, validation_reports

REPO = Path(__file__).resolve().parent.parent
DOCS = "doc_id long, text string, source string, part string"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, status string"


def plain_index(rows):
    out = defaultdict(list)
    for doc_id, text, source in rows:
        for i, line in enumerate((text or "").split("\n")):
            for name in re.findall(r"[^\W\d]\w*", line):
                if len(name) >= 3:
                    out[f"{source or 'none'}/{doc_id}", name].append(i + 1)
    return sorted((*k, len(v), min(v)) for k, v in out.items())


def put_docs(spark, path, rows):
    spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(2).write.mode("overwrite").parquet(path)


def test_index_takes_only_what_is_new(spark, tmp_path):
    files, out = f"{tmp_path}/docs", f"{tmp_path}/index"
    rows = [(i, f"def name_{i}(self):\n    return helper_{i % 3} + été", "src") for i in range(40)] + [(50, None, None), (51, "", None)]
    put_docs(spark, files, rows)
    first = reference_index.refresh(spark, files, out)
    assert first["changed"] == first["files"] == 42 and first["rows"] == len(plain_index(rows))
    assert sorted(map(tuple, reference_index.current(spark, out).collect())) == plain_index(rows)
    again = reference_index.refresh(spark, files, out)
    assert (again["changed"], again["gone"], again["rows"]) == (0, 0, 0) and os.listdir(f"{out}/manifest") == ["run=1"]
    rows = [*rows[2:10], (10, "changed entirely\n\nnow", "src"), *rows[11:], (60, "new file new", "src"), (60, "second part", "src")]
    put_docs(spark, files, rows)
    grown = reference_index.refresh(spark, files, out)
    assert (grown["changed"], grown["gone"]) == (2, 2) and grown["rows"] == len(plain_index([r for r in rows if r[0] in (10, 60)]))
    assert sorted(map(tuple, reference_index.current(spark, out).collect())) == plain_index(rows)
    put_docs(spark, files, [*rows, (0, rows[0][1], "src")])
    assert reference_index.refresh(spark, files, out)["changed"] == 1
    assert sorted(map(tuple, reference_index.current(spark, out).collect())) == plain_index([*rows, (0, rows[0][1], "src")])


def test_index_run_that_died_is_done_again(spark, tmp_path):
    files, out = f"{tmp_path}/docs", f"{tmp_path}/index"
    rows = [(i, f"alpha beta_{i}", "s") for i in range(6)]
    put_docs(spark, files, rows)
    reference_index.refresh(spark, files, out)
    rows[0], rows[1] = (0, "first change", "s"), (1, "lost change", "s")
    put_docs(spark, files, rows)
    reference_index.refresh(spark, files, out)
    for name in os.listdir(f"{out}/manifest/run=2"):  # as a run that died before its manifest
        os.remove(f"{out}/manifest/run=2/{name}")
    os.rmdir(f"{out}/manifest/run=2")
    rows[1] = (1, "alpha beta_1", "s")
    put_docs(spark, files, rows)
    assert reference_index.refresh(spark, files, out)["changed"] == 1
    assert sorted(map(tuple, reference_index.current(spark, out).collect())) == plain_index(rows)


def test_index_of_nothing(spark, tmp_path):
    files, out = f"{tmp_path}/docs", f"{tmp_path}/index"
    put_docs(spark, files, [(None, "no id", "s")])
    assert reference_index.refresh(spark, files, out)["files"] == 0 and reference_index.current(spark, out).count() == 0
    put_docs(spark, files, [(1, "now there", "s")])
    reference_index.refresh(spark, files, out)
    put_docs(spark, files, [])
    assert reference_index.refresh(spark, files, out)["gone"] == 1 and reference_index.current(spark, out).count() == 0


def test_index_rows_are_not_shuffled(spark, tmp_path):
    rows = [(1, "aaa bbb aaa\nbbb ccc aaa\n\naaa", "s"), (2, "", "s"), (3, "xx yy", "s"), (4, "ddd\neee ddd", "s"), (4, "eee\nddd", "s")]
    files = reference_index.files_of(spark.createDataFrame([(*r, "clash") for r in rows], DOCS), reference_index.DEFAULTS)
    found = reference_index.mentions(files.where("file_path <> 's/4'"))
    assert sorted(map(tuple, found.collect())) == plain_index(rows[:3]) and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    put_docs(spark, f"{tmp_path}/docs", rows)
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None)
    reference_index.refresh(spark, f"{tmp_path}/docs", f"{tmp_path}/index")
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters", None) == before
    now = reference_index.current(spark, f"{tmp_path}/index")
    assert sorted(map(tuple, now.collect())) == plain_index(rows)
    assert "hashpartitioning" not in now._jdf.queryExecution().executedPlan().toString()


def add_events(spark, path, rows):
    spark.createDataFrame([(i, *r, "clash") for i, r in enumerate(rows)], EVENTS).coalesce(1).write.mode("append").parquet(path)


def plain_reports(rows):
    checks = defaultdict(list)
    for ts, user, kind, value in rows:
        day = ts.strftime("%Y-%m-%d") if ts else "unknown"
        checks[day, None if user is None else str(user), kind or "unknown"].append(value)
    files = defaultdict(list)
    for (day, user, _), values in checks.items():
        bad = [v for v in values if v is not None and v > 50]
        files[day, user].append(("fail" if any(v > 90 for v in bad) else "warn" if bad else "pass", len(bad)))
    out = []
    for (day, user), found in files.items():
        n = Counter(s for s, _ in found)
        status = "fail" if n["fail"] else "warn" if n["warn"] else "pass"
        summary = "All checks passed" if status == "pass" else f"{n['fail']} error(s), {n['warn']} warning(s)"
        out.append((user, status, not n["fail"], summary, len(found), sum(x for _, x in found), day))
    return sorted(map(repr, out))


def test_reports_follow_growing_results(spark, tmp_path):
    results, out, mark = f"{tmp_path}/events", f"{tmp_path}/reports", f"{tmp_path}/checkpoint"
    at = lambda day, hour=1: datetime.datetime(2024, 1, day, hour)
    rows = [(at(1), 1, "click", 95.0), (at(1), 1, "click", 60.0), (at(1), 1, "view", 60.0), (at(2), 1, "view", 10.0), (at(2), None, None, None), (None, 2, "view", 51.0)]
    add_events(spark, results, rows)
    first = validation_reports.update(spark, results, out, mark)
    assert (first["batches"], first["results"], first["reports"]) == (1, 6, 4)
    assert sorted(repr(tuple(r)) for r in validation_reports.current(spark, out).collect()) == plain_reports(rows)
    assert validation_reports.update(spark, results, out, mark)["batches"] == 0
    untouched = set(os.listdir(f"{out}/reports/day=2024-01-02"))
    late = [(at(1, 3), 1, "view", 91.0), (at(1), 7, "view", 1.0), (at(3), 7, "purchase", 80.0)]
    add_events(spark, results, late)
    grown = validation_reports.update(spark, results, out, mark)
    assert (grown["results"], grown["reports"]) == (3, 3)
    assert sorted(repr(tuple(r)) for r in validation_reports.current(spark, out).collect()) == plain_reports(rows + late)
    assert set(os.listdir(f"{out}/reports/day=2024-01-02")) == untouched


def test_a_repeated_batch_writes_the_same(spark, tmp_path, monkeypatch):
    results, out, mark = f"{tmp_path}/events", f"{tmp_path}/reports", f"{tmp_path}/checkpoint"
    rows = [(datetime.datetime(2024, 1, 1 + i % 3), i % 5, "click", float(i)) for i in range(100)]
    add_events(spark, results, rows)
    whole = validation_reports.report_of

    def dies(checks):
        raise RuntimeError("lost")

    monkeypatch.setattr(validation_reports, "report_of", dies)
    with pytest.raises(Exception, match="lost"):
        validation_reports.update(spark, results, out, mark)
    monkeypatch.setattr(validation_reports, "report_of", whole)
    assert validation_reports.update(spark, results, out, mark)["results"] == 100
    assert sorted(repr(tuple(r)) for r in validation_reports.current(spark, out).collect()) == plain_reports(rows)
    add_events(spark, results, [])
    assert validation_reports.current(spark, f"{tmp_path}/none").count() == 0


def test_reports_of_nothing(spark, tmp_path):
    add_events(spark, f"{tmp_path}/events", [])
    assert validation_reports.update(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark")["reports"] == 0
    assert validation_reports.current(spark, f"{tmp_path}/out").count() == 0


def test_config_files(spark, tmp_path):
    for job in (reference_index, validation_reports):
        name = job.__name__.rpartition(".")[2]
        assert config.read_config(spark, str(REPO / "jobs" / f"{name}.json"), job.DEFAULTS) == job.DEFAULTS
    (tmp_path / "c.json").write_text(json.dumps({"prats": 3}))
    with pytest.raises(ValueError, match="prats"):
        config.read_config(spark, str(tmp_path / "c.json"), reference_index.DEFAULTS)


def test_settings_are_left_as_they_were(spark, tmp_path):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    put_docs(spark, f"{tmp_path}/docs", [(1, "a name", "s")])
    reference_index.refresh(spark, f"{tmp_path}/docs", f"{tmp_path}/index")
    add_events(spark, f"{tmp_path}/events", [(datetime.datetime(2024, 1, 1), 1, "x", 1.0)])
    validation_reports.update(spark, f"{tmp_path}/events", f"{tmp_path}/out", f"{tmp_path}/mark")
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")) == before


@pytest.mark.parametrize("job, source", [("reference_index", "--files"), ("validation_reports", "--results")])
def test_command_line(spark, tmp_path, job, source):
    put_docs(spark, f"{tmp_path}/docs", [(1, "some name", "s"), (2, "other name", "s")])
    add_events(spark, f"{tmp_path}/events", [(datetime.datetime(2024, 1, 1), 1, "x", 99.0)])
    table = "docs" if job == "reference_index" else "events"
    call = [sys.executable, str(REPO / "jobs" / f"{job}.py"), "--config", str(REPO / "jobs" / f"{job}.json"), source, f"{tmp_path}/{table}", "--output", f"{tmp_path}/out"]
    if job == "validation_reports":
        call += ["--checkpoint", f"{tmp_path}/mark"]
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    said = subprocess.run(call, capture_output=True, text=True, timeout=240, cwd=tmp_path, env=env)
    assert said.returncode == 0, said.stderr[-2000:]
    assert re.search(r"read 2 files|read 1 results", said.stderr) and "wrote" in said.stderr
    read = reference_index.current(spark, f"{tmp_path}/out") if table == "docs" else validation_reports.current(spark, f"{tmp_path}/out")
    assert read.where(F.lit(True)).count() == (4 if table == "docs" else 1)
