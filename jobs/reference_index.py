"""Job: a reference index of text files, refreshed by content hash.

Which file mentions which name, how often, and on which line first: what a search for the files
that a change touches starts from. A run reads the whole table for its hashes only, takes the
files whose hash isn't the one that the manifest holds, and adds its results under the
next run number:

    index/run=N/part=K   (file_path, name, mentions, first_line), K by a hash of the name
    manifest/run=N       (file_path, hash); a null hash for a file that is gone

The manifest is the high-water mark. It is written last, and no run writes into the folder of a
finished one: a run that died left no manifest for its number, and the next one writes that
number's index folder anew. A manifest that was written in part is a smaller finished run.
A file's rows are those of the last run that the manifest names for it. To compact an
index, build it anew in another folder.

    python jobs/reference_index.py --config jobs/reference_index.json --files documents.parquet --output index
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from jobs.config import read_config  # noqa: E402
from quarry.operators.graph import changed_files  # noqa: E402
from quarry.plans.staging import scope, stage  # noqa: E402
from quarry.sources.folders import read_or_empty  # noqa: E402

LOG = logging.getLogger("jobs.reference_index")
DEFAULTS = {"id_column": "doc_id", "text_column": "text", "folder_column": "source", "least_length": 3, "parts": 16}
#: Names as Python and JavaScript have them, letters and digits of any script.
NAME = r"[\p{L}_][\p{L}\p{N}_]*"
INDEX = "file_path string, name string, mentions long, first_line int, part int"
MANIFEST = "file_path string, hash string, run int"
#: Most changed files whose paths are broadcast (about 100 bytes each).
BROADCAST_FILES = 500_000


def files_of(table: DataFrame, config: dict) -> DataFrame:
    """(file_path, content) of a table's rows; rows without an id have no path and are left out."""
    folder = F.coalesce(F.col(config["folder_column"]).cast("string"), F.lit("none"))
    path = F.concat(folder, F.lit("/"), F.col(config["id_column"]).cast("string"))
    return table.select(path.alias("file_path"), F.coalesce(F.col(config["text_column"]).cast("string"), F.lit("")).alias("content")).where("file_path is not null")


def mentions(files: DataFrame, least_length: int = 3) -> DataFrame:
    """(file_path, name, mentions, first_line) of every name in every line, for each row by itself: its names
    are sorted, so that equal ones stand together, and nothing is shuffled."""
    once = lambda x, use: F.get(F.transform(F.array(x), use), 0)  # noqa: E731  ``use`` of a value that is worked out once
    long = lambda line: F.filter(F.regexp_extract_all(line, F.lit(NAME), F.lit(0)), lambda n: F.length(n) >= least_length)
    placed = F.flatten(F.transform(F.split("content", "\n", -1), lambda line, at: F.transform(long(line), lambda n: F.struct(n.alias("name"), (at + 1).alias("at")))))
    starts = lambda names: F.filter(F.transform(names, lambda _, i: i), lambda i: (i == 0) | (F.get(names, i)["name"] != F.get(names, i - 1)["name"]))
    run = lambda names, at: lambda start, j: F.struct(F.get(names, start)["name"].alias("name"), (F.coalesce(F.get(at, j + 1), F.size(names)) - start).cast("long").alias("mentions"), F.get(names, start)["at"].alias("first_line"))
    counted = once(F.sort_array(placed), lambda names: once(starts(names), lambda at: F.transform(at, run(names, at))))
    return files.select("file_path", F.inline(counted))


def summed(counted: DataFrame) -> DataFrame:
    """The ``mentions`` of each file's rows as one row for each name."""
    return counted.groupBy("file_path", "name").agg(F.sum("mentions").alias("mentions"), F.min("first_line").alias("first_line"))


def _few(paths: DataFrame) -> DataFrame:
    """For the narrow side of a join: broadcast if its counted rows are few enough."""
    return F.broadcast(paths) if paths.count() <= BROADCAST_FILES else paths


@contextmanager
def _writers(spark: SparkSession, n: int) -> Iterator[None]:
    """A task that writes to ``n`` folders keeps a file of each open, rather than sort its rows by folder."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def latest(spark: SparkSession, output: str) -> DataFrame:
    """(file_path, hash, run) of every file as its last run left it, gone files included."""
    last = read_or_empty(spark, f"{output}/manifest", MANIFEST).groupBy("file_path").agg(F.max(F.struct("run", "hash")).alias("m"))
    return last.select("file_path", "m.hash", "m.run")


def current(spark: SparkSession, output: str) -> DataFrame:
    """(file_path, name, mentions, first_line): the index as it stands.

    Which files' rows are out of date is found from their paths alone, so that the rows are only
    filtered while such files are few."""
    with scope(spark) as own:
        live = latest(spark, output).where("hash is not null").select("file_path", "run")
        rows = read_or_empty(spark, f"{output}/index", f"{INDEX}, run int")
        stale = own.keep(stage(rows.select("file_path", "run").distinct().join(live, ["file_path", "run"], "left_anti"), "index-stale"))
    return rows.join(_few(stale), ["file_path", "run"], "left_anti").select("file_path", "name", "mentions", "first_line")


def refresh(spark: SparkSession, files_path: str, output: str, config: dict | None = None) -> dict[str, int]:
    """One run; returns what it read and wrote. A run without changes writes nothing.

    Rows of one path are parts of one file. Null texts are empty files. Other columns are
    ignored, whatever their names. Files that left the table leave the index. An empty table
    empties it."""
    with scope(spark):
        return _refresh(spark, files_path, output, DEFAULTS | (config or {}))


def _refresh(spark: SparkSession, files_path: str, output: str, config: dict) -> dict[str, int]:
    files = files_of(spark.read.parquet(files_path), config)
    hashed = files.groupBy("file_path").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.sha2("content", 256))), ","), 256).alias("sha256"), F.count("*").alias("rows"))
    known = stage(latest(spark, output), "index-known")
    now = stage(hashed, "index-files")
    fresh = changed_files(now, known).where("not cached").select("file_path")
    gone = known.where("hash is not null").join(now, "file_path", "left_anti").select("file_path", F.lit(None).cast("string").alias("hash"))
    marks = stage(now.join(fresh, "file_path", "left_semi").select("file_path", F.col("sha256").alias("hash")).unionByName(gone), "index-marks")
    n = {"files": now.count(), "changed": marks.where("hash is not null").count(), "gone": marks.where("hash is null").count(), "rows": 0}
    LOG.info("read %d files of %s: %d new or changed, %d gone", n["files"], files_path, n["changed"], n["gone"])
    if not n["changed"] + n["gone"]:
        LOG.info("nothing to write")
        return n
    run = (known.agg(F.max("run")).first()[0] or 0) + 1
    wanted = marks.where("hash is not null").select("file_path")
    if n["changed"] < n["files"]:
        files = files.join(F.broadcast(wanted) if n["changed"] <= BROADCAST_FILES else wanted, "file_path", "left_semi")
    files, several = files if n["changed"] else files.limit(0), now.where("rows > 1").select("file_path")
    if several.isEmpty():
        found = mentions(files, config["least_length"])
    else:
        few = _few(several)
        found = mentions(files.join(few, "file_path", "left_anti"), config["least_length"]).unionByName(summed(mentions(files.join(few, "file_path", "left_semi"), config["least_length"])))
    parted = found.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(config["parts"])).cast("int"))
    with _writers(spark, config["parts"]):
        parted.write.mode("overwrite").partitionBy("part").parquet(f"{output}/index/run={run}")
    n["rows"] = spark.read.schema(INDEX).parquet(f"{output}/index/run={run}").count()
    marks.write.mode("overwrite").parquet(f"{output}/manifest/run={run}")
    LOG.info("wrote run %d to %s: %d rows of the index, %d of the manifest", run, output, n["rows"], n["changed"] + n["gone"])
    return n


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Refreshes a reference index of text files.")
    parser.add_argument("--config", help="JSON with the settings of DEFAULTS")
    parser.add_argument("--files", required=True, help="Parquet table of files")
    parser.add_argument("--output", required=True, help="folder of the index")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("reference_index").getOrCreate()
    try:
        refresh(spark, args.files, args.output, read_config(spark, args.config, DEFAULTS))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
