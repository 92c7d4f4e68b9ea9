"""Source files as rows: scan, exclude, hash, and parse in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.schemas import GRAPH_EXCLUDED, SEARCH_EXCLUDED, SYMBOLS
from quarry.functions.text import excluded, language_of_path
from quarry.sources import declarations, import_code, python_code, ts_code
from quarry.sources.tree import supported, tree

GLOBS = {"python": ["*.py"], "typescript": ["*.ts", "*.tsx", "*.js", "*.jsx"], "javascript": ["*.ts", "*.tsx", "*.js", "*.jsx"]}
SYMBOL_GLOBS = {"python": ["*.py", "*.pyi"], "typescript": ["*.d.ts"], "javascript": ["*.d.ts"]}
BINDINGS = "file_path string, local string, level int, module string, name string, line_number int"
TAGGED = "file_path string, kind string, name string, target string, type string, line_number int, signature string, ordinal int"


def listed(spark: SparkSession, root: str, patterns: list[str], exclude: tuple[str, ...] = (), contents: bool = True) -> DataFrame:
    """(file_path, content, sha256, size, error) of a tree's files whose names fit a pattern.

    Text that isn't UTF-8 has replacement characters; the hash is of the bytes. A file that can't
    be read has an error instead. Roots in a store that Arrow doesn't know are read by
    Spark's own source, which leaves out names that begin with an underscore or a dot."""
    if supported(root):
        return tree(spark, root, patterns, exclude, contents)
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(patterns) + "}").load(root)
    text = (F.make_valid_utf8(F.col("content").cast("string")), F.sha2("content", 256)) if contents else (F.lit(None).cast("string"),) * 2
    return found.select(F.col("path").alias("file_path"), text[0].alias("content"), text[1].alias("sha256"), F.col("length").alias("size"), F.lit(None).cast("string").alias("error"))


def scan(spark: SparkSession, root: str, language: str = "python", exclude: tuple[str, ...] = GRAPH_EXCLUDED, glob: list[str] | None = None) -> DataFrame:
    """FILES rows of a directory tree, with the error of those that can't be read. Paths lose the
    ``file:`` prefix; any component in ``exclude`` leaves a file out, ancestors of the root
    included. Excluded folders aren't listed."""
    if language not in GLOBS:
        raise ValueError(f"unknown language: {language!r}")
    found = listed(spark, root, glob or GLOBS[language], exclude).where(~excluded(F.col("file_path"), exclude))
    return found.select("file_path", language_of_path(F.col("file_path")).alias("language"), "content", "sha256", "size", "error")


def scan_symbols(spark: SparkSession, root: str, language: str = "python", compat: bool = False) -> DataFrame:
    """Files that symbol search reads: its own extensions and exclusions. In ``compat``
    a TypeScript search finds no file at all, as in the tool that this follows, which
    holds a name's last suffix against ``.d.ts``."""
    found = scan(spark, root, language, SEARCH_EXCLUDED, SYMBOL_GLOBS[language])
    return found.limit(0) if compat and language != "python" else found


def inline(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """FILES rows of code given as text (path to content)."""
    rows = spark.createDataFrame([(p, c) for p, c in files.items()], "file_path string, content string")
    return rows.select("file_path", language_of_path(F.col("file_path")).alias("language"), "content", F.sha2(F.encode("content", "UTF-8"), 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"))


def _per_file(files: DataFrame, columns: list[str], schema: str, rows_of: Callable[..., Iterator[tuple]]) -> DataFrame:
    """One pass over the files; ``rows_of(*columns)`` gives tuples of the schema."""

    names = [part.split()[0] for part in schema.split(", ")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [row for values in zip(*(batch[c] for c in columns), strict=True) for row in rows_of(*values)]
            yield pd.DataFrame(out, columns=names)

    return files.select(*columns).mapInPandas(work, schema)


def extract(files: DataFrame, heritage: bool = False) -> DataFrame:
    """Tagged graph rows (node or edge) of every file, in the order of its text."""

    def rows_of(path: str, language: str, content: str) -> Iterator[tuple]:
        found = python_code.graph_rows(content or "") if language == "python" else ts_code.graph_rows(content or "", heritage)
        for i, r in enumerate(found):
            if r[0] == "node":
                yield path, "node", r[1], None, r[2], r[3], r[4], i
            else:
                yield path, "edge", r[1], r[2], r[3], r[4], None, i

    return _per_file(files, ["file_path", "language", "content"], TAGGED, rows_of)


def nodes_of(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'node'").select("file_path", F.col("name").alias("symbol_name"), F.col("type").alias("symbol_type"), "line_number", "signature", "ordinal")


def raw_edges_of(tagged: DataFrame) -> DataFrame:
    return tagged.where("kind = 'edge'").select("file_path", F.col("name").alias("source"), "target", F.col("type").alias("edge_type"), "line_number")


def symbols(files: DataFrame) -> DataFrame:
    """SYMBOLS rows: Python by syntax tree, declaration files by pattern."""

    def rows_of(path: str, content: str) -> Iterator[tuple]:
        found = declarations.symbols(content or "") if path.endswith(".d.ts") else python_code.symbols(content or "")
        for i, (name, kind, line, signature, doc, parent) in enumerate(found):
            yield name, kind, line, signature, path, doc, parent, i

    return _per_file(files, ["file_path", "content"], SYMBOLS, rows_of)


def bindings(files: DataFrame) -> DataFrame:
    """(file_path, local, level, module, name, line_number): what names stand for in other files."""

    def rows_of(path: str, language: str, content: str) -> Iterator[tuple]:
        found = import_code.python_bindings(content or "") if language == "python" else import_code.typescript_bindings(content or "")
        yield from ((path, *row) for row in found)

    return _per_file(files, ["file_path", "language", "content"], BINDINGS, rows_of)


def identifiers(files: DataFrame) -> DataFrame:
    """(path, name): every name and attribute that a Python file mentions."""

    def rows_of(path: str, content: str) -> Iterator[tuple]:
        yield from ((path, name) for name in sorted(python_code.identifiers(content or "")))

    return _per_file(files, ["file_path", "content"], "path string, name string", rows_of)
