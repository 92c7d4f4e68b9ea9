"""A data source of source trees: every file, pruned folders, an error row for what can't be read.

Spark's own file sources hide names that begin with an underscore or a dot, so they never
give ``__init__.py``, and they list a tree before a filter can leave any of it out. Here the
folders are walked from the root, excluded ones are not listed, and what is found is cut
into partitions of about equal bytes. Files are opened where they are read, through Arrow's
file systems, so a root may be local or remote.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_path string, content string, sha256 string, size bigint, error string"
#: Bytes and files of a partition, and bytes of a batch.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 32 << 20, 2_000, 4 << 20


def opened(root: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a root, its path there, and what stands before paths in rows."""
    local = re.sub(r"^file:(//(?=/))?", "", root)
    if local != root or "://" not in root:
        return fs.LocalFileSystem(), local.rstrip("/") or "/", ""
    system, path = fs.FileSystem.from_uri(root)
    scheme, _, rest = root.partition("://")
    return system, path.rstrip("/"), f"{scheme}://{rest[: len(rest.rstrip('/')) - len(path.strip('/'))].rstrip('/')}"


def supported(root: str) -> bool:
    """Whether Arrow has the root's file system; where it hasn't, Spark's readers may."""
    try:
        opened(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def exists(root: str) -> bool:
    system, path, _ = opened(root)
    return system.get_file_info(path).type != fs.FileType.NotFound


def walk(system: fs.FileSystem, root: str, exclude: frozenset[str]) -> Iterator[fs.FileInfo]:
    """All files below a root (or the root itself) but those in excluded folders, level by level."""
    first = system.get_file_info(root)
    if first.type == fs.FileType.File:
        yield first
    level = [root] if first.type == fs.FileType.Directory else []
    with ThreadPoolExecutor(8) as pool:
        while level:
            listed = pool.map(lambda folder: system.get_file_info(fs.FileSelector(folder)), level)
            level = []
            for found in listed:
                for x in sorted(found, key=lambda x: x.path):
                    if x.type == fs.FileType.File:
                        yield x
                    elif x.type == fs.FileType.Directory and x.base_name not in exclude:
                        level.append(x.path)


@dataclass
class Files(InputPartition):
    """Paths of one partition, with their sizes."""

    files: list[tuple[str, int]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["root"]
        self.patterns = json.loads(options.get("patterns", '["*"]'))
        self.exclude = frozenset(json.loads(options.get("exclude", "[]")))
        self.contents = options.get("contents", "true") == "true"

    def partitions(self) -> list[Files]:
        system, root, _ = opened(self.root)
        out: list[Files] = []
        size = 0
        for x in walk(system, root, self.exclude):
            if not any(fnmatch.fnmatchcase(x.base_name, p) for p in self.patterns):
                continue
            if not out or size > PARTITION_BYTES or len(out[-1].files) >= PARTITION_FILES:
                out.append(Files([]))
                size = 0
            out[-1].files.append((x.path, x.size))
            size += x.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _, before = opened(self.root)
        rows: list[tuple] = []
        held = 0
        for path, size in partition.files:
            row = (before + path, None, None, size, None)
            if self.contents:
                try:
                    with system.open_input_stream(path) as stream:
                        raw = stream.read()
                    row = (before + path, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), len(raw), None)
                except (OSError, pa.ArrowException) as e:
                    row = (before + path, None, None, size, f"{type(e).__name__}: {e}")
            rows.append(row)
            held += row[3] if row[1] else 0
            if held > BATCH_BYTES or len(rows) >= 1000:
                yield self._batch(rows)
                rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [("file_path", pa.string()), ("content", pa.string()), ("sha256", pa.string()), ("size", pa.int64()), ("error", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])


class TreeSource(DataSource):
    """Options: root, patterns and exclude (JSON lists of name patterns and of folder names), contents."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


_REGISTERED: set[str] = set()


def tree(spark: SparkSession, root: str, patterns: list[str], exclude: tuple[str, ...] = (), contents: bool = True) -> DataFrame:
    """SCHEMA rows of a tree; a root that isn't there is an error. Without ``contents``, paths and sizes only."""
    if not exists(root):
        raise FileNotFoundError(f"PATH_NOT_FOUND: {root} does not exist")
    session = str(spark._jsparkSession.sessionUUID())
    if session not in _REGISTERED:
        spark.dataSource.register(TreeSource)
        _REGISTERED.add(session)
    return spark.read.format("source_tree").options(root=root, patterns=json.dumps(patterns), exclude=json.dumps(list(exclude)), contents=str(contents).lower()).load()
