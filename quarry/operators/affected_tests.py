"""Test files that mention affected functions."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import is_test_file, last_segment
from quarry.sources.files import identifiers

#: Names of one automaton, some 100 MB where they are long.
AUTOMATON_NAMES = 100_000


def targets(names: DataFrame, column: str = "caller") -> DataFrame:
    """(name): the last dotted segments, each once."""
    return names.select(last_segment(F.col(column)).alias("name")).distinct()


def by_reference(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(path): Python test files with a name or attribute among ``wanted`` (name)."""
    tests = files.where(is_test_file(F.col("file_path"), "python"))
    return identifiers(tests).join(wanted, "name", "left_semi").select("path").distinct()


def _automaton(names: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for name in names:
        found.add_word(name, True)
    found.make_automaton()
    return found


def _hits(found: ahocorasick.Automaton, paths: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """(path) of the texts that hold a name: one pass over each, up to its first hit."""
    held = [next(found.iter(text.as_py()), None) is not None for text in texts] if len(found) else [False] * len(texts)
    return pa.RecordBatch.from_arrays([paths.filter(pa.array(held, pa.bool_()))], names=["path"])


def by_substring(files: DataFrame, wanted: DataFrame, max_names: int = AUTOMATON_NAMES) -> DataFrame:
    """(path): TypeScript and JavaScript test files whose text holds a wanted name
    anywhere. Each text is read once by an automaton of all names. Up to ``max_names`` names
    are broadcast; more are dealt in blocks of that size, and a text is read once for each
    block. The answer is the same. Null names and texts hold nothing; any text holds the empty name."""
    tests = files.where(is_test_file(F.col("file_path"), "typescript")).where("content is not null").select(F.col("file_path").alias("path"), "content")
    names = wanted.where("name is not null").select("name").distinct()
    if not names.where("name = ''").isEmpty():
        return tests.select("path").distinct()
    listed = [r[0] for r in names.take(max_names + 1)]
    if len(listed) <= max_names:
        shared = files.sparkSession.sparkContext.broadcast(listed)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _automaton(shared.value)
            for batch in batches:
                yield _hits(found, batch.column(0), batch.column(1))

        return tests.mapInArrow(search, "path string").distinct()
    blocks = -(-names.count() // max_names)
    shares = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = F.lit(None).cast("string")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = names.select(F.pmod(F.xxhash64("name"), F.lit(blocks)).cast("int").alias("block"), every(shares).alias("share"), F.lit(0).alias("kind"), none.alias("path"), F.col("name").alias("content"))
    texts = tests.select(every(blocks).alias("block"), F.pmod(F.xxhash64("path"), F.lit(shares)).cast("int").alias("share"), F.lit(1).alias("kind"), "path", "content")

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, listed, found = None, [], None
        for batch in batches:
            for block, share, kind, i, j in _stretches(batch):
                if (block, share) != at:
                    at, listed, found = (block, share), [], None
                if kind == 0:
                    listed += batch.column(4)[i:j].to_pylist()
                else:
                    found = found or _automaton(listed)
                    yield _hits(found, batch.column(3)[i:j], batch.column(4)[i:j])

    met = asked.unionByName(texts).repartition("block", "share").sortWithinPartitions("block", "share", "kind")
    return met.mapInArrow(dealt, "path string").distinct()


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
    """(block, share, kind, start, end) of the stretches of equal keys."""
    keys = [batch.column(c).to_numpy() for c in range(3)]
    edges = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) if batch.num_rows else np.zeros(0, int)
    for i, j in zip(edges, np.append(edges[1:], batch.num_rows), strict=True):
        yield (*(int(k[i]) for k in keys), int(i), int(j))
