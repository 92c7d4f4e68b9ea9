"""The most similar names for many asked ones: bounds first, scores for what they leave.

A name's letters are hashed to the bits of one number. A candidate's letters that the query
lacks are at least as many as the bits that it lacks, so bits and lengths bound the score
from above:

    (length - missing bits) / longer length, or 1 where either's bits hold the other's

A task meets its candidates tile by tile with the asked names, computes all bounds of a
tile at once, and scores a pair only if its bound can still enter the asked name's best
``top``. What leaves a task are these best rows, which merge: the best of all are among
the best of each. Few asked names are broadcast; more are dealt in blocks, each to a number
of tasks that share the candidates, and every candidate meets each block once.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Most asked names that are broadcast (about 100 bytes each), and asked names of a block.
BROADCAST_ASKED, BLOCK = 50_000, 8_192
#: Candidates of a tile.
TILE = 512
#: Candidates that one task meets with a block.
SHARE = 500_000
ROW = "name string, symbol_type string, signature string, dir_rank int, file_path string, ordinal int"


def letters(names: list[str]) -> np.ndarray:
    """A bit for each distinct letter; letters beyond 64 may share one."""
    out = np.zeros(len(names), np.uint64)
    for i, name in enumerate(names):
        bits = 0
        for c in set(name):
            bits |= 1 << (ord(c) & 63 if c.isascii() else zlib.crc32(c.encode()) & 63)
        out[i] = bits
    return out


def score(candidate: str, query: str, own: frozenset[str]) -> float:
    """``text.similarity`` of lower-case names; ``own``: the query's letters."""
    if candidate == query:
        return 1.0
    if query in candidate or candidate in query:
        return 0.9
    return sum(c in own for c in candidate) / max(len(candidate), len(query))


class Best:
    """The best ``top`` candidates of each asked name, by directory, score, file and place."""

    def __init__(self, asked: list[str], threshold: float, top: int, scorer: Callable[..., float] = score):
        self.asked, self.threshold, self.top, self.score = asked, threshold, top, scorer
        self.bits, self.lengths = letters(asked), np.array([len(q) for q in asked], np.int64)
        self.own = [frozenset(q) for q in asked]
        self.rows: list[list[tuple]] = [[] for _ in asked]
        #: Directory and score that a candidate must reach: those of the last of a full list.
        self.least = np.full(len(asked), threshold)
        self.last_dir = np.full(len(asked), np.iinfo(np.int64).max)

    def bounds(self, bits: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Upper bounds of scores, asked names by candidates."""
        lacks = bits[None, :] & ~self.bits[:, None]
        longer = np.maximum(lengths[None, :], self.lengths[:, None])
        bound = (lengths[None, :] - np.bitwise_count(lacks)) / np.maximum(longer, 1)
        holds = ((lacks == 0) & (lengths[None, :] <= self.lengths[:, None])) | (((self.bits[:, None] & ~bits[None, :]) == 0) & (self.lengths[:, None] <= lengths[None, :]))
        return np.where(holds, 1.0, bound)

    def meet(self, candidates: list[tuple]) -> None:
        """candidates: (lower-case name, directory, file, place, ...) rows."""
        for at in range(0, len(candidates), TILE):
            tile = candidates[at : at + TILE]
            names = [c[0] for c in tile]
            dirs = np.array([c[1] for c in tile], np.int64)
            bound = self.bounds(letters(names), np.array([len(n) for n in names], np.int64))
            hopeful = (bound >= self.threshold) & ((dirs[None, :] < self.last_dir[:, None]) | ((dirs[None, :] == self.last_dir[:, None]) & (bound >= self.least[:, None])))
            for q in np.flatnonzero(hopeful.any(axis=1)):
                some = np.flatnonzero(hopeful[q])
                for i in some[np.lexsort((-bound[q, some], dirs[some]))].tolist():
                    if dirs[i] > self.last_dir[q] or (dirs[i] == self.last_dir[q] and bound[q, i] < self.least[q]):
                        break
                    found = self.score(names[i], self.asked[q], self.own[q])
                    if found >= self.threshold:
                        self._keep(int(q), (int(dirs[i]), -found, *tile[i][2:4], tile[i]))

    def _keep(self, q: int, row: tuple) -> None:
        rows = self.rows[q]
        rows.append(row)
        rows.sort(key=lambda r: r[:4])
        del rows[self.top :]
        if len(rows) == self.top:
            self.last_dir[q], self.least[q] = rows[-1][0], -rows[-1][1]


def _candidates(symbols: DataFrame, top: int) -> DataFrame:
    """(l, ROW): of each lower-case name the first ``top`` symbols, as no more can be among the best."""
    rows = symbols.where("name is not null").select(F.lower("name").alias("l"), "name", "symbol_type", "signature", F.coalesce(F.col("dir_rank"), F.lit(0)).cast("int").alias("dir_rank"), F.coalesce("file_path", F.lit("")).alias("file_path"), F.coalesce(F.col("ordinal"), F.lit(0)).cast("int").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("l").orderBy("dir_rank", "file_path", "ordinal"))
    return rows.withColumn("place", place).where(F.col("place") <= top).drop("place")


def _task(threshold: float, top: int, fixed: list[str] | None) -> Callable:
    """Rows (block, salt, kind, asked, l, ROW) in their order, or (l, ROW) with ``fixed`` asked names."""

    def finished(best: Best) -> Iterator[pa.RecordBatch]:
        out = [(q, *row[4][4:7], row[0], *row[2:4], -row[1]) for q, rows in zip(best.asked, best.rows, strict=True) for row in rows]
        if out:
            types = [pa.string()] * 4 + [pa.int32(), pa.string(), pa.int32(), pa.float64()]
            names = ["l_asked", "name", "symbol_type", "signature", "dir_rank", "file_path", "ordinal", "score"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def candidates(batch: pa.RecordBatch) -> list[tuple]:
        c = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        return list(zip(c["l"], c["dir_rank"], c["file_path"], c["ordinal"], c["name"], c["symbol_type"], c["signature"], strict=True))

    def broadcast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(fixed, threshold, top)
        for batch in batches:
            best.meet(candidates(batch))
        yield from finished(best)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, best = None, [], None
        for batch in batches:
            rows = candidates(batch)
            for key, i, j in _stretches(batch):
                if key[:2] != at:
                    if best:
                        yield from finished(best)
                    at, asked, best = key[:2], [], None
                if key[2] == 0:
                    asked += batch.column("asked")[i:j].to_pylist()
                else:
                    best = best or Best(asked, threshold, top)
                    best.meet(rows[i:j])
        if best:
            yield from finished(best)

    return dealt if fixed is None else broadcast


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple, int, int]]:
    """Stretches of equal (block, salt, kind)."""
    keys = [batch.column(c).to_numpy() for c in ("block", "salt", "kind")]
    edges = np.flatnonzero(np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))) if batch.num_rows else np.zeros(0, int)
    for i, j in zip(edges, np.append(edges[1:], batch.num_rows), strict=True):
        yield tuple(int(k[i]) for k in keys), int(i), int(j)


def nearest(symbols: DataFrame, asked: DataFrame, threshold: float = 0.7, top: int = 5) -> DataFrame:
    """(symbol, ROW, score): for each asked symbol (``symbol``) its ``top`` most similar names that score
    ``threshold`` or more, by directory, then score, file and place in the file.

    Equal asked names are one; null names on either side take no part. Without candidates or
    asked names there are no rows."""
    spark = asked.sparkSession
    wanted = asked.where("symbol is not null").select("symbol", F.lower("symbol").alias("l_asked")).distinct()
    distinct = wanted.select("l_asked").distinct()
    few = [r[0] for r in distinct.take(BROADCAST_ASKED + 1)]
    found = _candidates(symbols, top)
    schema = f"l_asked string, {ROW}, score double"
    if len(few) <= BROADCAST_ASKED:
        shared = spark.sparkContext.broadcast(sorted(few))
        partial = found.sortWithinPartitions("dir_rank").mapInArrow(lambda batches: _task(threshold, top, shared.value)(batches), schema)
    else:
        blocks = -(-distinct.count() // BLOCK)
        salts = max(1, -(-found.count() // SHARE))
        null = lambda c, t: F.lit(None).cast(t).alias(c)
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        side = distinct.select(F.pmod(F.xxhash64("l_asked"), F.lit(blocks)).cast("int").alias("block"), every(salts, "salt"), F.lit(0).alias("kind"), F.col("l_asked").alias("asked"), null("l", "string"), *(null(*c.split()) for c in ROW.split(", ")))
        other = found.withColumn("salt", F.pmod(F.xxhash64("l"), F.lit(salts)).cast("int")).select(every(blocks, "block"), "salt", F.lit(1).alias("kind"), null("asked", "string"), "l", *(c.split()[0] for c in ROW.split(", ")))
        met = side.unionByName(other).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "dir_rank")
        partial = met.mapInArrow(_task(threshold, top, None), schema)
    order = Window.partitionBy("l_asked").orderBy("dir_rank", F.desc("score"), "file_path", "ordinal")
    best = partial.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top).drop("place")
    return wanted.join(best, "l_asked").drop("l_asked")
