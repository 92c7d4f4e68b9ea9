"""Vectorised word and shingle hashing over Arrow string buffers.

A word is a run of bytes other than space and 0x09-0x0D. All work is done on the
UTF-8 buffer of a slice of rows at a time, so memory is bounded by ``SLICE_BYTES``
(or by one text, if that is longer). Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_R = _U(0x9E3779B97F4A7C15)
_R_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256).astype(_U) * _U(2) + _U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_POWERS = {"up": np.ones(1, _U), "down": np.ones(1, _U)}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(which: str, n: int) -> np.ndarray:
    have = _POWERS[which]
    if len(have) < n:
        size = max(n, SLICE_BYTES)
        steps = np.full(size, _R if which == "up" else _R_INV, _U)
        steps[0] = 1
        have = _POWERS[which] = np.multiply.accumulate(steps)
    return have[:n]


@contextmanager
def arrow_rows(spark, rows: int):
    """Jobs inside exchange batches of so many rows with Python, for rows that are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Tables that operators keep in a worker process, by operator: how to drop them.
_KEPT_TABLES: dict[str, Callable[[], None]] = {}


def keeps_tables(operator: str, drop: Callable[[], None]) -> None:
    """Says how to drop the tables that ``operator`` keeps between tasks of a process."""
    _KEPT_TABLES[operator] = drop


def begin_work(operator: str) -> None:
    """A worker turns to ``operator``: the tables of all others are dropped."""
    for name, drop in _KEPT_TABLES.items():
        if name != operator:
            drop()


def release_memory() -> None:
    """Gives freed memory back to the system, for worker processes that go on to other
    tasks; without effect where the C library can't."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass


@dataclass
class Slice:
    """Rows ``first``..``last`` (exclusive) of a column, as bytes with row offsets."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray  # last - first + 1 positions in data
    _made: dict[bool, np.ndarray] = field(default_factory=dict, repr=False)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row (from 0) of every word, in order."""
        if not len(self.data):
            none = np.zeros(0, np.int64)
            return none, none, none
        inside = ~_SPACE[self.data]
        edges = self.offsets[(self.offsets < len(self.data)) & (self.offsets >= 0)]
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        before[edges] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        after[edges[edges > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, "right") - 1

    def _sums(self, lower: bool) -> np.ndarray:
        """Running sums over the slice's bytes, made once per slice."""
        if lower not in self._made:
            n = len(self.data)
            sums = self._made[lower] = np.zeros(n + 1, _U)
            np.cumsum((_LOWER if lower else _BYTE)[self.data] * _powers("up", n), out=sums[1:])
        return self._made[lower]

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, A-Z lowered first if ``lower``."""
        sums, down = self._sums(lower), _powers("down", len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cut a string column into slices of about ``limit`` bytes, whole rows each."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    _, raw, data = texts.buffers()
    offsets = np.frombuffer(raw, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield Slice(a, b, everything[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        a = b


def shingle_sets(part: Slice, width: int, common: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Per row of the slice: its sorted distinct shingles of ``width`` lowered words (a
    shorter text gives one shingle, an empty one none), and its word count.

    A shingle is 58 bits of hash below 6 bits of commonness, the sum of its words'
    levels in ``common`` (sorted word hashes, levels), so rare shingles sort first.
    """
    starts, ends, rows = part.words()
    h = part.word_hashes(starts, ends, lower=True)
    level = np.zeros(len(h), _U)
    if common is not None and len(common[0]) and len(h):
        at = np.minimum(np.searchsorted(common[0], h), len(common[0]) - 1)
        level = np.where(common[0][at] == h, common[1][at], _U(0))
    counts = np.bincount(rows, minlength=part.last - part.first)
    first = np.concatenate(([0], np.cumsum(counts)))

    def chain(at: int, m: int, k: int) -> np.ndarray:
        grams, levels = np.full(m, _U(k)), np.zeros(m, _U)
        for i in range(at, at + k):
            grams = mix(grams * _R + h[i : i + m])
            levels += level[i : i + m]
        return np.minimum(levels, _U(63)) << _U(58) | grams >> _U(6)

    grams = chain(0, max(0, len(h) - width + 1), width)
    out = []
    for r, n in enumerate(counts):
        a = first[r]
        if n >= width:
            out.append(np.unique(grams[a : a + n - width + 1]))
        else:
            out.append(chain(a, 1, n) if n else np.zeros(0, _U))
    return out, counts
