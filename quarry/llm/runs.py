"""Whole groups from a partition that is sorted by its keys, a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def _starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for key in keys:
        values = table.column(key).to_numpy()
        change[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(change)


def _key(table: pa.Table, keys: list[str], at: int) -> tuple:
    return tuple(table.column(key)[at].as_py() for key in keys)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Yields tables of complete runs of equal keys, with the runs' bounds in them.

    Only the run that is still open is carried from batch to batch.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        starts = _starts(now, keys)
        if len(starts) == 1 and held and _key(held[-1], keys, 0) == _key(now, keys, 0):
            held.append(now)
            continue
        done = pa.concat_tables([*held, now.slice(0, starts[-1])]) if held or starts[-1] else None
        held = [now.slice(starts[-1])]
        if done is not None and done.num_rows:
            yield done, np.append(_starts(done, keys), done.num_rows)
    if held:
        done = pa.concat_tables(held)
        yield done, np.append(_starts(done, keys), done.num_rows)
