"""Substring dedup: passages that an earlier document holds already.

Each text is cut by content: a gear rolling hash runs over its bytes, and a piece
ends where the hash is the least within ``REACH`` bytes on either side. Whether a byte
is a cut depends on the ``2 * REACH + 16`` bytes around it only, so an insertion moves
the cuts near it and no others. A chunk begins at every cut and is the shortest run of
pieces with enough words or bytes to be a passage, so chunks overlap; a text that is too
short for one is a chunk as a whole. Chunks are compared by digest: the document of least
id that has a chunk keeps it, and a chunk in any other document is a repeat of that
place. Repeats that lie at one distance from their places in one document, without a gap,
are one passage, which that document holds from end to end.

Where text repeats itself at once, equal chunks overlap or touch; they are numbered from the
start of the stretch, and only chunks of equal number are compared, so stretches of a
short period are held against each other from their starts.

Chunks are written once. Repeated digests grow with the corpus, so they meet the chunks
in a shuffled join, whose large partitions (a passage that many documents share) adaptive
execution splits. Digests have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bytewords import Slice, mix, release_memory, slices
from quarry.plans.staging import stage

#: Bytes on either side over which a cut's hash is the least.
REACH = 16
#: A piece without a cut for so many bytes is cut there.
LONGEST = 256
#: Least bytes of a piece inside a stretch of short period.
PERIODIC = 64
_GEAR = np.random.default_rng(97).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash ``h = (h << 2) + gear[byte]`` at every byte: 16 bytes count."""
    h = _GEAR[data]
    for reach in (1, 2, 4, 8):
        shifted = h[:-reach] << np.uint32(2 * reach)
        h = h.copy()
        h[reach:] += shifted
    return h


def _least_before(h: np.ndarray, reach: int) -> np.ndarray:
    """The least of the ``reach`` (a power of two) values before each position."""
    low = h.copy()
    step = 1
    while step < reach:
        low[step:] = np.minimum(low[step:], low[:-step].copy())
        step *= 2
    out = np.full_like(h, np.iinfo(h.dtype).max)
    out[1:] = low[:-1]
    return out


def _periodic_cuts(ends: np.ndarray, ties: np.ndarray) -> np.ndarray:
    """Cuts in long gaps between ``ends`` where the hash is as low as ``REACH`` bytes
    before: text of a short period, whose ties are all at one place of the period. The
    first tie and each one ``PERIODIC`` bytes or more after the last make equal pieces,
    wherever the stretch lies."""
    gap = np.searchsorted(ends, ties)
    long = np.diff(ends, prepend=0)[gap] > PERIODIC
    gap, ties = gap[long], ties[long]
    out: list[int] = []
    for own in np.split(ties, np.flatnonzero(np.diff(gap)) + 1):
        i = 0
        while i < len(own):
            out.append(own[i])
            i = int(np.searchsorted(own, own[i] + PERIODIC))
    return np.array(out, np.int64)


def cuts(data: np.ndarray) -> np.ndarray:
    """Where pieces of one text end, the end of the text included."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    h = gear(data)
    before, least_after = _least_before(h, REACH), h <= _least_before(h[::-1], REACH)[::-1]
    ends = np.unique(np.append(np.flatnonzero((h < before) & least_after) + 1, n))
    ties = np.flatnonzero((h == before) & least_after) + 1
    if len(ties):
        ends = np.unique(np.append(ends, _periodic_cuts(ends, ties)))
    gaps = np.diff(ends, prepend=0)
    if gaps.max() > LONGEST:
        more = [np.arange(e - g + LONGEST, e, LONGEST) for e, g in zip(ends[gaps > LONGEST], gaps[gaps > LONGEST], strict=True)]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def _chunks_of_text(ends: np.ndarray, before: np.ndarray, upto: np.ndarray, min_words: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """First and last piece of each chunk, and whether the text is one short chunk.

    ends: of the pieces; before and upto: words that begin before a piece starts, ends.
    The last chunk reaches the end of the text."""
    starts = np.append(0, ends[:-1])
    last = np.minimum(np.searchsorted(upto, before + min_words), np.searchsorted(ends, starts + min_bytes))
    first = np.flatnonzero(last < len(ends))
    if not len(first):
        return np.zeros(1, np.int64), np.full(1, len(ends) - 1), True
    last = last[first]
    if last[-1] < len(ends) - 1:
        first, last = np.append(first, first[-1]), np.append(last, len(ends) - 1)
    return first, last, False


def _numbered(digest: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Digests of one text's chunks, those that overlap or touch an equal one told apart by their
    number in the stretch."""
    order = np.lexsort((start, digest))
    d, s, e = digest[order], start[order], end[order]
    again = np.append(False, (d[1:] == d[:-1]) & (s[1:] <= e[:-1]))
    if not again.any():
        return digest
    at = np.arange(len(d))
    number = at - np.maximum.accumulate(np.where(again, 0, at))
    out = digest.copy()
    out[order[again]] = mix(d[again] + number[again].astype(np.uint64))
    return out


def _chunks_of(part: Slice, min_words: int, min_bytes: int) -> tuple[np.ndarray, ...]:
    """For a slice: row, start, end, words before start and end, digest and shortness of
    each chunk."""
    began = part.words()[0]
    found: list[list[np.ndarray]] = [[] for _ in range(7)]
    for r in range(part.last - part.first):
        a, b = part.offsets[r], part.offsets[r + 1]
        if b == a:
            continue
        ends = cuts(part.data[a:b])
        starts = np.append(0, ends[:-1])
        before, upto = np.searchsorted(began, starts + a), np.searchsorted(began, ends + a)
        first, last, short = _chunks_of_text(ends, before, upto, min_words, min_bytes)
        start, end = starts[first], ends[last]
        digest = part.word_hashes(start + a, end + a, lower=False)
        digest = mix(~digest) if short else _numbered(digest, start, end)
        n = len(first)
        for column, values in zip(found, (np.full(n, r), start, end, before[first] - before[0], upto[last] - before[0], digest.view(np.int64), np.full(n, short)), strict=True):
            column.append(values)
    if not found[0]:
        return (np.zeros(0, np.int64),) * 7
    return tuple(np.concatenate(x) for x in found)


def chunk_table(docs: DataFrame, id_col: str, text_col: str, min_words: int, min_bytes: int) -> DataFrame:
    """(row, k, start, end, w0, w1, digest): every chunk of every text."""
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    fields = [T.StructField("row", T.LongType()), source.schema["k"], *(T.StructField(c, T.IntegerType()) for c in ("start", "end", "w0", "w1")), T.StructField("digest", T.LongType())]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(2)):
                row, start, end, w0, w1, digest, _ = _chunks_of(part, min_words, min_bytes)
                at = pa.array(row + part.first)
                columns = [batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x.astype(np.int32)) for x in (start, end, w0, w1)), pa.array(digest)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
        release_memory()

    return source.mapInArrow(work, T.StructType(fields))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25, min_bytes: int = 256, label: str = "passages") -> DataFrame:
    """(id, first_id, start_byte, end_byte, n_chunks, n_words, first_start): passages to drop.

    A row is a stretch of a document that the document ``first_id``, of a smaller id,
    holds whole from byte ``first_start`` on: ``min_words`` words or ``min_bytes`` bytes
    or more, or all of a text that is shorter than both and equal to another. ``first_id``
    is the least id that holds the stretch's chunks; stretches with different ``first_id``
    may overlap. A repeated passage of ``w`` words shows as some ten words shorter, as the
    pieces across its edges differ.

    Null and empty texts have no chunks. Rows with a null id, and repeats within one
    id, aren't reported. Repeated rows of one id give a row each. Texts of any length
    are cut whole. Other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """
    chunks = stage(chunk_table(docs.where(F.col(id_col).isNotNull()), id_col, text_col, min_words, min_bytes), f"{label}-chunks")
    held = chunks.groupBy("digest").agg(F.min(F.struct("k", "row", "start")).alias("first"), F.max("k").alias("last")).where("first.k <> last")
    held = stage(held.select("digest", F.col("first.k").alias("fk"), F.col("first.row").alias("frow"), F.col("first.start").alias("fstart")), f"{label}-repeats")
    again = chunks.join(held, "digest").where("fk <> k").withColumn("apart", F.col("start") - F.col("fstart")).drop("digest")
    order = Window.partitionBy("row", "frow", "apart").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("opens", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int")).withColumn("run", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("row", "frow", "apart", "run").agg(
        F.first("k").alias(id_col), F.first("fk").alias("first_id"), F.min("start").cast("long").alias("start_byte"), F.max("end").cast("long").alias("end_byte"),
        F.count("*").alias("n_chunks"), (F.max("w1") - F.min("w0")).cast("long").alias("n_words"), F.min("fstart").cast("long").alias("first_start"),
    )
    return spans.drop("row", "frow", "apart", "run")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 25) -> DataFrame:
    """``docs`` with every repeated passage cut out of its text; ids must be unique.

    Cuts inside a character widen to the whole character. Null texts stay null."""
    spans = repeated_passages(docs, id_col, text_col, min_words).groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start_byte", "end_byte"))).alias("_spans"))

    @F.pandas_udf("string")
    def cut(texts, found):
        out = []
        for text, own in zip(texts, found, strict=True):
            if text is None or own is None:
                out.append(text)
                continue
            raw, at, kept = text.encode(), 0, []
            for span in own:
                kept.append(raw[at : span["start_byte"]])
                at = max(at, span["end_byte"])
            out.append(b"".join([*kept, raw[at:]]).decode("utf-8", "ignore"))
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = docs.join(spans, F.col(id_col) == F.col("_id"), "left")
    return joined.withColumn(text_col, F.when(F.col("_spans").isNull(), F.col(text_col)).otherwise(cut(F.col(text_col), F.col("_spans")))).select(*docs.columns)
