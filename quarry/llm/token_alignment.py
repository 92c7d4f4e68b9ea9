"""Cross-tokenizer alignment: which tokens of one vocabulary stand for those of another.

Both tokenizers cut the same bytes (a space and the text). Two token occurrences are
linked when their byte ranges overlap, and the offsets where tokens of both end cut a text
into groups. Overlapping occurrences share exactly one stretch between neighbouring ends
of either side, so a text's links are its distinct ends.

Tokens never reach over a single space between visible characters to the text before it, so
texts are cut there into chunks, and a worker encodes equal chunks once. Tasks encode slices of
texts once and write three kinds of rows: a summary per document;
links per slice and stripe of B ids (distinct pairs of the slice, and for each document
which of them it holds how often); and pair counts that the task has summed already. The
counts meet by stripe in dense blocks (B ids of the stripe by A ids), filled by
``np.add.at``; the row maxima of a block give each B id's best count. A stripe with
many partial blocks is first added up in salted parts. Links then go to the stripe
that has their counts, split by salt where there are many, and only sums per document
leave it. No step holds more than a slice, a block or a stripe's nonzero counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bytewords import begin_work, keeps_tables, release_memory
from quarry.plans.staging import stage

#: Bytes of text whose links are packed together.
SLICE = 1 << 20
#: Characters that the tokenizers get at once, if one chunk isn't longer.
PART = 1 << 18
#: Characters of chunks whose ids a worker keeps before it starts anew.
KEPT_CHARS = 1 << 21
#: Stripes of B ids that links are dealt by, and that count blocks are made for.
STRIPES, FINE = 32, 256
#: Distinct pairs that a task sums up before it passes them on.
MOST_PAIRS = 1 << 21
#: Partial blocks of a stripe that one task adds up, and slices whose links one task scores.
PARTIALS, SCORED = 256, 4096
#: Least parts of a stripe's links.
LEAST_SALTS = 8
#: A single space between two visible characters begins a token on both sides.
_CUT = re.compile(r"(?<=[!-~\w]) (?=[!-~\w])")
_VISIBLE = re.compile(r"[!-~\w]")


@dataclass(frozen=True)
class Vocabularies:
    """The files of both sides: a byte-level BPE (JSON) and a piece model with byte fallback."""

    byte_level: bytes
    pieces: bytes


def byte_level_alphabet() -> dict[str, int]:
    """Characters by which byte-level vocabularies write bytes: printable Latin-1 stands for
    itself, the other bytes in order for the characters from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(others)}


@dataclass
class Encoded:
    """Tokens of some texts, text after text: ids, how many a text has, and whether a text's
    chunks all give their own bytes back."""

    a: np.ndarray
    n_a: np.ndarray
    b: np.ndarray
    n_b: np.ndarray
    exact: np.ndarray

    def only(self, keep: np.ndarray) -> Encoded:
        return Encoded(self.a[np.repeat(keep, self.n_a)], self.n_a[keep], self.b[np.repeat(keep, self.n_b)], self.n_b[keep], self.exact[keep])

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return tuple(ids[(end := int(n[: i + 1].sum())) - int(n[i]) : end] for ids, n in ((self.a, self.n_a), (self.b, self.n_b)))


class Coders:
    """Both tokenizers with their tables: bytes and lengths of tokens, and ids as text."""

    def __init__(self, files: Vocabularies):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(files.byte_level.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        alphabet, vocabulary = byte_level_alphabet(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        #: Whether no piece goes on over a space, so that texts can be cut before one.
        self.apart = not any("▁" in p.lstrip("▁") for p in pieces)
        self.forget()
        self.lengths_a, self.lengths_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        #: An id with what follows it: "," or "|" on side A, "," or ";" on side B.
        self.shown = [b"%d%b" % (i, end) for table, ends in ((self.bytes_a, b",|"), (self.bytes_b, b",;")) for end in (ends[:1], ends[1:]) for i in range(len(table))]

    def encode(self, texts: list[str]) -> Encoded:
        """Ids of both sides of all texts (none empty), put together from those of their chunks."""
        if self._kept_chars > KEPT_CHARS:
            self.forget()
        split = [self.chunks_of(text) for text in texts]
        self._learn(list({chunk for chunks in split for chunk in chunks} - self._index.keys()))
        chunks = np.fromiter(map(self._index.__getitem__, chain.from_iterable(split)), np.int64)
        last = np.cumsum(np.array([len(x) for x in split], np.int64)) - 1
        sides = []
        for ids, upto in zip(self._ids, self._upto, strict=True):
            first, n = upto[chunks], upto[chunks + 1] - upto[chunks]
            total = np.cumsum(n)
            at = np.repeat(first - total + n, n) + np.arange(total[-1] if len(n) else 0)
            sides.append((ids[at], np.diff(total[last], prepend=0) if len(last) else last))
        exact = np.minimum.reduceat(self._exact[chunks], np.append(0, last[:-1] + 1)) if len(last) else last.astype(bool)
        return Encoded(*sides[0], *sides[1], exact)

    def forget(self) -> None:
        """Drops the kept chunks."""
        self._index: dict[str, int] = {}
        self._ids, self._upto = [np.zeros(0, np.int64)] * 2, [np.zeros(1, np.int64)] * 2
        self._exact, self._kept_chars = np.zeros(0, bool), 0

    def _learn(self, chunks: list[str]) -> None:
        """Encodes new chunks: those that begin and end visibly together, the others one by one."""
        together = [c for c in chunks if c and _VISIBLE.match(c[0]) and _VISIBLE.match(c[-1])] if self.apart else []
        alone = list(set(chunks) - set(together))
        at = 0
        while at < len(together):
            end, size = at, 0
            while end < len(together) and (end == at or size + len(together[end]) <= PART):
                size += len(together[end])
                end += 1
            if not self._learn_together(together[at:end]):
                alone += together[at:end]
            at = end
        for chunk in alone:
            a, b = (np.array(x, np.int64) for x in (self.a.encode(" " + chunk, add_special_tokens=False).ids, self.b.encode(chunk)))
            self._keep([chunk], (a, b), ([len(a)], [len(b)]), self.covers(chunk, a, b))

    def _learn_together(self, chunks: list[str]) -> bool:
        """Encodes the chunks as one text; false if its tokens don't end where chunks do."""
        text = " ".join(chunks)
        a, b = (np.array(x, np.int64) for x in (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)))
        if not self.covers(text, a, b):
            return False
        stops, counts = np.cumsum([len(c.encode()) + 1 for c in chunks]), []
        for ids, lengths in ((a, self.lengths_a), (b, self.lengths_b)):
            ends = np.cumsum(lengths[ids])
            at = np.searchsorted(ends, stops)
            if (ends[at] != stops).any():
                return False
            counts.append(np.diff(at, prepend=-1))
        self._keep(chunks, (a, b), counts, True)
        return True

    def _keep(self, chunks: list[str], ids: tuple[np.ndarray, np.ndarray], counts, exact: bool) -> None:
        self._index.update(zip(chunks, range(len(self._index), len(self._index) + len(chunks)), strict=True))
        self._ids = [np.concatenate([old, new]) for old, new in zip(self._ids, ids, strict=True)]
        self._upto = [np.concatenate([old, old[-1] + np.cumsum(n)]) for old, n in zip(self._upto, counts, strict=True)]
        self._exact = np.append(self._exact, np.full(len(chunks), exact))
        self._kept_chars += sum(map(len, chunks))

    def chunks_of(self, text: str) -> list[str]:
        """The text cut at single spaces, which are dropped: what a space and each chunk give
        is what a space and the whole text give."""
        return _CUT.split(text) if self.apart else [text]

    def covers(self, text: str, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether both sides' bytes are a space and the text."""
        raw = b" " + text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, b.tolist())) == raw


def pack(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, by byte planes and compressed."""
    x = np.ascontiguousarray(x, "<u8" if len(x) and int(x.max()) >> 32 else "<u4")
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return bytes([x.itemsize]) + len(x).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(raw: bytes) -> np.ndarray:
    width, n = raw[0], int.from_bytes(raw[1:9], "little")
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(raw[9:], width * n, "zstd"), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.int64)


class Aligned:
    """Links and groups of some texts: ids and ends of all tokens, text after text."""

    def __init__(self, coders: Coders, encoded: Encoded):
        a, b, self.n_a, self.n_b = encoded.a, encoded.b, encoded.n_a, encoded.n_b
        n = len(self.n_a)
        ends_a, ends_b = np.cumsum(coders.lengths_a[a]), np.cumsum(coders.lengths_b[b])
        size = int(ends_a[-1]) + 1 if len(a) else 1
        on_a, on_b = np.zeros(size, bool), np.zeros(size, bool)
        on_a[ends_a] = True
        on_b[ends_b] = True
        both = on_a & on_b
        ends = np.flatnonzero(on_a | on_b)
        at_a, at_b = ((np.cumsum(on, dtype=np.int32) - on)[ends] for on in (on_a, on_b))
        self.a, self.b = a[at_a], b[at_b]
        doc_of_a = np.repeat(np.arange(n), self.n_a)
        self.doc = doc_of_a[at_a]
        before = np.cumsum(both, dtype=np.int32) - both
        self.group_a, self.group_b = before[ends_a], before[ends_b]
        self.n_links = np.bincount(self.doc, minlength=n)
        self.n_groups = np.bincount(doc_of_a[both[ends_a]], minlength=n)
        self._tokens = a, b, both[ends_a], both[ends_b]

    def digests(self, coders: Coders) -> list[str]:
        """The sha256 of each text's groups, shown as ids."""
        a, b, last_a, last_b = self._tokens
        if not len(a):
            return []
        n_groups = int(self.group_a[-1]) + 1
        per_a, per_b = np.bincount(self.group_a, minlength=n_groups), np.bincount(self.group_b, minlength=n_groups)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(per_b) - per_b)[self.group_a]] = a + last_a * len(coders.bytes_a)
        order[np.arange(len(b)) + np.cumsum(per_a)[self.group_b]] = 2 * len(coders.bytes_a) + b + last_b * len(coders.bytes_b)
        shown = [coders.shown[i] for i in order.tolist()]
        upto = np.append(0, np.cumsum(self.n_a + self.n_b)).tolist()
        return [hashlib.sha256(b"".join(shown[x:y])[:-1]).hexdigest() for x, y in zip(upto[:-1], upto[1:], strict=True)]


class PairTotals:
    """Counts of pairs (as one number each) that a task has met."""

    def __init__(self) -> None:
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, codes: np.ndarray, counts: np.ndarray) -> None:
        both, at = np.unique(np.concatenate([self.codes, codes]), return_inverse=True)
        sums = np.zeros(len(both), np.int64)
        np.add.at(sums, at, np.concatenate([self.counts, counts]))
        self.codes, self.counts = both, sums


def _links(found: Aligned, n_docs: int, width: int, n_b: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per stripe: its distinct pairs, how far each entry (document, pair) lies behind the
    last one, and the links of the entry. A pair is ``b // STRIPES * width + a``."""
    codes = (-(-n_b // STRIPES)) * width
    key = ((found.b % STRIPES) * n_docs + found.doc) * codes + found.b // STRIPES * width + found.a
    key, times = np.unique(key, return_counts=True)
    edges = np.searchsorted(key, np.arange(STRIPES + 1) * (n_docs * codes))
    for stripe in range(STRIPES):
        lo, hi = edges[stripe], edges[stripe + 1]
        if lo < hi:
            own = key[lo:hi] - stripe * n_docs * codes
            pairs, at = np.unique(own % codes, return_inverse=True)
            place = own // codes * len(pairs) + at
            yield stripe, pairs, np.diff(place, prepend=0), times[lo:hi]


_KEPT: dict[str, Coders] = {}
keeps_tables("token_alignment", _KEPT.clear)


def _coders(files: Vocabularies) -> Coders:
    key = hashlib.sha256(files.byte_level).hexdigest() + hashlib.sha256(files.pieces).hexdigest()
    begin_work("token_alignment")
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Coders(files)
    return _KEPT[key]


def _sizes(files: Vocabularies) -> tuple[int, int]:
    coders = _coders(files)
    return len(coders.bytes_a), len(coders.bytes_b)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Ids and texts of about ``SLICE`` characters."""
    for batch in batches:
        texts, at = [], 0
        size = 0
        for i, text in enumerate(batch.column(1)):
            texts.append(text.as_py())
            size += len(texts[-1] or "")
            if size >= SLICE or i == batch.num_rows - 1:
                yield batch.column(0).slice(at, len(texts)), texts
                texts, at, size = [], i + 1, 0


def encoded(docs: DataFrame, files: Vocabularies, id_col: str, text_col: str) -> DataFrame:
    """Rows of three kinds: of documents (``doc`` is set), links (``stripe``) and counts (``fine``).

    ``block`` tells slices apart; it is made in the task, so this table has to be staged
    before it is used more than once."""
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    whole, binary, long = T.IntegerType(), T.BinaryType(), T.LongType()
    kinds = [("block", long), ("doc", whole), ("k", source.schema["k"].dataType), ("n_a", long), ("n_b", long), ("n_groups", long), ("n_links", long), ("groups_sha256", T.StringType()), ("stripe", whole), ("pairs", binary), ("steps", binary), ("times", binary), ("fine", whole), ("codes", binary), ("counts", binary)]
    schema = T.StructType([T.StructField(c, t) for c, t in kinds])
    shared = docs.sparkSession.sparkContext.broadcast(files)

    def rows(n: int, target: pa.Schema, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in target], schema=target)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = _coders(shared.value)
        width, n_b = len(coders.bytes_a), len(coders.bytes_b)
        per_fine = (-(-n_b // FINE)) * width
        block = TaskContext.get().partitionId() << 32
        totals, target = PairTotals(), None

        def summed() -> Iterator[pa.RecordBatch]:
            edges = np.searchsorted(totals.codes, np.arange(FINE + 1) * per_fine)
            some = [i for i in range(FINE) if edges[i] < edges[i + 1]]
            cut = [slice(edges[i], edges[i + 1]) for i in some]
            if some:
                yield rows(len(some), target, block=[block] * len(some), fine=some, codes=[pack(totals.codes[x] - i * per_fine) for i, x in zip(some, cut, strict=True)], counts=[pack(totals.counts[x]) for x in cut])

        for keys, texts in _slices(batches):
            if target is None:
                arrow = {long: pa.int64(), whole: pa.int32(), binary: pa.binary(), T.StringType(): pa.string()}
                target = pa.schema([pa.field(c, keys.type if c == "k" else arrow[t]) for c, t in kinds])
            there = [i for i, text in enumerate(texts) if text]
            ids = coders.encode([texts[i] for i in there])
            good = np.array([exact or coders.covers(texts[i], *ids.of(j)) for j, (i, exact) in enumerate(zip(there, ids.exact.tolist(), strict=True))], bool)
            kept = np.array(there, np.int64)[good]
            found = Aligned(coders, ids.only(good))
            numbers = {}
            for c in ("n_a", "n_b", "n_groups", "n_links"):
                numbers[c] = np.zeros(len(texts), np.int64)
                numbers[c][kept] = getattr(found, c)
            shown = [""] * len(texts)
            for i, digest in zip(kept.tolist(), found.digests(coders), strict=True):
                shown[i] = digest
            yield rows(len(texts), target, block=np.full(len(texts), block), doc=np.arange(len(texts), dtype=np.int32), k=keys, groups_sha256=shown, **numbers)
            found.doc = kept[found.doc]
            links = list(_links(found, len(texts), width, n_b))
            if links:
                stripe, pairs, steps, times = zip(*links, strict=True)
                yield rows(len(links), target, block=[block] * len(links), stripe=list(stripe), pairs=list(map(pack, pairs)), steps=list(map(pack, steps)), times=list(map(pack, times)))
            totals.add(*np.unique((found.b % FINE) * per_fine + found.b // FINE * width + found.a, return_counts=True))
            if len(totals.codes) > MOST_PAIRS:
                yield from summed()
                totals = PairTotals()
            block += 1
        yield from summed()
        coders.forget()
        release_memory()

    return source.mapInArrow(work, schema)


def _added_up(parts: DataFrame, keys: list[str], n_ids: int, width: int, best: bool) -> DataFrame:
    """Partial counts (fine, codes, counts) of each key added up in a dense block.

    If ``best``, the rows are a stripe's: (stripe, pairs, counts, is_best), the pairs as in links."""
    schema = "stripe int, pairs binary, counts binary, is_best binary" if best else "fine int, codes binary, counts binary"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("token_alignment_counts")
        block, at = np.zeros(n_ids * width, np.int64), None

        def row() -> pa.RecordBatch:
            codes = np.flatnonzero(block)
            counts = block[codes]
            if not best:
                values = [at[0], pack(codes), pack(counts)]
            else:
                top = block.reshape(n_ids, width).max(axis=1)
                b = codes // width * FINE + at[0]
                values = [at[0] % STRIPES, pack(b // STRIPES * width + codes % width), pack(counts), pack((counts == top[codes // width]).astype(np.int64))]
            block[codes] = 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32()] + [pa.binary()] * (len(values) - 1), strict=True)], names=[f.split()[0] for f in schema.split(", ")])

        for batch in batches:
            for *key, codes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at is not None and key != at:
                    yield row()
                at = key
                np.add.at(block, unpack(codes), unpack(counts))
        if at is not None:
            yield row()
        del block
        release_memory()

    ordered = parts.select(*keys, "codes", "counts").repartition(*keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(work, schema)


def _counted(table: DataFrame, n_a: int, n_b: int, label: str) -> DataFrame:
    """(stripe, pairs, counts, is_best): counts of all pairs, over the whole table."""
    parts = table.where("fine is not null").select("block", "fine", "codes", "counts")
    n_ids, salts = -(-n_b // FINE), -(-parts.count() // (FINE * PARTIALS))
    if salts > 1:
        salted = parts.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
        parts = _added_up(salted, ["fine", "salt"], n_ids, n_a, best=False)
    return stage(_added_up(parts, ["fine"], n_ids, n_a, best=True), f"{label}-counts")


def _scores(table: DataFrame, counts: DataFrame) -> DataFrame:
    """(block, doc, n_best, count_sum): sums over each document's links, by stripe."""
    links = table.where("stripe is not null").select("stripe", "block", "pairs", "steps", "times")
    salts = max(LEAST_SALTS, -(-links.count() // (STRIPES * SCORED)))
    none = F.lit(None).cast("binary")
    dealt = links.select("stripe", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), "block", "pairs", F.col("steps").alias("x"), F.col("times").alias("y"))
    known = counts.select("stripe", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "pairs", F.col("counts").alias("x"), F.coalesce("is_best", none).alias("y"))
    schema = "block long, doc int, n_best long, count_sum long"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("token_alignment_counts")
        at, ready = None, False
        parts: list[tuple[np.ndarray, ...]] = []
        pairs = counts = best = np.zeros(0, np.int64)
        for batch in batches:
            for stripe, salt, kind, block, listed, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (stripe, salt) != at:
                    at, ready, parts = (stripe, salt), False, []
                if kind == 0:
                    parts.append((unpack(listed), unpack(x), unpack(y)))
                    continue
                if not ready:
                    pairs, counts, best = (np.concatenate(z) for z in zip(*parts, strict=True))
                    order = np.argsort(pairs)
                    pairs, counts, best, ready, parts = pairs[order], counts[order], best[order], True, []
                own = np.searchsorted(pairs, unpack(listed))
                place, times = np.cumsum(unpack(x)), unpack(y)
                doc, of = place // len(own), own[place % len(own)]
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                sums = [np.add.reduceat(v, first) for v in (best[of] * times, counts[of] * times)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block)), pa.array(doc[first].astype(np.int32)), *map(pa.array, sums)], names=["block", "doc", "n_best", "count_sum"])
        release_memory()

    together = known.unionByName(dealt).repartition("stripe", "salt").sortWithinPartitions("stripe", "salt", "kind")
    by_stripe = together.mapInArrow(work, schema)
    return by_stripe.groupBy("block", "doc").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, files: Vocabularies, id_col: str = "doc_id", text_col: str = "text", label: str = "align") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    A pair's count is how many links of all rows hold it; ``n_best`` are the links whose count
    is the highest of their B id, ties included, ``count_sum`` is the sum of counts over links.
    A null or empty text, and one whose tokens' bytes on either side aren't a space and the text,
    has no tokens: zeros and an empty ``groups_sha256``. Repeated rows each give a row and count
    each time; null ids stay null. Other columns are ignored, whatever their names. Texts of any
    length are taken whole. An empty table gives an empty result. The vocabularies (a fixed few
    MB) are broadcast.
    """
    table = stage(encoded(docs, files, id_col, text_col), f"{label}-encoded")
    scores = _scores(table, _counted(table, *_sizes(files), label)).withColumnsRenamed({"block": "s_block", "doc": "s_doc"})
    rows = table.where("doc is not null").select("block", "doc", "k", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = rows.join(scores, (F.col("block") == F.col("s_block")) & (F.col("doc") == F.col("s_doc")), "left")
    return out.select(F.col("k").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")


def pair_counts(docs: DataFrame, files: Vocabularies, text_col: str = "text", label: str = "pairs") -> DataFrame:
    """(a_id, b_id, count, is_best) of every linked pair of ids: the alignment itself.

    Rows are treated as in ``align``; a table without links gives no rows."""
    n_a, n_b = _sizes(files)
    table = stage(encoded(docs.select(F.lit(0).alias("k"), F.col(text_col).alias("t")), files, "k", "t"), f"{label}-encoded")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stripe, pairs, counts, best in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs = unpack(pairs)
                columns = [pairs % n_a, pairs // n_a * STRIPES + stripe]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), pa.array(unpack(counts)), pa.array(unpack(best).astype(bool))], names=["a_id", "b_id", "count", "is_best"])

    return _counted(table, n_a, n_b, label).mapInArrow(spread, "a_id int, b_id int, count long, is_best boolean")
