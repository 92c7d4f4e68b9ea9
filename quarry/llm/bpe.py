"""Byte-level BPE as a lazily determinised finite-state transducer, and its inverse.

Encoding. A token sequence is what the merges give exactly if every adjacent pair of
its tokens is (the pair's bytes, merged on their own, give that pair back). So each
prefix of a piece has one last token, and the transducer's state after some bytes is
the last token it has committed and the bytes since. A token is emitted as soon as all
ways in which later bytes can continue share it: lookahead ends with the longest
vocabulary entry that the pending bytes may still become. States and arcs are made
when first taken and kept in a table; once that is full, a missing arc makes the
machine go on undetermined to the piece's end. Pieces of text seen before are kept in a
table too, which is emptied when full. Neither bound changes a result.

Decoding. Token bytes stream through an incremental UTF-8 state machine that holds
back an unfinished sequence (3 bytes at most) and replaces ill-formed ones.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bytewords import begin_work, release_memory, slices

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are packed as little-endian 32-bit integers")

#: Bounds of the lazily filled tables, in entries.
STATES = 100_000
PIECES = 200_000
#: Bytes of texts whose results are one batch.
RESULT_BYTES = 1 << 20
_NONE = 1 << 40  # above every rank


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line.strip())}


def merge_by_rank(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The definition: merge the adjacent pair of least rank, leftmost first."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    costs = [ranks.get(piece[i : i + 2], _NONE) for i in range(len(piece) - 1)]
    while costs and (least := min(costs)) != _NONE:
        i = costs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del costs[i]
        if i:
            costs[i - 1] = ranks.get(parts[i - 1] + parts[i], _NONE)
        if i < len(costs):
            costs[i] = ranks.get(parts[i] + parts[i + 1], _NONE)
    return tuple(ranks[p] for p in parts)


class Transducer:
    """Bytes in, token ids out. State 0 is the start of a piece."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")
        self._build_trie()
        self.fits: dict[int, bool] = {}
        self.histories: dict[int, tuple | None] = {}
        self._reset()

    def _build_trie(self) -> None:
        """A trie of all tokens with suffix links. For each node: ``ends`` has (length,
        token) of the tokens that end there, longest first; ``opens`` the lengths of the
        suffixes that can still grow into longer tokens."""
        self.child: dict[int, int] = {}
        token, up, depth, grows = [-1], [(0, 0)], [0], [True]
        for piece, rank in self.ranks.items():
            node = 0
            for byte in piece:
                key = node << 8 | byte
                after = self.child.get(key)
                if after is None:
                    grows[node] = True
                    after = self.child[key] = len(token)
                    token.append(-1)
                    up.append((node, byte))
                    depth.append(depth[node] + 1)
                    grows.append(False)
                node = after
            token[node] = rank
        self.suffix = [0] * len(token)
        self.ends: list[tuple] = [()] * len(token)
        self.opens: list[tuple[int, ...]] = [()] * len(token)
        for node in sorted(range(1, len(token)), key=depth.__getitem__):
            parent, byte = up[node]
            link = self.suffix[node] = self._goto(self.suffix[parent], byte) if parent else 0
            self.ends[node] = ((depth[node], token[node]), *self.ends[link]) if token[node] >= 0 else self.ends[link]
            self.opens[node] = (depth[node], *self.opens[link]) if grows[node] else self.opens[link]
        self.size = {r: len(b) for r, b in self.bytes_of.items()}

    def _goto(self, node: int, byte: int) -> int:
        """The node of the longest suffix, after one more byte, that begins a token."""
        while (after := self.child.get(node << 8 | byte)) is None:
            if not node:
                return 0
            node = self.suffix[node]
        return after

    def _reset(self) -> None:
        #: (committed token, bytes since, last token at each length of these, trie node)
        self.states: list[tuple[int, bytes, tuple[int, ...], int]] = [(-1, b"", (-1,), 0)]
        self.index: dict[tuple[int, bytes], int] = {(-1, b""): 0}
        self.arcs: dict[int, tuple[int, tuple[int, ...]]] = {}
        self.finals: dict[int, tuple[int, ...]] = {}

    def _history(self, token: int) -> tuple | None:
        """How a token's bytes merge on their own: the ranks in turn, and the first and
        last part before each and after all. None if they don't end as the token."""
        if token not in self.histories:
            parts, ranks = [bytes((b,)) for b in self.bytes_of[token]], []
            firsts, lasts = [parts[0]], [parts[-1]]
            while len(parts) > 1:
                costs = [self.ranks.get(x + y, _NONE) for x, y in zip(parts, parts[1:], strict=False)]
                least = min(costs)
                if least == _NONE:
                    break
                i = costs.index(least)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                ranks.append(least)
                firsts.append(parts[0])
                lasts.append(parts[-1])
            self.histories[token] = (tuple(ranks), tuple(firsts), tuple(lasts)) if len(parts) == 1 and self.ranks[parts[0]] == token else None
        return self.histories[token]

    def _pair(self, a: int, b: int) -> bool:
        """Whether token b can follow token a (or, for -1, begin a piece): whether their
        bytes, merged together, never merge across the boundary. Until then each side
        merges as on its own, least rank first, of equal ones the leftmost."""
        key = a << 32 | b
        fits = self.fits.get(key)
        if fits is None:
            if len(self.fits) > 2 * STATES:
                self.fits.clear()
            fits = self.fits[key] = self._history(b) is not None and (a < 0 or self._apart(a, b))
        return fits

    def _apart(self, a: int, b: int) -> bool:
        (left, _, lasts), (right, firsts, _) = self._history(a), self._history(b)
        i = j = 0
        x, y = left[0] if left else _NONE, right[0] if right else _NONE
        across = self.ranks.get(lasts[0] + firsts[0], _NONE)
        while True:
            if x <= y and x <= across:
                if x == _NONE:
                    return True
                i += 1
                x = left[i] if i < len(left) else _NONE
                if lasts[i] is not lasts[i - 1]:
                    across = self.ranks.get(lasts[i] + firsts[j], _NONE)
            elif across <= y:
                return False
            else:
                j += 1
                y = right[j] if j < len(right) else _NONE
                if firsts[j] is not firsts[j - 1]:
                    across = self.ranks.get(lasts[i] + firsts[j], _NONE)

    def _tokens(self, last: tuple[int, ...], start: int, end: int) -> tuple[int, ...]:
        """The tokens between two boundaries, read backwards from the later one."""
        out = []
        while end > start:
            out.append(last[end])
            end -= self.size[last[end]]
        return tuple(reversed(out))

    def _arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        before, tail, last, node = self.states[state]
        node, n, found = self._goto(node, byte), len(tail) + 1, -1
        for length, token in self.ends[node]:
            start = n - length
            if start == 0 and self._pair(before, token) or start > 0 and last[start] >= 0 and self._pair(last[start], token):
                found = token
                break
        tail += bytes((byte,))
        last = (*last, found)
        live = [n - length for length in self.opens[node] if length <= n and (length == n or last[n - length] >= 0)]
        done: tuple[int, ...] = ()
        if not live or live[0]:  # go back to the deepest boundary that the chains of all live starts share
            chains = {*live, n} if found >= 0 else set(live)
            while len(chains) > 1:
                high = max(chains)
                chains.remove(high)
                chains.add(high - self.size[last[high]])
            low = chains.pop()
            if low:
                done = self._tokens(last, 0, low)
                before, tail, last = done[-1], tail[low:], last[low:]
        at = self.index.get((before, tail))
        if at is None:
            at = self.index[before, tail] = len(self.states)
            self.states.append((before, tail, last, node))
        return at, done

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The tokens of one piece; a piece that is a token is that token."""
        out: list[int] = []
        state, arcs = 0, self.arcs
        for at, byte in enumerate(piece):
            key = state << 8 | byte
            arc = arcs.get(key)
            if arc is None:
                if len(self.states) >= STATES:
                    out += self._undetermined(state, piece[at:])
                    break
                arc = arcs[key] = self._arc(state, byte)
            state = arc[0]
            if arc[1]:
                out += arc[1]
        else:
            end = self.finals.get(state)
            if end is None:
                _, tail, last, _ = self.states[state]
                end = self.finals[state] = self._tokens(last, 0, len(tail))
            out += end
        if len(out) > 1 and piece in self.ranks:
            return (self.ranks[piece],)
        return tuple(out)

    def _undetermined(self, state: int, rest: bytes) -> tuple[int, ...]:
        """The tokens from a state on to the piece's end, without making states: how the
        machine goes on where an arc is missing and the table is full."""
        last, node = list(self.states[state][2]), self.states[state][3]
        n, ends, child, suffix, fits = len(last) - 1, self.ends, self.child, self.suffix, self.fits
        for byte in rest:
            while (after := child.get(node << 8 | byte)) is None and node:
                node = suffix[node]
            node = after or 0
            n += 1
            found = -1
            for length, token in ends[node]:
                start = n - length
                if start >= 0 and ((before := last[start]) >= 0 or not start):
                    fit = fits.get(before << 32 | token)
                    if fit or fit is None and self._pair(before, token):
                        found = token
                        break
            last.append(found)
        return self._tokens(last, 0, n)


class Pieces(dict):
    """Piece text to its packed ids (little-endian unsigned 32-bit), filled as needed.

    Pieces used since the last time the table was full outlive the next emptying."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer = transducer
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("I", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed


class Encoder:
    """Text to packed ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.split = regex.compile(pattern)
        self.pieces = Pieces(Transducer(ranks))

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))


_KEPT: dict[tuple[str, str], tuple[Encoder, Decoder]] = {}


def kept_coders(ranks_file: bytes, pattern: str) -> tuple[Encoder, Decoder]:
    """The coders of this process: a worker that runs many tasks keeps its tables."""
    key = (hashlib.sha256(ranks_file).hexdigest(), pattern)
    if key not in _KEPT:
        _KEPT.clear()
        ranks = read_ranks(ranks_file)
        _KEPT[key] = Encoder(ranks, pattern), Decoder(ranks)
    return _KEPT[key]


class Utf8Machine:
    """Incremental UTF-8 decoding. The state is the unfinished sequence held back."""

    #: For each lead byte range, the number of continuation bytes and the bounds of the first of them.
    LEADS = [(0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F)]
    LEAD = {b: (more, lo, hi) for first, final, more, lo, hi in LEADS for b in range(first, final + 1)}

    def __init__(self) -> None:
        self.held = b""

    def _unfinished(self, data: bytes) -> int:
        """How many bytes at the end of data begin a sequence that could go on."""
        for n in range(1, min(3, len(data)) + 1):
            b = data[-n]
            if b in self.LEAD:
                more, lo, hi = self.LEAD[b]
                rest = data[len(data) - n + 1 :]
                return n if n <= more and all((lo if i == 0 else 0x80) <= x <= (hi if i == 0 else 0xBF) for i, x in enumerate(rest)) else 0
            if not 0x80 <= b <= 0xBF:
                return 0
        return 0

    def feed(self, data: bytes) -> str:
        """The text that is certain after these bytes; U+FFFD for each ill-formed part."""
        data = self.held + data
        hold = self._unfinished(data)
        self.held = data[len(data) - hold :]
        return data[: len(data) - hold].decode("utf-8", "replace")

    def finish(self) -> str:
        out = "�" if self.held else ""
        self.held = b""
        return out


class Decoder:
    """Packed ids to bytes and text, a block of tokens at a time."""

    def __init__(self, ranks: dict[bytes, int], block: int = 65_536):
        self.table = {r: b for b, r in ranks.items()}
        self.block = block

    def stream(self, packed: bytes) -> Iterator[tuple[bytes, str]]:
        """Yields (bytes, text) as they become certain."""
        machine, find = Utf8Machine(), self.table.__getitem__
        for at in range(0, len(packed), 4 * self.block):
            data = b"".join(map(find, np.frombuffer(packed[at : at + 4 * self.block], "<u4").tolist()))
            yield data, machine.feed(data)
        yield b"", machine.finish()


def encode_decode(docs: DataFrame, ranks_file: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes each text, decodes the ids, and reports both.

    Returns id, n_tokens, ids_sha256, decoded_sha256, round_trip (the decoded text is
    the text) and, if ``with_ids``, token_ids (array of int). A null text counts as
    empty: no tokens, and the digests of nothing. Empty tables give empty results; rows
    are independent, so repeats and ties don't matter; texts of any length are handled
    whole; other columns are ignored, whatever their names; null ids stay null.
    ``ranks_file`` (a vocabulary's fixed size, under 1 MB) is broadcast.
    """
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    fields = [source.schema["k"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("round_trip", T.BooleanType())]
    fields += [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))] * with_ids
    shared = docs.sparkSession.sparkContext.broadcast(ranks_file)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("bpe")
        encoder, decoder = kept_coders(shared.value, pattern)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32())]
        for whole in batches:
            for batch in (whole.slice(part.first, part.last - part.first) for part in slices(whole.column(1), RESULT_BYTES)):
                out: list[list] = [[] for _ in fields[1:]]
                for text in batch.column(1):
                    text = text.as_py() or ""
                    packed = encoder.encode(text)
                    seen, parts = hashlib.sha256(), []
                    for data, part in decoder.stream(packed):
                        seen.update(data)
                        parts.append(part)
                    row = [len(packed) // 4, hashlib.sha256(packed).hexdigest(), seen.hexdigest(), "".join(parts) == text]
                    for column, value in zip(out, row + [np.frombuffer(packed, "<u4").astype(np.int32)] * with_ids, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=False))], names=[f.name for f in fields])
        release_memory()

    return source.mapInArrow(work, T.StructType(fields)).withColumnRenamed("k", id_col)
