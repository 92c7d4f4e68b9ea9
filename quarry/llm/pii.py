"""Personal data by fixed forms and a semi-Markov conditional random field.

The field scores whole spans: a segment of up to ``LONGEST`` tokens of one type has
features of its shape, digits, checksums and left neighbour, which no single token
shows. Decoding is dynamic programming over segment ends, bounded by the longest
entity, that chooses boundaries and types together. Weights are trained here, by
gradient ascent on the conditional likelihood of generated labelled sentences (forward
and backward sums over the same segments).

A segment holds a spelled address or ``LEAST_DIGITS`` to ``MOST_DIGITS`` digits, so only
tokens within ``LONGEST`` tokens of a digit, an ``@`` or a spelled-out ``at`` can be in
one, and the lattice of a text is a set of regions of that reach; all other tokens are
outside in any labelling. Spans of the fixed forms always stay; the field adds spans
apart from them.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bytewords import Slice, slices

KINDS = ("email", "ip", "card", "phone")
# The base forms of the contract.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The same matches as IP, in one pass over any run of digits and dots.
_IP_ONCE = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
#: Most tokens of a segment.
LONGEST = 24
#: Digits of a segment that spells no address.
LEAST_DIGITS, MOST_DIGITS = 4, 19
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]", re.A)
_TRIGGER = re.compile(r"[0-9@]|[(\[{]\s?(?:at|dot)\s?[)\]}]|\bat\s+[A-Za-z0-9-]+\s+dot\b", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """All matches of EMAIL: each must hold the first ``@`` after a run of local characters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed forms, by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)]
    out += [(1, m.start(), m.end()) for m in _IP_ONCE.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def _reach(text: str, at: int, step: int) -> int:
    """Where the ``LONGEST`` tokens before (step -1) or from ``at`` on (1) begin or end."""
    width = 8 * LONGEST
    while True:
        if step > 0:
            found = tokens(text, at, min(len(text), at + width))
            if at + width >= len(text) or len(found) > LONGEST:  # the last one may be cut
                return found[min(LONGEST, len(found)) - 1][1] if found else at
        else:
            found = tokens(text, max(0, at - width), at)
            if at <= width or len(found) > LONGEST:
                return found[-min(LONGEST, len(found))][0] if found else at
        width *= 4


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text within ``LONGEST`` tokens of a trigger, merged."""
    first = last = None
    for m in _TRIGGER.finditer(text):
        if last is not None and m.start() <= last + LONGEST:  # a token has a character at least
            last = max(last, m.end())
            continue
        a = _reach(text, m.start(), -1)
        if last is not None:
            end = _reach(text, last, 1)
            if a <= end:
                last = m.end()
                continue
            yield first, end
        first, last = a, m.end()
    if last is not None:
        yield first, _reach(text, last, 1)


def _bucket(n: int) -> str:
    return str(n) if n < 4 else "4-6" if n < 7 else "7-9" if n < 10 else "10-12" if n < 13 else "13-15" if n < 16 else "16-19" if n < 20 else "20+"


def _shape(span: str) -> str:
    out = re.sub(r"[0-9]+", "9", re.sub(r"[A-Za-z]+", "a", re.sub(r"(?i)[(\[{]\s?at\s?[)\]}]|\bat\b", "@@", re.sub(r"(?i)[(\[{]\s?dot\s?[)\]}]|\bdot\b", "..", span))))
    return re.sub(r"\s+", " ", out)


def features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the segment of tokens i..j (exclusive), the same for all types."""
    span = text[toks[i][0] : toks[j - 1][1]]
    shape = _shape(span)
    digits = re.sub(r"[^0-9]", "", span)
    before = text[max(0, toks[i][0] - 1) : toks[i][0]]
    after = text[toks[j - 1][1] : toks[j - 1][1] + 1]
    out = ["bias", f"shape={shape[:24]}", f"digits={_bucket(len(digits))}", f"letters={_bucket(len(re.sub('[^A-Za-z]', '', span)))}", f"first={shape[:1]}", f"last={shape[-1:]}", f"seps={''.join(sorted(set(re.sub('[9a@]', '', shape))))}"]
    around = text[max(0, toks[i][0] - 2) : toks[i][0]], text[toks[j - 1][1] : toks[j - 1][1] + 2]
    out += [f"head={_shape(around[0])}", f"tail={_shape(around[1])}"]
    out.append(f"edges={'w' if before.isalnum() else 's' if not before or before.isspace() else 'p'}{'w' if after.isalnum() else 's' if not after or after.isspace() else 'p'}")
    groups = re.findall(r"[0-9]+", span)
    if groups:
        out.append(f"groups={','.join(str(len(g)) for g in groups[:6])}")
    local, at, host = shape.partition("@")
    if at:
        host = re.sub(r"\s?\.\.\s?", ".", host.removeprefix("@").strip())
        out.append(f"mail={' ' in local.strip()}{' ' in host}{'.' in host}{local.strip()[-1:]}")
    if 16 <= len(digits) <= 19:
        out.append(f"luhn={luhn(digits)}")
    if len(groups) == 4:
        out.append(f"octets={all(len(g) < 4 and int(g) < 256 for g in groups)}")
    if i:
        word = text[toks[i - 1][0] : toks[i - 1][1]].lower()
        out.append(f"cue={word if word.isalpha() and len(word) < 9 else _shape(word)[:24]}")
    return out


_DOT = re.compile(r"(?i)\bdot\b")
_ADDRESS = re.compile(r"(?i)(?=(@|[(\[{]\s?at\s?[)\]}]|\bat\s+\S+\s+dot\b))")


class Lattice:
    """The segments of a region: ends[j] lists (i, features).

    A segment begins and ends in a letter, digit, ``+`` or ``(``, spans no line end or wide
    gap, and holds a spelled address, or digits enough and no letters but ``dot``."""

    def __init__(self, text: str, toks: list[tuple[int, int]]):
        self.n = n = len(toks)
        self.ends: list[list[tuple[int, list[str]]]] = [[] for _ in range(n + 1)]
        if not n:
            return
        begin, stop = toks[0][0], toks[-1][1]
        dots = {m.start() for m in _DOT.finditer(text, begin, stop)}
        addresses = sorted((m.start(1), m.end(1)) for m in _ADDRESS.finditer(text, begin, stop))
        # for each token: digits and letters before it, first wide gap after it, where the
        # first address that begins at it or later ends
        digits, letters, gap, spelled = [0] * (n + 1), [0] * (n + 1), [n] * (n + 1), [stop + 1] * (n + 1)
        for t, (a, b) in enumerate(toks):
            c = text[a]
            digits[t + 1] = digits[t] + (b - a if c.isdigit() else 0)
            letters[t + 1] = letters[t] + (c.isalpha() and a not in dots)
        for t in range(n - 1, -1, -1):
            between = text[toks[t][1] : toks[t + 1][0]] if t + 1 < n else "\n"
            gap[t] = t + 1 if "\n" in between or "  " in between else gap[t + 1]
            while addresses and addresses[-1][0] >= toks[t][0]:
                spelled[t] = min(spelled[t], addresses.pop()[1])
            spelled[t] = min(spelled[t], spelled[t + 1])
        first = [text[a].isalnum() or text[a] in "+(" for a, _ in toks]
        last = [text[b - 1].isascii() and text[b - 1].isalnum() for _, b in toks]
        for i in range(n):
            if not first[i]:
                continue
            for j in range(i + 1, min(gap[i], i + LONGEST) + 1):
                held = digits[j] - digits[i]
                address = toks[j - 1][1] >= spelled[i]
                if held > MOST_DIGITS and spelled[i] > stop:
                    break
                if last[j - 1] and (address or (LEAST_DIGITS <= held <= MOST_DIGITS and letters[j] == letters[i])):
                    self.ends[j].append((i, features(text, toks, i, j)))


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs)) if top > -math.inf else top


class SemiMarkov:
    """Weights by (type, feature); a token outside of entities scores 0."""

    def __init__(self) -> None:
        self.weights: dict[tuple[int, str], float] = {}

    def score(self, kind: int, feats: list[str]) -> float:
        w = self.weights
        return sum(w.get((kind, f), 0.0) for f in feats)

    def decode(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """(first token, end token, kind) of the best labelling."""
        best, back = [0.0] * (lattice.n + 1), [None] * (lattice.n + 1)
        for j in range(1, lattice.n + 1):
            best[j] = best[j - 1]
            for i, feats in lattice.ends[j]:
                for kind in range(len(KINDS)):
                    s = best[i] + self.score(kind, feats)
                    if s > best[j]:
                        best[j], back[j] = s, (i, kind)
        out, j = [], lattice.n
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
        return out[::-1]

    def _marginals(self, lattice: Lattice) -> Iterator[tuple[float, int, list[str], int, int]]:
        n, kinds = lattice.n, range(len(KINDS))
        scored = [[(i, f, [self.score(k, f) for k in kinds]) for i, f in ends] for ends in lattice.ends]
        ahead = [0.0] + [0.0] * n
        for j in range(1, n + 1):
            ahead[j] = _logsum([ahead[j - 1]] + [ahead[i] + s for i, _, ss in scored[j] for s in ss])
        rest: list[list[float]] = [[] for _ in range(n + 1)]
        behind = [0.0] * (n + 1)
        for j in range(n, -1, -1):
            if j < n:
                behind[j] = _logsum(rest[j] + [behind[j + 1]])
            for i, _, ss in scored[j]:
                rest[i] += [behind[j] + s for s in ss]
        for j in range(1, n + 1):
            for i, f, ss in scored[j]:
                for k, s in enumerate(ss):
                    p = math.exp(ahead[i] + s + behind[j] - ahead[n])
                    if p > 1e-4:
                        yield p, k, f, i, j

    def train(self, data: list[tuple[Lattice, set[tuple[int, int, int]]]], epochs: int = 6, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> None:
        """Ascends the log-likelihood, a sentence at a time, weights pulled to zero."""
        rng = random.Random(seed)
        for epoch in range(epochs):
            step = rate / (1 + epoch)
            for lattice, truth in rng.sample(data, len(data)):
                grad: dict[tuple[int, str], float] = {}
                for p, k, feats, i, j in self._marginals(lattice):
                    for f in feats:
                        grad[k, f] = grad.get((k, f), 0.0) - p
                for j, ends in enumerate(lattice.ends):
                    for i, feats in ends:
                        for k in range(len(KINDS)):
                            if (i, j, k) in truth:
                                for f in feats:
                                    grad[k, f] = grad.get((k, f), 0.0) + 1.0
                for key, g in grad.items():
                    w = self.weights.get(key, 0.0)
                    self.weights[key] = w + step * (g - decay * w)


def labelled_sentences(n: int = 1500, seed: int = 3) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Generated sentences with the spans of their entities: (start, end, kind).

    They hold entities in the base forms and in others (spelled-out addresses, numbers
    without a country code or with other separators), and look-alikes that are none:
    versions, dates, amounts, times, ratios, and long numbers that fail the checksum."""
    rng = random.Random(seed)
    syllables = "an the er in on re th de la que ment tion ou eau sch ung heit ver ci os as do te le and of".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(ok: bool, k: int = 16) -> str:
        body = str(rng.randint(1, 9)) + num(k - 2)
        good = next(c for c in "0123456789" if luhn(body + c))
        return body + (good if ok else str((int(good) + rng.randint(1, 9)) % 10))

    def spaced(digits: str, sep: str) -> str:
        return sep.join(digits[a : a + 4] for a in range(0, len(digits), 4))

    def entity() -> tuple[str, int]:
        at, dot = rng.choice([("@", "."), ("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("(at)", "."), (" (at) ", "."), (" [at] ", "."), (" [at] ", " [dot] "), ("[at]", "[dot]")])
        host = [f"{word()}{rng.choice(['', num(1)])}", *(word() for _ in range(rng.choice([0, 1, 1, 2]))), rng.choice(["com", "org", "net", "de", "fr"])]
        local = rng.choice([".", "-", "_"]).join(word() for _ in range(rng.choice([1, 1, 2, 2, 3, 5]))) + rng.choice(["", "", num(2), "." + num(2)])
        said = rng.choice([str, str, str.title, str.upper])
        octets = [str(rng.randint(0, 255)) for _ in range(4)]
        a, b, c = num(3), num(3), num(4)
        kind = rng.randrange(4)
        return [
            said(f"{local}{at}{dot.join(host)}"),
            rng.choice([".", ".", "[.]", " dot "]).join(octets),
            spaced(card(True), rng.choice(["", " ", "-", ".", "/"])),
            rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{rng.randint(10, 99)} {a} {b}{c}", f"+{rng.randint(1, 99)}-{a}-{b}-{c}"]),
        ][kind], kind

    def other() -> str:
        return rng.choice([f"version {num(1)}.{num(1)}", f"{num(1)}.{num(1)}.{num(2)}", f"{rng.randint(1900, 2030)}", f"{num(2)}/{num(2)}/{rng.randint(1900, 2030)}", f"{rng.randint(1900, 2030)}-{num(2)}-{num(2)}", f"${num(3)},{num(3)}.{num(2)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(3)}%", num(rng.randint(4, 24)), card(False), spaced(card(False), rng.choice([" ", "-"])), f"{rng.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}", f"{num(2)}.{num(2)}.{num(2)}.{num(2)}.{num(2)}", f"page {num(3)}-{num(3)}", f"{num(6)}", f"{word()} at {word()}", f"{num(3)} {num(3)} {num(3)} {num(3)} {num(3)}", f"@{word()}", f"{num(1)}.{num(6)}", f"{word()}{num(4)}", f"'{num(16)}{word()}{num(5)}'", f"{num(3)}-{num(4)}"])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            text += " ".join([*(word() for _ in range(rng.randint(0 if not text else 1, 5))), ""])
            if rng.random() < 0.55:
                cue = rng.choice(["", "", "", "call ", "mail ", "ip ", "card ", "tel: ", "host "])
                body, kind = entity()
                spans.append((len(text) + len(cue), len(text) + len(cue) + len(body), kind))
                text += cue + body
            else:
                text += other()
            text += rng.choice([" ", ". ", ", ", "### ", "%%% ", "!! ", " | ", "\n"])
        out.append((text + word() if rng.random() < 0.7 else text.rstrip(" \n"), spans))
    return out


_MODEL: list[SemiMarkov] = []


def trained_model() -> SemiMarkov:
    """Trained once in a process, from the generated sentences."""
    if not _MODEL:
        data = []
        for text, spans in labelled_sentences():
            for a, b in regions(text):
                toks = tokens(text, a, b)
                starts, ends = {t[0]: i for i, t in enumerate(toks)}, {t[1]: i + 1 for i, t in enumerate(toks)}
                truth = {(starts[s], ends[e], k) for s, e, k in spans if s in starts and e in ends}
                data.append((Lattice(text, toks), truth))
        model = SemiMarkov()
        model.train(data)
        _MODEL.append(model)
    return _MODEL[0]


def added_spans(text: str, base: list[tuple[int, int, int]], model: SemiMarkov) -> list[tuple[int, int, int]]:
    """Entities of the field's best labelling that no base span touches."""
    out, starts, reach = [], [], []
    for _, x, y in sorted(base, key=lambda z: z[1]):
        starts.append(x)
        reach.append(max(y, reach[-1] if reach else 0))
    for a, b in regions(text):
        toks = tokens(text, a, b)
        for i, j, kind in model.decode(Lattice(text, toks)):
            s, e = toks[i][0], toks[j - 1][1]
            before = bisect.bisect_left(starts, e)  # base spans that begin before the end
            if not before or reach[before - 1] <= s:
                out.append((kind, s, e))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_HOT = np.zeros(256, bool)
_HOT[[*range(48, 58), 64]] = True
_SPELLED = re.compile(rb"[(\[{]\s?at\s?[)\]}]|\bat\s+[A-Za-z0-9-]+\s+dot\b", re.I)


def candidate_rows(part: Slice) -> np.ndarray:
    """Rows of a slice with a digit, an ``@`` or a spelled-out address."""
    hits = np.concatenate((np.flatnonzero(_HOT[part.data]), np.array([m.start() for m in _SPELLED.finditer(part.data.tobytes())], np.int64)))
    return np.unique(np.searchsorted(part.offsets, hits, "right") - 1)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiMarkov | None = None) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans) per row.

    Counts and digest are of the base spans, ``kind:start:end`` in code points by kind,
    then start; ``spans`` lists the base and the added ones alike. Null and empty texts
    have none. An added span has ``LONGEST`` tokens at most (runs of letters, runs of
    digits, other characters), and ``LEAST_DIGITS`` to ``MOST_DIGITS`` digits if it spells
    no address. Texts are read whole; equal scores go to the labelling met first;
    repeated rows get equal answers; other columns are ignored, whatever their names;
    an empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    names = [*(f"n_{k}" for k in KINDS), "n_added"]
    schema = T.StructType([source.schema["k"], *(T.StructField(c, T.LongType()) for c in names), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast((model or trained_model()).weights)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = SemiMarkov()
        field.weights = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column(1)
            counts, digests, spans = np.zeros((len(texts), 5), np.int64), [nothing] * len(texts), [""] * len(texts)
            for part in slices(texts):
                for r in candidate_rows(part):
                    text = part.data[part.offsets[r] : part.offsets[r + 1]].tobytes().decode()
                    base = base_spans(text)
                    added = added_spans(text, base, field)
                    at = part.first + int(r)
                    counts[at, :4] = np.bincount([k for k, _, _ in base], minlength=4)
                    counts[at, 4] = len(added)
                    digests[at], spans[at] = hashlib.sha256(listed(base).encode()).hexdigest(), listed(sorted(base + added))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return source.mapInArrow(work, schema).withColumnRenamed("k", id_col)
