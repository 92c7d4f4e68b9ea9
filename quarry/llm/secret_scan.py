"""Secret scans: fixed forms, and strings that look random to character Markov models.

Two second-order character models, which back off to first order, are trained: one from
labelled random strings and one from labelled ordinary ones (compounds of several
languages, paths, UUIDs, dates and numbers, repeated and neighbouring letters, invented
words). A long run of key characters is a secret if its log-likelihood ratio per character
is above a threshold, and so is any stretch of a run, or of what base forms leave of it,
whose ratio is above a second one. Both thresholds are set on held-out ordinary strings,
of words that training didn't see, so that at most ``FALSE_POSITIVES`` of them are called
secrets. Candidate runs are found on the bytes of many texts at once; only texts with a
candidate are looked at one by one.

Hexadecimal digits in groups count as ordinary, as in UUIDs; the fixed form finds keys of
lower-case hexadecimal digits.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bytewords import Slice, begin_work, release_memory, slices

# The base forms of the contract, and the least lengths of their matches.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
#: Fewest characters of a run that the models judge.
LEAST_RUN = 20
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_WORDS = re.compile(rb"password|passwd|secret|token|api_?key", re.I)
_CLASS = np.zeros(256, bool)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
#: Key characters that join words.
MARKS = "+/_=-"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Share of held-out ordinary strings that may be called secrets.
FALSE_POSITIVES = 0.001
#: Most labelled strings of a table that training reads.
SAMPLE = 200_000
# Ordinary words of code and prose, in several languages.
ORDINARY = """account action active address amount array author background balance batch border buffer button cache callback
category channel client cluster collection column compare complete config connection container content context control
counter create current customer database default delete description device dictionary directory discount display
document download duration element email enable encode error event example export factory feature field filter format
function generate global group handler header height history identifier image import index input insert instance
integer interface interval invoice item iterator language layer layout length level library license limit listener
location manager margin master material maximum memory message method minimum model module monitor network number
object operation option order output package page parameter parent partition pattern payment percent person picture
zeitung geschwindigkeit versicherung gesellschaft rechnung verarbeitung haupt ordnung schaft entwicklung
quelle bonjour developpement utilisateur bibliotheque chemin fichier ancien nouveau fenetre valeur
usuario contrasena mensaje direccion nombre archivo pagina siguiente busqueda proyecto""".split()
# Rows and sequences of neighbouring characters.
SEQUENCES = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "0123456789", "qwertyuiopasdfghjklzxcvbnm")


def _compound(rng: random.Random, words: list[str]) -> str:
    some = [rng.choice(words) for _ in range(rng.randint(2, 6))]
    joined = [lambda: "_".join(some), lambda: "-".join(some), lambda: "".join(w.title() for w in some), lambda: some[0] + "".join(w.title() for w in some[1:]), lambda: "_".join(some).upper(), lambda: "".join(some), lambda: "".join(some).upper(), lambda: "".join(some).capitalize(), lambda: "-".join(w.title() for w in some)]
    return rng.choice(joined)() + rng.choice(["", "", "", str(rng.randint(0, 99)), f"_{rng.randint(1900, 2099)}", f"V{rng.randint(1, 9)}"])


def _path(rng: random.Random, words: list[str]) -> str:
    short = lambda: rng.choice(["src", "lib", "x", "y", "com", "org", "v1", "v2", "api", "main", "test", "bin", "usr", "img", "a", "b", str(rng.randint(0, 2030))])
    return "/".join(rng.choice([short, lambda: rng.choice(words), lambda: _compound(rng, words)])() for _ in range(rng.randint(3, 9)))


def _groups(rng: random.Random, words: list[str]) -> str:
    digits = rng.choice(["0123456789abcdef", "0123456789ABCDEF"])
    sizes = rng.choice([(8, 4, 4, 4, 12), (8, 4, 4, 4, 12), (7, 7, 7), (4, 4, 4, 4, 4), (8, 8, 8)])
    return "-".join("".join(rng.choice(digits) for _ in range(n)) for n in sizes)


def _numbers(rng: random.Random, words: list[str]) -> str:
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    date, time = f"{rng.randint(1900, 2099)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}", f"{rng.randint(0, 23):02d}{num(2)}{num(2)}"
    return rng.choice([f"{date}T{time}Z-{num(4)}-{num(4)}", f"{date[:4]}-{date[4:6]}-{date[6:]}_{time[:2]}-{time[2:4]}-{time[4:]}-{num(3)}", num(rng.randint(20, 40)), f"{rng.choice(words)}-{'0' * rng.randint(4, 12)}{num(10)}", f"{date}_{time}_{rng.choice(words)}_{num(2)}", "-".join(num(rng.randint(2, 6)) for _ in range(6)), f"{rng.choice(words)}/{date[:4]}/{date[4:6]}/{date[6:]}/{num(5)}"])


def _repeats(rng: random.Random, words: list[str]) -> str:
    unit = "".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 1, 1, 2, 3, 4])))
    mark = rng.choice("=-_+/")
    return rng.choice([lambda: (unit * 80)[: rng.randint(20, 80)], lambda: mark * rng.randint(20, 80), lambda: rng.choice(words) + mark * 20, lambda: mark.join(str(rng.randint(0, 9)) for _ in range(12)), lambda: (rng.choice(words) + mark) * 4])()


def _neighbours(rng: random.Random, words: list[str]) -> str:
    some = "".join(rng.choice([x, x[::-1], x.upper()])[rng.randint(0, 2) :] for x in rng.choices(SEQUENCES, k=4))
    return some[: rng.randint(20, 60)]


def _invented(rng: random.Random, words: list[str]) -> str:
    parts = [w[i : i + rng.randint(2, 3)] for w in rng.choices(words, k=12) for i in (rng.randrange(len(w) - 2),)]
    onset = lambda: rng.choice([rng.choice("bcdfghjklmnprstvwyz"), rng.choice(["sch", "ch", "st", "tr", "kr", "pr", "bl", "gl", "th", "qu", "sp", "dr", "fl", "ph", "sh"]), ""])
    word = lambda: "".join(onset() + rng.choice(["a", "e", "i", "o", "u", "y", "ou", "ei", "au", "ie", "ea"]) + rng.choice(["", "", "n", "r", "s", "l", "t", "ck", "ng", "x"]) for _ in range(rng.randint(2, 5)))
    some = [word() for _ in range(rng.randint(3, 6))]
    said = rng.choice([lambda: "".join(parts), lambda: "".join(some), lambda: "_".join(some), lambda: "-".join(some), lambda: "".join(w.title() for w in some)])()
    return rng.choice([said, said, said.upper(), said.title()])


_FAMILIES = (_compound, _compound, _path, _groups, _numbers, _repeats, _neighbours, _invented, _invented, _invented)


def labelled_samples(seed: int = 11, n: int = 3000, words: list[str] | None = None) -> list[tuple[str, bool]]:
    """(string, is_random): generated strings of keys, and twice as many ordinary ones."""
    rng, out = random.Random(seed), []
    words = ORDINARY if words is None else words
    pools = [ALPHABET[:62], ALPHABET[:62], ALPHABET, ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62]]
    for i in range(n):
        out.append(("".join(rng.choice(pools[i % len(pools)]) for _ in range(rng.randint(20, 64))), True))
        out += [(_FAMILIES[(2 * i + j) % len(_FAMILIES)](rng, words), False) for j in range(2)]
    return out


class Markov:
    """Second-order character probabilities, backed off to first order, in logs."""

    def __init__(self, strings: list[str], weight: float = 4.0):
        n = len(ALPHABET)
        self.index = {c: i for i, c in enumerate(ALPHABET)}
        counts = np.zeros((n + 1, n + 1, n))  # the last index of the first two: before the string
        for s in strings:
            at = np.fromiter((self.index[c] for c in s), np.int64, len(s))
            before = np.concatenate(([n, n], at))
            np.add.at(counts, (before[:-2], before[1:-1], at), 1.0)
        one = counts.sum(axis=0) + 0.5
        one /= one.sum(axis=1, keepdims=True)
        self.logs = np.log((counts + weight * one) / (counts.sum(axis=2, keepdims=True) + weight))


def best_stretch(ratios: np.ndarray, above: float) -> tuple[int, int] | None:
    """The stretch of ``LEAST_RUN`` characters or more whose ratios exceed ``above`` by
    the greatest sum; None if no stretch's mean exceeds it."""
    if len(ratios) < LEAST_RUN:
        return None
    upto = np.append(0.0, np.cumsum(ratios - above))
    gain = upto[LEAST_RUN:] - np.minimum.accumulate(upto[:-LEAST_RUN])
    last = int(np.argmax(gain))
    return (int(np.argmin(upto[: last + 1])), last + LEAST_RUN) if gain[last] > 0 else None


class SecretModel:
    """The ratio of the two models, and thresholds from held-out ordinary strings."""

    def __init__(self, samples: list[tuple[str, bool]] | None = None, held_out: list[str] | None = None, false_positives: float = FALSE_POSITIVES):
        if samples is None:
            samples = labelled_samples(words=[w for i, w in enumerate(ORDINARY) if i % 3])
            held_out = [s for s, y in labelled_samples(12, 2000, ORDINARY[::3]) if not y] if held_out is None else held_out
            rest = [(s, y) for s, y in labelled_samples(13, 1000, ORDINARY[::3]) if not y]
        else:
            held_out, rest = held_out or [], [(s, False) for s in held_out or []]
        self._fit(samples)
        held_out = [s for s in held_out if len(s) >= LEAST_RUN]
        rng = random.Random(5)
        joined = [rng.choice("/_-=").join(rng.choice(held_out) for _ in range(rng.randint(2, 5))) for _ in held_out[::2]]
        self.threshold = max(0.0, float(np.quantile([self.score(s) for s in held_out] or [0.0], 1 - false_positives)))
        self.stretch_threshold = max(self.threshold, float(np.quantile([self._best_ratio(s) for s in [*held_out, *joined]] or [0.0], 1 - false_positives)))
        self._fit([*samples, *rest])  # the thresholds stay those of words that weren't seen

    def _fit(self, samples: list[tuple[str, bool]]) -> None:
        first = Markov([s for s, y in samples if y])
        self.ratio, self.index = (first.logs - Markov([s for s, y in samples if not y]).logs).astype(np.float32), first.index

    @classmethod
    def from_table(cls, labelled: DataFrame, string_col: str = "string", label_col: str = "is_random", limit: int = SAMPLE) -> SecretModel:
        """Trained from a table of labelled strings, of which ``limit`` at most are read, by
        a hash of the string; a fifth of the ordinary ones sets the thresholds. Strings with
        other than key characters, and nulls, are left out."""
        key = F.col(string_col).rlike(r"^[A-Za-z0-9+/_=-]+$") & F.col(label_col).isNotNull()
        rows = labelled.where(key).select(F.col(string_col).alias("s"), F.col(label_col).cast("boolean").alias("y")).orderBy(F.xxhash64("s"), "s", "y").limit(limit).collect()
        plain = [r.s for r in rows if not r.y]
        return cls([*((r.s, True) for r in rows if r.y), *((s, False) for i, s in enumerate(plain) if i % 5)], plain[::5])

    def _best_ratio(self, run: str) -> float:
        """The greatest ratio that a stretch of the run has."""
        ratios, most = self.ratios(run), 0.0
        while (found := best_stretch(ratios, most)) is not None:
            most = max(float(np.nextafter(most, np.inf)), float(ratios[slice(*found)].mean()))
        return most

    def ratios(self, run: str) -> np.ndarray:
        """By character. What a run repeats is no new sign of randomness: three characters
        that occurred before in it count for the ordinary model only."""
        at = np.fromiter((self.index[c] for c in run), np.int64, len(run))
        before = np.concatenate(([len(ALPHABET)] * 2, at))
        out = self.ratio[before[:-2], before[1:-1], at].astype(np.float64)
        again = np.ones(len(at), bool)
        again[np.unique((before[:-2] * 128 + before[1:-1]) * 128 + at, return_index=True)[1]] = False
        return np.where(again, np.minimum(out, 0.0), out)

    def score(self, run: str) -> float:
        """Log-likelihood ratio per character: positive if random is likelier."""
        return float(self.ratios(run).mean())

    def is_secret(self, run: str) -> bool:
        return self.score(run) > self.threshold

    def _grown(self, run: str, ratios: np.ndarray, at: int) -> int:
        """How far a stretch of the first ``at`` characters goes on: to the next mark, if that
        is near or what lies between looks random as a run, and over the parts between marks
        that look random as a stretch."""
        marks = [i for i in range(at, len(run)) if run[i] in MARKS] + [len(run)]
        if marks[0] > at and marks[0] - at > LEAST_RUN and ratios[at : marks[0]].mean() <= self.threshold:
            return at + LEAST_RUN
        at = marks[0]
        for then in marks[1:]:
            if ratios[at:then].mean() <= self.stretch_threshold:
                break
            at = then
        return at

    def secrets(self, run: str) -> list[tuple[int, int]]:
        """(start, end) of a run as a whole, or else of its random stretches, each widened on
        either side."""
        if self.is_secret(run):
            return [(0, len(run))]
        ratios, out, todo = self.ratios(run), [], [(0, len(run))]
        while todo:
            a, b = todo.pop()
            found = best_stretch(ratios[a:b], self.stretch_threshold)
            if found is None:
                continue
            start, end = a + found[0], a + found[1]
            start = end - self._grown(run[a:end][::-1], ratios[a:end][::-1], end - start)
            end = start + self._grown(run[start:b], ratios[start:b], end - start)
            out.append((start, end))
            todo += [(a, start), (end, b)]
        return sorted(out)


_KEPT: list[SecretModel] = []


def kept_model() -> SecretModel:
    """The model of this process, trained once from the generated samples."""
    if not _KEPT:
        _KEPT.append(SecretModel())
    return _KEPT[0]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed forms, in order."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, base: list[tuple[int, int, int]], model: SecretModel) -> list[tuple[int, int, int]]:
    """What the models call random in runs and in the parts that base spans leave of them."""
    out, taken = [], merged(base)
    for m in _RUN.finditer(text):
        at = m.start()
        first = bisect.bisect_right(taken, at, key=lambda x: x[1])
        for s, e in [*itertools.takewhile(lambda x: x[0] < m.end(), itertools.islice(taken, first, None)), (m.end(), m.end())]:
            if s - at >= LEAST_RUN:
                out += [(at + a, 3, at + b) for a, b in model.secrets(text[at:s])]
            at = max(at, e)
    return out


def merged(base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover together, in order and apart."""
    out: list[tuple[int, int]] = []
    for s, _, e in base:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def candidate_rows(part: Slice) -> np.ndarray:
    """Rows of a slice that can hold a span: a keyword, AKIA, or a long run."""
    data = part.data
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _CLASS[data]
    steps = np.diff(inside)
    starts, ends = np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)
    hits = starts[ends - starts >= LEAST_RUN]
    words = np.array([m.start() for m in _WORDS.finditer(data.tobytes())], np.int64)
    rows = np.searchsorted(part.offsets, np.concatenate((hits, words)), "right") - 1
    # a run may have begun in the row before: its whole reach counts
    last = np.searchsorted(part.offsets, ends[ends - starts >= LEAST_RUN] - 1, "right") - 1
    crossing = [np.arange(a, b + 1) for a, b in zip(rows[: len(hits)], last, strict=True) if b > a]
    return np.unique(np.concatenate([rows, *crossing]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, model: SecretModel | None = None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, n_random, base_sha256, spans), or ``keep`` columns
    with these, for each row of ``docs``.

    Spans are ``kind:start:end`` in code points, by start and then kind; the digest is of
    the base ones. Base forms always stay; ``random`` spans are stretches of 20 or more key
    characters apart from them. Null and empty texts have none. Texts are read whole,
    repeated rows get equal answers, ties can't arise, other columns are ignored, whatever their names,
    and an empty table gives an empty result.
    """
    keep = [id_col] if keep is None else keep
    source = docs.select(*(F.col(c) for c in keep), F.col(text_col).cast("string").alias("_text_"))
    names = ["n_assign", "n_access", "n_hex", "n_random"]
    schema = T.StructType([*source.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in names), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])

    shared = docs.sparkSession.sparkContext.broadcast(model or kept_model())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        nothing = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            counts, digests, spans = np.zeros((len(texts), 4), np.int64), [nothing] * len(texts), [""] * len(texts)
            for part in slices(texts):
                for r in candidate_rows(part):
                    text = part.data[part.offsets[r] : part.offsets[r + 1]].tobytes().decode()
                    base = base_spans(text)
                    found = sorted(base + random_spans(text, base, model))
                    at = part.first + int(r)
                    counts[at] = np.bincount([k for _, k, _ in found], minlength=4)
                    digests[at], spans[at] = hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(counts[:, i]) for i in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return source.mapInArrow(work, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", model: SecretModel | None = None) -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mark``; for the assign form
    the value alone. Null texts stay null; all columns stay as they are otherwise."""
    columns, schema = docs.columns, docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model or kept_model())

    def cut(text: str) -> str:
        base = base_spans(text)
        out, done = [], 0
        for a, k, b in sorted(base + random_spans(text, base, shared.value)):
            a = ASSIGN.match(text, a).start(2) if k == 0 else a
            if b > done:
                out += [text[done:a], mark] if a >= done else []
                done = b
        return "".join([*out, text[done:]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("secrets")
        at = columns.index(text_col)
        for batch in batches:
            for part in slices(batch.column(at)):
                own = batch.slice(part.first, part.last - part.first)
                rows = candidate_rows(part)
                if len(rows):
                    values = own.column(at).to_pylist()
                    for r in rows:
                        values[r] = cut(values[r])
                    own = pa.RecordBatch.from_arrays([pa.array(values, own.column(at).type) if i == at else c for i, c in enumerate(own.columns)], names=columns)
                yield own
        release_memory()

    return docs.mapInArrow(work, schema)
