"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, fixed by its code point. A trigram binds
its letters: their vectors, each permuted by its place, are multiplied. A text's vector
bundles (adds) its trigrams, a language's prototype bundles all texts of the language,
and a text gets the language whose prototype has the greatest cosine. Prototypes are
taken as differences from their mean, so what all languages share doesn't count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bytewords import arrow_rows, begin_work, keeps_tables, release_memory
from quarry.plans.staging import stage

DIMS = 1024
#: Languages whose prototypes (8 KB each) meet the documents at once; more come in turns.
LANGUAGES = 5000
UNKNOWN = "und"
#: Fewest texts of a length class for a floor of its own, and buckets of scores.
LEAST_LABELLED = 100
SCORE_BUCKETS = 1000
#: Most trigrams whose vectors a process keeps (1 KB each), and of texts of no language.
_KNOWN_TRIGRAMS, _FEW_TRIGRAMS = 24_000, 40_000
#: Trigrams that are bundled at once, and texts that are exchanged with a worker at once.
_STEP, _ROWS = 1024, 1000
_TABLE: list[np.ndarray] = []


def _lower_table() -> np.ndarray:
    """Code point to its lower-case letter, or to a space if it is no letter."""
    if not _TABLE:
        table = np.full(0x110000, 32, np.int64)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLE.append(table)
    return _TABLE[0]


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(codes, counts, has_letter): trigrams of letters and single spaces between words."""
    points = _lower_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    points = np.concatenate(([32], points, [32]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    points = points[keep]
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), False
    codes, counts = np.unique(points[:-2] << 42 | points[1:-1] << 21 | points[2:], return_counts=True)
    return codes, counts, True


class Hypervectors:
    """Vectors of trigrams, made when first met; the table is emptied when full."""

    def __init__(self, dims: int = DIMS, most: int = _KNOWN_TRIGRAMS):
        self.dims, self.most = dims, most
        self._reset()

    def _reset(self) -> None:
        """codes is sorted; slots has the row of each, in the order of arrival. letters has
        the place of a letter in the tables of its vector, permuted 0, 1 and 2 times."""
        self.codes, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.rows, self.used = np.zeros((1024, self.dims), np.int8), 0
        self.letters: dict[int, int] = {}
        self.permuted = np.zeros((3, 64, self.dims), np.int8)

    def _places(self, points: np.ndarray) -> np.ndarray:
        """Of letters in the tables; new ones are put in."""
        met, inverse = np.unique(points, return_inverse=True)
        for point in met.tolist():
            if point not in self.letters:
                at = self.letters[point] = len(self.letters)
                if at == self.permuted.shape[1]:
                    self.permuted = np.concatenate((self.permuted, np.zeros_like(self.permuted)), axis=1)
                vector = np.random.default_rng([20240901, point]).choice(np.array([-1, 1], np.int8), self.dims)
                for times in range(3):
                    self.permuted[times, at] = np.roll(vector, times)
        return np.array([self.letters[p] for p in met.tolist()], np.int64)[inverse]

    def _bind(self, codes: np.ndarray) -> np.ndarray:
        """The vectors of trigrams: their letters', permuted by place, multiplied."""
        a, b, c = (self._places(x) for x in (codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF))
        return self.permuted[2, a] * self.permuted[1, b] * self.permuted[0, c]

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each as often as counted."""
        at = np.searchsorted(self.codes, codes)
        known = at < len(self.codes)
        known[known] = self.codes[at[known]] == codes[known]
        if not known.all():
            if len(self.codes) + len(codes) > self.most:
                self._reset()
                known = np.zeros(len(codes), bool)
            missing = codes[~known]
            if self.used + len(missing) > len(self.rows):
                more = np.zeros((max(self.used + len(missing), min(2 * len(self.rows), self.most)), self.dims), np.int8)
                more[: self.used] = self.rows[: self.used]
                self.rows = more
            self.rows[self.used : self.used + len(missing)] = self._bind(missing)
            place = np.searchsorted(self.codes, missing)
            self.codes = np.insert(self.codes, place, missing)
            self.slots = np.insert(self.slots, place, np.arange(self.used, self.used + len(missing)))
            self.used += len(missing)
            at = np.searchsorted(self.codes, codes)
        return counts.astype(np.float32) @ self.rows[self.slots[at]].astype(np.float32)


_KEPT: list[Hypervectors] = []


keeps_tables("language", _KEPT.clear)


def kept_vectors() -> Hypervectors:
    """The vectors of this process: a worker that runs many tasks keeps its table."""
    if not _KEPT:
        _KEPT.append(Hypervectors())
    return _KEPT[0]


def held_out(id_col: str) -> Column:
    """Whether a document is kept from learning; a null id isn't."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """Languages and their prototypes: staged vectors, read in blocks of ``LANGUAGES``."""

    def __init__(self, vectors: DataFrame):
        self.vectors, self.kept = vectors, None
        total, self.n = np.zeros(DIMS), 0
        for _, rows in self._read():
            total, self.n = total + rows.sum(axis=0), self.n + len(rows)
        self.mean = total / max(self.n, 1) if self.n > 1 else np.zeros(DIMS)
        if self.n <= LANGUAGES:
            self.kept = list(self._centred())

    def _read(self) -> Iterator[tuple[list[str], np.ndarray]]:
        """Names in order, and their vectors at length 1."""
        last = None
        while True:
            left = self.vectors if last is None else self.vectors.where(F.col("lang") > last)
            found = left.orderBy("lang").limit(LANGUAGES).collect()
            if found:
                rows = np.array([r.x for r in found], float).reshape(-1, DIMS)
                yield [r.lang for r in found], rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            if len(found) < LANGUAGES:
                return
            last = found[-1].lang

    def _centred(self) -> Iterator[tuple[list[str], np.ndarray]]:
        for langs, rows in self._read():
            rows = rows - self.mean
            yield langs, (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def blocks(self) -> Iterator[tuple[list[str], np.ndarray]]:
        yield from self._centred() if self.kept is None else self.kept or [([], np.zeros((0, DIMS), np.float32))]


def learn(labelled: DataFrame, text_col: str, lang_col: str) -> Model:
    """Languages and their normalised prototypes, from every row of ``labelled``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("language")
        space = kept_vectors()
        sums: dict[str, np.ndarray] = {}

        def batch_of() -> pa.RecordBatch:
            langs = list(sums)
            dims = [np.arange(DIMS, dtype=np.int32)] * len(langs)
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(langs, DIMS).tolist(), pa.string()), pa.array(np.concatenate(dims)), pa.array(np.concatenate([np.rint(sums[x]) for x in langs]))], names=["lang", "dim", "x"])

        def bundle(met: dict[str, list]) -> None:
            for lang, found in met.items():
                codes, inverse = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([n for _, n in found]))
                total = sums.setdefault(lang, np.zeros(DIMS))
                for a in range(0, len(codes), _STEP):
                    total += space.bundle(codes[a : a + _STEP], counts[a : a + _STEP])

        for whole in batches:
            for batch in (whole.slice(a, 256) for a in range(0, whole.num_rows, 256)):
                met: dict[str, list] = {}
                for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    codes, counts, letters = trigrams(text.as_py())
                    if letters:
                        met.setdefault(lang, []).append((codes, counts))
                bundle(met)
                if len(sums) >= 1000:  # partial sums go on; a task holds 10 MB of them at most
                    yield batch_of()
                    sums.clear()
        if sums:
            yield batch_of()
        release_memory()

    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("t"))
    sums = known.mapInArrow(work, "lang string, dim int, x double").groupBy("lang", "dim").agg(F.sum("x").alias("x"))
    with arrow_rows(labelled.sparkSession, _ROWS):
        return Model(stage(sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x")))["x"].alias("x")), "languages"))


def shuffled(text: str) -> str:
    """``text`` with its letters in another order, the same one every time."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    letters = _lower_table()[points] != 32
    points[letters] = np.random.default_rng(zlib.crc32(points.tobytes())).permutation(points[letters])
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def predict(docs: DataFrame, model: Model, text_col: str, keep: list[str] | None = None, shuffle: bool = False, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the language and score, called ``names``, from
    the text alone, or from the text with its letters shuffled. Each block of languages is a
    pass over the texts; a later language wins by a greater cosine only."""
    keep = docs.columns if keep is None else keep
    sc = docs.sparkSession.sparkContext
    there = keep.index(text_col) if text_col in keep and dict(docs.dtypes)[text_col] == "string" else None  # or else beside the kept ones
    own = [] if there is not None else [F.col(text_col).cast("string").alias("t")]
    now = docs.select(F.lit(UNKNOWN).alias("name"), F.lit(-2.0).alias("cosine"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), *own)

    def judged(before: DataFrame, shared, last: bool) -> DataFrame:
        schema = T.StructType(before.schema.fields[: -1 if last and own else None])  # what only further blocks need goes

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, prototypes = shared.value
            begin_work("language")
            space = Hypervectors(most=_FEW_TRIGRAMS) if shuffle else kept_vectors()  # trigrams of no language aren't kept
            for batch in batches:
                names, scores, *rest = batch.columns
                names, scores = names.to_pylist(), scores.to_pylist()
                for i, text in enumerate(rest[-1 if there is None else there]):
                    text = text.as_py()
                    text = shuffled(text) if shuffle and text else text
                    codes, counts, letters = trigrams(text) if text else (None, None, False)
                    if letters and langs:
                        vector = sum(space.bundle(codes[a : a + _STEP], counts[a : a + _STEP]) for a in range(0, len(codes), _STEP))
                        cosines = prototypes @ vector / max(float(np.linalg.norm(vector)), 1e-12)
                        best = int(np.argmax(cosines))
                        if cosines[best] > scores[i]:
                            names[i], scores[i] = langs[best], float(cosines[best])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()), *rest][: len(schema)], names=schema.names)
            release_memory()

        return before.mapInArrow(work, schema)

    count = max(1, -(-model.n // LANGUAGES))
    for i, block in enumerate(model.blocks()):
        now = judged(now if not i else stage(now, "languages-met"), sc.broadcast(block), i == count - 1)
    score = F.least(F.greatest("cosine", F.lit(0.0)), F.lit(1.0))
    return now.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.col("name").alias(names[0]), score.alias(names[1]))


def length_class(text_col: str) -> Column:
    """The binary logarithm of a text's number of letters, rounded down."""
    return F.floor(F.log2(F.greatest(F.length(F.regexp_replace(F.col(text_col).cast("string"), r"[^\p{L}]+", "")), F.lit(1)))).cast("int")


def floors(labelled: DataFrame, model: Model, text_col: str, lang_col: str, least: float) -> dict[int, float]:
    """Length class to the score below which a text is in no learned language, from
    every row of ``labelled`` that ``model`` wasn't learned from.

    A floor is what 99 % of the texts don't reach once their letters are shuffled, but at
    most a quarter of what 95 % of the texts given their own language do reach, so short
    texts, which score low, stay, and texts with a wrong label hardly count. A class of
    fewer than ``LEAST_LABELLED`` such texts goes by those of its own and all smaller
    ones, and by ``least`` if these are too few as well; no floor is below ``least``.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"), length_class(text_col).alias("class"))
    sketches = []
    for shuffle in (False, True):
        judged = predict(rows, model, "t", ["lang", "class"], shuffle).where(F.col("lang_pred") != UNKNOWN)
        judged = judged if shuffle else judged.where("lang_pred = lang")
        with arrow_rows(labelled.sparkSession, _ROWS):
            counts = judged.groupBy("class", F.floor(F.col("score") * SCORE_BUCKETS).cast("int").alias("bucket")).count().collect()
        sketch: dict[int, np.ndarray] = {}
        for c, b, n in counts:
            sketch.setdefault(c, np.zeros(SCORE_BUCKETS + 1, np.int64))[b] += n
        sketches.append(sketch)
    own, apart = sketches
    quantile = lambda x, q: float(np.searchsorted(np.cumsum(x), q * x.sum())) / SCORE_BUCKETS
    out = {}
    for c in own:
        classes = [c] if own[c].sum() >= LEAST_LABELLED else [k for k in own if k <= c]
        texts, noise = sum(own[k] for k in classes), sum(apart[k] for k in classes if k in apart)
        out[c] = max(least, min(quantile(noise, 0.99), quantile(texts, 0.05) / 4)) if texts.sum() >= LEAST_LABELLED else least
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score) for each row of ``docs``.

    Prototypes are learned from text and language of the rows that aren't held out and
    whose language isn't null (all of them, not a sample); predictions see the text
    only. A null text, or one without a letter, is ``und`` with score 0, as is any text
    if nothing could be learned. Scores are cosines, negative ones raised to 0. Of equal
    cosines the language that sorts first wins. There is no limit to languages. Texts are read whole; repeated rows get
    equal answers; other columns are ignored, whatever their names; an empty table gives
    an empty result.
    """
    base = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("lang"))
    model = learn(base.where(~held_out("k")), "t", "lang")
    out = predict(base.withColumn("held_out", held_out("k")), model, "t", ["k", "held_out"])
    return out.withColumnRenamed("k", id_col)
