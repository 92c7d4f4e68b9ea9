"""Quality rules with adaptive thresholds, in DataFrame functions only.

Each text is measured inside its row by array functions. The measures of all documents
that pass the base rule go into mergeable quantile sketches per language and source:
counts by bucket, where a bucket keeps the ``BITS`` highest bits of a value, so merging
is addition, exact in any order, and a quantile is off by ``2 ** -(BITS - 1)`` of itself
at most. No measure has a constant of its own. The fence of a measure carries the tail of
the document's own group on: through the quantiles ``q75`` and ``q90`` an exponential tail
is laid, and the fence is where it expects one document among ``RARE`` times the group,

    fence = q90 + (q90 - q75) / ln(2.5) * ln(0.1 * RARE * n)

(word length has a lower fence as well, from ``q25`` and ``q10``). The fence of a share is at
least that of the smallest occurrence (one symbol, one repeated line, one window of three words
found twice) in the group's median text, as a group can't tell rates below that apart. A text beyond the fence fails if chance can't explain it: the fence is
widened to the score interval of ``Z`` standard errors of a rate that is counted on as many
units as the text has. So short texts have more room, and long ones little.

Groups of fewer than ``LEAST`` documents use the merged sketch of their language, and
languages of fewer than that the merged sketch of all. Thresholds are joined back to
filter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Fewest documents for a sketch to stand on its own.
LEAST = 200
#: A fence expects one document in so many times the group beyond it.
RARE = 10
#: Standard errors that chance is given.
Z = 3
#: Highest bits of a value that its bucket keeps, and units of a measure's values.
BITS, UNIT = 7, 1 << 16
#: Per measure: what is counted, on how many units, and the smallest occurrence if it is a share of them.
MEASURES = {"symbol_share": ("n_symbols", "word_chars", 1), "dup_line_share": ("n_dup_lines", "n_lines", 1), "repeat_share": ("n_repeat_words", "n_words", 6), "word_length": ("word_chars", "n_words", 0)}
UNITS = ("word_chars", "n_lines", "n_words")
#: Most language and source groups whose thresholds are broadcast (about 60 MB).
BROADCAST_GROUPS = 500_000


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _repeat_words(words: Column) -> Column:
    """How many words are in 3-word windows found twice or more: the windows' hashes are
    sorted with their positions, so equal ones are neighbours."""

    def windows(w: Column) -> Column:
        return F.sort_array(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.struct(F.xxhash64(F.element_at(w, i), F.element_at(w, i + 1), F.element_at(w, i + 2)).alias("h"), i.alias("p"))))

    def repeated(g: Column) -> Column:
        def twice(x: Column, j: Column) -> Column:
            before = F.when(j > 0, F.get(g, j - 1)["h"] == x["h"])
            after = F.when(j + 1 < F.size(g), F.get(g, j + 1)["h"] == x["h"])
            return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

        starts = F.transform(F.filter(g, twice), lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))
        return F.size(F.array_distinct(F.flatten(starts)))

    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0)).otherwise(_let(windows(w), repeated)))


def base_measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    per_text = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words")))
    per_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    out = docs.select(F.col(id_col).alias("k"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), per_text.alias("t"), per_line.alias("l"), symbols.alias("n_symbols"))
    out = out.select("k", "lang", "source", "t.n_words", "t.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "t.n_repeat_words")
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return out.withColumn("base_failed", failed)


def _bucket(value: Column) -> Column:
    """A whole number with all but its ``BITS`` highest bits cleared."""
    low = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def _sketched() -> dict[str, Column]:
    """Measures in units, and the bases they are counted on, as bucket numbers."""
    rates = {m: F.floor(F.col(a) * UNIT / F.col(b)).cast("long") for m, (a, b, _) in MEASURES.items()}
    return {name: _bucket(c) for name, c in (rates | {b: F.col(b) for b in UNITS}).items()}


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, q10, q25, q50, q75, q90) of sketches (keys, measure, bucket, count)."""
    upto = F.sum("count").over(Window.partitionBy(*keys, "measure").orderBy("bucket"))
    total = F.sum("count").over(Window.partitionBy(*keys, "measure"))
    ranked = sketch.withColumn("upto", upto).withColumn("n", total)
    at = [F.min(F.when(F.col("upto") * 100 >= F.col("n") * q, F.col("bucket"))).alias(f"q{q}") for q in (10, 25, 50, 75, 90)]
    return ranked.groupBy(*keys, "measure").agg(F.max("n").alias("n"), *at)


def thresholds(measured: DataFrame) -> DataFrame:
    """(lang, source, <measure>_low, <measure>_high, <base>_median) for each group: fences
    as rates, before chance is allowed for."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), c.alias("bucket")) for m, c in _sketched().items())))
    rows = measured.where("not base_failed").select("lang", "source", pairs.alias("x")).select("lang", "source", "x.measure", "x.bucket")
    own = stage(rows.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("count")), "quality-sketches")
    of_lang = own.groupBy("lang", "measure", "bucket").agg(F.sum("count").alias("count"))
    of_all = own.groupBy("measure", "bucket").agg(F.sum("count").alias("count"))
    a = _quantiles(own, ["lang", "source"])
    whole = F.struct("n", "q10", "q25", "q50", "q75", "q90")
    b = _quantiles(of_lang, ["lang"]).select(F.col("lang").alias("b_lang"), F.col("measure").alias("b_measure"), whole.alias("b"))
    c = _quantiles(of_all, []).select(F.col("measure").alias("c_measure"), whole.alias("c"))
    both = a.withColumn("a", whole).join(F.broadcast(c), F.col("measure") == F.col("c_measure")).join(b, F.col("lang").eqNullSafe(F.col("b_lang")) & (F.col("measure") == F.col("b_measure")))
    both = both.select("lang", "source", "measure", F.when(F.col("a.n") >= LEAST, F.col("a")).when(F.col("b.n") >= LEAST, F.col("b")).otherwise(F.col("c")).alias("q"))
    far = F.log(F.col("q.n") * (0.1 * RARE)) / math.log(2.5)
    low = (F.col("q.q10") - (F.col("q.q25") - F.col("q.q10")) * far) / UNIT
    high = (F.col("q.q90") + (F.col("q.q90") - F.col("q.q75")) * far) / UNIT
    ends = [f(F.when(F.col("measure") == m, e)).alias(f"{m}_{x}") for m in MEASURES for x, e, f in (("low", low, F.min), ("high", high, F.max))]
    return both.groupBy("lang", "source").agg(*ends, *(F.max(F.when(F.col("measure") == u, F.col("q.q50"))).alias(f"{u}_median") for u in UNITS))


def _allowed(fence: Column, units: Column, median: Column, smallest: int, sign: int) -> Column:
    """The end of the score interval of ``Z`` standard errors around a rate; a share is the
    ``smallest`` occurrence in the median text at least."""
    z2 = float(Z * Z)
    if smallest:
        p = F.least(F.greatest(fence, F.lit(float(smallest)) / median), F.lit(1.0))
        return (p + z2 / (2 * units) + sign * Z * F.sqrt(p * (1 - p) / units + z2 / (4 * units * units))) / (1 + z2 / units)
    p = F.greatest(fence, F.lit(0.0))
    return p + z2 / (2 * units) + sign * Z * F.sqrt(p / units + z2 / (4 * units * units))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", label: str = "quality") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, failed_rule) for each row of ``docs``.

    ``kept`` is false if the base rule fails (fewer than 50 words, or over half of the
    words in windows of three that the text repeats), or if a measure lies beyond the
    fences of the document's language and source and what chance allows; ``failed_rule``
    names the first such measure. Null and empty texts have no words: base_failed. A null
    language or source is a group of its own. In a group of identical values the fence is
    that value. Rows are independent of repeats, apart from the sketches, which count every
    row that passes the base rule. A text is handled whole, in its row. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    measured = stage(base_measures(docs, id_col, text_col, lang_col, source_col), f"{label}-measures")
    fences = stage(thresholds(measured), f"{label}-fences").withColumnsRenamed({"lang": "f_lang", "source": "f_source"})
    fences = F.broadcast(fences) if fences.count() <= BROADCAST_GROUPS else fences
    joined = measured.join(fences, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    rule = F.lit(None).cast("string")
    for m, (count, base, smallest) in reversed(MEASURES.items()):
        units, median = F.col(base).cast("double"), F.col(f"{base}_median")
        rate = F.col(count) / F.col(base)
        beyond = rate > _allowed(F.col(f"{m}_high"), units, median, smallest, 1)
        if not smallest:
            beyond = beyond | (rate < _allowed(F.col(f"{m}_low"), units, median, smallest, -1))
        rule = F.when(beyond, F.lit(m)).otherwise(rule)
    out = joined.withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(rule))
    return out.select(F.col("k").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")


#: The rows of the op2 query in DuckDB.
SQL = r"""
WITH d0 AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
d1 AS (SELECT r, doc_id, lang, source, text, regexp_extract_all(text, '[^ \t\n\x0B\f\r]+') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS l FROM d0),
g0 AS (SELECT r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram, i FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d1)),
g1 AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g0) WHERE c > 1),
g2 AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g1) GROUP BY r),
m AS (SELECT d1.r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(g2.n, 0) AS BIGINT) AS n_repeat_words
  FROM d1 LEFT JOIN g2 USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT lang, source, unnest([{'m': 'symbol_share', 'v': n_symbols * 65536 // word_chars}, {'m': 'dup_line_share', 'v': n_dup_lines * 65536 // n_lines},
    {'m': 'repeat_share', 'v': n_repeat_words * 65536 // n_words}, {'m': 'word_length', 'v': word_chars * 65536 // n_words},
    {'m': 'word_chars', 'v': word_chars}, {'m': 'n_lines', 'v': n_lines}, {'m': 'n_words', 'v': n_words}], recursive := true) FROM b WHERE NOT base_failed),
x AS (SELECT lang, source, m, (v >> CAST(greatest(length(bin(v)) - 7, 0) AS BIGINT)) << CAST(greatest(length(bin(v)) - 7, 0) AS BIGINT) AS b FROM v),
qs AS (SELECT lang, source, m, {'n': count(*), 'q': quantile_disc(b, [0.1, 0.25, 0.5, 0.75, 0.9])} AS q FROM x GROUP BY lang, source, m),
ql AS (SELECT lang, m, {'n': count(*), 'q': quantile_disc(b, [0.1, 0.25, 0.5, 0.75, 0.9])} AS q FROM x GROUP BY lang, m),
qa AS (SELECT m, {'n': count(*), 'q': quantile_disc(b, [0.1, 0.25, 0.5, 0.75, 0.9])} AS q FROM x GROUP BY m),
f0 AS (SELECT qs.lang, qs.source, qs.m, CASE WHEN qs.q.n >= 200 THEN qs.q WHEN ql.q.n >= 200 THEN ql.q ELSE qa.q END AS q
  FROM qs JOIN ql ON qs.m = ql.m AND qs.lang IS NOT DISTINCT FROM ql.lang JOIN qa ON qs.m = qa.m),
f AS (SELECT lang, source, m, q.q[3] AS median, (q.q[1] - (q.q[2] - q.q[1]) * (ln(q.n::DOUBLE) / ln(2.5::DOUBLE))) / 65536 AS low,
    (q.q[5] + (q.q[5] - q.q[4]) * (ln(q.n::DOUBLE) / ln(2.5::DOUBLE))) / 65536 AS high FROM f0),
p AS (SELECT lang, source, max(high) FILTER (WHERE m = 'symbol_share') AS a, max(high) FILTER (WHERE m = 'dup_line_share') AS c, max(high) FILTER (WHERE m = 'repeat_share') AS d,
    max(high) FILTER (WHERE m = 'word_length') AS e, min(low) FILTER (WHERE m = 'word_length') AS e0,
    max(median) FILTER (WHERE m = 'word_chars') AS ua, max(median) FILTER (WHERE m = 'n_lines') AS uc, max(median) FILTER (WHERE m = 'n_words') AS ud FROM f GROUP BY lang, source),
j0 AS (SELECT b.*, least(greatest(a, 1.0::DOUBLE / ua), 1.0) AS a, least(greatest(c, 1.0::DOUBLE / uc), 1.0) AS c, least(greatest(d, 6.0::DOUBLE / ud), 1.0) AS d, greatest(e, 0.0) AS e, greatest(e0, 0.0) AS e0,
    word_chars::DOUBLE AS ua, n_lines::DOUBLE AS uc, n_words::DOUBLE AS ud
  FROM b LEFT JOIN p ON b.lang IS NOT DISTINCT FROM p.lang AND b.source IS NOT DISTINCT FROM p.source),
j AS (SELECT *, CASE WHEN base_failed THEN 'base'
    WHEN n_symbols / word_chars > (a + 9 / (2 * ua) + 3 * sqrt(a * (1 - a) / ua + 9 / (4 * ua * ua))) / (1 + 9 / ua) THEN 'symbol_share'
    WHEN n_dup_lines / n_lines > (c + 9 / (2 * uc) + 3 * sqrt(c * (1 - c) / uc + 9 / (4 * uc * uc))) / (1 + 9 / uc) THEN 'dup_line_share'
    WHEN n_repeat_words / n_words > (d + 9 / (2 * ud) + 3 * sqrt(d * (1 - d) / ud + 9 / (4 * ud * ud))) / (1 + 9 / ud) THEN 'repeat_share'
    WHEN word_chars / n_words > e + 9 / (2 * ud) + 3 * sqrt(e / ud + 9 / (4 * ud * ud)) OR word_chars / n_words < e0 + 9 / (2 * ud) - 3 * sqrt(e0 / ud + 9 / (4 * ud * ud)) THEN 'word_length' END AS failed_rule FROM j0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule IS NULL AS kept, failed_rule FROM j
"""
