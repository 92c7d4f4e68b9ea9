"""Mixing sources to target weights: whole copies, then a Pareto order sample.

Targets fill up like water: each source gets its weight's share of the total size, at
most ``max_copies`` times its own, and the excess is shared again by weight. A source
whose target is ``r`` times its size takes every document ``floor(r)`` times for certain.
What is left of the target, ``B`` words, is a sample of fixed size in words with unequal
probabilities: a document of ``s`` words is included with ``p = min(1, s / c)``, where
``c`` is such that the expected words are ``B``. Documents of ``c`` words and more are
certain; the others rank by ``(u / (1 - u)) / (p / (1 - p))``, their random odds divided
by the odds of inclusion, and are taken in this order while they fit; documents behind
the first that doesn't fit, and small enough, fill the rest. ``u`` is a digest of the id,
so reruns agree.

Sources are numbered over sorted partitions, and the level of the water is found by sums
over all sources, so no source table is sorted in one task. ``c`` comes from the counts
of documents by size. Ranks are cut into buckets of equal width in their logarithm: the
logarithm of random odds has a density of a quarter at most, whatever the odds of
inclusion, so a bucket of width ``4 * BUCKET / n`` holds about ``BUCKET`` of a source's
``n`` documents at most. Sums by bucket find the one in which the sample ends, and only
that bucket is sorted: no source is ever gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.staging import stage

WORD = r"[^\x20\x09-\x0D]+"
BUCKET = 10_000
#: Least width of a bucket, in logarithms of odds.
LEAST_WIDTH = 1 / 4096
#: Most sources whose table is broadcast (about 64 MB); beyond it the joins shuffle.
BROADCAST_SOURCES = 500_000
#: Most documents whose verdicts are broadcast (about 100 MB) to what is carried along.
BROADCAST_ROWS = 1_000_000
_WIDE = "decimal(38,0)"


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on key and seed only."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def numbered(sources: DataFrame, label: str) -> DataFrame:
    """Adds ``g``, the place of each source by code point, null last, from 1: partitions
    are sorted ranges, and a place is the rows of earlier partitions and those before."""
    key = [F.col("source").isNull(), F.col("source")]
    dealt = stage(sources.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), f"{label}-sorted")
    part = F.shiftright("at", 33)
    before = dealt.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    before = before.withColumn("skip", F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).select("part", "skip")  # a row for each partition
    return dealt.withColumn("part", part).join(F.broadcast(before), "part").withColumn("g", (F.col("skip") + F.col("at") - F.shiftleft("part", 33) + 1).cast("long")).drop("part", "skip", "at")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_copies: int, label: str = "mix") -> DataFrame:
    """sizes: (source, size). Returns (source, g, n, source_size, target, whole).

    ``g`` numbers the sources by code point, null last; weights repeat in this order. The
    sources above their cap are found in rounds: each one's level is what the sources that
    were full leave to the weights of the others, which can only fill more of them."""
    own = numbered(sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), label)
    turn = F.pmod(F.col("g") - 1, F.lit(len(weights)))
    own = own.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))).withColumn("cap", F.col("source_size").cast("double") * max_copies)
    own = stage(own, f"{label}-sources")
    total = float(own.agg(F.sum("source_size")).first()[0] or 0)
    level, full_before, share = 0.0, -1, 0.0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("w")
        found = own.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("w"))), F.lit(0.0))).first()
        share = (total - found[1]) / found[2] if found[2] else 0.0
        if found[0] == full_before or not found[2]:
            break
        level, full_before = share, found[0]
    full = F.col("cap") < F.lit(level) * F.col("w")
    own = own.withColumn("target", F.when(full, F.col("cap")).otherwise(F.least("cap", F.lit(share) * F.col("w"))))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return own.withColumn("whole", F.floor(ratio)).select("source", "g", "n", "source_size", "target", "whole")


def inclusion(by_size: DataFrame, budget: DataFrame) -> DataFrame:
    """(g, certain_from, scale, left) from (g, size, count) and (g, budget): documents of
    ``certain_from`` words and more are included for certain, others with probability
    ``scale * size``, and ``left`` words of the budget are for these.

    The largest sizes are certain: a size is if, all above it taken, the rest of the
    budget in proportion to size would include it with certainty."""
    larger = Window.partitionBy("g").orderBy(F.desc("size"))
    above = F.sum(F.col("size").cast(_WIDE) * F.col("count")).over(larger.rowsBetween(Window.unboundedPreceding, -1))
    squares = F.sum(F.col("size").cast(_WIDE) * F.col("size") * F.col("count")).over(Window.partitionBy("g").orderBy("size"))
    at = by_size.withColumn("above", F.coalesce(above.cast("double"), F.lit(0.0))).withColumn("squares", squares.cast("double")).join(budget, "g")
    certain = (F.col("size") > 0) & ((F.col("budget") - F.col("above")) * F.col("size") >= F.col("squares"))
    ends = at.withColumn("certain", certain).groupBy("g").agg(
        F.min(F.when(F.col("certain"), F.col("size"))).alias("certain_from"),
        F.max_by(F.struct("above", "squares", "budget"), F.when(~F.col("certain"), F.col("size"))).alias("rest"),
    )
    left = F.greatest(F.col("rest.budget") - F.col("rest.above"), F.lit(0.0))
    return ends.select("g", "certain_from", F.when(F.col("rest.squares") > 0, left / F.col("rest.squares")).otherwise(F.lit(0.0)).alias("scale"), F.coalesce(left, F.lit(0.0)).alias("left"))


def _first_fitting(rows: DataFrame, budget: DataFrame, nearest: bool, few_sources: bool, label: str) -> DataFrame:
    """Adds ``chosen``: the rows of each g, by (rank, k, size), whose running size stays
    within the budget (or, if ``nearest``, half of the row's size beyond it)."""
    hist = rows.groupBy("g", "bucket").agg(F.sum("size").alias("inside"))
    running = F.sum("inside").over(Window.partitionBy("g").orderBy("bucket"))
    hint = F.broadcast if few_sources else (lambda x: x)
    edge = hist.withColumn("upto", running).join(hint(budget), "g").where(F.col("upto") > F.col("budget"))
    edge = stage(edge.groupBy("g").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("inside")).alias("passed"), "budget"), "bucket").alias("e")).select("g", F.col("e.bucket").alias("at"), "e.passed", "e.budget"), label)
    placed = rows.join(hint(edge), "g", "left")
    inside = placed.where(F.col("bucket") == F.col("at"))
    upto = F.col("passed") + F.sum("size").over(Window.partitionBy("g").orderBy("rank", "k", "size").rowsBetween(Window.unboundedPreceding, 0))
    limit = F.col("budget") + (F.col("size") / 2 if nearest else F.lit(0.0))
    inside = inside.withColumn("chosen", upto <= limit)
    others = placed.where(F.col("at").isNull() | (F.col("bucket") != F.col("at"))).withColumn("chosen", F.col("at").isNull() | (F.col("bucket") < F.col("at")))
    return others.unionByName(inside).drop("at", "passed", "budget")


def bucket_of(rank: Column, n: Column) -> Column:
    """The bucket of a rank among a source's ``n`` documents: its logarithm, in steps."""
    width = F.greatest(F.lit(4.0 * BUCKET) / n, F.lit(LEAST_WIDTH))
    return F.floor(F.log(rank) / width).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", label: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: id, source, size, source_size, target, copies, taken,
    chance, and the columns of ``carry``.

    ``copies`` is how often the mix holds the document (at most ``max_copies``) and
    ``taken = copies * size``; ``chance`` is the probability of a copy beyond the whole
    ones, proportional to size up to 1. The words of a source come within half a document
    that still fits of its target.

    Null and empty texts have size 0: they get the whole copies of their source and no
    other. A null source is a source, the last. A null id counts as the text "null".
    Documents of equal rank are ordered by id, then size; rows that repeat one another
    fully are told apart arbitrarily, which can't change the multiset returned. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("k"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)))
    kept = [f"carry_{i}" for i in range(len(carry))]
    whole_rows = stage(base.withColumn("row", F.monotonically_increasing_id()), f"{label}-sizes")
    base = whole_rows.drop(*kept)
    sources = stage(source_targets(base, weights, max_copies, label), f"{label}-targets")
    facts = sources.agg(F.count("*"), F.sum("n")).first()
    hint = F.broadcast if facts[0] <= BROADCAST_SOURCES else (lambda x: x)
    of = hint(sources.select(F.col("source").alias("_s"), "g", "n", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    placed = base.join(of, F.col("source").eqNullSafe(F.col("_s"))).drop("_s", "source")
    budget = sources.select("g", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    odds = stage(inclusion(placed.groupBy("g", "size").agg(F.count("*").alias("count")), budget), f"{label}-odds")
    placed = placed.drop("budget").join(hint(odds), "g")
    p = F.col("scale") * F.col("size")
    certain = F.coalesce(F.col("size") >= F.col("certain_from"), F.lit(False))
    u = uniform(F.coalesce(F.col("k").cast("string"), F.lit("null")), seed)
    open_ = ~certain & (p > 0)
    ranked = placed.withColumn("certain", certain).withColumn("chance", F.when(certain, 1.0).otherwise(F.least(p, F.lit(1.0)))).withColumn("u", u)
    ranked = ranked.withColumn("rank", F.when(open_ & (F.col("chance") < 1), (F.col("u") / (1 - F.col("u"))) / (F.col("chance") / (1 - F.col("chance")))).when(open_, F.lit(0.0)))
    ranked = ranked.withColumn("bucket", F.when(F.col("rank") > 0, bucket_of(F.col("rank"), F.col("n"))).when(F.col("rank") == 0, F.lit(-(1 << 62))))
    ranked = stage(ranked.select("row", "k", "size", "g", "certain", "chance", "rank", "bucket"), f"{label}-ranked")
    sampled, fixed = ranked.where("rank is not null"), ranked.where("rank is null")
    left = odds.select("g", F.col("left").alias("budget"))
    first = stage(_first_fitting(sampled, left, False, facts[0] <= BROADCAST_SOURCES, f"{label}-edge1"), f"{label}-first")
    spent = first.where("chosen").groupBy("g").agg(F.sum("size").alias("spent"))
    room = stage(left.join(spent, "g", "left").select("g", (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget")), f"{label}-left")
    open_rows = first.where("not chosen").drop("chosen").join(hint(room).withColumnRenamed("budget", "room"), "g")
    fits = _first_fitting(open_rows.where("size <= room").drop("room"), room, True, facts[0] <= BROADCAST_SOURCES, f"{label}-edge2")
    rest = open_rows.where("not size <= room").drop("room").withColumn("chosen", F.lit(False))
    chosen = first.where("chosen").unionByName(fits).unionByName(rest).unionByName(fixed.withColumn("chosen", F.col("certain")))
    out = chosen.join(hint(sources).select("g", "source", "source_size", "target", "whole"), "g")
    copies = F.col("whole") + F.col("chosen").cast("int")
    out = out.withColumn("copies", F.least(copies, F.lit(max_copies)).cast("long"))
    named = [F.col(a).alias(b) for a, b in zip(kept, carry, strict=True)]
    if carry:  # what is carried meets the verdicts once, and isn't part of the ranking
        out = whole_rows.select("row", *kept).join(F.broadcast(out) if (facts[1] or 0) <= BROADCAST_ROWS else out, "row")
    return out.select(F.col("k").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "chance", *named)


#: The rows of the op6 query in DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS g FROM s0),
s2 AS (SELECT *, ((g - 1) % 3 + 1)::DOUBLE AS w, source_size::DOUBLE * 3 AS cap FROM s1),
s3 AS (SELECT *, sum(source_size::DOUBLE) OVER () AS total,
    (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level FROM s2),
s4 AS (SELECT *, cap < level * w AS is_full FROM s3),
s5 AS (SELECT *, (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0)) / (sum(CASE WHEN NOT is_full THEN w END) OVER ()) AS share FROM s4),
s6 AS (SELECT source, g, source_size, CASE WHEN is_full THEN cap ELSE least(cap, share * w) END AS target FROM s5),
s7 AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM s6),
s8 AS (SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS budget FROM s7),
b0 AS (SELECT g, size, any_value(budget) AS budget, count(*) AS n FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source GROUP BY g, size),
b1 AS (SELECT *, coalesce((sum(size::HUGEINT * n) OVER (PARTITION BY g ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE, 0.0) AS above,
    (sum(size::HUGEINT * size * n) OVER (PARTITION BY g ORDER BY size))::DOUBLE AS squares FROM b0),
b2 AS (SELECT *, size > 0 AND (budget - above) * size >= squares AS certain FROM b1),
b3 AS (SELECT g, min(CASE WHEN certain THEN size END) AS certain_from, max(CASE WHEN NOT certain THEN squares END) AS squares,
    greatest(max(budget) - min(CASE WHEN NOT certain THEN above END), 0.0) AS left_ FROM b2 GROUP BY g),
r0 AS (SELECT d.*, s8.g, s8.source_size, s8.target, s8.whole, left_ AS budget, coalesce(size >= certain_from, false) AS certain,
    least(left_ / squares * size, 1.0) AS p
  FROM d JOIN s8 ON d.source IS NOT DISTINCT FROM s8.source JOIN b3 ON b3.g = s8.g),
r AS (SELECT *, CASE WHEN certain OR NOT p > 0 THEN NULL WHEN p < 1 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 0.0 END AS rk FROM r0),
c1 AS (SELECT *, rk IS NOT NULL AND sum(CASE WHEN rk IS NULL THEN 0 ELSE size END) OVER (PARTITION BY g ORDER BY rk NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= budget AS one FROM r),
c2 AS (SELECT *, budget - coalesce(sum(CASE WHEN one THEN size END) OVER (PARTITION BY g), 0) AS room FROM c1),
c3 AS (SELECT *, rk IS NOT NULL AND NOT one AND size <= room AS open FROM c2),
c4 AS (SELECT *, open AND sum(CASE WHEN open THEN size ELSE 0 END) OVER (PARTITION BY g ORDER BY rk NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= room + size / 2 AS two FROM c3)
SELECT doc_id, size, source_size, target, CAST(least(whole + CASE WHEN certain OR one OR two THEN 1 ELSE 0 END, 3) * size AS BIGINT) AS taken FROM c4
"""
