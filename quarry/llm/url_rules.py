"""URL filters: host and path rules by hash prefixes, in DataFrame functions only.

A rule allows or blocks a host, all its subdomains, and the paths that begin with its own.
Each url is expanded into expressions: the last labels of its host with a prefix of its
path, for those numbers of labels and path lengths that some rule has (``shapes``).
Expressions meet rules in an equi-join on the first hex digits of their digests; a
candidate is confirmed by the full digest of the url's expression in the rule's own shape,
and the longest confirmed rule gives the verdict.

Shapes are rounded down above ``EXACT_LABELS`` labels and ``EXACT_PATH`` characters, so
that a url has a bounded number of expressions whatever the rules; the full digest is always that
of the whole rule. Urls that no rule fits are judged by the words of their host: listed
words are rules of the least rank, joined in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join compares.
PREFIX = 8
#: Labels of a host and characters of a path up to which shapes are exact.
EXACT_LABELS, EXACT_PATH = 8, 256
#: Most rules that are broadcast (about 300 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: The rules of the registered query: (host, path, verdict).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words of hosts that block an url which no rule fits: whole words between other characters.
WORDS = ["adult", "ads", "bets", "casino", "pills", "porn", "spam", "xxx"]


def lowered(text: Column) -> Column:
    """A-Z lower-cased, other characters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, from behind the first ``://`` up to ``/``, ``?``, ``#`` or the end, and the path,
    from there up to ``?``, ``#`` or the end; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lowered(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _label_shape(n: Column) -> Column:
    return F.least(n, F.lit(EXACT_LABELS))


def _path_shape(n: Column) -> Column:
    """Path lengths are exact up to ``EXACT_PATH``, and the largest power of two in them beyond."""
    return F.when(n <= EXACT_PATH, n).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin(n.cast("long"))) - 1)).cast("int")


def expression(labels: Column, n_labels: Column, path: Column, n_path: Column) -> Column:
    """What is digested: host suffix and path prefix, with the suffix's length in front so that
    no two pairs read alike."""
    suffix = F.array_join(F.slice(labels, F.size(labels) - n_labels + 1, n_labels), ".")
    return F.concat(F.length(suffix).cast("string"), F.lit(":"), suffix, F.substring(path, F.lit(1), n_path))


def _labels(host: Column) -> Column:
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.split(host, r"\.", -1))


def _digest(text: Column) -> Column:
    return F.sha2(text, 256)


def compiled(rules: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(prefix, digest, n_labels, n_path, shape_labels, shape_path, rule, verdict, rank) of rules (host,
    path, verdict) and of blocked host words (word). Equal rules are one, and block wins among them."""
    rules = rules.select(lowered(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumn("labels", _labels(F.col("host")))
    rules = rules.withColumns({"n_labels": F.size("labels"), "n_path": F.length("path")})
    rules = rules.withColumns({"shape_labels": _label_shape(F.col("n_labels")), "shape_path": _path_shape(F.col("n_path"))})
    whole = _digest(expression(F.col("labels"), F.col("n_labels"), F.col("path"), F.col("n_path")))
    key = _digest(expression(F.col("labels"), F.col("shape_labels"), F.col("path"), F.col("shape_path")))
    rank = F.struct(F.lit(1).alias("kind"), (F.length("host") + F.col("n_path")).alias("length"), F.length("host").alias("host_length"))
    out = rules.select(F.substring(key, 1, PREFIX).alias("prefix"), whole.alias("digest"), "n_labels", "n_path", "shape_labels", "shape_path", F.concat("host", "path").alias("rule"), "verdict", rank.alias("rank"))
    if words is None:
        return out
    word = words.where("word is not null").select(_digest(F.concat(F.lit("w:"), lowered(F.col("word")))).alias("digest"), F.col("word")).distinct()
    none = F.lit(None).cast("int")
    rank = F.struct(F.lit(0).alias("kind"), F.length("word").alias("length"), F.lit(0).alias("host_length"))
    return out.unionByName(word.select(F.substring("digest", 1, PREFIX).alias("prefix"), "digest", *(none.alias(c) for c in ("n_labels", "n_path", "shape_labels", "shape_path")), F.col("word").alias("rule"), F.lit("block").alias("verdict"), rank.alias("rank")))


def judge(pages: DataFrame, rules: DataFrame, words: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict, word) for each row of ``pages``.

    ``rules`` (host, path, verdict): a rule fits its host and all subdomains (an empty or null host:
    every url), if the url's path starts with the rule's (empty or null: any). The longest
    wins, by host and path together, then by host; of equal rules with both verdicts, block. A url
    without a rule is blocked if its host has one of ``words`` (word), else ``otherwise`` holds;
    ``word`` is that word. Null urls and urls without ``://`` have an empty host and path and fit rules without either only.
    Repeated rows, null ids and urls of any length are rows like others; other columns are
    ignored, whatever their names. An empty table gives an empty result; without rules,
    words and ``otherwise`` judge.

    A row's candidates are reduced to the best one in the task that made them; rows are then
    grouped by (id, host, path), so a host that many urls share is spread by their paths.
    """
    listed = compiled(rules, words)
    few = listed.count() <= BROADCAST_RULES
    shapes = [tuple(r) for r in listed.where("n_labels is not null").select("shape_labels", "shape_path").distinct().collect()]
    host, path = host_and_path(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("k"), host.alias("host"), path.alias("path")).withColumn("labels", _labels(F.col("host")))
    fits = F.filter(F.array(*(F.struct(F.lit(a).alias("l"), F.lit(b).alias("p")) for a, b in sorted(shapes))), lambda s: (s["l"] <= F.size("labels")) & (s["p"] <= F.length("path"))) if shapes else F.array().cast("array<struct<l:int,p:int>>")
    sites = F.transform(fits, lambda s: F.struct(F.substring(_digest(expression(F.col("labels"), s["l"], F.col("path"), s["p"])), 1, PREFIX).alias("prefix"), s["l"].alias("l"), s["p"].alias("p"), F.lit(None).cast("string").alias("w")))
    every = sites
    if words is not None:
        own = F.array_distinct(F.filter(F.split("host", "[^a-z0-9]+"), lambda w: w != ""))
        every = F.concat(sites, F.transform(own, lambda w: F.struct(F.substring(_digest(F.concat(F.lit("w:"), w)), 1, PREFIX).alias("prefix"), F.lit(None).cast("int").alias("l"), F.lit(None).cast("int").alias("p"), w.alias("w"))))
    itself = F.array(F.struct(F.lit("").alias("prefix"), F.lit(None).cast("int").alias("l"), F.lit(None).cast("int").alias("p"), F.lit(None).cast("string").alias("w")))
    asked = urls.withColumn("x", F.explode(F.concat(itself, every))).select("k", "host", "path", "labels", F.col("x.prefix").alias("prefix"), F.col("x.l").alias("l"), F.col("x.p").alias("p"), F.col("x.w").alias("w"))
    rule = F.broadcast(listed) if few else listed
    met = asked.join(rule.withColumnRenamed("prefix", "r_prefix"), F.col("prefix") == F.col("r_prefix"), "left")
    site = expression(F.col("labels"), F.col("n_labels"), F.col("path"), F.col("n_path"))
    same_shape = (F.col("l") == F.col("shape_labels")) & (F.col("p") == F.col("shape_path")) & (F.size("labels") >= F.col("n_labels")) & (F.length("path") >= F.col("n_path"))
    confirmed = F.when(F.col("w").isNotNull(), F.col("n_labels").isNull() & (_digest(F.concat(F.lit("w:"), F.col("w"))) == F.col("digest"))).otherwise(same_shape & (_digest(site) == F.col("digest")))
    best = F.max(F.when(confirmed, F.struct("rank", "verdict", "rule"))).alias("best")
    found = met.groupBy("k", "host", "path").agg(best, F.sum(F.when(F.col("prefix") == "", 1).otherwise(0)).alias("n"))
    rows = found.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    by_rule = F.col("best.rank.kind") == 1
    return rows.select(F.col("k").alias(id_col), "host", "path", F.when(by_rule, F.col("best.rule")).alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"), F.when(~by_rule, F.col("best.rule")).alias("word"))


#: The rows of the op12 query in DuckDB.
SQL = rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
l AS (SELECT * FROM (VALUES {", ".join(map(repr, RULES))}) AS v(rule_host, rule_path, rule_verdict)),
f AS (SELECT page_id, host, path, (SELECT max({{'n': length(rule_host || rule_path), 'rule': rule_host || rule_path, 'verdict': rule_verdict}}) FROM l
    WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)) AS best,
  list_sort(list_filter(regexp_split_to_array(host, '[^a-z0-9]+'), lambda w: list_contains({WORDS!r}, w)), 'DESC') AS found FROM h)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN len(found) > 0 THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN best IS NULL THEN (SELECT max({{'n': length(w), 'w': w}}).w FROM (SELECT unnest(found) AS w)) END AS word FROM f
"""
