"""Depth-bounded traversal of the call graph, and impact of a change.

One join per level: the frontier (broadcast while its counted size allows) meets the
call edges, visited names are taken out by an anti-join, and the level is staged, which
both cuts lineage and tells whether to go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.graph import calls, one_row
from quarry.plans.staging import stage

#: Most frontier names that are broadcast; beyond it the level's join shuffles.
BROADCAST_NAMES = 1_000_000
#: Depth to which the dependents of an impact are counted, whatever is listed.
COUNT_DEPTH = 3
CALLER = "caller string, caller_file string, caller_type string, caller_line int, call_line int, depth int"


def transitive_dependents(edges: DataFrame, symbol: str, max_depth: int = 3) -> DataFrame:
    """Names that reach ``symbol`` by calls, each once at its least depth.

    Traversal is by name: symbols of one name in several files are one. The row that
    stands for a name is its first by file, line and call line on that level. Cycles
    end; the root itself never appears; an unknown symbol gives no rows."""
    spark = edges.sparkSession
    links = calls(edges).select("dst_name", F.col("src_name").alias("caller"), F.col("src_file").alias("caller_file"), F.col("src_type").alias("caller_type"), F.col("src_line").alias("caller_line"), "call_line")
    frontier = spark.range(1).select(F.lit(symbol).alias("dst_name"))
    size, visited, levels, called = 1, frontier.withColumnRenamed("dst_name", "caller"), [], None
    for depth in range(1, max_depth + 1):
        side = F.broadcast(frontier) if size <= BROADCAST_NAMES else frontier
        reached = links.join(side, "dst_name").drop("dst_name")
        # the least call line of each caller first (a missing one is the least), by a hash aggregate ahead of any shuffle
        least = F.when(~F.max(F.col("call_line").isNull()), F.min("call_line"))
        reached = reached.groupBy("caller", "caller_file", "caller_type", "caller_line").agg(least.alias("call_line"))
        one = reached.groupBy("caller").agg(F.min(F.struct("caller_file", "caller_line", "call_line", "caller_type")).alias("r")).join(visited, "caller", "left_anti")
        level = stage(one.select("caller", "r.caller_file", "r.caller_type", "r.caller_line", "r.call_line", F.lit(depth).alias("depth")), f"level{depth}")
        size = level.count()
        if not size:
            break
        levels.append(level)
        frontier = level.select(F.col("caller").alias("dst_name"))
        if size > BROADCAST_NAMES and depth < max_depth:  # few of many names are called, and only those lead on
            called = stage(links.select("dst_name").distinct(), "called") if called is None else called
            frontier = stage(frontier.join(called, "dst_name", "left_semi"), f"frontier{depth}")
            size = frontier.count()
            if not size:
                break
        visited = visited.unionByName(level.select("caller"))
    return reduce(DataFrame.unionByName, levels) if levels else spark.createDataFrame([], CALLER)


def impact(nodes: DataFrame, edges: DataFrame, symbol: str, change_type: str = "modify", high: tuple[float, int] = (0.5, 10), medium: tuple[float, int] = (0.2, 5), count_depth: int = COUNT_DEPTH, dependents: DataFrame | None = None) -> DataFrame:
    """One row: callers, dependents to ``count_depth``, their share of all nodes and the
    risk. Both the share and the count must be above a level's limits. ``dependents``: what
    a search to that depth or deeper has found already."""
    found = transitive_dependents(edges, symbol, count_depth) if dependents is None else dependents.where(F.col("depth") <= count_depth)
    ratio = F.when(F.col("total_nodes") > 0, F.col("transitive_dependents") / F.col("total_nodes")).otherwise(F.lit(0.0))
    level = lambda x: (ratio > x[0]) & (F.col("transitive_dependents") > x[1])
    risk = F.when(level(high), "high").when(level(medium), "medium").otherwise("low")
    one = one_row(direct_callers=calls(edges).where(F.col("dst_name") == symbol).agg(F.count("*")), transitive_dependents=found.agg(F.count("*")), total_nodes=nodes.agg(F.count("*")))
    out = one.select(F.lit(symbol).alias("symbol"), F.lit(change_type).alias("change_type"), "direct_callers", "transitive_dependents", "total_nodes", ratio.alias("impact_ratio"), risk.alias("risk_level"))
    return exact_round(out, "impact_ratio")


def distinct_links(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Staged (symbol, caller): every call once, and of these the calls whose caller is called itself. Only the
    latter lead from level to level, however many callers there are that nothing calls."""
    links = stage(calls(edges).select(F.col("dst_name").alias("symbol"), F.col("src_name").alias("caller")).distinct(), "links")
    both = stage(links.select("caller").distinct().join(links.select(F.col("symbol").alias("caller")).distinct(), "caller", "left_semi"), "called-callers")
    return links, stage(links.join(_few(both), "caller", "left_semi"), "inner-links")


def _few(names: DataFrame) -> DataFrame:
    """For the narrow side of a join: broadcast if its counted rows are few enough."""
    return F.broadcast(names) if names.count() <= BROADCAST_NAMES else names


def dependents_of_all(edges: DataFrame, max_depth: int = COUNT_DEPTH, links: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(symbol, dependents) for every called symbol: how many names reach it in so many calls.

    Exact: the pairs (symbol, dependent) of all levels are made, which is for graphs whose
    neighbourhoods are small. Pairs of symbols whose callers nothing calls are their calls. A symbol isn't its own
    dependent; a cycle alone gives 0. ``links``: what ``distinct_links`` gives."""
    every, inner = links or distinct_links(edges)
    count = F.count_if(F.col("caller") != F.col("symbol")).alias("dependents")
    reach = inner
    for depth in range(3, max_depth + 1):
        step = reach.select("symbol", F.col("caller").alias("next"))
        reach = stage(inner.unionByName(inner.withColumnRenamed("symbol", "next").join(step, "next").select("symbol", "caller")).distinct(), f"reach{depth}")
    if max_depth < 2:
        return every.groupBy("symbol").agg(count)
    reached = reach.select("symbol", F.col("caller").alias("next"))
    far = every.withColumnRenamed("symbol", "next").join(_few(reached), "next").select("symbol", "caller")
    hubs = _few(stage(inner.select("symbol").distinct(), "hubs"))
    near = every.join(hubs, "symbol", "left_semi").unionByName(far).distinct().groupBy("symbol").agg(count)
    return near.unionByName(every.join(hubs, "symbol", "left_anti").groupBy("symbol").agg(count))


def estimated_dependents(edges: DataFrame, max_depth: int = COUNT_DEPTH, lg_registers: int = 14, links: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(symbol, dependents) for every called symbol, within a few hundredths of ``dependents_of_all``.

    One HyperLogLog sketch per symbol stands for the names that reach it. Each level merges the
    sketches of a symbol's callers into its own, map-side first: a join and an aggregate for
    all symbols at once that have a called caller, whose rows don't grow with what the sketches hold. The standard
    error is about 1.04 / sqrt(2 ** lg_registers), 0.8 % by default. A symbol that calls itself through others counts itself."""
    every, inner = links or distinct_links(edges)
    direct = stage(every.groupBy("symbol").agg(F.hll_sketch_agg("caller", lg_registers).alias("sketch")), "sketches1")
    hubs = _few(stage(inner.select("symbol").distinct(), "hubs"))
    own = direct.join(hubs, "symbol", "left_semi")
    callers = stage(direct.withColumnRenamed("symbol", "caller").join(_few(inner.select("caller").distinct()), "caller", "left_semi"), "sketches-callers")
    merged = None
    for depth in range(2, max_depth + 1):
        if merged is not None:
            callers = callers.join(hubs.withColumnRenamed("symbol", "caller"), "caller", "left_anti").unionByName(merged.withColumnRenamed("symbol", "caller"))
        of_callers = inner.join(callers, "caller").select("symbol", "sketch")
        merged = stage(own.unionByName(of_callers).groupBy("symbol").agg(F.hll_union_agg("sketch").alias("sketch")), f"sketches{depth}")
    reached = direct if merged is None else direct.join(hubs, "symbol", "left_anti").unionByName(merged)
    return reached.select("symbol", F.hll_sketch_estimate("sketch").alias("dependents"))


def exact_round(ratio: DataFrame, column: str, places: int = 3) -> DataFrame:
    """Half-even rounding of the exact double, as Python rounds; an Arrow function, for
    callers that need it digit for digit (``F.round`` rounds the decimal form half up)."""

    @F.pandas_udf("double")
    def rounded(x):
        return x.map(lambda v: round(v, places))

    return ratio.withColumn(column, rounded(column))


def impact_report(spark: SparkSession, nodes: DataFrame, edges: DataFrame, symbol: str, change_type: str = "modify", max_depth: int = 3, test_files: DataFrame | None = None) -> DataFrame:
    """``impact`` with the dependents to ``max_depth`` and the test files (path, name)
    that mention them, as arrays. The counts stay those of depth 3: one search, to the greater
    of both depths, gives both."""
    searched = transitive_dependents(edges, symbol, max(max_depth, COUNT_DEPTH))
    dependents = searched.where(F.col("depth") <= max_depth)
    names = dependents.select("caller").unionByName(spark.range(1).select(F.lit(symbol).alias("caller")))
    listed = dependents.agg(F.sort_array(F.collect_list(F.concat_ws("@", F.format_string("%d", "depth"), "caller"))).alias("dependents"))
    if test_files is None:
        hit = spark.range(1).select(F.array().cast("array<string>"))
    else:
        targets = names.select(F.substring_index("caller", ".", -1).alias("name")).distinct()
        hit = test_files.join(targets, "name", "left_semi").agg(F.sort_array(F.collect_set("path")))
    counted = impact(nodes, edges, symbol, change_type, dependents=searched)
    row = one_row(counted=counted.select(F.struct("*")), dependents=listed, test_files=hit)
    return row.select("counted.*", "dependents", "test_files")
