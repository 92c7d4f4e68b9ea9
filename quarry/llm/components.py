"""Connected components of an edge table, by alternating large and small stars.

Every round is two map-side-combined minimum aggregations and two equi-joins, so no
component is ever gathered in one task; each round's edges are staged as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.plans.staging import drop, stage

#: Edges of a file that a round writes, and the least number of files.
FILE_EDGES, LEAST_FILES = 250_000, 12


def _with_least(both: DataFrame) -> DataFrame:
    """(u, v, m): each directed edge with the least node of u's neighbourhood."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u")


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """edges: (a, b) longs. Returns (node, component): the least node reachable.

    Rounds go on until one changes nothing; a round's table is dropped after the next.

    Nodes without an edge to another node don't appear; nulls and self-loops are
    ignored; repeated edges don't matter; an empty table gives an empty result.
    """
    now = stage(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        f"{label}-edges",
    )
    mark, size = None, now.count()
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _with_least(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        files = max(LEAST_FILES, -(-size // FILE_EDGES))
        before, now = now, stage(tied.where("u <> v").distinct().coalesce(files), f"{label}-stars")
        drop(before)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == mark:
            break
        mark, size = seen, seen[0]
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
