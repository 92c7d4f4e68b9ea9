"""The skill catalog: listing, search, pages, and what is installed."""

from __future__ import annotations

import json
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quarry.functions import text

#: Items up to a page's end that are simply sorted, and rows and ranges of the sample beyond.
TOP, SAMPLE, RANGES = 10_000, 20_000, 64
LISTING = "array<struct<name:string,type:string,html_url:string,size:bigint,path:string,download_url:string>>"


def catalog(listings: DataFrame) -> DataFrame:
    """(name, source, description, url, ordinal) from (source, listing JSON, source_rank):
    directories whose name has no leading dot, in the order of sources and listings.
    Sources are put after one another; names that several have stay."""
    items = listings.select("source", "source_rank", F.posexplode(F.from_json("listing", LISTING)).alias("pos", "item"))
    kept = items.where((F.col("item.type") == "dir") & ~F.col("item.name").startswith("."))
    return kept.select(F.col("item.name").alias("name"), "source", text.title_name(F.col("item.name")).alias("description"), F.coalesce("item.html_url", F.lit("")).alias("url"), F.struct("source_rank", "pos").alias("ordinal"))


def search(items: DataFrame, query: str = "") -> DataFrame:
    """Items whose name holds the query, in any case; all for an empty one."""
    query = query.strip().lower()
    return items.where(F.lower("name").contains(query)) if query else items


def _ranges(items: DataFrame, order: list[str]) -> tuple[list[Row], list[int]]:
    """Bounds that cut the order into ranges, from a sample, and how many items each range has."""
    few = min(1.0, SAMPLE / max(1, items.count()))
    sampled = items.select(*order).sample(few, 17).orderBy(*order).collect()
    step = max(1, len(sampled) // RANGES)
    bounds = list(dict.fromkeys(sampled[step::step]))
    listed = F.array(*(_value(items, order, b) for b in bounds)) if bounds else None
    at = F.size(F.filter(listed, lambda b: b <= F.struct(*order))) if bounds else F.lit(0)
    counted = {r[0]: r[1] for r in items.groupBy(at.alias("at")).count().collect()}
    return bounds, [counted.get(i, 0) for i in range(len(bounds) + 1)]


def _value(items: DataFrame, order: list[str], row: Row) -> Column:
    """A row of the order's columns as a constant."""
    return F.from_json(F.lit(json.dumps(row.asDict(True), default=str)), items.select(*order).schema)


def page(items: DataFrame, order: list[str], limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of the catalog order, then sorted by name within the page, with
    ``total`` and ``more`` (whether items follow). Limit 200 at most, offset 0 at least.

    A page near the start is a top-k. One further on is found by counts of ranges of the order
    (numbers, texts, or structs of these): only the ranges that hold it are sorted."""
    limit, offset = min(limit, 200), max(offset, 0)
    total, skip, held = items.agg(F.count("*").alias("total")), offset, items
    if offset + limit > TOP:
        bounds, counts = _ranges(items, order)
        upto = list(accumulate(counts))
        first = next((i for i, n in enumerate(upto) if n > offset), len(bounds))
        last = next((i for i, n in enumerate(upto) if n >= offset + limit), len(bounds))
        skip = offset - (upto[first] - counts[first])
        if first:
            held = held.where(F.struct(*order) >= _value(items, order, bounds[first - 1]))
        if last < len(bounds):
            held = held.where(F.struct(*order) < _value(items, order, bounds[last]))
    head = held.orderBy(*order).limit(skip + limit)
    numbered = head.withColumn("_rn", F.row_number().over(Window.orderBy(*order))).where(F.col("_rn") > skip).drop("_rn")
    return numbered.join(F.broadcast(total)).withColumn("more", F.col("total") > offset + limit).orderBy("name")


def with_installed(items: DataFrame, installed: DataFrame) -> DataFrame:
    """Adds ``installed``: whether the installed table has the name."""
    names = installed.select("name").distinct().withColumn("_there", F.lit(True))
    return items.join(names, "name", "left").withColumn("installed", F.coalesce("_there", F.lit(False))).drop("_there")


def installed(files: DataFrame) -> DataFrame:
    """(name, file_count, total_size, description, files) per skill folder from
    (relative_path, size, content): folders that hold a SKILL.md right inside."""
    named = files.withColumn("name", F.substring_index("relative_path", "/", 1)).withColumn("inside", F.expr("substr(relative_path, length(name) + 2)")).where("inside <> ''")
    grouped = named.groupBy("name").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"), F.sort_array(F.collect_list("inside")).alias("files"), F.max(F.when(F.col("inside") == "SKILL.md", F.coalesce("content", F.lit("")))).alias("main"))
    return grouped.where("main is not null").select("name", "file_count", "total_size", text.description(F.col("main")).alias("description"), "files")


def skill_detail(listings: DataFrame) -> DataFrame:
    """(skill, source, files, total_size, description) from (skill, source, source_rank,
    listing JSON, main): of several sources that list a skill, the first."""
    items = F.filter(F.from_json("listing", LISTING), lambda x: x["type"] == "file")
    rows = listings.select("skill", "source", "source_rank", F.transform(items, lambda x: x["name"]).alias("files"), F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x["size"], F.lit(0))).alias("total_size"), text.description(F.coalesce("main", F.lit(""))).alias("description"))
    first = rows.withColumn("_rn", F.row_number().over(Window.partitionBy("skill").orderBy("source_rank"))).where("_rn = 1")
    return first.drop("_rn", "source_rank")


def totals(installed_skills: DataFrame) -> DataFrame:
    return installed_skills.agg(F.count("*").alias("skills"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"), F.coalesce(F.sum("total_size"), F.lit(0)).alias("bytes"))
