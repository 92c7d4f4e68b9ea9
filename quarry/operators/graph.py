"""Relational operators over a code graph.

``edges`` is denormalised (see schemas.EDGES): each row holds both ends' natural keys,
so callers, callees and dependencies are filters, not joins. Orders are total.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dedupe_nodes(nodes: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row per (file, symbol, line): the first inserted, as an insert that ignores
    conflicts leaves. Map-side combined: a minimum of the whole row by its ordinal."""
    keys = ["file_path", "symbol_name", "line_number"]
    rest = [c for c in nodes.columns if c not in (*keys, ordinal)]
    return nodes.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordinal).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def resolve_edges(nodes: DataFrame, raw: DataFrame, scope: str = "file") -> DataFrame:
    """Raw (file, source, target) edges to EDGES rows; those without both ends go.

    ``file``: an end is the node of that name in the edge's own file, of the least line
    if there are several. ``project``: the source is, and the target is found by name
    in any file (its own first, then by path and line)."""
    if scope not in ("file", "project"):
        raise ValueError(f"unknown scope: {scope!r}")
    named = F.min_by(F.struct("symbol_type", "line_number"), "line_number")
    ends = nodes.groupBy("file_path", "symbol_name").agg(named.alias("n"))
    side = lambda p: ends.select(F.col("file_path").alias(f"{p}_file"), F.col("symbol_name").alias(f"{p}_name"), F.col("n.symbol_type").alias(f"{p}_type"), F.col("n.line_number").alias(f"{p}_line"))
    edges = raw.select(F.col("file_path").alias("src_file"), F.col("source").alias("src_name"), F.col("target").alias("dst_name"), "edge_type", F.col("line_number").alias("call_line"))
    out = edges.join(side("src"), ["src_file", "src_name"])
    if scope == "file":
        out = out.join(side("dst").withColumnRenamed("dst_file", "src_file"), ["src_file", "dst_name"]).withColumn("dst_file", F.col("src_file"))
    else:
        local = side("dst").select(F.col("dst_file").alias("src_file"), "dst_name", F.struct("dst_file", "dst_type", "dst_line").alias("near"))
        anywhere = side("dst").groupBy("dst_name").agg(F.min(F.struct("dst_file", "dst_line", "dst_type")).alias("far"))
        out = out.join(local, ["src_file", "dst_name"], "left").join(anywhere, "dst_name")
        pick = lambda c: F.coalesce(F.col(f"near.{c}"), F.col(f"far.{c}")).alias(c)
        out = out.select("src_file", "src_name", "src_type", "src_line", pick("dst_file"), "dst_name", pick("dst_type"), pick("dst_line"), "edge_type", "call_line")
    return out.select("src_file", "src_name", "src_type", "src_line", "dst_file", "dst_name", "dst_type", "dst_line", "edge_type", "call_line")


def calls(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("edge_type") == "calls")


def callers(edges: DataFrame, symbol: str, file_path: str | None = None) -> DataFrame:
    """Call sites of a symbol, by name; one row for each call, recursion included."""
    found = calls(edges).where(F.col("dst_name") == symbol)
    if file_path is not None:
        found = found.where(F.col("src_file") == file_path)
    return found.select(F.col("src_name").alias("caller"), F.col("src_file").alias("caller_file"), F.col("src_type").alias("caller_type"), F.col("src_line").alias("caller_line"), "call_line")


def callees(edges: DataFrame, symbol: str) -> DataFrame:
    found = calls(edges).where(F.col("src_name") == symbol)
    return found.select(F.col("dst_name").alias("callee"), F.col("dst_file").alias("callee_file"), F.col("dst_type").alias("callee_type"), F.col("dst_line").alias("callee_line"), "call_line")


def hotspots(edges: DataFrame, top: int = 10, file_path: str | None = None) -> DataFrame:
    """The most called symbols; ties by name, then file."""
    found = calls(edges)
    if file_path is not None:
        found = found.where(F.col("dst_file") == file_path)
    counted = found.groupBy(F.col("dst_name").alias("symbol"), F.col("dst_file").alias("file")).agg(F.min("dst_type").alias("type"), F.count("*").alias("caller_count"))
    return counted.orderBy(F.desc("caller_count"), "symbol", "file").limit(top)


def module_dependencies(edges: DataFrame, file_path: str | None = None, top: int | None = None) -> DataFrame:
    """Calls between different files, counted by pair."""
    found = calls(edges).where(F.col("src_file") != F.col("dst_file"))
    if file_path is not None:
        found = found.where(F.col("src_file") == file_path)
    counted = found.groupBy(F.col("src_file").alias("source_file"), F.col("dst_file").alias("target_file")).agg(F.count("*").alias("call_count"))
    return counted if top is None else counted.orderBy(F.desc("call_count"), "source_file", "target_file").limit(top)


def one_row(**parts: DataFrame) -> DataFrame:
    """One row of the single values of tables with one row and one column each."""
    kinds = {name: df.schema[0].dataType for name, df in parts.items()}
    rows = [df.select(*((F.col(f"`{df.columns[0]}`") if name == own else F.lit(None)).cast(kinds[name]).alias(name) for name in parts)) for own, df in parts.items()]
    return reduce(DataFrame.unionByName, rows).agg(*(F.first(name, ignorenulls=True).alias(name) for name in parts))


def totals(nodes: DataFrame, edges: DataFrame, file_path: str | None = None) -> DataFrame:
    """(total_nodes, total_edges), of a file (edges by source) if given; all edge types."""
    if file_path is not None:
        nodes, edges = nodes.where(F.col("file_path") == file_path), edges.where(F.col("src_file") == file_path)
    return one_row(total_nodes=nodes.agg(F.count("*")), total_edges=edges.agg(F.count("*")))


def graph_stats(nodes: DataFrame, edges: DataFrame, file_path: str | None = None) -> DataFrame:
    """One row: totals, the top 5 hotspots and 10 module dependencies as arrays."""
    def listed(top: DataFrame, count: str, *names: str) -> DataFrame:
        best = F.sort_array(F.collect_list(F.struct((-F.col(count)).alias("o"), *(F.col(n).alias(f"c{i}") for i, n in enumerate(names)))))
        return top.agg(F.transform(best, lambda x: F.concat_ws("|", *(x[f"c{i}"] for i in range(len(names))), (-x["o"]).cast("string"))))

    if file_path is not None:
        own_nodes, own_edges = nodes.where(F.col("file_path") == file_path), edges.where(F.col("src_file") == file_path)
    else:
        own_nodes, own_edges = nodes, edges
    return one_row(
        total_nodes=own_nodes.agg(F.count("*")), total_edges=own_edges.agg(F.count("*")),
        hotspots=listed(hotspots(edges, 5, file_path), "caller_count", "symbol", "file"),
        module_dependencies=listed(module_dependencies(edges, file_path, 10), "call_count", "source_file", "target_file"),
    )


def is_empty(nodes: DataFrame) -> bool:
    return nodes.isEmpty()


def remove_files(nodes: DataFrame, edges: DataFrame, manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three without what belongs to ``files`` (file_path): edges go at either end."""
    gone = files.select("file_path").distinct()
    left = edges.join(gone.withColumnRenamed("file_path", "src_file"), "src_file", "left_anti").join(gone.withColumnRenamed("file_path", "dst_file"), "dst_file", "left_anti")
    return nodes.join(gone, "file_path", "left_anti"), left, manifest.join(gone, "file_path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(file_path, cached): whether the stored hash is the current one."""
    stored = manifest.select("file_path", F.col("hash").alias("stored"))
    return files.join(stored, "file_path", "left").select("file_path", F.coalesce(F.col("sha256") == F.col("stored"), F.lit(False)).alias("cached"))


def cache_valid(files: DataFrame, manifest: DataFrame, probe: int = 100) -> DataFrame:
    """(valid): whether the first ``probe`` files by path are all cached."""
    first = files.orderBy("file_path").limit(probe)
    return changed_files(first, manifest).agg(F.coalesce(F.bool_and("cached"), F.lit(True)).alias("valid"))


def language_vote(paths: DataFrame, library: str | None = None) -> DataFrame:
    """(language) by counting extensions. Without a library: Python at least level with
    both, then TypeScript level with JavaScript, null if there are no files at all. For
    a library: a strict winner (``.d.ts`` twice, no ``x`` variants), else by the library."""
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    n = lambda *e: F.count_if(ext.isin(*e))
    if library is None:
        py, ts, js = n(".py"), n(".ts", ".tsx"), n(".js", ".jsx")
        counted = paths.agg(py.alias("py"), ts.alias("ts"), js.alias("js"))
        vote = F.when(F.expr("py + ts + js = 0"), F.lit(None)).when(F.expr("py >= ts and py >= js"), "python").when(F.expr("ts >= js"), "typescript").otherwise("javascript")
    else:
        counted = paths.agg(n(".py").alias("py"), (n(".ts") + F.count_if(F.col("path").endswith(".d.ts"))).alias("ts"), n(".js").alias("js"))
        # Libraries that settle a tie.
        tie = "python" if library in ("fastapi", "flask", "django", "pydantic", "numpy", "pandas") else "typescript" if library in ("react", "express", "typescript", "next") else "python"
        vote = F.when(F.expr("py > ts and py > js"), "python").when(F.expr("ts > py and ts > js"), "typescript").when(F.expr("js > py and js > ts"), "javascript").otherwise(tie)
    return counted.select(vote.alias("language"))


def first_by_priority(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order: first match wins."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
