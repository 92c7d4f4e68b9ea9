"""Calls resolved by what their files import, in joins.

A call's name is looked up in its own file. If no symbol there has it, the file's bindings
say which module holds the name's beginning; the module is found among the files (from the
importing file's folders upwards, the nearest first), and the rest of the name is looked up
there in the same way. Aliases, re-exports and star imports are thus further steps of one lookup, and
a step is a join of all open lookups at once, by file and name. A name is open while no step
has found it; lookups that come back to a place they have been at end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.plans.staging import stage

#: Folders below a file's ancestors in which modules are looked for too.
ROOTS = ("", "src/", "lib/")
#: Files that stand for their folder.
_INDEX = r"(^|/)(__init__|index)$"
LOOKUP = ["src_file", "target"]


def _folders(path: Column) -> Column:
    return F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)


def modules(files: DataFrame) -> DataFrame:
    """(module, file): the paths by which each file (file_path) can be imported: without its extension, and
    its folder's for one that stands for it. Of several files with one path, the least."""
    stem = F.regexp_replace("file_path", r"(\.d)?\.[^./]+$", "")
    paths = F.array_distinct(F.array(stem, F.regexp_replace(stem, _INDEX, "")))
    return files.select(F.col("file_path").alias("file"), F.explode(paths).alias("module")).where("module <> ''").groupBy("module").agg(F.min("file").alias("file"))


def located(bindings: DataFrame, known: DataFrame) -> DataFrame:
    """(file_path, local, name, at_file, below) of bindings (file_path, local, level, module, name): the file that
    a binding leads to. ``below``: of ``from m import f`` where ``m/f`` is a file itself, so
    that what follows ``f`` is looked up in it. Modules that no file has give no row."""
    folders = _folders(F.col("file_path"))
    joined = lambda parts: F.array_join(parts, "/")
    under = lambda n: F.slice(folders, F.lit(1), F.greatest(F.size(folders) - n, F.lit(0)))
    path = lambda base, tail: F.ltrim(F.concat_ws("/", F.when(joined(base) != "", joined(base)), F.when(tail != "", tail)))
    own = bindings.where("level = -1").select("file_path", "local", "name", F.col("file_path").alias("at_file"), F.lit(False).alias("below"))
    relative = F.array(F.struct(F.lit(0).alias("far"), path(under(F.col("level") - 1), F.col("module")).alias("module")))
    upward = F.flatten(F.transform(F.sequence(F.lit(0), F.size(folders)), lambda n: F.array(*(F.struct((n * len(ROOTS) + i).alias("far"), path(under(n), F.concat(F.lit(root), F.col("module"))).alias("module")) for i, root in enumerate(ROOTS)))))
    asked = bindings.where("level >= 0").withColumn("c", F.explode(F.when(F.col("level") > 0, relative).otherwise(upward)))
    asked = asked.select("file_path", "local", "name", F.col("c.far").alias("far"), F.col("c.module").alias("m"))
    inner = asked.where("name is not null and name <> '*'").withColumn("m", F.concat_ws("/", F.when(F.col("m") != "", F.col("m")), "name"))
    both = asked.withColumn("below", F.lit(False)).unionByName(inner.withColumn("below", F.lit(True)))
    met = both.join(known, both["m"] == known["module"]).where("file <> file_path")
    near = met.groupBy("file_path", "local", "name", "below").agg(F.min_by("file", "far").alias("at_file"))
    return own.unionByName(near.select(*own.columns))


def lookup(asked: DataFrame, nodes: DataFrame, places: DataFrame, steps: int = 16) -> DataFrame:
    """(src_file, target, dst_file, dst_name, dst_type, dst_line) for the asked (src_file, target) that can be found.

    ``nodes``: NODES; imported names that are nodes of their own don't count. ``places``: from
    ``located``. ``steps`` bounds how many files a name is followed through; the search ends by itself
    when no lookup is open."""
    ends = stage(nodes.where("symbol_type <> 'import'").groupBy("file_path", "symbol_name").agg(F.min(F.struct("line_number", "symbol_type")).alias("n")), "ends")
    at = ends.select(F.col("file_path").alias("at_file"), F.col("symbol_name").alias("name"), F.col("n.symbol_type").alias("dst_type"), F.col("n.line_number").alias("dst_line"))
    to = stage(places.select(F.col("file_path").alias("at_file"), "local", F.col("name").alias("known_as"), F.col("at_file").alias("next_file"), "below").distinct(), "places")
    state = stage(asked.select(*LOOKUP).distinct().withColumns({"at_file": F.col("src_file"), "name": F.col("target")}), "asked")
    seen, found = [state], []
    for step in range(steps):
        hit = stage(state.join(at, ["at_file", "name"]).groupBy(*LOOKUP).agg(F.min(F.struct("at_file", "name", "dst_type", "dst_line")).alias("d")), f"found{step}")
        found.append(hit)
        open_ = state.join(hit.select(*LOOKUP), LOOKUP, "left_anti")
        parts = F.split("name", r"\.")
        heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("taken"), F.array_join(F.slice(parts, F.lit(1), n), ".").alias("local")))
        every = F.concat(heads, F.array(F.struct(F.lit(0).alias("taken"), F.lit("*").alias("local"))))
        moves = open_.withColumn("h", F.explode(every)).select(*LOOKUP, "at_file", "name", F.col("h.taken").alias("taken"), F.col("h.local").alias("local")).join(to, ["at_file", "local"])
        parts = F.split("name", r"\.")
        rest = F.array_join(F.slice(parts, F.col("taken") + 1, F.size(parts)), ".")
        keep = F.when(F.col("taken") == 0, F.col("name")).when(F.col("known_as").isNull() | F.col("below"), rest).otherwise(F.concat_ws(".", "known_as", F.when(rest != "", rest)))
        # the longest beginning that is bound goes; names that a star may bring go only where no other does
        best = moves.withColumn("next", keep).where("next <> ''").withColumn("most", F.expr("max(taken) over (partition by src_file, target, at_file, name)")).where("taken = most")
        state = best.select(*LOOKUP, F.col("next_file").alias("at_file"), F.col("next").alias("name")).distinct()
        state = stage(state.join(reduce(DataFrame.unionByName, seen), [*LOOKUP, "at_file", "name"], "left_anti"), f"step{step}")
        if state.isEmpty():
            break
        seen.append(state)
    first = reduce(DataFrame.unionByName, [h.withColumn("step", F.lit(i)) for i, h in enumerate(found)]).groupBy(*LOOKUP).agg(F.min(F.struct("step", "d")).alias("x"))
    return first.select(*LOOKUP, F.col("x.d.at_file").alias("dst_file"), F.col("x.d.name").alias("dst_name"), "x.d.dst_type", "x.d.dst_line")


def resolve_by_imports(nodes: DataFrame, raw: DataFrame, bindings: DataFrame, files: DataFrame) -> DataFrame:
    """Raw (file, source, target) edges to EDGES rows by what each file imports.

    ``bindings``: (file_path, local, level, module, name); ``files``: (file_path) of all files. An edge's
    target gets the name that it has where it is defined. Edges whose source isn't a symbol of
    their file, and whose target is defined in no file that the imports lead to, go. Methods of
    values (``x.f()`` with a variable ``x``) are such targets. Empty tables give no rows."""
    calls = raw.select(F.col("file_path").alias("src_file"), F.col("source").alias("src_name"), "target", "edge_type", F.col("line_number").alias("call_line"))
    source = nodes.groupBy("file_path", "symbol_name").agg(F.min(F.struct("line_number", "symbol_type")).alias("n")).select(F.col("file_path").alias("src_file"), F.col("symbol_name").alias("src_name"), F.col("n.symbol_type").alias("src_type"), F.col("n.line_number").alias("src_line"))
    known = stage(calls.join(source, ["src_file", "src_name"]), "known")
    ends = lookup(known, nodes, located(bindings, modules(files)))
    out = known.join(ends, LOOKUP)
    return out.select("src_file", "src_name", "src_type", "src_line", "dst_file", "dst_name", "dst_type", "dst_line", "edge_type", "call_line")
