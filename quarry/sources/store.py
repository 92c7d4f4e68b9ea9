"""The graph store: nodes, edges and file manifest as Parquet, added to run by run.

A write adds a folder per table under a run of its own and never touches another's, so a
batch of ten files writes the rows of ten files, and writers don't meet:

    nodes/run=R      NODES
    edges/run=R      EDGES, resolved within their file: filters by name reach the scan
    raw/run=R        RAW_EDGES, from which other scopes are resolved when read
    bindings/run=R   what imports bind, of files that were put in the scope ``imports``
    manifest/run=R   file_path, hash, updated_at, kind, version, scope

The manifest is written last; rows of a run that it doesn't know are never read. For each
file the latest ``put`` or ``gone`` decides, by version (the run that brought the content) and
then by run: its rows are those of that put, and of later ``add`` rows. ``forget`` hides a
hash, ``clear`` (without a file) ends everything before it. A manifest that was written in part is
a smaller run, as each of its files is whole. Runs are numbered by the clock, so the last
writer of a file wins, and writers of different files both count.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.schemas import EDGES, GRAPH_EXCLUDED, MANIFEST, NODES, RAW_EDGES
from quarry.operators import graph, imports
from quarry.plans.staging import stage
from quarry.sources import files as source_files
from quarry.sources.folders import read_or_empty

TABLES = {"nodes": NODES, "edges": EDGES, "raw": RAW_EDGES, "bindings": source_files.BINDINGS}
MARKS = "file_path string, hash string, updated_at double, kind string, version string, scope string"


class GraphStore:
    """``root`` is any path that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def runs(self, table: str = "manifest") -> list[str]:
        """Runs with a folder of that table, oldest first."""
        path, fs = self._folder(table)
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))

    def version(self) -> str | None:
        """The last run: what was read stays right as long as this is the same."""
        return max(self.runs(), default=None)

    @staticmethod
    def _new_run() -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def _write(self, run: str, **tables: DataFrame) -> None:
        """In the order given: the manifest goes last."""
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/run={run}")

    def _mark(self, run: str, rows: DataFrame, kind: str, scope: str = "file") -> DataFrame:
        """MARKS rows of (file_path, hash, updated_at)."""
        return rows.select("file_path", "hash", F.col("updated_at").cast("double").alias("updated_at"), F.lit(kind).alias("kind"), F.lit(run).alias("version"), F.lit(scope).alias("scope"))

    def _marks(self) -> DataFrame:
        """All marks of files that count, with the file's deciding one (``base``) and last one."""
        marks = read_or_empty(self.spark, f"{self.root}/manifest", f"{MARKS}, run string")
        cleared = F.coalesce(F.max(F.when(F.col("kind") == "clear", F.col("version"))), F.lit(""))
        since = marks.agg(cleared.alias("since"))
        marks = marks.where("file_path is not null").join(F.broadcast(since), F.col("version") > F.col("since")).drop("since")
        at = F.struct("version", "run")
        of_file = marks.groupBy("file_path").agg(F.max(F.when(F.col("kind").isin("put", "gone"), at)).alias("base"), F.max(F.struct("version", "run", "kind", "hash", "updated_at")).alias("last"))
        return marks.join(of_file, "file_path").withColumn("at", at)

    def _live(self, marks: DataFrame) -> DataFrame:
        """(file_path, run, version): the runs whose rows are a file's."""
        live = marks.where("kind in ('put', 'add') and (base is null or at >= base)")
        return live.select("file_path", "run", "version")

    def _rows(self, table: str, live: DataFrame) -> DataFrame:
        key = "src_file" if table == "edges" else "file_path"
        found = read_or_empty(self.spark, f"{self.root}/{table}", f"{TABLES[table]}, run string")
        return found.join(live.select(F.col("file_path").alias(key), "run"), [key, "run"], "left_semi").drop("run")

    def scope(self) -> str:
        """The scope that the last run was resolved in."""
        marks = read_or_empty(self.spark, f"{self.root}/manifest", f"{MARKS}, run string")
        last = marks.agg(F.max(F.when(F.col("kind") == "put", F.struct("run", "scope"))).alias("m")).select("m.scope").first()
        return last[0] or "file"

    def read(self, scope: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """NODES, EDGES and MANIFEST as they stand. Edges of ``project`` and ``imports`` scope are
        resolved over all files now, so they are those of a graph built anew."""
        marks = self._marks()
        live = self._live(marks)
        nodes, scope = self._rows("nodes", live), scope or self.scope()
        if scope == "project":
            edges = graph.resolve_edges(nodes, self._rows("raw", live), "project")
        elif scope == "imports":
            edges = imports.resolve_by_imports(nodes, self._rows("raw", live), self._rows("bindings", live), live.select("file_path").distinct())
        else:
            edges = self._rows("edges", live)
        known = marks.where("at = struct(last.version, last.run) and kind in ('put', 'add')").select("file_path", "hash", "updated_at")
        return tuple(df.select(*(c.split()[0] for c in ddl.split(", "))) for df, ddl in ((nodes, NODES), (edges, EDGES), (known, MANIFEST)))

    def register_views(self, prefix: str = "") -> None:
        """The stored tables as SQL views: nodes, edges, manifest."""
        for name, df in zip(("nodes", "edges", "manifest"), self.read(), strict=True):
            df.createOrReplaceTempView(prefix + name)

    def clear(self) -> None:
        run = self._new_run()
        self._write(run, manifest=self._mark(run, self.spark.createDataFrame([(None, None, None)], MANIFEST), "clear"))

    def invalidate(self, paths: list[str]) -> None:
        """Forgets the hashes of files, so that the next build reads them again."""
        run, known = self._new_run(), self.read("file")[2]
        self._write(run, manifest=self._mark(run, stage(known.where(F.col("file_path").isin(*paths) if paths else F.lit(False)), "forgotten"), "forget"))

    def remove(self, files: DataFrame) -> None:
        """Files (file_path) that are gone: their rows are no longer read."""
        run = self._new_run()
        gone = stage(files.select("file_path", F.lit(None).cast("string").alias("hash"), F.lit(None).alias("updated_at")).distinct(), "gone")
        self._write(run, manifest=self._mark(run, gone, "gone"))

    def put(self, files: DataFrame, remove_first: bool = True, resolve_scope: str = "file", now: float | None = None, heritage: bool = False) -> None:
        """Parses and stores files. Without ``remove_first`` old rows stay: nodes are
        deduplicated, edges are not. Repeated, it gives the same graph; no files write nothing."""
        run = self._new_run()
        hashes = stage(files.groupBy("file_path").agg(F.max("sha256").alias("hash")).withColumn("updated_at", F.lit(time.time() if now is None else now)), "put")
        if hashes.isEmpty():
            return
        tagged = stage(source_files.extract(files, heritage), "extracted")
        fresh = known = stage(graph.dedupe_nodes(source_files.nodes_of(tagged)), "parsed")
        if not remove_first:
            old = self.read("file")[0].join(hashes.select("file_path"), "file_path", "left_semi")
            fresh = fresh.join(old, ["file_path", "symbol_name", "line_number"], "left_anti")
            known = old.unionByName(fresh.select(*old.columns))
        raw = source_files.raw_edges_of(tagged)
        columns = [c.split()[0] for c in NODES.split(", ")]
        marks = self._mark(run, hashes, "put" if remove_first else "add", resolve_scope)
        bound = {"bindings": source_files.bindings(files)} if resolve_scope == "imports" else {}
        self._write(run, nodes=fresh.select(*columns), edges=graph.resolve_edges(known, raw, "file"), raw=raw, **bound, manifest=marks)

    def compact(self) -> None:
        """Writes all that is read into one run. Files that are put meanwhile keep their newer rows,
        as a file's version stays that of its content."""
        run, marks = self._new_run(), stage(self._marks(), "marks")
        live = self._live(marks)
        content = F.max(F.struct("version", "hash", "updated_at", "scope")).alias("m")
        kept = marks.where("kind in ('put', 'add') and (base is null or at >= base)").groupBy("file_path").agg(content)
        kept = kept.select("file_path", "m.hash", "m.updated_at", F.lit("put").alias("kind"), "m.version", "m.scope")
        self._write(run, **{table: self._rows(table, live) for table in TABLES}, manifest=kept)

    def vacuum(self, older_than_seconds: float = 86_400.0) -> list[str]:
        """Deletes runs that nothing is read from, if they are older than any reader or writer that
        may still be at work; returns them."""
        marks = stage(self._marks(), "marks")
        needed = self._live(marks).select("run").unionByName(marks.select("last.run")).unionByName(marks.select("base.run"))
        cleared = read_or_empty(self.spark, f"{self.root}/manifest", f"{MARKS}, run string").where("kind = 'clear'").agg(F.max("run").alias("run"))
        keep = {r[0] for r in needed.unionByName(cleared).distinct().collect()}
        limit = f"{time.time_ns() - int(older_than_seconds * 1e9):020d}"
        dead = sorted({run for table in (*TABLES, "manifest") for run in self.runs(table) if run not in keep and run < limit})
        for run in dead:
            for table in (*TABLES, "manifest"):
                path, fs = self._folder(f"{table}/run={run}")
                fs.delete(path, True)
        return dead


def build_graph(spark: SparkSession, store: GraphStore, root: str, scope: str = "full", path: str | None = None, force: bool = False, language: str | None = None, resolve_scope: str = "file", purge_missing: bool = False, heritage: bool = False, exclude: tuple[str, ...] = GRAPH_EXCLUDED) -> DataFrame:
    """Builds or refreshes the stored graph; returns its statistics (one row).

    ``full`` reads the root, ``module`` a directory, ``file`` one file. Files whose hash
    is stored are skipped before parsing unless ``force``. ``file`` scope adds without
    removing the file's old rows first, so edges repeat on rebuild; ``purge_missing``
    (off by default) also drops stored files that are gone. A missing path or unknown
    scope is a one-row table with an error."""
    error = lambda text: spark.range(1).select(F.lit(text).alias("error"))
    if scope not in ("full", "file", "module"):
        return error(f"Invalid scope: {scope}")
    if scope != "full" and not path:
        return error(f"Path required for scope={scope}")
    try:
        if language is None:
            language = vote(spark, root)
        found = source_files.scan(spark, root if scope == "full" else path, language, exclude)
        found.isEmpty()
    except Exception as e:  # the path can't be read: reported as the tool reports it
        if "PATH_NOT_FOUND" in str(e):
            return error(f"Path not found: {path or root}")
        raise
    if purge_missing:
        nodes, _, manifest = store.read("file")
        stored = manifest.select("file_path").unionByName(nodes.select("file_path")).distinct()
        store.remove(stored.join(found.select("file_path"), "file_path", "left_anti"))
    if not force and scope != "file":
        found = stale_only(store, found)
    store.put(found, remove_first=scope != "file", resolve_scope=resolve_scope, heritage=heritage)
    nodes, edges, _ = store.read(resolve_scope)
    return graph.graph_stats(nodes, edges, path if scope == "file" else None)


def vote(spark: SparkSession, root: str) -> str:
    """The language of a project by its files; an error if it has none."""
    from quarry.errors import LanguageDetectionError

    listed = source_files.listed(spark, root, ["*.py", "*.ts", "*.tsx", "*.js", "*.jsx"], contents=False)
    language = graph.language_vote(listed.select(F.col("file_path").alias("path"))).first()[0]
    if language is None:
        raise LanguageDetectionError(f"no Python, TypeScript or JavaScript files in {root}")
    return language


def stale_only(store: GraphStore, files: DataFrame) -> DataFrame:
    """The files whose stored hash isn't theirs."""
    stale = stage(graph.changed_files(files.select("file_path", "sha256"), store.read("file")[2]).where("not cached").select("file_path"), "stale")
    return files.join(stale, "file_path", "left_semi")


def rebuild(store: GraphStore, files: DataFrame, resolve_scope: str = "file", heritage: bool = False) -> None:
    """Incremental refresh of changed files: their old rows out, new ones in."""
    store.put(files, remove_first=True, resolve_scope=resolve_scope, heritage=heritage)
