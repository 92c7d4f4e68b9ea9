"""The nine tools: argument checks, calls of the operators, and text reports."""

from __future__ import annotations

import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.errors import QuarryError
from quarry.functions.memo import Memo
from quarry.functions.schemas import GRAPH_EXCLUDED
from quarry.operators import affected_tests, catalog, graph, symbols, traverse, validation
from quarry.sources import files, search, skills
from quarry.sources.store import GraphStore, build_graph, vote


def _check(name: str, value, least: int = 0, most: int | None = None, among: tuple = (), pattern: str = "") -> None:
    size = len(value) if isinstance(value, str) else value
    if (most is not None and size > most) or size < least or (among and value not in among) or (pattern and not re.fullmatch(pattern, value)):
        raise QuarryError(f"invalid {name}: {value!r}")


@dataclass
class Tools:
    """A project: its graph store, its symbols and its skills."""

    spark: SparkSession
    root: str
    store_root: str
    skills_dir: str = ""
    config: skills.Config | None = None
    client: skills.HttpClient | None = None
    #: Whether verification searches the driver's own interpreter too (slow the first time).
    interpreter: bool = False
    #: Whether extends and implements are edges of the graph.
    heritage: bool = False
    #: Names of folders that graph builds leave out.
    exclude: tuple[str, ...] = GRAPH_EXCLUDED
    #: Known symbols by library, where they aren't the built-in ones.
    known: dict[str, str] | None = None
    #: Limits (share of all nodes, dependents) above which a change is of high or medium risk.
    high_risk: tuple[float, int] = (0.5, 10)
    medium_risk: tuple[float, int] = (0.2, 5)

    def __post_init__(self) -> None:
        self.store = GraphStore(self.spark, self.store_root)
        self.config = self.config or skills.Config()
        self.answers = Memo(256)

    # graph

    def analyze_codebase_graph(self, scope: str = "full", path: str | None = None, force_rebuild: bool = False, language: str | None = None, resolve_scope: str = "file") -> str:
        _check("scope", scope, among=("full", "file", "module"))
        if path is not None:
            _check("path", path, 0, 500)
        row = build_graph(self.spark, self.store, self.root, scope, path, force_rebuild, language, resolve_scope, heritage=self.heritage, exclude=self.exclude).first().asDict()
        self.answers.clear()
        if "error" in row:
            return f"Error: {row['error']}"
        lines = ["Code Graph Analysis:", f"  Total nodes (functions/classes): {row['total_nodes']}", f"  Total edges (call relationships): {row['total_edges']}"]
        if row["hotspots"]:
            lines.append("\nHotspots:")
            lines += [f"  - {s} in {f} - {n} callers" for s, f, n in (h.rsplit("|", 2) for h in row["hotspots"][:5])]
        if row["module_dependencies"]:
            lines.append("\nModule dependencies:")
            lines += [f"  - {a} -> {b} ({n} calls)" for a, b, n in (m.rsplit("|", 2) for m in row["module_dependencies"][:10])]
        return "\n".join(lines)

    def _graph(self):
        nodes, edges, _ = self.store.read()
        if graph.is_empty(nodes):
            raise QuarryError("The graph is empty; analyze the codebase first")
        return nodes, edges

    def analyze_impact(self, symbol: str, change_type: str = "modify", max_depth: int = 3) -> str:
        _check("symbol", symbol, 1, 200)
        _check("change_type", change_type, among=("modify", "delete", "rename"))
        _check("max_depth", max_depth, 1, 5)
        nodes, edges = self._graph()
        searched = traverse.transitive_dependents(edges, symbol, max(max_depth, traverse.COUNT_DEPTH))
        row = traverse.impact(nodes, edges, symbol, change_type, self.high_risk, self.medium_risk, dependents=searched).first()
        dependents = searched.where(F.col("depth") <= max_depth)
        wanted = affected_tests.targets(dependents.select("caller").unionByName(self.spark.createDataFrame([(symbol,)], "caller string")))
        language = vote(self.spark, self.root)
        found = files.scan(self.spark, self.root, language)
        tests = affected_tests.by_reference(found, wanted) if language == "python" else affected_tests.by_substring(found, wanted)
        paths = [r[0] for r in tests.orderBy("path").limit(10).collect()]
        named = dependents.orderBy("depth", "caller").limit(15).collect()
        lines = [f"Impact Analysis: {symbol}", f"Change type: {change_type}", f"Risk level: {row.risk_level.upper()}", f"Direct callers: {row.direct_callers}", f"Transitive dependents: {row.transitive_dependents}", f"Impact ratio: {row.impact_ratio:.1%}"]
        if paths:
            lines += ["\nAffected test files:", *(f"  - {p}" for p in paths)]
        if named:
            lines += [f"\nTransitive dependents (depth <= {max_depth}):", *(f"  - {d.caller} (depth {d.depth})" for d in named)]
        return "\n".join(lines)

    def find_callers(self, symbol: str, file_path: str | None = None) -> str:
        _check("symbol", symbol, 1, 200)
        found = graph.callers(self._graph()[1], symbol, file_path)
        rows = found.orderBy("caller_file", "caller_line", "call_line", "caller").collect()
        return "\n".join([f"Callers of '{symbol}':", f"Total callers: {len(rows)}", *(f"  - {r.caller} ({r.caller_type}) in {r.caller_file}:{r.caller_line}" for r in rows)])

    # symbols

    def _symbols(self, library: str, language: str):
        """Parsed at each call, so that an answer is about the files as they are."""
        from quarry.plans.staging import stage

        return stage(search.symbols_of(self.spark, self.root, library, language, self.interpreter), "symbols")

    def detect_language(self, library: str = "") -> str:
        """By the files of the project, a tie by the library."""
        listed = files.listed(self.spark, self.root, ["*.py", "*.ts", "*.js"], contents=False)
        return graph.language_vote(listed.select(F.col("file_path").alias("path")), library).first()[0]

    def verify_api(self, library: str, symbol: str, symbol_type: str = "", import_path: str = "", doc_url: str = "", language: str | None = None) -> str:
        """``symbol_type`` and ``import_path`` are accepted and, as in the tool this
        follows, don't narrow the local search. The last 256 answers are kept by library,
        symbol, type and language, until the graph is built again."""
        _check("library", library, 1, 100)
        _check("symbol", symbol, 1, 200)
        _check("doc_url", doc_url, 0, 1000)
        key = f"{library}:{symbol}:{symbol_type}:{language or ''}"
        if key in self.answers:
            return self.answers.get(key)
        language = language or self.detect_language(library)
        package = (Path(self.root) / "node_modules" / library).is_dir()
        asked = self.spark.createDataFrame([(library, symbol, language, doc_url or None, package)], "library string, symbol string, language string, doc_url string, package boolean")
        row = symbols.verify(asked, self._symbols(library, language), symbols.known_symbols(self.spark, self.known)).first()
        lines = [f"API Verification: {symbol} in {library}", f"Status: {row.status}", ""]
        if row.status == "FOUND":
            lines.append(f"Source: {row.source}")
            lines += [f"{label}: {value}" for label, value in (("Signature", row.signature), ("File", row.file_path), ("Line", row.line_number), ("Import", row.import_path)) if value]
        else:
            lines.append("Message: Symbol not found")
            if row.similar:
                lines += ["\nSimilar symbols:", *(f"  - {s}" for s in row.similar)]
        self.answers.put(key, "\n".join(lines))
        return self.answers.get(key)

    # skills

    def list_skill_catalog(self, limit: int = 50, offset: int = 0, query: str = "") -> str:
        _check("query", query, 0, 100)
        items = catalog.catalog(skills.fetch_listings(self.spark, self.config.sources, self.client or skills.HttpClient(self.config.http)))
        if items.isEmpty():
            raise QuarryError("The skill catalog could not be fetched")
        found = catalog.search(items, query)
        limit, offset = min(limit, 200), max(offset, 0)
        total = found.count()
        rows = catalog.with_installed(catalog.page(found, ["ordinal"], limit, offset), self._installed()).orderBy("name").collect()
        lines = [f"Available skills ({total} total, showing {len(rows)}):\n"]
        for r in rows:
            lines.append(f"- **{r.name}** {'[INSTALLED]' if r.installed else '[available]'}")
            lines += [f"  {r.description}"] * bool(r.description)
        if offset + limit < total:
            lines.append(f"\n... use offset={offset + limit} to see more skills")
        return "\n".join(lines)

    def _installed(self):
        if not self.skills_dir or not Path(self.skills_dir).is_dir():
            return self.spark.createDataFrame([], "name string, file_count long, total_size long, description string, files array<string>")
        return catalog.installed(skills.installed_files(self.spark, self.skills_dir))

    def get_skill_detail(self, skill_name: str) -> str:
        _check("skill_name", skill_name, 1, 200, pattern=r"[a-zA-Z0-9_-]+")
        client = self.client or skills.HttpClient(self.config.http)
        rows = []
        for i, s in enumerate(self.config.sources):
            try:
                listing = client.get(f"{s.api_url}/contents/skills/{skill_name}")
                main = client.get(f"{s.raw_url}/skills/{skill_name}/SKILL.md")
                rows.append((skill_name, s.name, i, listing, main))
            except QuarryError:
                continue
        if not rows:
            raise QuarryError(f"Could not find skill '{skill_name}'")
        info = catalog.skill_detail(self.spark.createDataFrame(rows, "skill string, source string, source_rank int, listing string, main string")).first()
        here = any(r.name == skill_name for r in self._installed().select("name").collect())
        return "\n".join([f"Skill: {skill_name} [{'INSTALLED' if here else 'available'}]", f"Source: {info.source}", f"Description: {info.description or 'N/A'}", f"Files: {len(info.files)}", f"Total size: {info.total_size:,} bytes", *(f"  - {f}" for f in info.files)])

    def download_skill(self, skill_name: str) -> str:
        _check("skill_name", skill_name, 1, 200, pattern=r"[a-zA-Z0-9_-]+")
        r = skills.download(skill_name, self.config.sources, self.skills_dir, self.client or skills.HttpClient(self.config.http))
        return f"Successfully downloaded skill '{r['skill']}'\nSource: {r['source']}\nLocation: {r['path']}\nFiles downloaded: {r['file_count']}"

    def list_installed_skills(self) -> str:
        found = self._installed()
        total = catalog.totals(found).first()
        lines = [f"Installed skills ({total.skills} total, {total['files']} files, {total.bytes:,} bytes):\n"]
        for r in found.orderBy("name").collect():
            lines += [f"### {r.name}", f"  Files: {r.file_count} | Size: {r.total_size:,} bytes", *[f"  Description: {r.description}"] * bool(r.description), *(f"    - {f}" for f in r.files)]
        return "\n".join(lines)

    # validation

    def sandbox_validate(self, code: str, file_path: str | None = None, language: str | None = None, checks: tuple[str, ...] | None = None, tool_outputs: dict[str, str] | None = None, python_version: str = "", dependencies: tuple[str, ...] = (), ts_config: dict | None = None) -> str:
        """Code is parsed, never run. ``tool_outputs`` (``{"types:mypy": text}``) brings in
        what external tools said, as none is started from here; checks that need one and have no
        output are reported as skipped. ``python_version``, ``dependencies`` and ``ts_config`` are for
        those tools: accepted, and without effect on what is checked here."""
        path = file_path or ("<unnamed>.ts" if language in ("typescript", "javascript") else "<unnamed>")
        outputs = {k: self.spark.createDataFrame([(path, v)], "file_path string, output string") for k, v in (tool_outputs or {}).items()}
        asked = None if checks is None else tuple(dict.fromkeys((*checks, *(k.split(":")[0] for k in outputs))))
        row = validation.validate(files.inline(self.spark, {path: code}), asked, outputs).first()
        lines = [f"Sandbox Validation: {path}", f"Status: {row.status.upper()}", f"Can write: {row.can_write}", f"Summary: {row.summary}", ""]
        for r in row.results:
            lines.append(f"[{r.status.upper()}] {r.check}")
            lines += [f"  {i.severity.upper()}{f' line {i.line}' if i.line else ''}: [{i.code}] {i.message}" for i in r.issues]
        return "\n".join(lines)
