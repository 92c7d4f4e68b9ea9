"""Resolution by imports, on projects whose edges were worked out by hand."""

from quarry.operators import imports
from quarry.plans import code_fixtures as code
from quarry.sources import files, import_code


def edges(spark, project):
    found = files.inline(spark, project)
    tagged = files.extract(found)
    raw = files.raw_edges_of(tagged).where("edge_type = 'calls'")
    out = imports.resolve_by_imports(files.nodes_of(tagged), raw, files.bindings(found), found)
    return sorted((r.src_file, r.src_name, r.dst_file, r.dst_name, r.call_line) for r in out.collect())


def test_python_bindings():
    source = "import a.b\nimport c.d as e\nfrom f.g import h as i, j\nfrom ..k import *\nfrom . import l\n"
    assert list(import_code.python_bindings(source)) == [
        ("a.b", 0, "a/b", None, 1), ("a", 0, "a", None, 1), ("e", 0, "c/d", None, 2), ("i", 0, "f/g", "h", 3), ("j", 0, "f/g", "j", 3), ("*", 2, "k", "*", 4), ("l", 1, "", "l", 5),
    ]
    assert not list(import_code.python_bindings("def broken(:"))


def test_typescript_bindings():
    source = """import a, { b as c, type D } from '../m/n';
import * as e from "pkg";
import type { F } from './f';
export { g as h, i } from './j';
export * from './k';
export * as l from './l';
export { m as n };
export default class O {}
import p = require('./p');
const { q: r, s } = require('t');
const u = require("./u");
import './side-effects';
export const v = 1;
// import { no } from 'comment'
export default function w() {}
"""
    assert list(import_code.typescript_bindings(source)) == [
        ("a", 2, "m/n", "default", 1), ("c", 2, "m/n", "b", 1), ("D", 2, "m/n", "D", 1), ("e", 0, "pkg", None, 2), ("F", 1, "f", "F", 3), ("h", 1, "j", "g", 4), ("i", 1, "j", "i", 4),
        ("*", 1, "k", "*", 5), ("l", 1, "l", None, 6), ("n", -1, "", "m", 7), ("default", -1, "", "O", 8), ("p", 1, "p", None, 9), ("r", 0, "t", "q", 10), ("s", 0, "t", "s", 10), ("u", 1, "u", None, 11), ("default", -1, "", "w", 15),
    ]
    for odd in ("import {", "export", "import * as", "export default", "import a from", "require(", "= require('x')", "import { a as } from 'b'"):
        list(import_code.typescript_bindings(odd))


def test_names_go_where_imports_lead(spark):
    assert edges(spark, code.IMPORT_PROJECT) == sorted(code.IMPORT_EDGES)


def test_folders_above_and_source_roots(spark):
    project = {
        "/w/proj/tests/deep/test_a.py": "from pkg.core import run\ndef test():\n    run()\n",
        "/w/proj/src/pkg/core.py": "def run(): pass\n",
        "/w/other/pkg/core.py": "def run(): pass\n",
        "/w/proj/near/pkg/core.py": "def run(): pass\n",
        "/w/proj/near/use.py": "from pkg.core import run\ndef use():\n    run()\n",
    }
    assert edges(spark, project) == [("/w/proj/near/use.py", "use", "/w/proj/near/pkg/core.py", "run", 3), ("/w/proj/tests/deep/test_a.py", "test", "/w/proj/src/pkg/core.py", "run", 3)]


def test_circles_end_and_nothing_gives_nothing(spark):
    circle = {"a.py": "from b import f\ndef g():\n    f()\n", "b.py": "from c import f\n", "c.py": "from b import f\nfrom a import *\n"}
    assert edges(spark, circle) == []
    assert edges(spark, {"a.py": ""}) == []
    long = {f"m{i}.py": f"from m{i + 1} import f\n" for i in range(10)} | {"m10.py": "def f(): pass\n", "use.py": "from m0 import f as g\ndef u():\n    g()\n"}
    assert edges(spark, long) == [("use.py", "u", "m10.py", "f", 3)]


def test_a_stored_graph_follows_imports(spark, tmp_path):
    from quarry.sources.store import GraphStore, build_graph

    for path, content in code.IMPORT_PROJECT.items():
        if path.endswith(".py"):
            f = tmp_path / "proj" / path
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(content)
    root, store = str(tmp_path / "proj"), GraphStore(spark, f"file://{tmp_path}/store")
    want = [(f"{root}/{a}", b, f"{root}/{c}", d, n) for a, b, c, d, n in code.IMPORT_EDGES if a.endswith(".py")]
    calls = lambda: sorted((r.src_file, r.src_name, r.dst_file, r.dst_name, r.call_line) for r in store.read()[1].where("edge_type = 'calls'").collect())
    assert build_graph(spark, store, root, language="python", resolve_scope="imports").first().total_edges == len(want)
    assert calls() == sorted(want)
    (tmp_path / "proj/pkg/__init__.py").write_text("from aaa.core import run as start\nfrom .more import *\n")
    build_graph(spark, store, root, language="python", resolve_scope="imports")
    moved = [(a, b, c.replace("pkg/core", "aaa/core"), d, n) if n == 9 and b == "main" else (a, b, c, d, n) for a, b, c, d, n in want]
    assert calls() == sorted(moved) != sorted(want)


def test_query_parses_every_file_once(spark, tmp_path):
    from quarry.plans import catalog_queries

    spark.createDataFrame([(i,) for i in range(3)], "page_id long").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog_queries.QUERIES["edge_resolution_imports"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.count() > 0 and "InPandas" not in plan and "ArrowPython" not in plan
