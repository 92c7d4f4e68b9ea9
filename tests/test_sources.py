import ast
import hashlib

import pytest

from quarry.errors import NetworkError, QuarryError, RetryExhaustedError, SkillNotFoundError
from quarry.plans import code_fixtures as code
from quarry.sources import declarations, python_code, skills, ts_code


@pytest.mark.parametrize("source", ["class {", "function (", "`${", "a(((", ")))", "interface X {", "type A = {", "const f = (", "import {", "<", "@a(", "", "/re(", "'open", "enum E {", "=> => =>", "async", "a?.(b)"])
def test_scanner_never_fails(source):
    ts_code.graph_rows(source)


def test_scanner_details():
    rows = ts_code.graph_rows("function f() { if (a) { b(); } new C(d()); e<T>(1); g()(2); return `x${h(1)}` + /k(/.test(y) }\n")
    assert [r[2] for r in rows if r[0] == "edge"] == ["b", "d", "e", "g", "g", "h", "/k(/.test"]
    heritage = ts_code.graph_rows("class A extends B<C> implements D, E {}\ninterface I extends J {}\n", heritage=True)
    assert [r[1:4] for r in heritage if r[0] == "edge"] == [("A", "B<C>", "extends"), ("A", "D", "implements"), ("A", "E", "implements"), ("I", "J", "extends")]
    assert not [r for r in ts_code.graph_rows("class A extends B {}") if r[0] == "edge"]


def test_expression_arrow_body_call_does_not_count():
    rows = ts_code.graph_rows("const f = (a) => g(h(a));\n")
    assert [r[2] for r in rows if r[0] == "edge"] == ["h"]


def test_python_rows_of_odd_sources():
    assert not list(python_code.graph_rows("def x(:"))
    assert not list(python_code.graph_rows("a\x00b"))
    assert python_code.syntax_issues("x = (")[0]["severity"] == "error"
    assert [i["code"] for i in python_code.lint_issues("import os\ntry:\n    pass\nexcept:\n    x == None\n")] == ["F401", "E722", "E711"]


def test_declarations_in_comments_count():
    assert [s[0] for s in declarations.symbols("// class Ghost\n")] == ["Ghost"]


class Fake:
    def __init__(self, pages):
        self.pages = pages

    def get(self, url):
        if url not in self.pages:
            raise NetworkError("404", status_code=404)
        return self.pages[url]

    def get_bytes(self, url):
        return self.get(url).encode()


SOURCE = skills.SkillSource("main", "https://github.com/o/r")
PAGES = {
    "https://api.github.com/repos/o/r/contents/skills": code.LISTINGS[0][1],
    "https://api.github.com/repos/o/r/contents/skills/code-review": '[{"name":"SKILL.md","type":"file","size":30,"download_url":"d1"},{"name":"sub","type":"dir"},{"name":"lost","type":"file","download_url":"gone","size":1}]',
    "https://api.github.com/repos/o/r/contents/skills/code-review/sub": '[{"name":"a.txt","type":"file","download_url":"d2"}]',
    "https://raw.githubusercontent.com/o/r/main/skills/code-review/SKILL.md": "description: Reviews code\n",
    "d1": "description: Reviews code\n",
    "d2": "x",
}


def test_download_and_guard(tmp_path):
    got = skills.download("code-review", [SOURCE], tmp_path, Fake(PAGES))
    assert got["file_count"] == 1 and skills.tree(tmp_path, "code-review") == ["SKILL.md", "sub/a.txt"]
    assert skills.read_main(tmp_path, "code-review").startswith("description")
    (tmp_path / "code-review-evil").mkdir()
    with pytest.raises(ValueError):
        skills.read_file(tmp_path, "code-review", "../code-review-evil/x")
    with pytest.raises(SkillNotFoundError):
        skills.download("none", [SOURCE], tmp_path, Fake({}))


def test_retry_limits_and_config(tmp_path):
    calls, waits = [], []

    @skills.with_retry(2, 0.5, jitter=False, sleep=waits.append)
    def fails():
        calls.append(1)
        raise NetworkError("x")

    with pytest.raises(RetryExhaustedError):
        fails()
    assert len(calls) == 3 and waits == [0.5, 1.0]
    now = [0.0]
    limiter = skills.RateLimiter(2, 60, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(3):
        limiter.acquire()
    assert now[0] == 60.0
    assert skills.Config.load(tmp_path / "none").http.max_retries == 3
    (tmp_path / "c.json").write_text('{"http": {"max_retries": 9}, "skills": {"sources": [{"name": "a", "url": "u"}]}}')
    loaded = skills.Config.load(tmp_path / "c.json")
    assert (loaded.http.max_retries, loaded.http.timeout_seconds, loaded.sources[0].branch) == (9, 15.0, "main")


def test_tools(spark, tmp_path):
    from quarry.api import Tools

    for path, content in (code.PY_PROJECT | {"tests/test_cart.py": "def test():\n    assert Cart().total(1)\n"}).items():
        f = tmp_path / "proj" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    tools = Tools(spark, str(tmp_path / "proj"), f"file://{tmp_path}/store", str(tmp_path / "skills"), skills.Config([SOURCE]), Fake(PAGES))
    with pytest.raises(QuarryError):
        tools.find_callers("net")
    assert "Total nodes (functions/classes): 11" in tools.analyze_codebase_graph()
    assert "Total callers: 1" in tools.find_callers("net")
    said = tools.analyze_impact("Cart.total", max_depth=2)
    assert "Risk level: LOW" in said and "test_cart.py" in said and "Line.cost (depth 1)" in said
    with pytest.raises(QuarryError):
        tools.analyze_impact("x", max_depth=9)
    assert "Status: FOUND" in tools.verify_api("numpy", "zeros")
    assert "fetch" in tools.verify_api("shop", "fetc")
    assert "[available]" in tools.list_skill_catalog(query="code")
    assert "Reviews code" in tools.get_skill_detail("code-review")
    assert "Files downloaded: 1" in tools.download_skill("code-review")
    assert "Reviews code" in tools.list_installed_skills()
    assert "[INSTALLED]" in tools.list_skill_catalog(query="code")
    assert "Can write: False" in tools.sandbox_validate("def f(:", "a.py")
    assert "Status: PASS" in tools.sandbox_validate("import os\n")
    assert "Can write: False" in tools.sandbox_validate("let x", "a.ts", tool_outputs={"types:tsc": code.TSC_OUTPUT})


def test_declaration_search_and_its_compat_mode(spark, tmp_path):
    from quarry.sources import files

    (tmp_path / "types").mkdir()
    (tmp_path / "types/api.d.ts").write_text(code.DTS_FILE["types/api.d.ts"])
    assert files.symbols(files.scan_symbols(spark, str(tmp_path), "typescript")).count() == 7
    assert files.scan_symbols(spark, str(tmp_path), "typescript", compat=True).count() == 0
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path), "cobol")


def test_deep_nesting_is_a_syntax_issue_or_no_rows():
    assert python_code.syntax_issues("-" * 200_000 + "1")[0]["code"] == "SyntaxError"
    assert not list(python_code.graph_rows("-" * 200_000 + "1")) and python_code.import_issues("-" * 200_000 + "1")[0]["code"] == "SKIP"
    name = ".".join(["a"] * 3000)
    assert [r[2] for r in python_code.graph_rows(f"def f():\n    {name}()\n") if r[0] == "edge"] == [name]
    assert python_code.dotted(ast.parse("a.b[c.d][1].e", mode="eval").body) == "a.b[c.d][1].e"
    nested = "`${" * 3000 + "f()" + "}`" * 3000
    assert [r[2] for r in ts_code.graph_rows(f"function g() {{ {nested} }}") if r[0] == "edge"] == ["f"]
    assert list(ts_code.graph_rows("`${" * 3000)) == [] and list(ts_code.graph_rows("`\\")) == []


def test_templates_inside_templates():
    toks = [t.text for t in ts_code.tokenize("a`x${b({c: `${d()}`})}y` }")]
    assert toks == ["a", "`x${b({c: `${d()}`})}y`", "(", "b", "(", "{", "c", ":", "`${d()}`", "(", "d", "(", ")", ")", "}", ")", ")", "}"]


def test_files_that_are_not_utf8_are_read(spark, tmp_path):
    from quarry.sources import files

    (tmp_path / "latin.py").write_bytes("def caf\xe9(): pass\nx = '\xe9'\n".encode("latin-1"))
    (tmp_path / "good.py").write_text("def good(): pass\n")
    rows = {r.file_path.rpartition("/")[2]: r for r in files.scan(spark, str(tmp_path)).collect()}
    assert "\ufffd" in rows["latin.py"].content and rows["latin.py"].sha256 == hashlib.sha256((tmp_path / "latin.py").read_bytes()).hexdigest()
    assert [r.symbol_name for r in files.nodes_of(files.extract(files.scan(spark, str(tmp_path)))).collect()] == ["good"]
    assert "good" in {r.name for r in files.symbols(files.scan_symbols(spark, str(tmp_path))).collect()}


def test_checks_without_a_result_are_skipped_not_passed(spark, tmp_path):
    from quarry.api import Tools

    tools = Tools(spark, str(tmp_path), f"file://{tmp_path}/store")
    said = tools.sandbox_validate("function ( { !!! ", language="typescript")
    assert "Status: WARN" in said and "0 error(s), 3 warning(s)" in said and "[SKIP] tsc not available, skipping syntax check" in said and "eslint not available, skipping lint check" in said
    types = tools.sandbox_validate("x = 1\n", "a.py", checks=("syntax", "types"), python_version="3.12", dependencies=("os",), ts_config={})
    assert "[PASS] syntax" in types and "[SKIP] mypy not available, skipping type check" in types
    assert "[SKIP]" not in tools.sandbox_validate("x = 1\n", "a.py", checks=("syntax", "types"), tool_outputs={"types:mypy": ""})
    assert "no imports check for typescript" in tools.sandbox_validate("let x", "a.ts", checks=("imports",))


def test_trees_are_pruned_and_whole(spark, tmp_path, monkeypatch):
    from quarry.sources import files, tree

    for path in ("pkg/__init__.py", "pkg/_private.py", "pkg/.hidden.py", "a.py", "node_modules/x/deep.py", "pkg/venv/y.py", "b.txt"):
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("def f(): pass\n")
    (tmp_path / "pkg/lost.py").symlink_to(tmp_path / "nowhere.py")
    (tmp_path / "big.py").write_bytes(b"\xff" * 10)
    opened = []

    class Watched(tree.fs.LocalFileSystem):
        def get_file_info(self, what):
            opened.append(getattr(what, "base_dir", what))
            return super().get_file_info(what)

    found = [x.path[len(str(tmp_path)) + 1 :] for x in tree.walk(Watched(), str(tmp_path), frozenset(files.GRAPH_EXCLUDED))]
    assert not [p for p in opened if "node_modules" in p or "venv" in p] and len(opened) == 3
    assert sorted(p for p in found if p.endswith(".py")) == ["a.py", "big.py", "pkg/.hidden.py", "pkg/__init__.py", "pkg/_private.py"]
    monkeypatch.setattr(tree, "PARTITION_FILES", 2)
    rows = {r.file_path[len(str(tmp_path)) + 1 :]: r for r in files.scan(spark, f"file://{tmp_path}").collect()}
    assert sorted(rows) == ["a.py", "big.py", "pkg/.hidden.py", "pkg/__init__.py", "pkg/_private.py"] and all(r.error is None for r in rows.values())
    assert rows["big.py"].content == "\ufffd" * 10 and rows["a.py"].size == 14
    assert [r.file_path for r in files.scan(spark, f"{tmp_path}/a.py").collect()] == [f"{tmp_path}/a.py"]
    assert files.listed(spark, str(tmp_path), ["*.none"]).count() == 0
    with pytest.raises(FileNotFoundError):
        files.scan(spark, f"{tmp_path}/none")


def test_a_file_that_cannot_be_read_is_an_error_row(tmp_path):
    from quarry.sources import tree

    (tmp_path / "a.py").write_text("x = 1\n")
    reader = tree.TreeReader({"root": str(tmp_path), "patterns": '["*.py"]'})
    parts = reader.partitions()
    parts[0].files.append((f"{tmp_path}/gone.py", 3))
    good, bad = [r for part in parts for batch in reader.read(part) for r in batch.to_pylist()]
    assert good["content"] == "x = 1\n" and good["error"] is None
    assert bad["content"] is None and "FileNotFoundError" in bad["error"] and bad["file_path"].endswith("gone.py")
