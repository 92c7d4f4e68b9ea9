import random

import pytest

from quarry.api import Tools
from quarry.errors import NetworkError, RetryExhaustedError
from quarry.functions.memo import Memo
from quarry.operators import near_names, symbols
from quarry.sources import search
from quarry.sources.store import GraphStore, build_graph

PYTHON = {
    "venv/lib/site-packages/pkg/inside.py": "def installed(): pass\n",
    "third/site-packages/pkg/core.py": "def installed(a): pass\ndef both(): pass\n",
    "third/site-packages/other/core.py": "def foreign(): pass\n",
    "src/pkg/own.py": "def both(x): pass\ndef own(): pass\n",
    "tool.py": "def own(y): pass\ndef ownership(): pass\n",
}
TYPESCRIPT = {"types/api.d.ts": "export declare function fetchAll(n: number): void;\n", "node_modules/lib/index.d.ts": "export declare function hidden(): void;\n", "a.ts": "class A extends B {}\nclass B {}\n", "b.ts": ""}


def tools(spark, tmp_path, sources, **options):
    for path, content in sources.items():
        f = tmp_path / "proj" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    return Tools(spark, str(tmp_path / "proj"), f"file://{tmp_path}/store", **options)


def test_directories_in_order(spark, tmp_path):
    t = tools(spark, tmp_path, PYTHON)
    named = [str(p.relative_to(t.root)) for p in search.directories(t.root, "pkg", "python")]
    assert named == ["third/site-packages/pkg", "venv/lib/site-packages/pkg", "src", "."]
    assert search.interpreter_directories() and search.directories(t.root, "none", "typescript") == [search.Path(t.root)]


def test_first_directory_answers(spark, tmp_path):
    t = tools(spark, tmp_path, PYTHON)
    assert "core.py" in t.verify_api("pkg", "installed") and "Import: from core import installed" in t.verify_api("pkg", "installed")
    assert "def both()" in t.verify_api("pkg", "both")
    own = t.verify_api("pkg", "own")
    assert "own.py" in own and "from pkg.own import own" in own
    assert "DOES_NOT_EXIST" in t.verify_api("pkg", "owner") and "own (function) - def own()" in t.verify_api("pkg", "owner")
    assert len(t.answers) == 4 and "pkg:own::" in t.answers
    t.answers.clear()
    assert "FOUND" in t.verify_api("other", "foreign")


def test_language_is_detected_and_packages_imported(spark, tmp_path):
    t = tools(spark, tmp_path, TYPESCRIPT)
    assert t.detect_language("react") == "typescript"
    said = t.verify_api("lib", "fetchAll")
    assert "Status: FOUND" in said and "import { fetchAll } from 'lib'" in said
    assert "Import" not in t.verify_api("absent", "fetchAll") and "DOES_NOT_EXIST" in t.verify_api("lib", "hidden")


def test_requests_with_two_urls_are_two(spark):
    table = spark.createDataFrame([("f", "function", "a.py", 1, "def f()", "", "", 0, 0, "a.py")], "name string, symbol_type string, file_path string, line_number int, signature string, docstring string, parent string, ordinal int, dir_rank int, relative_path string")
    asked = spark.createDataFrame([("x", "f", "python", "https://a.b"), ("x", "f", "python", "https://c.d"), ("x", "f", "python", "https://c.d"), ("x", "g", "python", None)], "library string, symbol string, language string, doc_url string")
    got = symbols.verify(asked, table, symbols.known_symbols(spark)).collect()
    assert sorted((r.symbol, r.doc_url or "") for r in got) == [("f", "https://a.b"), ("f", "https://c.d"), ("g", "")]


def near_tables(spark, n=400):
    rng = random.Random(8)
    words = ["get", "Set", "user", "Total", "price", "_", "list", "é", "of", "data", "9"]
    name = lambda: "".join(rng.choice(words) for _ in range(rng.randint(0, 4)))
    rows = [(name(), "function", f"def f{i}()", i % 3, rng.choice("abc") + ".py", i) for i in range(n)] + [(None, "function", "", 0, "a.py", n)]
    return rows, [name() + rng.choice(["", "x", "q"]) for _ in range(60)] + [None, "", "total", "TOTAL"]


def plain_nearest(rows, asked, threshold=0.7, top=5):
    out = []
    for q in {x for x in asked if x is not None}:
        found = []
        for name, kind, signature, rank, path, ordinal in rows:
            if name is not None and (s := near_names.score(name.lower(), q.lower(), frozenset(q.lower()))) >= threshold:
                found.append((rank, -s, path, ordinal, name))
        out += [(q, *row) for row in sorted(found)[:top]]
    return sorted(out)


@pytest.mark.parametrize("few", [True, False])
def test_nearest_names_equal_all_pairs(spark, monkeypatch, few):
    if not few:
        for bound, value in (("BROADCAST_ASKED", 3), ("BLOCK", 7), ("SHARE", 50), ("TILE", 16)):
            monkeypatch.setattr(near_names, bound, value)
    rows, asked = near_tables(spark)
    table = spark.createDataFrame(rows, "name string, symbol_type string, signature string, dir_rank int, file_path string, ordinal int").repartition(3)
    found = near_names.nearest(table, spark.createDataFrame([(q,) for q in asked], "symbol string")).collect()
    assert sorted((r.symbol, r.dir_rank, -r.score, r.file_path, r.ordinal, r.name) for r in found) == plain_nearest(rows, asked)
    assert near_names.nearest(table.limit(0), spark.createDataFrame([("a",)], "symbol string")).count() == 0
    assert near_names.nearest(table, spark.createDataFrame([], "symbol string")).count() == 0


def test_few_pairs_are_scored():
    rng = random.Random(9)
    name = lambda: "_".join("".join(rng.choice("etaoinsrhldcumfpgwybvk") for _ in range(rng.randint(3, 8))) for _ in range(rng.randint(1, 3)))
    rows = [(name(), i % 2, "a.py", i, None, None, None) for i in range(4000)]
    asked = [r[0][:-1] + rng.choice("zjq") for r in rng.sample(rows, 100)]
    scored = []

    def counting(*pair):
        scored.append(pair)
        return near_names.score(*pair)

    best = near_names.Best(asked, 0.7, 5, counting)
    best.meet(sorted(rows, key=lambda r: r[1]))
    want = [sorted((r[1], -s, *r[2:4]) for r in rows if (s := near_names.score(r[0], q, frozenset(q))) >= 0.7)[:5] for q in asked]
    assert [[row[:4] for row in own] for own in best.rows] == want
    assert len(scored) < len(rows) * len(asked) / 10


def test_heritage_reaches_the_graph(spark, tmp_path):
    t = tools(spark, tmp_path, TYPESCRIPT, heritage=True)
    t.analyze_codebase_graph(language="typescript")
    edges = t.store.read()[1].collect()
    assert [(r.src_name, r.dst_name, r.edge_type) for r in edges] == [("A", "B", "extends")]


def sizes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*.parquet")), sum(1 for f in folder.rglob("*.parquet"))


def rows(store, scope=None):
    return [sorted(map(str, t.drop("updated_at").collect())) for t in store.read(scope)]


def test_a_batch_writes_its_own_files_only(spark, tmp_path):
    sources = {f"m{i}.py": f"def f{i}():\n    return g{i}()\n\ndef g{i}():\n    return f{(i + 1) % 60}()\n" for i in range(60)}
    t = tools(spark, tmp_path, sources)
    store = GraphStore(spark, t.store_root)
    build_graph(spark, store, t.root, resolve_scope="project")
    whole = {name: sizes(tmp_path / "store" / name) for name in ("nodes", "edges", "raw")}
    first = rows(store)
    for i in range(10):
        (tmp_path / f"proj/m{i}.py").write_text(f"def f{i}():\n    return new{i}()\n\ndef new{i}(): pass\n")
    build_graph(spark, store, t.root, resolve_scope="project")
    last = store.version()
    for name in whole:
        touched = spark.read.parquet(f"{t.store_root}/{name}/run={last}")
        key = "src_file" if name == "edges" else "file_path"
        assert touched.select(key).distinct().count() == 10 and sizes(tmp_path / "store" / name / f"run={last}")[0] < whole[name][0]
    fresh = GraphStore(spark, f"{t.store_root}2")
    build_graph(spark, fresh, t.root, resolve_scope="project")
    assert rows(store) == rows(fresh) != first and rows(store, "file") == rows(fresh, "file")


def test_two_writers_at_once_both_count(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from quarry.sources import files

    store = GraphStore(spark, f"file://{tmp_path}/store")
    sources = [files.inline(spark, {f"{w}.py": f"def of_{w}(): pass\n", "both.py": f"def both_{w}(): pass\n"}) for w in "abcd"]
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(store.put, sources))
    names = {r.symbol_name for r in store.read()[0].collect()}
    assert {f"of_{w}" for w in "abcd"} < names and len(names) == 5 and len(store.runs()) == 4
    assert store.read()[2].count() == 5


def test_compaction_keeps_what_is_read(spark, tmp_path, monkeypatch):
    from quarry.sources import files

    store = GraphStore(spark, f"file://{tmp_path}/store")
    for i in range(4):
        store.put(files.inline(spark, {f"{i}.py": f"def f{i}(): pass\n", "same.py": f"def s{i}(): s{i}()\n"}))
    store.put(files.inline(spark, {"same.py": "def s3(): s3()\ndef more(): pass\n"}), remove_first=False)
    store.invalidate(["0.py"])
    store.remove(spark.createDataFrame([("1.py",)], "file_path string"))
    before = rows(store)
    assert len(before[0]) == 5 and len(before[1]) == 2 and len(before[2]) == 3
    reader = store.read()
    late = files.inline(spark, {"2.py": "def newer(): pass\n"})
    meant = store._live

    def overtaken(marks):  # a file is put after the compaction has read
        monkeypatch.setattr(store, "_live", meant)
        found = meant(marks)
        store.put(late)
        return found

    monkeypatch.setattr(store, "_live", overtaken)
    store.compact()
    assert [x for x in rows(store)[0] if "2.py" in x] == [x.replace("symbol_name='f2'", "symbol_name='newer'").replace("f2()", "newer()") for x in before[0] if "2.py" in x]
    assert reader[0].count() == 5
    assert store.vacuum() == [] and len(store.vacuum(0)) >= 4
    assert len(store.runs("nodes")) == 2 and len(rows(store)[0]) == 5 and rows(store)[1] == before[1]
    assert sorted(r.file_path for r in store.read()[2].collect()) == ["2.py", "3.py", "same.py"]
    store.clear()
    assert rows(store) == [[], [], []]
    store.put(late)
    assert len(rows(store)[0]) == 1


def test_a_run_that_died_is_not_read(spark, tmp_path, monkeypatch):
    from quarry.sources import files

    store = GraphStore(spark, f"file://{tmp_path}/store")
    store.put(files.inline(spark, {"a.py": "def a(): pass\n"}))
    before = rows(store)
    whole = GraphStore._write
    monkeypatch.setattr(GraphStore, "_write", lambda self, run, **tables: whole(self, run, **{k: v for k, v in tables.items() if k != "manifest"}))
    store.put(files.inline(spark, {"a.py": "def other(): pass\n", "b.py": "def b(): pass\n"}))
    monkeypatch.undo()
    assert rows(store) == before and len(store.runs("nodes")) == 2 and len(store.vacuum(0)) == 1


def test_a_repeated_batch_is_written_once(spark, tmp_path):
    from quarry.sources import files
    from quarry.sources.store import rebuild, stale_only

    store = GraphStore(spark, f"file://{tmp_path}/store")
    batch = files.inline(spark, {"a.py": "def a(): a()\n", "b.py": "def b(): pass\n"})
    for _ in range(2):
        rebuild(store, stale_only(store, batch))
    assert len(store.runs()) == 1 and len(rows(store)[1]) == 1


def test_answers_follow_the_files(spark, tmp_path):
    t = tools(spark, tmp_path, {"a.py": "def first(): pass\n", "gen/b.py": "def made(): pass\n"}, exclude=("gen",), known={"lib": "special"}, high_risk=(0.0, 0))
    assert "Total nodes (functions/classes): 1" in t.analyze_codebase_graph()
    assert "Risk level: LOW" in t.analyze_impact("first")
    assert "FOUND" in t.verify_api("lib", "special") and "DOES_NOT_EXIST" in t.verify_api("lib", "later")
    (tmp_path / "proj/a.py").write_text("def later(): pass\ndef use():\n    later()\n")
    assert "Total nodes (functions/classes): 2" in t.analyze_codebase_graph()
    assert "Status: FOUND" in t.verify_api("lib", "later") and "Risk level: HIGH" in t.analyze_impact("later")


def test_memo_keeps_the_last():
    m = Memo(2)
    m.put("a", 1), m.put("b", 2), m.get("a"), m.put("c", 3)
    assert "b" not in m and m.get("a") == 1 and len(m) == 2
    m.invalidate("a")
    assert m.get("a", 0) == 0


def test_retries_end_in_a_network_error():
    last = NetworkError("x", status_code=503)
    e = RetryExhaustedError.after(3, last)
    assert isinstance(e, NetworkError) and e.recoverable and e.status_code == 503
    with pytest.raises(NetworkError):
        raise e
