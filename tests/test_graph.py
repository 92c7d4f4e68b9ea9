import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.operators import graph, traverse
from quarry.plans import code_fixtures as code
from quarry.sources import files
from quarry.sources.store import GraphStore, build_graph, rebuild

EDGE = "src_file string, src_name string, src_type string, src_line int, dst_file string, dst_name string, dst_type string, dst_line int, edge_type string, call_line int"


def edges_of(spark, pairs):
    return spark.createDataFrame([("f", a, "t", 1, "f", b, "t", 1, "calls", i) for i, (a, b) in enumerate(pairs)], EDGE)


def plain_bfs(pairs, root, depth):
    seen, todo, out = {root}, deque([(root, 0)]), {}
    while todo:
        at, d = todo.popleft()
        if d < depth:
            for a, b in pairs:
                if b == at and a not in seen:
                    seen.add(a)
                    out[a] = d + 1
                    todo.append((a, d + 1))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_dependents_equal_plain_search_on_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(20)}", f"n{rng.randrange(20)}") for _ in range(40)] + [("n0", "n0")]
    got = {r.caller: r.depth for r in traverse.transitive_dependents(edges_of(spark, pairs), "n0", 4).collect()}
    assert got == plain_bfs(pairs, "n0", 4)


def test_dependents_of_unknown_symbol(spark):
    assert traverse.transitive_dependents(edges_of(spark, [("a", "b")]), "zzz").count() == 0


def test_impact_needs_both_share_and_count(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(12)], "symbol_name string")
    star = edges_of(spark, [(f"n{i}", "n0") for i in range(1, 12)] + [("n1", "n0"), ("n0", "n0")])
    row = traverse.impact(nodes, star, "n0").first()
    assert (row.direct_callers, row.transitive_dependents, row.risk_level) == (13, 11, "high")
    few = traverse.impact(nodes.limit(3), edges_of(spark, [("n1", "n0"), ("n2", "n0")]), "n0").first()
    assert few.risk_level == "low" and few.impact_ratio == 0.667
    assert traverse.impact(nodes.limit(0), star, "n0").first().impact_ratio == 0.0


def test_exact_round_is_half_even_on_the_double(spark):
    values = [0.0005, 0.0015, 0.0625, 1 / 3, 0.1235]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r.x for r in traverse.exact_round(df, "x").collect()] == [round(v, 3) for v in values]


def project(spark, tmp_path, sources):
    for path, content in sources.items():
        f = tmp_path / "proj" / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(content)
    return str(tmp_path / "proj"), GraphStore(spark, f"file://{tmp_path}/store")


def test_build_scopes_cache_and_purge(spark, tmp_path):
    root, store = project(spark, tmp_path, code.PY_PROJECT | {"venv/x.py": "def hidden(): pass\n"})
    row = build_graph(spark, store, root).first()
    assert row.total_nodes == 10
    # within their own files: inner and net from label, label from fetch, Base from Cart, and Cart.total from Line.cost
    assert row.total_edges == 5
    again = build_graph(spark, store, root).first()
    assert (again.total_nodes, again.total_edges) == (10, 5)
    one = f"{root}/shop/cart.py"
    once = build_graph(spark, store, root, "file", one).first()
    assert once.total_edges == 4  # file scope adds edges again without removing them
    nodes, edges, _ = store.read()
    assert nodes.count() == 10 and edges.count() == 7
    (tmp_path / "proj/shop/prices.py").unlink()
    assert build_graph(spark, store, root).first().total_nodes == 10
    assert build_graph(spark, store, root, purge_missing=True).first().total_nodes == 6
    assert build_graph(spark, store, root, "other", "x").first().error
    assert build_graph(spark, store, root, "file").first().error
    assert "not found" in build_graph(spark, store, root, "file", f"{root}/no.py").first().error


def test_project_scope_finds_other_files(spark, tmp_path):
    root, store = project(spark, tmp_path, code.PY_PROJECT)
    build_graph(spark, store, root, resolve_scope="project")
    _, edges, _ = store.read()
    store.register_views("g_")
    assert spark.sql("SELECT count(*) FROM g_edges JOIN g_nodes ON dst_name = symbol_name").first()[0] > 0
    across = edges.where("src_file <> dst_file").collect()
    assert [(r.src_name, r.dst_name) for r in across] == [("Cart.total", "net")]


def test_rebuild_replaces_and_is_idempotent(spark, tmp_path):
    root, store = project(spark, tmp_path, code.PY_PROJECT)
    build_graph(spark, store, root)
    changed = files.inline(spark, {f"{root}/shop/cart.py": "def only():\n    only()\n"})
    rebuild(store, changed)
    first = [sorted(map(str, t.drop("updated_at").collect())) if "hash" in t.columns else sorted(map(str, t.collect())) for t in store.read()]
    rebuild(store, changed)
    assert first == [sorted(map(str, t.drop("updated_at").collect())) if "hash" in t.columns else sorted(map(str, t.collect())) for t in store.read()]
    assert store.read()[0].count() == 5
    store.invalidate([f"{root}/shop/cart.py"])
    assert store.read()[2].count() == 2
    store.clear()
    assert graph.is_empty(store.read()[0])


def test_streaming_refresh(spark, tmp_path):
    from quarry.streaming.refresh import refresh_graph, watch_files

    root, store = project(spark, tmp_path, code.PY_PROJECT)
    q = refresh_graph(watch_files(spark, f"file://{root}"), store, f"file://{tmp_path}/ck")
    q.awaitTermination(120)
    assert store.read()[0].count() == 10


def admissions(spark, folder, batches, **options):
    """The answers over a stream that takes each batch by itself."""
    from quarry.streaming.refresh import admit_requests

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "client string, at double").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("client string, at double").parquet(f"file://{folder}/in")
        q = admit_requests(stream, **options).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    return sorted((r.client or "", r.at, r.admitted, r.wait) for r in spark.read.schema("client string, at double, admitted boolean, wait double").parquet(f"{folder}/out").collect())


def test_admissions_dont_depend_on_batches(spark, tmp_path):
    from quarry.streaming.refresh import Window

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), float(t)) for t in (1, 2, 3, 62, 62.5)] + [(rng.choice(["a", "b", "c"]), round(rng.uniform(1, 300), 3)) for _ in range(120)]
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 9))  # none comes more than the delay late
    rows.append(("end", 1000.0))
    plain = []
    for client in {c for c, _ in rows if c != "end"}:
        window = Window(3, 60_000_000, [])
        for at in sorted(t for c, t in rows if c == client):
            wait = window.admit(round(at * 1e6))
            plain.append((client or "", at, not wait, wait / 1e6))
    options = {"limit": 3, "window_seconds": 60, "delay_seconds": 10}
    whole = admissions(spark, tmp_path / "one", [rows], **options)
    assert whole == sorted(plain) and not all(r[2] for r in whole)
    cut = [rows[:37], rows[37:38], rows[38:90], rows[90:]]
    assert admissions(spark, tmp_path / "many", cut, **options) == whole


def test_requests_that_come_too_late_are_left_out(spark, tmp_path):
    got = admissions(spark, tmp_path, [[("a", 1.0), ("a", 100.0)], [("a", 2.0), ("a", 200.0)], [("z", 900.0)]], limit=1, window_seconds=60, delay_seconds=5)
    assert got == [("a", 1.0, True, 0.0), ("a", 100.0, True, 0.0), ("a", 200.0, True, 0.0)]


def test_similarity_equals_plain_scorer(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcXY_") for _ in range(rng.randrange(0, 7))) for _ in range(40)]

    def score(c, q):
        c, q = c.lower(), q.lower()
        return 1.0 if c == q else 0.9 if q in c or c in q else sum(x in q for x in c) / max(len(c), len(q))

    pairs = [(a, b) for a in words for b in words[:15]]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("s", text.similarity(F.col("a"), F.col("b")))
    for r in df.collect():
        assert r.s == pytest.approx(score(r.a, r.b)), (r.a, r.b)


def test_many_wanted_names_are_found_like_few(spark):
    from quarry.operators import affected_tests
    from quarry.sources import files

    rng = random.Random(3)
    texts = {"tests/a.test.ts": "call(myHelperFn)", "tests/b.test.js": "x['odd-name']", "tests/c.test.ts": "nothing", "tests/d.test.ts": "use total$ now", "tests/e.ts": "myHelperFn", "tests/f.test.ts": ""}
    texts |= {f"tests/r{i}.test.ts": "".join(rng.choice("abé$") for _ in range(rng.randint(0, 60))) for i in range(80)}
    found = files.inline(spark, texts)
    names = ["Helper", "odd-name", "total$", "é$a", "abba", "bbb", *(f"absent{i}" for i in range(30))]
    wanted = spark.createDataFrame([(n,) for n in [*names, None, "Helper"]], "name string")
    plain = {p for p, t in texts.items() if ".test." in p and any(n in t for n in names)}
    few = {r.path for r in affected_tests.by_substring(found, wanted).collect()}
    assert few == plain and {"tests/a.test.ts", "tests/b.test.js", "tests/d.test.ts"} < few
    assert {r.path for r in affected_tests.by_substring(found, wanted, max_names=4).collect()} == few
    assert affected_tests.by_substring(found, wanted.limit(0)).count() == 0
    empty = spark.createDataFrame([("",), ("zzz",)], "name string")
    assert affected_tests.by_substring(found, empty).count() == sum(".test." in p for p in texts)


def test_paths_and_urls(spark):
    df = spark.createDataFrame([("a/b.d.ts",), ("x/.ts",), ("noext",), ("q.PY",), (None,)], "p string")
    assert [r[0] for r in df.select(text.suffix(F.col("p"))).collect()] == [".ts", "", "", ".PY", None]
    assert [r[0] for r in df.select(text.language_of_path(F.col("p"))).collect()] == ["typescript", "python", "python", "python", "python"]
    urls = spark.createDataFrame([("http://a",), ("https:///x",), ("ftp://a",), ("",), (None,), ("HTTP://b/c",)], "u string")
    assert [r[0] for r in urls.select(text.url_valid(F.col("u"))).collect()] == [True, False, False, False, False, True]


def test_description(spark):
    cases = {"---\ndescription: \"Quoted text\"\n": "Quoted text", "# Title here\nmore": "Title here", "# no line end": "", "": "", "x\n" * 30 + "description: late\n# H\n": "H", "description: " + "y" * 200 + "\n": "y" * 120}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert [r[0] for r in df.select(text.description(F.col("c"))).collect()] == list(cases.values())


def test_dependents_of_all_symbols(spark):
    rng = random.Random(4)
    pairs = {(f"s{rng.randrange(60)}", f"s{rng.randrange(60)}") for _ in range(90)} | {("loop", "loop"), *((f"c{i}", "hub") for i in range(3000))}
    columns = "src_file string, src_name string, src_type string, src_line int, dst_file string, dst_name string, dst_type string, dst_line int, edge_type string, call_line int"
    edges = spark.createDataFrame([("f", a, "function", 1, "f", b, "function", 1, "calls", 1) for a, b in pairs], columns)
    callers = {b: {a for a, c in pairs if c == b} for _, b in pairs}
    want = {}
    for symbol in callers:
        reached, level = set(), {symbol}
        for _ in range(3):
            level = {a for b in level for a in callers.get(b, ())}
            reached |= level
        want[symbol] = len(reached - {symbol})
    assert {r.symbol: r.dependents for r in traverse.dependents_of_all(edges).collect()} == want
    near = {r.symbol: r.dependents for r in traverse.estimated_dependents(edges).collect()}
    assert near.keys() == want.keys() and all(abs(near[s] - n) <= max(1, 0.05 * n) for s, n in want.items())
    assert traverse.estimated_dependents(edges.limit(0)).count() == 0


def test_search_ends_where_nothing_calls(spark, monkeypatch):
    columns = "src_file string, src_name string, src_type string, src_line int, dst_file string, dst_name string, dst_type string, dst_line int, edge_type string, call_line int"
    rows = [("f", f"s{i}", "function", i, "f", f"s{i // 2}", "function", 1, "calls", None if i == 5 and k else 9 - k) for i in range(1, 16) for k in range(2)]
    rows += [("e", "s9", "class", 3, "f", "s4", "function", 1, "calls", 7), ("f", "s1", "function", 1, "f", "s15", "function", 1, "calls", 2)]
    edges, staged = spark.createDataFrame(rows, columns), []
    keep = traverse.stage
    monkeypatch.setattr(traverse, "stage", lambda df, label: staged.append(label) or keep(df, label))
    monkeypatch.setattr(traverse, "BROADCAST_NAMES", 0)
    found = {r.caller: (r.depth, r.caller_file, r.caller_line, r.call_line) for r in traverse.transitive_dependents(edges, "s2", 9).collect()}
    line = {5: None, 9: 7}
    assert found == {f"s{i}": (d, "e" if i == 9 else "f", 3 if i == 9 else i, line.get(i, 8)) for d, of in ((1, (4, 5)), (2, (8, 9, 10, 11))) for i in of}
    assert [x for x in staged if x.startswith("level")] == ["level1", "level2"]


def test_dependents_of_all_by_called_callers(spark):
    rng = random.Random(8)
    pairs = {(f"s{rng.randrange(40)}", f"s{rng.randrange(40)}") for _ in range(70)} | {(f"leaf{i}", f"s{i % 7}") for i in range(200)} | {(f"leaf{i}", f"end{i % 9}") for i in range(200)} | {("x", "x")}
    columns = "src_file string, src_name string, src_type string, src_line int, dst_file string, dst_name string, dst_type string, dst_line int, edge_type string, call_line int"
    edges = spark.createDataFrame([("f", a, "function", 1, "f", b, "function", 1, "calls", 1) for a, b in pairs], columns)
    callers = {b: {a for a, c in pairs if c == b} for _, b in pairs}
    links = traverse.distinct_links(edges)
    assert {(r.caller, r.symbol) for r in links[1].collect()} == {(a, b) for a, b in pairs if a in callers}
    for depth in (1, 2, 4):
        want = {}
        for symbol in callers:
            reached, level = set(), {symbol}
            for _ in range(depth):
                level = {a for b in level for a in callers.get(b, ())}
                reached |= level
            want[symbol] = reached
        assert {r.symbol: r.dependents for r in traverse.dependents_of_all(edges, depth, links=links).collect()} == {s: len(x - {s}) for s, x in want.items()}
        near = {r.symbol: r.dependents for r in traverse.estimated_dependents(edges, depth, links=links).collect()}
        assert near.keys() == want.keys() and all(abs(near[s] - len(x)) <= max(1, 0.05 * len(x)) for s, x in want.items())


def test_pages_far_on_are_read_by_ranges(spark, monkeypatch):
    from quarry.operators import catalog

    rng = random.Random(6)
    rows = [(f"n{rng.randrange(400)}", rng.choice([None, 1, 2]), i) for i in range(900)]
    items = spark.createDataFrame(rows, "name string, rank int, ordinal long").withColumn("place", F.struct("rank", "ordinal")).repartition(5)
    for bound, value in (("TOP", 20), ("SAMPLE", 300), ("RANGES", 8)):
        monkeypatch.setattr(catalog, bound, value)
    for order, key in ((["name", "ordinal"], lambda r: (r[0], r[2])), (["place"], lambda r: (r[1] is not None, r[1] or 0, r[2]))):
        ordered = sorted(rows, key=key)
        for offset in (0, 15, 100, 437, 880, 899, 5000):
            got = catalog.page(items, order, 30, offset).collect()
            assert sorted((r.name, r.ordinal) for r in got) == sorted((r[0], r[2]) for r in ordered[offset : offset + 30]), (order, offset)
            assert all(r.total == 900 and r.more == (offset + 30 < 900) for r in got)
    bounds, counts = catalog._ranges(items, ["name", "ordinal"])
    assert len(bounds) >= 7 and sum(counts) == 900 and max(counts) < 300
    same = items.withColumn("name", F.lit("x")).withColumn("ordinal", F.lit(1).cast("long"))
    assert len(catalog.page(same, ["name", "ordinal"], 30, 500).collect()) == 30 and catalog.page(items.limit(0), ["name"], 30, 500).count() == 0
