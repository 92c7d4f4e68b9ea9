import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, mixing, va_search
from quarry.llm.components import connected_components


def test_mix_meets_targets(docs):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "b", "c", None])) for i in range(800)]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == 800 and sorted(got) == sorted(mixing.mix(docs(rows)).collect())
    total, by = sum(r.size for r in got), defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        by[r.source][0] += r.taken
        by[r.source][1:] = [r.target, r.source_size]
    for source, w in zip(["a", "b", "c", None], [1, 2, 3, 1], strict=True):
        taken, target, size = by[source]
        assert abs(taken - target) <= 60 and target <= 3 * size + 1e-6
        assert target == pytest.approx(total * w / 7)


def test_mix_excess_is_shared_again(docs):
    rows = [(i, "w " * 100, "en", "a") for i in range(20)] + [(100 + i, "w " * 10, "en", "b") for i in range(3)] + [(200 + i, "w " * 50, "en", "c") for i in range(20)]
    got = {r.source: r for r in mixing.mix(docs(rows)).collect()}
    assert got["b"].target == 90 and got["b"].taken == 30
    assert got["a"].target == pytest.approx((3030 - 90) / 4) and got["c"].target == pytest.approx((3030 - 90) * 3 / 4)


def test_mix_odd_rows(odd):
    rows = mixing.mix(odd, carry=("lang", "n")).collect()
    assert len(rows) == 8 and {r.n for r in rows} == {"clash"}
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mix_small_buckets_give_the_same(docs, monkeypatch):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 9), "en", rng.choice("ab")) for i in range(500)]
    plain = sorted(mixing.mix(docs(rows)).collect())
    monkeypatch.setattr(mixing, "BUCKET", 4)
    assert sorted(mixing.mix(docs(rows)).collect()) == plain


def test_inclusion_follows_size(docs):
    """Sources alike but for their ids are repeated draws: documents are included as often
    as their chances say, long ones for certain, and every draw meets its target."""
    sizes = [5, 10, 20, 40, 80, 160, 320, 640] * 40
    rows = [(g * 1000 + i, "w " * s, "en", f"s{g:03d}") for g in range(30) for i, s in enumerate(sizes)]
    got = mixing.mix(docs(rows), weights=(1, 3)).collect()
    seen = defaultdict(list)
    for r in got:
        half = r.target < r.source_size
        seen[half, r.size, round(r.chance, 9)].append(r.copies - (0 if half else 1))
    total = sum(sizes)
    for half, budget in ((True, total / 2), (False, total / 2)):
        chances = {s: c for h, s, c in seen if h == half}
        assert sum(s * chances[s] for s in sizes) == pytest.approx(budget)
        assert chances[320] == pytest.approx(64 * chances[5]) and chances[5] < 0.01 < 0.5 < chances[640]
    for (_, _, chance), drawn in seen.items():
        assert abs(np.mean(drawn) - chance) < 4 * np.sqrt(chance * (1 - chance) / len(drawn)) + 0.03
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[r.source] - r.target) <= 320 for r in got)


def test_certain_documents(docs):
    rows = [(i, "w " * 10, "en", "a") for i in range(100)] + [(500, "w " * 600, "en", "a"), (600, "w " * 1600, "en", "b")]
    tight = {r.doc_id: r for r in mixing.mix(docs(rows), weights=(1, 3)).collect()}
    assert tight[500].chance == 1.0 and {round(tight[i].chance, 9) for i in range(100)} == {0.2}
    assert sum(tight[i].copies for i in range(100)) == 20


@pytest.mark.parametrize("odds_of", [0.001, 0.5, 0.999])
def test_buckets_are_even_at_any_chance(spark, odds_of, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 100)
    n = 20_000
    u = mixing.uniform(F.col("id").cast("string"), "even")
    rank = (F.col("u") / (1 - F.col("u"))) / F.lit(odds_of / (1 - odds_of))
    counts = spark.range(n).withColumn("u", u).select(mixing.bucket_of(rank, F.lit(n)).alias("b")).groupBy("b").count().collect()
    assert max(r["count"] for r in counts) < 1.5 * 100


def test_many_sources_are_numbered_in_order(spark):
    names = [None, "", "a", "B", "é", "😀", *(f"s{i}" for i in range(300))]
    df = spark.createDataFrame([(x, 1) for x in names], "source string, n int").repartition(7)
    got = sorted((r.g, r.source) for r in mixing.numbered(df, "t").collect())
    assert [s for _, s in got] == [*sorted(names[1:]), None] and [g for g, _ in got] == list(range(1, len(names) + 1))
    assert mixing.numbered(df.limit(0), "t").count() == 0


def test_carried_columns_by_either_join(odd, docs, monkeypatch):
    rows = docs([(i, "w " * (i % 7), "en", "ab"[i % 2]) for i in range(60)])
    few = sorted(map(str, mixing.mix(rows, carry=("lang", "text")).collect())), sorted(map(str, mixing.mix(odd, carry=("n",)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert few == (sorted(map(str, mixing.mix(rows, carry=("lang", "text")).collect())), sorted(map(str, mixing.mix(odd, carry=("n",)).collect())))


def brute_top(rows, k):
    ok = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 20 == 0:
            near = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "ties", "huge"])
def test_search_equals_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(va_search, "QUERIES", 7)
    rng = np.random.default_rng(3)
    make = {"normal": lambda: rng.normal(size=8), "ties": lambda: rng.integers(0, 2, 8) / 1.0, "huge": lambda: rng.normal(size=8) * 1e7}[kind]
    rows = [(i, [float(np.float32(x)) for x in make()]) for i in range(400)]
    rows += [(1000, None), (1001, [1.0, None]), (1020, [float("nan")] * 8), (1040, [float("inf")] * 8), (None, [0.0] * 8), (1060, [1.0, 2.0]), (1061, [3.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("rank", F.lit(2)).repartition(5)
    got = va_search.top_k(df, F.col("vec_id") % 20 == 0, k=6, label="t")
    assert sorted(map(tuple, got.collect())) == brute_top(rows, 6)
    assert va_search.top_k(df.limit(0), F.col("vec_id") % 20 == 0, label="t").count() == 0


def test_cells_bound_every_product():
    rng = np.random.default_rng(1)
    x, q = np.floor(64 * rng.normal(size=(1024, 32))), np.floor(64 * rng.normal(size=(20, 32)))
    edges = np.quantile(x, np.arange(1, 64) / 64, axis=0)
    for e in (edges, edges * 3, None):
        least, most = va_search.Approximation.of(x, e).bounds(q, np.abs(q))
        assert (least <= q @ x.T).all() and (q @ x.T <= most).all()
    assert (va_search.Approximation.of(x, edges).bounds(q, np.abs(q))[1] - q @ x.T).mean() < 0.2 * (np.abs(q) @ np.abs(x).T).mean()


def test_bounds_hold_under_cancellation():
    """Large components whose products cancel: the rounding of a bound isn't of its size."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        big = np.floor(rng.normal(size=(200, 16)) * 2.0**33)
        x = np.hstack([big, big + rng.integers(-9, 9, big.shape)])
        half = np.floor(rng.normal(size=(5, 16)) * 2.0**20)
        q = np.hstack([half, -half])
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q], dtype=object)
        least, most = va_search.Approximation.of(x, np.quantile(x, np.arange(1, 64) / 64, axis=0)).bounds(q, np.abs(q))
        assert all(least[i, j] <= exact[i, j] <= most[i, j] for i in range(5) for j in range(200))


def test_exact_vectors_are_read_for_few(spark, monkeypatch):
    """Reads are counted: exact vectors of candidates only, first k and then the rest."""
    read = []
    whole = va_search._read
    monkeypatch.setattr(va_search, "_read", lambda near, *rest: (read.append(near.count()), whole(near, *rest))[1])
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    rows = [(i, [float(np.float32(v)) for v in centres[i % 40] + 0.1 * rng.normal(size=16)]) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = va_search.top_k(df, F.col("vec_id") % 20 == 0, k=5, label="t")
    assert sorted(map(tuple, got.collect())) == brute_fast(rows, 5)
    assert read[0] == 200 * 5 and sum(read) < 200 * 4000 / 20


def brute_fast(rows, k):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64)
    out = []
    for q in range(0, len(rows), 20):
        s = x @ x[q]
        near = [j for j in np.lexsort((np.arange(len(rows)), -s)) if j != q][:k]
        out += [(q, r + 1, int(j), int(s[j])) for r, j in enumerate(near)]
    return sorted(out)


def test_chat_reads_back(spark):
    rng = random.Random(4)
    parts = ["\\", "<", ">", "</turn>", "<turn user>", "\\### Assistant: </turn> ok", "a", "\n", "<image 0>", "é", ""]
    rows = [(c, t, rng.choice(["user", "assistant", None, "a<b>\\"]), "".join(rng.choices(parts, k=rng.randint(0, 6))) if rng.random() < 0.9 else None) for c in range(40) for t in range(rng.randint(1, 5))] + [(None, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).withColumn("parts", chat.text_parts())
    out = {r.conv_id: r for r in chat.format_conversations(df.repartition(3)).collect()}
    assert len(out) == 41
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: r[1])]
        assert [(role, text) for role, text, _ in chat.read_back(out[c].formatted)] == want
        said = [chat.unescape(out[c].formatted[m.start : m.end]) for m in out[c].mask]
        assert said == [text for role, text in want if role == "assistant"]
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_parts_become_placeholders():
    parts = [{"kind": "text", "text": "see <1>"}, {"kind": "image", "uri": "i.png", "width": 57, "height": 28}, {"kind": "audio", "uri": "a.wav", "seconds": 1.5}, {"kind": None, "text": "end"}, {"kind": "document", "uri": "d.pdf", "pages": 2}]
    text, mask, attached = chat.render([("user", parts), ("assistant", [{"kind": "text", "text": "ok"}])], ("assistant",))
    assert text == "<turn user>see \\<1\\><image 0><audio 1>end<document 2></turn><turn assistant>ok</turn>"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in attached] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 3000)]
    assert chat.read_back(text)[0] == ("user", "see <1>end", [("image", 0), ("audio", 1), ("document", 2)])
    assert [text[a:b] for a, b in mask] == ["ok"]
    text, _, attached = chat.render([("user", [{"kind": "video", "uri": "v.mp4"}, {"kind": "visit", "uri": None}])], ())
    assert text == "<turn user><other 0><other 1></turn>"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in attached] == [("video", "v.mp4", 0), ("visit", None, 0)]
    assert chat.read_back(text) == [("user", "", [("other", 0), ("other", 1)])]


def test_conversations_that_share_a_key_stay_apart(spark, monkeypatch):
    rows = [(c, t, "user", f"{c}{t}") for c in ("x", "y", None) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumn("parts", chat.text_parts())
    monkeypatch.setattr(chat.F, "xxhash64", lambda *_: F.lit(1).cast("long"))
    out = {r.conv_id: [t for _, t, _ in chat.read_back(r.formatted)] for r in chat.format_conversations(df).collect()}
    assert out == {c: [f"{c}{t}" for t in range(3)] for c in ("x", "y", None)}


def test_components_equal_plain_union(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(5, 5)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = connected_components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert {r.node: r.component for r in got} == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
