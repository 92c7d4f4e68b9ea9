import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quarry.llm import token_alignment as al


@pytest.fixture(scope="module")
def files():
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        return al.Vocabularies(a.read(), b.read())


@pytest.fixture(scope="module")
def coders(files):
    return al.Coders(files)


def plain(texts, coders):
    """The rows by the definition: ranges of tokens held against each other one by one."""
    linked, out = [], []
    for text in texts:
        a = coders.a.encode(" " + text, add_special_tokens=False).ids if text else []
        b = coders.b.encode(text) if text else []
        said = [b"".join(t[i] for i in ids) for t, ids in ((coders.bytes_a, a), (coders.bytes_b, b))]
        if not text or set(said) != {(" " + text).encode()}:
            a, b = [], []
        spans = []
        for ids, table in ((a, coders.bytes_a), (b, coders.bytes_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(table[i]), i))
                at += len(table[i])
            spans.append(own)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(s[2]) for s in side if start < s[1] <= end) for side in spans))
            start = end
        linked.append(links)
        out.append([len(a), len(b), len(ends), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""])
    counts = Counter(x for links in linked for x in links)
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    rows = [(*row[:4], sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), row[4]) for row, links in zip(out, linked, strict=True)]
    return rows, counts, best


TEXTS = [
    "Hello world, this is a test.", "naïve café déjà vu", "日本語 😀 text\twith\ntabs  and   spaces ", "<s> <|endoftext|> <unk> <0x41>", "", None, "a ▁ b", " leading", "Hello world, this is a test.",
    "x" * 300, "\r\n\r\n  12345 67890 ½ don't we'll", "\x00\x1f control", "ﬁ e\u0301",
]


def test_rows_equal_the_definition(docs, files, coders):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab Zé,.1\n日") for _ in range(rng.randint(1, 80))) for _ in range(60)]
    got = {r.doc_id: tuple(r)[1:] for r in al.align(docs(list(enumerate(texts))).repartition(3), files).collect()}
    want, counts, best = plain(texts, coders)
    assert [got[i] for i in range(len(texts))] == want
    assert got[6] == (0, 0, 0, 0, 0, 0, "")
    pairs = {(r.a_id, r.b_id): (r["count"], r.is_best) for r in al.pair_counts(docs(list(enumerate(texts))), files).collect()}
    assert pairs == {x: (n, n == best[x[1]]) for x, n in counts.items()}


def test_small_bounds_give_the_same(docs, files, monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["the", "alignment", "été", "of", "12", "über"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    table = docs(list(enumerate(texts))).repartition(2)
    want = sorted(al.align(table, files).collect())
    for name, value in (("SLICE", 200), ("MOST_PAIRS", 50), ("PARTIALS", 1), ("SCORED", 1)):
        monkeypatch.setattr(al, name, value)
    assert sorted(al.align(table, files).collect()) == want


def test_chunks_give_what_whole_texts_give(coders, monkeypatch):
    rng = random.Random(7)
    words = ["the", "aligned", "été", "a,b", "", "12", "it's", "日本", "'s", "(x)", "\n", "\t1", "½", "_", "▁", "😀", "e\u0301", "\x1f", "\u00a0", "--", "don't", "<s>"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 400))) for _ in range(60)] + [t for t in TEXTS if t]
    for name, bound in (("PART", al.PART), ("PART", 40), ("KEPT_CHARS", 0)):
        monkeypatch.setattr(al, name, bound)
        got = coders.encode(texts)
        for i, text in enumerate(texts):
            a, b = got.of(i)
            assert not got.exact[i] or coders.covers(text, a, b)
            assert a.tolist() == coders.a.encode(" " + text, add_special_tokens=False).ids
            assert b.tolist() == coders.b.encode(text)
    assert sum(map(len, map(coders.chunks_of, texts))) > 3000
    monkeypatch.setattr(coders, "apart", False)
    assert coders.chunks_of("a b c") == ["a b c"]


def test_packing():
    for x in ([], [0], [1, 2, 1 << 40], list(range(1000))):
        assert al.unpack(al.pack(np.array(x, np.int64))).tolist() == x


def test_odd_rows(odd, files):
    rows = al.align(odd, files).collect()
    assert len(rows) == 8 and sum(r.n_a == 0 for r in rows) == 2
    twice = [tuple(r) for r in rows if r.doc_id == 4]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert al.align(odd.limit(0), files).count() == 0 and al.pair_counts(odd.limit(0), files).count() == 0
    renamed = odd.drop("k").withColumn("k", F.col("doc_id").cast("string"))
    assert al.align(renamed, files, id_col="k").columns[0] == "k"


def test_a_text_of_megabytes(docs, files):
    row = al.align(docs([(1, "one two three, four. " * 150_000)]), files).collect()[0]
    assert row.n_a == row.n_b > 600_000 and row.n_links >= row.n_groups > 0 and row.count_sum > row.n_links
