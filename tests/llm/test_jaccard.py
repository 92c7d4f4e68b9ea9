import random
import re

import pytest

from quarry.llm import jaccard_join
from quarry.llm.jaccard_join import jaccard_components


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) and part[i] != part[j]:
                a, b = part[i], part[j]
                part = [a if p == b else p for p in part]
    least = {}
    for (k, _), p in zip(rows, part, strict=True):
        least[p] = min(k, least.get(p, k))
    return sorted((k, len(s), least[p]) for (k, _), s, p in zip(rows, sets, part, strict=True))


def corpus(seed, n=90):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(400)] + ["The", "the", "OF", "of"] * 40
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.6:
            t = rng.choice(texts).split()
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                t[rng.randrange(len(t))] = rng.choice(words)
            t = t[: len(t) - rng.choice([0, 0, 1, 4])] or t
        else:
            t = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 6, 30, 60, 120, 200]))]
        texts.append(" ".join(t))
        rows.append((i * 3 + 1, rng.choice([" ", "\n", "\t"]).join(t)))
    return rows


@pytest.mark.parametrize("seed,width,percent,block", [(0, 4, 85, 4096), (1, 5, 80, 4096), (2, 4, 85, 4), (3, 3, 60, 3)])
def test_equals_brute_force(docs, seed, width, percent, block):
    rows = corpus(seed)
    got = jaccard_components(docs(rows), width=width, percent=percent, label="t", block=block)
    assert sorted(map(tuple, got.collect())) == brute(rows, width, percent)


def test_large_group_in_small_blocks(docs):
    """A chain of near copies, cut into many blocks, stays one component."""
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(40):
        t = list(base)
        t[i * 3] = "x%d" % i
        rows.append((i, " ".join(t)))
        base = t if i % 4 == 0 else base
    got = jaccard_components(docs(rows), label="t", block=5)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 85)


@pytest.mark.parametrize("tile,hot", [(2, 1), (5, 3), (8, 10**9)])
def test_large_tiles_in_blocks(docs, monkeypatch, tile, hot):
    """Tiles cut into blocks, and shingles whose entries aren't sorted, give the same."""
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "HOT_SHINGLE", hot)
    rng = random.Random(tile)
    base = ["b%d" % i for i in range(100)]
    rows = []
    for i in range(60):  # one hot passage, texts of several lengths, some near copies, some not
        t = base[: rng.choice([30, 60, 90, 100])] + ["x%d" % rng.randrange(400) for _ in range(rng.choice([0, 2, 4, 30]))]
        rows.append((i, " ".join(t)))
    rows += [(100 + k, t) for k, t in corpus(7, 40)]
    got = jaccard_components(docs(rows), label="t")
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 85)


def test_odd_rows(odd):
    got = [tuple(r) for r in jaccard_components(odd, label="t").collect()]
    assert sorted(got, key=str) == sorted([(1, 0, 1), (2, 0, 2), (3, 6, 3), (4, 1, 4), (4, 1, 4), (None, 1, None), (6, 1, 6), (7, 0, 7)], key=str)
    assert jaccard_components(odd.limit(0), label="t").count() == 0


def test_colliding_half_digests_are_told_apart(docs, spark):
    sets = spark.createDataFrame([(1, 3, 7, 1), (2, 3, 7, 2), (3, 3, 7, 2), (4, 0, 7, 9)], "k long, n long, d1 long, d2 long")
    sid = {r.k: r.sid for r in jaccard_join._with_set_id(sets).collect()}
    assert sid[1] != sid[2] == sid[3] and sid[4] is None
