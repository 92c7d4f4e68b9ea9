"""Every rule of the quality operator fires, and follows the texts of its own group."""

import random

import pytest

from quarry.llm import quality


def text(rng, n_words, symbols=0.0, dup_lines=0.0, repeats=0.0, length=5, per_line=8):
    """Prose in lines; shares of words with symbols, repeated lines and repeated words."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(max(1, round(rng.gauss(length, 1)))))
    lines, said = [], 0
    while said < n_words:
        if lines and rng.random() < dup_lines:
            lines.append(rng.choice(lines))
        else:
            words = [word() + ("#" * 5 if rng.random() < symbols else "") for _ in range(per_line)]
            if lines and rng.random() < repeats:
                words[:4] = rng.choice(lines).split()[:4]
            lines.append(" ".join(words))
        said += per_line
    return "\n".join(lines)


#: Lines of two words can repeat without repeating three words.
LEVELS = {"symbol_share": {"symbols": 0.4}, "dup_line_share": {"dup_lines": 0.3, "per_line": 2}, "repeat_share": {"repeats": 0.5}, "word_length": {"length": 9}}


@pytest.mark.parametrize("rule", list(LEVELS))
def test_rule_fires_and_follows_its_group(docs, rule):
    rng = random.Random(rule)
    quality_level = LEVELS[rule]
    usual = [(i, text(rng, rng.randint(150, 400), per_line=quality_level.get("per_line", 8)), "en", "usual") for i in range(250)]
    other = [(1000 + i, text(rng, rng.randint(150, 400), **quality_level), "en", "other") for i in range(250)]
    strange = [(2000 + i, text(rng, 400, **quality_level), "en", "usual") for i in range(3)]
    got = {r.doc_id: r for r in quality.quality(docs([*usual, *other, *strange])).collect()}
    fired = [got[2000 + i].failed_rule for i in range(3)]
    assert set(fired) <= {rule, "base"} and rule in fired
    assert sum(got[i].kept for i in range(250)) >= 249
    assert sum(got[1000 + i].kept for i in range(250) if not got[1000 + i].base_failed) >= 0.98 * sum(not got[1000 + i].base_failed for i in range(250))


def test_group_of_equal_values_allows_what_chance_explains(docs):
    rng = random.Random(5)
    rows = [(i, text(rng, 200), "en", "a") for i in range(250)]
    few = text(rng, 200).split(" ")
    few[3] += "#"
    long = (text(rng, 20000).replace(" ", "# ", 40), "en", "a")
    got = {r.doc_id: r.failed_rule for r in quality.quality(docs([*rows, (500, " ".join(few), "en", "a"), (501, *long), (502, " ".join(w + "##" for w in few), "en", "a")])).collect()}
    assert got[500] is None and got[501] is None and got[502] == "symbol_share"


def test_long_texts_have_no_more_room_than_their_length_gives(docs):
    """Long texts among texts of median length without one repeat: each rule rejects the bad ones, and
    a long clean text with a few repeats stays, as does a short one."""
    rng = random.Random(11)
    usual = [(i, text(rng, 150, per_line=25), "en", "a") for i in range(300)]
    lines = [x for one in text(rng, 3000, per_line=6).split("\n") for x in (one, "right")]
    clean = text(rng, 4000, per_line=25).split("\n")
    planted = {
        500: "\n".join(lines), 501: text(rng, 4000, repeats=0.9, per_line=25), 502: text(rng, 4000, symbols=0.1, per_line=25), 503: text(rng, 4000, length=8, per_line=25),
        510: "\n".join([*clean, clean[3]]), 511: text(rng, 4000, per_line=25), 512: text(rng, 60, per_line=20) + "\nsee above\nsee above",
    }
    got = {r.doc_id: r for r in quality.quality(docs([*usual, *((i, t, "en", "a") for i, t in planted.items())])).collect()}
    assert got[500].n_dup_lines == 499 and got[500].failed_rule == "dup_line_share"
    assert [got[i].failed_rule for i in (501, 502, 503)] == ["repeat_share", "symbol_share", "word_length"]
    assert [got[i].failed_rule for i in (510, 511, 512)] == [None] * 3 and sum(got[i].kept for i in range(300)) >= 299


def test_short_lower_words_and_small_groups(docs):
    rng = random.Random(6)
    rows = [(i, text(rng, 200, length=6), "en", "a") for i in range(250)]
    tiny = [(300 + i, text(rng, 200, length=6), "en", f"small{i}") for i in range(20)]
    got = {r.doc_id: r.failed_rule for r in quality.quality(docs([*rows, *tiny, (400, " ".join(rng.choice("abcdefghij") + rng.choice("klmnopqrst") for _ in range(300)), "en", "a"), (401, text(rng, 200, symbols=0.9), "en", "small3"), (402, text(rng, 200, symbols=0.9), "xx", None)])).collect()}
    assert got[400] == "word_length" and got[401] == "symbol_share" and got[402] == "symbol_share"
    assert sum(got[i] is None for i in [*range(250), *range(300, 320)]) >= 268


def test_bucket_keeps_the_highest_bits(spark):
    from pyspark.sql import functions as F

    values = [0, 1, 127, 128, 129, 255, 256, 65535, 65536, 10**12 + 12345]
    got = spark.createDataFrame([(v,) for v in values], "v long").select("v", quality._bucket(F.col("v")).alias("b")).collect()
    for r in got:
        shift = max(0, len(bin(r.v)) - 2 - quality.BITS)
        assert r.b == r.v >> shift << shift and r.v - r.b <= r.v / 64
