import hashlib
import random
import re

import numpy as np
import pytest

from quarry.llm import bpe, language_id, pii, quality, secret_scan, substring_dedup


# byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    public = pytest.importorskip("public_tokenizers")
    raw = open(public.path("byte_bpe_multi_50k.tiktoken"), "rb").read()
    return raw, bpe.read_ranks(raw), public.PATTERN


def test_transducer_equals_merges(vocabulary):
    _, ranks, _ = vocabulary
    t, rng, tokens = bpe.Transducer(ranks), random.Random(4), list(ranks)
    for _ in range(3000):
        piece = b"".join(rng.choices(tokens, k=rng.randint(1, 4)))
        assert t.encode(piece) == ((ranks[piece],) if piece in ranks else bpe.merge_by_rank(piece, ranks))


def test_small_vocabulary_with_unreachable_tokens():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"xyz": 260, b"aa": 261, b"aaaa": 262}
    t, rng = bpe.Transducer(ranks), random.Random(1)
    for _ in range(2000):
        piece = bytes(rng.choices(b"aabcdxyz", k=rng.randint(1, 12)))
        assert t.encode(piece) == ((ranks[piece],) if piece in ranks else bpe.merge_by_rank(piece, ranks)), piece
    with pytest.raises(ValueError):
        bpe.Transducer({b"a": 0})


def test_encoding_equals_library_and_full_tables_change_nothing(vocabulary, monkeypatch):
    tiktoken = pytest.importorskip("tiktoken")
    _, ranks, pattern = vocabulary
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(bpe, "STATES", 300)
    monkeypatch.setattr(bpe, "PIECES", 50)
    mine, rng = bpe.Encoder(ranks, pattern), random.Random(2)
    parts = ["a", "the", " th", "ing", "é", "ß", "漢", "😀", " ", "  ", "\n", "\t", "12", "'s", "'ll", "!!", "###", "İ", "​", "<|endoftext|>", "x" * 90]
    for _ in range(1500):
        s = "".join(rng.choices(parts, k=rng.randint(0, 25)))
        assert np.frombuffer(mine.encode(s), "<u4").tolist() == library.encode_ordinary(s), s


def test_utf8_machine_equals_whole_decoding():
    rng = random.Random(3)
    for _ in range(2000):
        data = b"".join(rng.choice([b"a", "é".encode(), "漢".encode(), "😀".encode(), b"\xff", b"\xe2\x82", b"\xf0\x9f", b"\xed\xa0\x80", b"\xc0\xaf", b"\x80", b"\xf4\x90"]) for _ in range(rng.randint(0, 8)))
        machine, out, at = bpe.Utf8Machine(), "", 0
        while at < len(data):
            step = rng.randint(1, 3)
            out += machine.feed(data[at : at + step])
            at += step
        assert out + machine.finish() == data.decode("utf-8", "replace"), data


def test_bpe_rows(odd, vocabulary):
    raw, _, pattern = vocabulary
    rows = bpe.encode_decode(odd, raw, pattern, with_ids=True).collect()
    assert len(rows) == 8 and all(r.round_trip for r in rows)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows[:2]] == [(0, empty, empty)] * 2
    assert rows[2].decoded_sha256 == hashlib.sha256(("a b c d e f " * 9000).encode()).hexdigest() and len(rows[2].token_ids) == rows[2].n_tokens
    assert bpe.encode_decode(odd.limit(0), raw, pattern).count() == 0


# substring dedup


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_cuts_resist_insertions():
    text = words(1, 3000).encode()
    def chunks(d):
        e = substring_dedup.cuts(np.frombuffer(d, np.uint8))
        return [d[a:b] for a, b in zip([0, *e[:-1]], e, strict=True)]
    a, b = chunks(text), chunks(text[:5000] + b"INSERTED" + text[5000:])
    assert b"".join(a) == text and len(set(a) - set(b)) <= 4
    assert max(map(len, chunks(b"a" * 5000))) <= substring_dedup.LONGEST


def test_planted_passages_are_found_and_others_left(docs):
    passage = words(99, 55)
    rows = [(i, words(i, 200)) for i in range(30)]
    for i in (3, 8, 21):
        rows[i] = (i, words(i, 100) + " " + passage + " " + words(i + 50, 90))
    rows += [(40, rows[5][1]), (41, None), (42, ""), (None, passage)]
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    assert {(r.doc_id, r.first_id) for r in got} == {(8, 3), (21, 3), (40, 5)}
    assert all(r.n_words >= 25 for r in got)
    cut = {r.doc_id: r.text for r in substring_dedup.without_repeats(docs([r for r in rows if r[0] is not None])).collect()}
    assert cut[3] == rows[3][1] and cut[40] == "" and cut[41] is None and len(cut[8].split()) < 215
    assert words(8, 90) in cut[8]


def test_ties_in_short_gaps_only():
    for n in range(1, 80):
        data = b"It " * n + words(n, 5).encode()
        assert substring_dedup.cuts(np.frombuffer(data, np.uint8))[-1] == len(data)


def test_short_copies_and_texts_without_spaces(docs):
    rng = random.Random(12)
    han = lambda n: "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(n))
    passage = han(200)
    rows = [(1, words(1, 9)), (2, words(2, 9)), (3, words(1, 9)), (4, words(1, 9) + " more"), (10, han(300) + passage), (11, han(250) + passage + han(80)), (12, han(300))]
    got = {(r.doc_id, r.first_id) for r in substring_dedup.repeated_passages(docs(rows)).collect()}
    assert got == {(3, 1), (11, 10)}


@pytest.mark.parametrize("phrase", ["word ", "a b ", "lorem ipsum dol "])
def test_periodic_passages_at_other_offsets(docs, phrase):
    stretch = phrase * (90 // len(phrase.split()))
    rows = [(1, words(1, 60) + " " + stretch + words(2, 60)), (2, words(3, 71) + " " + stretch + words(4, 50)), (3, words(5, 120))]
    got = substring_dedup.repeated_passages(docs(rows)).collect()
    assert [(r.doc_id, r.first_id) for r in got] == [(2, 1)]
    assert got[0].n_words > 45


def test_passages_stand_whole_in_their_first_document(docs):
    """Against brute force on small corpora of shared, nested and overlapping passages: a
    reported stretch is in its first document, and long common stretches are reported."""
    for seed in range(3):
        rng = random.Random(seed)
        shared = [words(500 + i, rng.randint(30, 90)) for i in range(6)] + [("tick tock " * 60).strip()]
        shared.append(" ".join([shared[0], shared[1]]))
        texts = [" ".join(x for _ in range(rng.randint(1, 4)) for x in (words(rng.random(), rng.randint(5, 60)), rng.choice(shared))) for _ in range(25)]
        got = substring_dedup.repeated_passages(docs(list(enumerate(texts)))).collect()
        raw = [t.encode() for t in texts]
        covered = [bytearray(len(t)) for t in raw]
        for r in got:
            assert r.first_id < r.doc_id and r.n_words >= 25
            stretch = raw[r.doc_id][r.start_byte : r.end_byte]
            assert raw[r.first_id][r.first_start : r.first_start + len(stretch)] == stretch
            assert abs(len(stretch.split()) - r.n_words) <= 1
            covered[r.doc_id][r.start_byte : r.end_byte] = b"\x01" * len(stretch)
        found = total = 0
        for i, t in enumerate(texts):
            for p in {p for p in shared if len(p.split()) > 50 and any(p in texts[j] for j in range(i))}:
                at = t.find(p)
                while at >= 0:
                    inside = covered[i][at : at + len(p)]
                    found, total = found + (sum(inside) >= len(p) - 160), total + 1
                    at = t.find(p, at + 1)
        assert total > 15 and found == total
        novel = [p for i, t in enumerate(texts) for p in [t.split()[:5]] if any(covered[i][: len(" ".join(p))])]
        assert not novel


def test_substring_odd_rows(odd):
    assert substring_dedup.repeated_passages(odd).count() == 0
    assert substring_dedup.repeated_passages(odd.limit(0)).count() == 0


# quality


def test_quality_measures_equal_plain_count(docs):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "b", "cc", "d#", "é|", "<x>"]) + rng.choice(["", "", "\n"]) for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, "", " \n ", "x y z", "x y z x y z"]
    rows = {r.doc_id: r for r in quality.quality(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        covered = {p for k, g in enumerate(grams) if grams.count(g) > 1 for p in range(k, k + 3)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(covered))
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_thresholds_follow_their_group(docs):
    clean = [(i, words(i, 80), "en", "a") for i in range(300)]
    noisy = [(1000 + i, " ".join(f"{w}##" for w in words(i, 80).split()), "en", "b") for i in range(300)]
    odd_one = (5000, " ".join(f"{w}##" for w in words(5000, 80).split()), "en", "a")
    kept = {r.doc_id: (r.kept, r.failed_rule) for r in quality.quality(docs([*clean, *noisy, odd_one])).collect()}
    assert kept[5000] == (False, "symbol_share")
    assert all(kept[i][0] for i in range(300)) and all(kept[1000 + i][0] for i in range(300))


def test_quality_odd_rows(odd):
    rows = quality.quality(odd).collect()
    assert len(rows) == 8 and not any(r.kept for r in rows if r.n_words < 50)
    assert quality.quality(odd.limit(0)).count() == 0


# language ID


def test_language_is_told_apart_on_held_out_texts(docs):
    rng = random.Random(5)
    parts = {"en": "the of and to in er ing tion".split(), "de": "der und die ung sch ein keit lich".split(), "fr": "le la et eau oi é que ment".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(60)), x) for i, x in enumerate(rng.choices(list(parts), k=240))]
    truth = {i: x for i, _, x in rows}
    got = language_id.identify(docs(rows)).collect()
    held = [r for r in got if r.held_out]
    assert 30 < len(held) < 100 and all(r.lang_pred == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_equals_plain_computation(docs):
    """Prototypes and cosines from the definition, trigram by trigram, in plain Python."""
    import zlib

    rng = random.Random(15)
    rows = [(i, "".join(rng.choice("abc dé'ß 1İ.") for _ in range(rng.randint(0, 60))) if rng.random() < 0.95 else None, rng.choice(["x", "y", "z", None])) for i in range(80)]
    letter = {}

    def vector(text):
        low = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
        padded = " " + " ".join(low.split(" ")).strip() + " "
        padded = re.sub(" +", " ", padded)
        out = np.zeros(language_id.DIMS)
        for a, b, c in zip(padded, padded[1:], padded[2:]):
            v = [letter.setdefault(x, np.random.default_rng([20240901, ord(x)]).choice(np.array([-1, 1], np.int8), language_id.DIMS).astype(int)) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out

    learned = {}
    for i, t, lang in rows:
        if t is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            learned[lang] = learned.get(lang, 0) + vector(t)
    names = sorted(learned)
    p = np.array([learned[x] / np.linalg.norm(learned[x]) for x in names])
    p = p - p.mean(axis=0)
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    got = {r.doc_id: r for r in language_id.identify(docs(rows)).collect()}
    for i, t, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        v = vector(t or "")
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        cosines = p @ v / np.linalg.norm(v)
        assert got[i].score == pytest.approx(max(0.0, cosines.max()), abs=1e-4)
        assert cosines[names.index(got[i].lang_pred)] == pytest.approx(cosines.max(), abs=1e-4)


def test_any_number_of_languages(docs, monkeypatch):
    rows = [(i, words(i, 30), f"l{i % 7}") for i in range(60)]
    whole = sorted(language_id.identify(docs(rows)).collect())
    monkeypatch.setattr(language_id, "LANGUAGES", 2)
    assert [(a.doc_id, a.lang_pred, pytest.approx(a.score)) for a in whole] == [(a.doc_id, a.lang_pred, a.score) for a in sorted(language_id.identify(docs(rows)).collect())]


def test_labels_of_held_out_rows_are_not_seen(docs):
    rows = [(i, words(i, 40), "aa" if i % 2 else "bb") for i in range(40)]
    flipped = [(i, t, "zz") for i, t, _ in rows]
    first = language_id.identify(docs(rows))
    out = {r.doc_id for r in first.where("held_out").collect()}
    mixed = language_id.identify(docs([flipped[i] if i in out else rows[i] for i in range(40)]))
    assert sorted(first.collect()) == sorted(mixed.collect())


def test_language_odd_rows(odd, docs):
    got = {(r.doc_id, r.lang_pred) for r in language_id.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (7, "und")} <= got
    assert language_id.identify(odd.limit(0)).count() == 0
    assert language_id.identify(docs([(1, "abc")])).first().lang_pred == "und"


# personal data


def plain_pii(t):
    out = [(0, *m.span()) for m in pii.EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in pii.IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in pii.CARD.finditer(t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in pii.PHONE.finditer(t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base_equals_plain_patterns():
    rng = random.Random(9)
    parts = ["a", "b.c", "@", "x@y.z", ".", "-", " ", "é", "10", "255", "1.2.3.4", "999.1.1.1", "+49 (30) 123-4567", "4111111111111111", "4111 1111 1111 1111", "\n", "_", "+", "(", ")"]
    for _ in range(4000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert pii.base_spans(t) == plain_pii(t), t


def test_pii_field_adds_what_forms_miss_and_keeps_base(docs):
    t = "mail joan (at) example (dot) org or call (212) 555-0187 now, host 10.0.0.7, v. 4.0 of 2019"
    model = pii.trained_model()
    added = [(pii.KINDS[k], t[a:b]) for k, a, b in pii.added_spans(t, pii.base_spans(t), model)]
    assert ("email", "joan (at) example (dot) org") in added and ("phone", "(212) 555-0187") in added and len(added) == 2
    exact = miss = extra = 0
    for text, spans in pii.labelled_sentences(200, 123):
        got, want = {(a, b, k) for k, a, b in pii.added_spans(text, [], model)}, set(spans)
        exact, miss, extra = exact + len(got & want), miss + len(want - got), extra + len(got - want)
    assert exact / (exact + miss) > 0.93 and exact / (exact + extra) > 0.93
    row = pii.find_pii(docs([(1, t)])).first()
    assert (row.n_email, row.n_ip, row.n_phone, row.n_added) == (0, 1, 0, 2)
    assert row.base_sha256 == hashlib.sha256(pii.listed(pii.base_spans(t)).encode()).hexdigest()


def test_spelled_out_addresses_in_any_case(docs):
    texts = ["write to Joan AT example DOT com today", "write to joan (At) example (Dot) com today"]
    rows = {r.doc_id: r for r in pii.find_pii(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].n_added == 1 and f"email:9:{t.index(' today')}" in rows[i].spans


# Sentences that no generator made, with what they hold beside base forms.
SENTENCES = [
    ("mail anna-maria-christina-elisabeth-heide at example dot org today", ["email:anna-maria-christina-elisabeth-heide at example dot org"]),
    ("maximilianalexander.hohenzollernburg.sigmaringen [at] example.org", ["email:maximilianalexander.hohenzollernburg.sigmaringen [at] example.org"]),
    ("please write to x (at) example.org now", ["email:x (at) example.org"]),
    ("Write: Jean-Luc_Picard(at)starfleet.example.com.", ["email:Jean-Luc_Picard(at)starfleet.example.com"]),
    ("our desk answers on (212) 555-0187 until noon", ["phone:(212) 555-0187"]),
    ("dial 0049 212 5550187 from abroad", ["phone:0049 212 5550187"]),
    ("charged 4111/1111/1111/1111 on Monday", ["card:4111/1111/1111/1111"]),
    ("the router 10[.]0[.]0[.]7 is down", ["ip:10[.]0[.]0[.]7"]),
    ("version 4.0.1 of 2019-11-23 is out", []),
    ("we meet at noon, dot the i and cross the t", []),
    ("born 12/03/1984 in room 1234 of house 77", []),
    ("isbn 978-3-16-148410-0 is out of print", []),
    ("order 123456789 shipped in 3 boxes of 40 pieces each", []),
    ("the price rose to 1,234,567.89 in 2021 and fell in 2022", []),
    ("they stayed at home and looked at the river", []),
]


def test_pii_on_sentences_of_no_generator(docs):
    rows = {r.doc_id: r for r in pii.find_pii(docs([(i, t) for i, (t, _) in enumerate(SENTENCES)])).collect()}
    wrong = []
    for i, (t, want) in enumerate(SENTENCES):
        got = [f"{k}:{t[int(a) : int(b)]}" for k, a, b in (x.split(":") for x in rows[i].spans.split(",") if x)]
        wrong += [(t, got)] if got != want else []
    assert len(wrong) <= 1, wrong


def test_pii_base_is_linear():
    import time

    began = time.perf_counter()
    for text in ("1" * 1_000_000, "1." * 500_000, "1 " * 500_000, "+1 " + "(" * 1_000_000, "a@" * 300_000, "1.1.1" * 200_000):
        pii.base_spans(text)
    assert time.perf_counter() - began < 6


def test_pii_ip_in_one_pass_equals_the_form():
    rng = random.Random(19)
    for _ in range(3000):
        t = "".join(rng.choice(["1", "22", "255", "256", ".", ".", "..", " ", "a", "0007", "1.2.3.4"]) for _ in range(rng.randint(0, 16)))
        want = [m.span() for m in pii.IP.finditer(t)]
        assert [m.span() for m in pii._IP_ONCE.finditer(t)] == want, t


def test_pii_regions_hold_every_segment():
    """Added spans of long texts are those of a lattice over the whole text."""
    rng, model = random.Random(23), pii.trained_model()
    for _ in range(25):
        parts = [t for t, _ in pii.labelled_sentences(3, rng.randrange(10**6))]
        t = (" lorem ipsum dolor sit amet" * rng.randint(0, 12)).join(parts)
        toks = pii.tokens(t)
        whole = [(k, toks[i][0], toks[j - 1][1]) for i, j, k in model.decode(pii.Lattice(t, toks))]
        assert pii.added_spans(t, [], model) == whole


def test_pii_decode_is_the_best_labelling():
    """The dynamic program equals trying every set of segments."""
    text = "x 12.34.56.78 y (017) 555-7713"
    toks = pii.tokens(text)
    lattice, model = pii.Lattice(text, toks), pii.trained_model()
    arcs = [(i, j, k, model.score(k, f)) for j, ends in enumerate(lattice.ends) for i, f in ends for k in range(4)]
    arcs = [a for a in arcs if a[3] > 0]

    def best(at):
        return max([0.0] + [a[3] + best(a[1]) for a in arcs if a[0] >= at])

    got = sum(next(s for i, j, k, s in arcs if (i, j, k) == seg) for seg in model.decode(lattice))
    assert got == pytest.approx(best(0))


def test_pii_odd_rows(odd):
    rows = pii.find_pii(odd).collect()
    assert len(rows) == 8 and all(r.spans == "" for r in rows)
    assert pii.find_pii(odd.limit(0)).count() == 0


# secrets


def plain_secrets(t):
    out = [(m.start(), 0, m.end()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secret_base_equals_plain_patterns(docs):
    rng = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "=", ":", " ", '"', "abc123xyz", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "\n", "secrets", "ſecret=abcdefgh"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(800)] + [None, ""]
    rows = {r.doc_id: r for r in secret_scan.scan(docs(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        want = plain_secrets(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(secret_scan.listed(want).encode()).hexdigest(), t
        assert (rows[i].n_assign, rows[i].n_access, rows[i].n_hex) == tuple(sum(k == j for _, k, _ in want) for j in range(3))
        assert set(filter(None, secret_scan.listed(want).split(","))) <= set(rows[i].spans.split(","))


def test_markov_models_on_unseen_samples(docs):
    model = secret_scan.SecretModel()
    samples = [(s, y) for s, y in secret_scan.labelled_samples(seed=77) if len(s) >= secret_scan.LEAST_RUN]
    assert np.mean([model.is_secret(s) for s, y in samples if y]) > 0.97
    assert np.mean([model.is_secret(s) for s, y in samples if not y]) < 0.01
    key = "qX7Zk29LmPw4RtYv8BnC3jHd"
    row = secret_scan.scan(docs([(1, f"see {key} and compute_total_account_balance_value")])).first()
    assert row.n_random == 1 and row.spans == f"random:4:{4 + len(key)}"


# Strings that no generator of the models made.
ORDINARY_STRINGS = """AAAAAAAAAAAAAAAAAAAAAAAAAAAA src/main/java/com/x/y/z/AbcDefFactory 550e8400-e29b-41d4-a716-446655440000
F47AC10B-58CC-4372-A567-0E02B2C3D479 20231117T235959Z-0001-0002 qwertyuiopasdfghjklzxcvbnm ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789
Donaudampfschifffahrtsgesellschaft Rechtsschutzversicherungsgesellschaften internationalization_and_localization
the_quick_brown_fox_jumps_over_the_lazy_dog /usr/local/share/applications/org.gnome anticonstitutionnellement-vraiment
wp-content/uploads/2019/03/summer-sale-banner 00000000000000000000000000000001 9876543210-9876543210-9876543210
org-apache-spark-sql-catalyst-expressions ArrayIndexOutOfBoundsExceptionHandlerFactoryBean xxxxxxxxxxxxxxxxxxxxxxxxxxx-xxxx
MAX_CONCURRENT_CONNECTIONS_PER_HOST =====================-------------------- users/42/orders/1001/items/7/reviews/page/2
pneumonoultramicroscopicsilicovolcanoconiosis Llanfairpwllgwyngyllgogerychwyrndrobwll 192-168-0-1-255-255-255-0-10-0-0-1
2024-02-29_13-45-59-000_backup_final_v2 nosotros-estabamos-caminando-lentamente abababababababababababababab""".split()
KEYS = """qX7Zk29LmPw4RtYv8BnC3jHd Zm9vYmFyMTIzNDU2Nzg5MHF3ZXJ0eXVpb3A4Kz ghp9Kd83hFzQ2mVx7Lr5TnB1cYw0PjS6uEa4iO
sk4f8Hq2Wz9Xv6Nb3Mk7Lp1Rt5Yc0Jd xoxb7Kq9ZpL2mN4vB6cX8wQ1eR3tY5u 7GQK2M9XW4PZ8RTB6VNC3HYJ5FDL
k3j9x7q2m5w8z1v6b4n0c7p2r9t5y8 EAACEdEose0cBAK7ZC2v9XqLmW4nRt8YpJhGf wJalrXUtnFEMI7K9MDENGbPxRfiCYzE4kT0qLm2s
dR9pXw2LqZ7vKm4BtY8nHc3JgF6sQa1E T3BlbkFJx9QmZ2LkV7cRw8NpYt5DhGs4 pat7Nq4Zx9Kw2Vr8Ly5Tm3Bc6Hd1Jf""".split()


def test_strings_of_no_generator(docs):
    rows = [(i, f"see {s} here") for i, s in enumerate([*ORDINARY_STRINGS, *KEYS])]
    got = {r.doc_id: r.n_random for r in secret_scan.scan(docs(rows)).collect()}
    flagged = [s for i, s in enumerate(ORDINARY_STRINGS) if got[i]]
    missed = [s for i, s in enumerate(KEYS) if not got[len(ORDINARY_STRINGS) + i]]
    assert len(flagged) <= 1 and missed == []  # Welsh has letter pairs that no training word has


def test_false_positives_on_unseen_words():
    """Stated rate, on words that neither training nor the thresholds saw, four times over."""
    rng = random.Random(91)
    words = ["".join(rng.choice(["st", "r", "k", "l", "m", "pr", "t", "sch", "d", "v"]) + rng.choice(["a", "e", "i", "o", "u", "ei", "ou"]) for _ in range(rng.randint(2, 4))) for _ in range(200)]
    plain = [s for s, y in secret_scan.labelled_samples(92, 4000, words) if not y and len(s) >= secret_scan.LEAST_RUN]
    model = secret_scan.kept_model()
    assert np.mean([bool(model.secrets(s)) for s in plain]) <= 4 * 2 * secret_scan.FALSE_POSITIVES


def test_model_from_a_labelled_table(spark, docs):
    rows = [*secret_scan.labelled_samples(93, 1500), (None, True), ("not a key string!", False), ("x", None)]
    model = secret_scan.SecretModel.from_table(spark.createDataFrame(rows, "string string, is_random boolean"))
    assert model.is_secret(KEYS[0]) and not model.is_secret(ORDINARY_STRINGS[0])
    assert secret_scan.scan(docs([(1, KEYS[0])]), model=model).first().n_random == 1


def test_redaction(docs):
    t = 'a password = "hunter22" b deadbeefdeadbeefdeadbeef00 c qX7Zk29LmPw4RtYv8BnC3jHd é'
    rows = {r.doc_id: r for r in secret_scan.redact(docs([(1, t, "en", "s"), (2, "clean text", "en", "s"), (3, None)])).collect()}
    assert rows[1].text == 'a password = "[secret]" b [secret] c [secret] é'
    assert rows[2].text == "clean text" and rows[3].text is None and rows[2].lang == "en"
    token = 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x'
    assert secret_scan.redact(docs([(1, token)])).first().text == 'token = "[secret]" x'


def test_keys_inside_longer_runs(docs):
    """Joined to ordinary words, and beside a base form in one run."""
    model = secret_scan.kept_model()
    samples, rng = secret_scan.labelled_samples(seed=78, n=600), random.Random(8)
    keys, plain = [s for s, y in samples if y], [s for s, y in samples if not y]
    found = clean = 0
    for key in keys:
        before = "".join(rng.choice(plain) + rng.choice("/_-") for _ in range(rng.randint(1, 3)))
        text = f"https://host.org/{before}{key}{rng.choice(['', '/' + rng.choice(plain)])} end"
        at = text.index(key)
        covered = {p for a, _, b in secret_scan.base_spans(text) for p in range(a, b)}
        covered |= {p for a, _, b in secret_scan.random_spans(text, secret_scan.base_spans(text), model) for p in range(a, b)}
        found += sum(p in covered for p in range(at, at + len(key))) >= 0.9 * len(key)
        clean += not secret_scan.random_spans(before + rng.choice(plain), [], model)
    assert found > 0.97 * len(keys) and clean > 0.98 * len(keys)
    access, key = "AKIA" + "Q2W3E4R5T6Y7U8I9", "wJalrXUtnFEMI7K9MDENGbPxRfiCYzE4kT0qLm2s"
    t = f"see {access}/{key} and first_account_value_total/customer-document-description/{key}/list x"
    assert key not in secret_scan.redact(docs([(1, t)])).first().text
    assert secret_scan.listed(secret_scan.base_spans(t)) == f"access:4:{4 + len(access)}"
    assert secret_scan.redact(docs([(1, t)])).first().text.endswith("/list x")


def test_secret_odd_rows(odd):
    assert [r.spans for r in secret_scan.scan(odd).collect()] == [""] * 8
    assert secret_scan.scan(odd.limit(0)).count() == 0
    assert secret_scan.redact(odd).count() == 8


def test_chunks_cost_the_same_in_large_slices():
    """Time per byte doesn't grow with the rows of a slice: hashes are summed once per slice."""
    import time

    import pyarrow as pa

    from quarry.llm.bytewords import slices
    from quarry.llm.substring_dedup import _chunks_of

    rng = random.Random(4)
    texts = pa.array([" ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randint(0, 99)) for _ in range(30)) for _ in range(3000)])

    def took(limit):
        began = time.process_time()
        for part in slices(texts, limit):
            _chunks_of(part, 25, 256)
        return time.process_time() - began

    took(1 << 19)
    assert min(took(1 << 19) for _ in range(2)) < 4 * min(took(1 << 13) for _ in range(2))
