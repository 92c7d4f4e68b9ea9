import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing

public = pytest.importorskip("public_tokenizers")


def test_stages_on_a_small_corpus(spark, docs, tmp_path):
    """Each stage against what its rule says of its own input."""
    rng = random.Random(3)
    syllables = {"en": "the of and er ing to in".split(), "de": "der und die ung sch ein".split()}
    text = lambda lang, n: " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, rng.randint(60, 120)), lang, rng.choice("ab")) for i in range(120) for lang in [rng.choice(["en", "de"])]]
    copy = rows[10][1].split()
    copy[5] = "changed"
    rows += [(500, rows[10][1], rows[10][2], "a"), (501, " ".join(copy), rows[10][2], "b"), (502, "12345 67890 !!", "en", "a"), (503, None, "en", "b")]
    rows[20] = (20, rows[20][1] + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', rows[20][2], "a")
    docs(rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    frames = [spark.read.parquet(f"file://{tmp_path}/documents.parquet")]
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, frames[-1], f"file://{tmp_path}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == frames[0].columns
        out.write.parquet(f"file://{tmp_path}/{i}")
        frames.append(spark.read.parquet(f"file://{tmp_path}/{i}"))
    ids = [sorted(r.doc_id for r in f.select("doc_id").collect()) for f in frames]
    assert set(ids[0]) - set(ids[1]) == {502, 503}
    assert set(ids[1]) - set(ids[2]) == {500, 501}
    assert ids[2] == ids[3]
    assert frames[3].where("doc_id = 20").first().text.endswith('token = "[secret]"')
    mixed = {r.doc_id: r.copies for r in mixing.mix(frames[3]).collect()}
    assert ids[4] == sorted(i for i, n in mixed.items() for _ in range(n))
    last = frames[5].collect()
    assert sorted(r.doc_id for r in last) == ids[4] and all(r.round_trip and len(r.token_ids) == r.n_tokens for r in last)
    whole = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert sorted(map(str, whole.collect())) == sorted(map(str, last))
    assert frames[5].select(F.countDistinct("doc_id")).first()[0] > 50


def test_clashing_columns_and_odd_rows(spark, docs, tmp_path):
    """Columns that stages use themselves, nulls in all of them, repeated rows, no rows."""
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("the of and er ing to in".split()) for _ in range(3)) for _ in range(n))
    rows = [(i, text(40), "en", "a") for i in range(30)] + [(7, None), (8, ""), (None, text(30), None, None), (30, "x", "en", None)]
    base = docs([*rows, rows[5], rows[5]])
    clash = base
    for name in ("score", "lang_pred", "copies", "copy", "size", "target", "chance", "k0", "k", "t", "c0", "_text_", "cosine", "name", "row", "g", "component_id"):
        clash = clash.withColumn(name, F.when(F.col("doc_id") > 3, F.concat(F.lit(name), F.col("doc_id").cast("string"))))
    plain = {}
    for frame in (base, clash, clash.limit(0)):
        now, counts = frame, []
        for i, (_, step) in enumerate(corpus_pipeline.STAGES):
            out = step(spark, now, "")
            out.write.mode("overwrite").parquet(f"file://{tmp_path}/odd{i}")
            now = spark.read.parquet(f"file://{tmp_path}/odd{i}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == frame.columns
                assert i != 3 or "score" not in now.columns or now.where("doc_id > 3 and score <> concat('score', doc_id)").count() == 0
            counts.append(sorted(str(r.doc_id) for r in now.select("doc_id").collect()))
        if frame is base:
            plain = counts
        else:
            assert counts == (plain if frame is clash else [[]] * 5)
    assert plain[0].count("5") == 3 and "7" in plain[0] and plain[0].count("7") == 1


def test_redaction_keeps_the_count_of_characters(spark, docs):
    rows = docs([(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "a"), (2, "clean", "en", "a"), (3, None)])
    got = {r.doc_id: r for r in corpus_pipeline.secrets(spark, rows, "").collect()}
    assert got[1].n_chars == len(got[1].text) < 40 and got[2].n_chars == 5 and got[3].n_chars == 0


def test_language_stage_rejects_unlearned_texts(spark, docs):
    """Long unlabelled texts of other words go; clean ones stay, short or long."""
    rng = random.Random(4)
    syllables = {"en": "the of and er ing to in".split(), "de": "der und die ung sch ein".split(), "fr": "le la et eau oi que ment".split()}
    text = lambda parts, n: " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))
    other, fi = [chr(c) for c in range(0x430, 0x44F)], "suo mi kal ja lii kyy hta pää".split()
    rows = [(i, text(syllables[lang], rng.randint(60, 120)), lang, "a") for i in range(1500) for lang in [rng.choice(list(syllables))]]
    short = [(2000 + i, text(syllables[lang], 3), lang, "a") for i in range(60) for lang in [rng.choice(list(syllables))]]
    unlearned = [(3000 + i, text([other, fi][i % 2], [200, 100][i % 2]), None, "a") for i in range(30)]
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs([*rows, *short, *unlearned]), "").collect()}
    assert {r[0] for r in rows} <= kept
    assert sum(r[0] in kept for r in short) >= 58
    assert not {r[0] for r in unlearned} & kept


def test_every_operator_has_a_query():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in range(1, 11) if sum(q.startswith(f"op{n}_") for q in names) != 1] == []
    assert "pipeline" in names and 4 <= len(corpus_pipeline.STAGES) <= 5
