"""The corpus pipeline: stages over documents, each one of the corpus operators.

Every stage works on all rows that its predecessor kept, and is written as Parquet and
reread before the next. All but the last return the columns of documents; names that a
stage needs beside them are made so that they clash with none. An empty table passes all
stages as an empty table. Other columns, whatever their names, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import encode_decode
from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.language_id import UNKNOWN, floors, held_out, learn, length_class, predict
from quarry.llm.mixing import mix
from quarry.llm.secret_scan import redact
from quarry.plans.staging import drop, stage

#: Documents whose best cosine is below this are in no learned language, whatever the
#: floor of their length.
LEAST_SCORE = 0.02
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python by a thousand rows or 4 MB: the settings hold from here on,
    as a stage is run by whoever writes its result."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        if not 0 < int(spark.conf.get(key).rstrip("bB")) <= most:
            spark.conf.set(key, str(most))


def _unused(columns: list[str], *wanted: str) -> list[str]:
    """The wanted names, each with underscores until no column has it in any case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: rejects texts without letters, and those like no language: below the
    floor that the held-out texts of their length give.

    A null text, and one that is empty or has no letter, goes. A null language teaches
    nothing and keeps nothing out, a null id isn't held out. Repeated rows are judged alike,
    equal cosines by the language that sorts first. If nothing can be learned, all go."""
    _small_batches(spark)
    model = learn(docs.where(~held_out("doc_id")), "text", "lang")
    by_class = floors(docs.where(held_out("doc_id")), model, "text", "lang", LEAST_SCORE)
    floor = F.lit(LEAST_SCORE)
    if by_class:
        listed = F.create_map(*(F.lit(x) for pair in sorted(by_class.items()) for x in pair))
        floor = F.coalesce(F.try_element_at(listed, length_class("text")), floor)
    said, score = _unused(docs.columns, "lang_pred", "score")
    judged = predict(docs, model, "text", names=(said, score))
    return judged.where((F.col(said) != UNKNOWN) & (F.col(score) >= floor)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): the least doc_id of each group stays.

    Texts without words link with nothing and stay, as do rows with a null id. Rows that
    share the least id of a group all stay; ties can't arise."""
    groups = jaccard_components(docs, width=5, percent=80, label="pipeline-jaccard")
    drop = stage(groups.where("doc_id <> component_id").select("doc_id").distinct(), "pipeline-copies")
    few = drop.count() <= 2_000_000
    kept = docs.join(F.broadcast(drop) if few else drop, "doc_id", "left_anti")
    return kept.select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scan: every secret in a text is replaced by a mark; all rows stay.

    ``n_chars`` is that of the text as it is now. Null texts stay null with their own
    ``n_chars``; empty texts hold nothing; repeated rows change alike."""
    _small_batches(spark)
    n_chars = F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return redact(docs).withColumn("n_chars", n_chars).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing to target weights: a document appears as often as the mix holds it.

    A null source is a source, the last. Texts without words cost nothing and follow the
    whole copies of their source. Equal ranks go by id, then size; repeated rows are
    documents of their own."""
    named = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    carry = tuple(at[c] for c in docs.columns if c not in ("doc_id", "source"))
    mixed = mix(named, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"], label="pipeline-mix", carry=carry).where("copies > 0")
    copied = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copied.select(*(F.col(at[c]).alias(c) for c in docs.columns))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids of every text, decoded again to hold them against it.

    A row for each document, repeated ones too: doc_id, n_tokens, ids_sha256,
    decoded_sha256, round_trip and token_ids. A null text counts as empty: no tokens."""
    _small_batches(spark)
    import public_tokenizers

    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = file.read()
    return encode_decode(docs, ranks, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secrets),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", tokens),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each staged in the shared folder for the next; of two that follow each
    other, the first is dropped once the second is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{i}")
            if before is not None:
                drop(before)
            before = docs
    return docs
