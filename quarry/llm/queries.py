"""The registered queries of the corpus operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import encode_decode
from quarry.llm import chat, mixing, quality, token_alignment, url_rules, va_search
from quarry.llm.jaccard_join import jaccard_components
from quarry.llm.language_id import identify
from quarry.llm.pii import find_pii
from quarry.llm.secret_scan import scan
from quarry.llm.substring_dedup import repeated_passages


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), label="op1")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), label="op2")


def op3_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(vocabulary), "rb") as file:
        ranks = file.read()
    return encode_decode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), width=4, percent=85, label="op4")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.format_conversations(turns.withColumn("parts", chat.text_parts())))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), label="op6")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_table(spark, sf_dir, "documents"))


def op8_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_search.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, label="op8")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path(byte_level), "rb") as a, open(public_tokenizers.path(pieces), "rb") as b:
        files = token_alignment.Vocabularies(a.read(), b.read())
    return token_alignment.align(_table(spark, sf_dir, "documents"), files, label="op11")


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    words = spark.createDataFrame([(w,) for w in url_rules.WORDS], "word string")
    return url_rules.judge(_table(spark, sf_dir, "pages"), rules, words)


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_source_mix": op6_source_mix,
    "op7_language_id": op7_language_id,
    "op8_exact_search": op8_exact_search,
    "op9_personal_data": op9_personal_data,
    "op10_secret_scan": op10_secret_scan,
    "op11_token_alignment": op11_token_alignment,
    "op12_url_rules": op12_url_rules,
}
SQL: dict[str, str] = {"op2_quality_rules": quality.SQL, "op5_chat_format": chat.SQL, "op6_source_mix": mixing.SQL, "op8_exact_search": va_search.SQL, "op12_url_rules": url_rules.SQL}
