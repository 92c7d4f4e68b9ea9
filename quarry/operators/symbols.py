"""Symbol search and verification, as joins over a SYMBOLS table built once.

``symbols`` rows carry ``dir_rank`` (the priority of their search directory, 0 first)
and ``relative_path`` (below that directory) where these matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text
from quarry.functions.schemas import KNOWN_SYMBOLS
from quarry.operators.graph import first_by_priority
from quarry.operators.near_names import nearest
from quarry.plans.staging import stage


def find_symbol(symbols: DataFrame, name: str, symbol_type: str = "") -> DataFrame:
    """The first symbol of that name (and type, if given) by path and place in the file."""
    found = symbols.where(F.col("name") == name)
    if symbol_type:
        found = found.where(F.col("symbol_type") == symbol_type)
    return found.orderBy("file_path", "ordinal").limit(1)


def similar(symbols: DataFrame, query: str, threshold: float = 0.7, per_dir: int = 10, overall: int | None = 5) -> DataFrame:
    """The most similar symbols: the best ``per_dir`` of each directory, in the order of
    directories, and the first ``overall`` of that list (all, if None)."""
    scored = symbols.withColumn("score", text.similarity_to(F.col("name"), query)).where(F.col("score") >= threshold)
    if "dir_rank" not in symbols.columns:
        scored = scored.withColumn("dir_rank", F.lit(0))
    ranked = scored.withColumn("rn", F.row_number().over(Window.partitionBy("dir_rank").orderBy(F.desc("score"), "file_path", "ordinal"))).where(F.col("rn") <= per_dir)
    return ranked if overall is None else ranked.orderBy("dir_rank", "rn").limit(overall)


def known_symbols(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """(library, symbol) of well-known libraries: a fixed small table, broadcast in joins."""
    rows = [(library, s) for library, names in (KNOWN_SYMBOLS if known is None else known).items() for s in (names.split() if isinstance(names, str) else sorted(names))]
    return spark.createDataFrame(rows, "library string, symbol string")


def verify(requests: DataFrame, symbols: DataFrame, known: DataFrame, similar_threshold: float = 0.7) -> DataFrame:
    """Answers (library, symbol, language, doc_url) requests, one wide row each.

    First the local symbols (all ranked directories, whatever the library), then the
    known ones, else DOES_NOT_EXIST with up to 5 similar names. Equal requests are one;
    a doc_url is judged by its form alone. ``symbols`` with a ``library`` column match
    only that library's requests. Requests may say whether the library's ``package`` is
    there: found TypeScript symbols are then imported from it."""
    asked = requests.dropDuplicates(["library", "symbol", "language", "doc_url"])
    keys = ["symbol"] + (["library"] if "library" in symbols.columns else [])
    at = symbols.withColumnRenamed("name", "symbol")
    wanted = at.join(asked.select("symbol").distinct(), "symbol", "left_semi")
    best = first_by_priority(wanted, keys, ["dir_rank", "file_path", "ordinal"]).select(*keys, F.struct("symbol_type", "file_path", "line_number", "signature", F.col("relative_path") if "relative_path" in at.columns else F.lit(None).cast("string").alias("relative_path")).alias("local"))
    out = stage(asked.join(best, keys, "left").join(known.withColumn("is_known", F.lit(True)).distinct(), ["library", "symbol"], "left"), "verified")
    lost = out.where("local is null and is_known is null").select("symbol").distinct()
    near = nearest(symbols, lost, similar_threshold)
    entry = F.struct("dir_rank", (-F.col("score")).alias("s"), "file_path", "ordinal", text.similar_entry(F.col("name"), F.col("symbol_type"), F.col("signature")).alias("e"))
    named = near.groupBy("symbol").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("near"))
    out = out.join(named, "symbol", "left").withColumn("similar", F.when(F.col("local").isNull() & F.col("is_known").isNull(), F.col("near")))
    source = F.when(F.col("local").isNotNull(), "local").when(F.col("is_known"), "known_library")
    package = F.col("package") if "package" in requests.columns else F.lit(False)
    from_package = F.when(F.col("language").isin("typescript", "javascript") & package & F.col("local").isNotNull(), text.ts_import(F.col("library"), F.lit(None).cast("string"), F.col("symbol")))
    import_path = F.when(F.col("local.relative_path").isNotNull() & (F.col("language") == "python"), text.python_import(F.col("local.relative_path"), F.col("symbol")))
    return out.select(
        "library", "symbol", "language", F.when(source.isNotNull(), "FOUND").otherwise("DOES_NOT_EXIST").alias("status"), source.alias("source"), "local.symbol_type", "local.file_path", "local.line_number", "local.signature",
        F.coalesce(import_path, from_package).alias("import_path"), F.when(text.url_valid(F.col("doc_url")), F.col("doc_url")).alias("doc_url"), F.coalesce("similar", F.array().cast("array<string>")).alias("similar"),
    )
