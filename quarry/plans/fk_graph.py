"""The foreign-key reference graph of the star-schema tables, as a code graph.

A row is a node ``table:key`` in the file ``table``; a row that refers to another
"calls" it. ``lineitem`` links orders to parts and suppliers, with the line as call line.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Tables with their keys, and references (table, key, column, referred table).
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey"}
REFERENCES = [("nation", "n_nationkey", "n_regionkey", "region"), ("customer", "c_custkey", "c_nationkey", "nation"), ("supplier", "s_suppkey", "s_nationkey", "nation"), ("orders", "o_orderkey", "o_custkey", "customer")]


def _name(table: str, key: Column) -> Column:
    return F.concat(F.lit(f"{table}:"), key.cast("string"))


def fk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t, k: spark.read.parquet(f"{sf_dir}/{t}.parquet").select(F.lit(t).alias("file_path"), _name(t, F.col(k)).alias("symbol_name"), F.lit("row").alias("symbol_type"), F.col(k).cast("int").alias("line_number"), F.lit("").alias("signature"))
    return reduce(DataFrame.unionByName, [one(t, k) for t, k in KEYS.items()])


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    def one(table: str, source_table: str, key: str, column: str, target: str, line: Column) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").where(F.col(key).isNotNull() & F.col(column).isNotNull())
        return rows.select(F.lit(source_table).alias("src_file"), _name(source_table, F.col(key)).alias("src_name"), F.lit("row").alias("src_type"), F.col(key).cast("int").alias("src_line"), F.lit(target).alias("dst_file"), _name(target, F.col(column)).alias("dst_name"), F.lit("row").alias("dst_type"), F.col(column).cast("int").alias("dst_line"), F.lit("calls").alias("edge_type"), line.cast("int").alias("call_line"))

    parts = [one(t, t, k, c, r, F.lit(0)) for t, k, c, r in REFERENCES]
    parts += [one("lineitem", "orders", "l_orderkey", c, r, F.col("l_linenumber")) for c, r in (("l_partkey", "part"), ("l_suppkey", "supplier"))]
    return reduce(DataFrame.unionByName, parts)


#: DuckDB: the same as common table expressions n (nodes) and e (edges).
SQL = " UNION ALL ".join(f"SELECT '{t}' AS file_path, '{t}:' || {k} AS symbol_name, 'row' AS symbol_type, CAST({k} AS INTEGER) AS line_number FROM {t}" for t, k in KEYS.items())
_EDGE = "SELECT '{s}' AS src_file, '{s}:' || {k} AS src_name, 'row' AS src_type, CAST({k} AS INTEGER) AS src_line, '{r}' AS dst_file, '{r}:' || {c} AS dst_name, 'row' AS dst_type, CAST({c} AS INTEGER) AS dst_line, 'calls' AS edge_type, CAST({l} AS INTEGER) AS call_line FROM {t} WHERE {k} IS NOT NULL AND {c} IS NOT NULL"
EDGE_SQL = " UNION ALL ".join([_EDGE.format(s=t, t=t, k=k, c=c, r=r, l="0") for t, k, c, r in REFERENCES] + [_EDGE.format(s="orders", t="lineitem", k="l_orderkey", c=c, r=r, l="l_linenumber") for c, r in (("l_partkey", "part"), ("l_suppkey", "supplier"))])
WITH = f"WITH n AS ({SQL}), e AS ({EDGE_SQL})"
