"""Replays of caches, rate limits and retries over event tables."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lru_hits(events: DataFrame, key: str, order: list[str], capacity: int, cache: str) -> DataFrame:
    """Adds ``hit``: whether a least-recently-used cache of ``capacity`` entries holds
    the key at each access; a miss is put in, and the oldest entry goes if it is full.

    Each value of ``cache`` is a cache of its own, read in the order given. A replay is
    sequential within a cache, so caches are dealt over tasks and sorted, and a task
    streams through them with one cache's entries in memory: linear work, where counting
    distinct keys between accesses by a self-join would be quadratic."""
    schema = T.StructType([*events.schema.fields, T.StructField("hit", T.BooleanType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries: OrderedDict = OrderedDict()
        current: object = object()
        for batch in batches:
            hits = []
            for of, k in zip(batch.column(cache).to_pylist(), batch.column(key).to_pylist(), strict=True):
                if of != current:
                    entries, current = OrderedDict(), of
                hits.append(k in entries)
                entries[k] = None
                entries.move_to_end(k)
                if len(entries) > capacity:
                    entries.popitem(last=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hits, pa.bool_())], names=schema.names)

    return events.repartition(cache).sortWithinPartitions(cache, *order).mapInArrow(work, schema)


def request_density(events: DataFrame, client: str, seconds: Column, window: int = 60) -> DataFrame:
    """Adds ``density``: the client's events in the ``window`` seconds up to each."""
    over = Window.partitionBy(client).orderBy("_at").rangeBetween(-window, 0)
    return events.withColumn("_at", seconds.cast("long")).withColumn("density", F.count("*").over(over)).drop("_at")


def backoff_delays(spark: SparkSession, max_retries: int = 3, factor: float = 0.5) -> DataFrame:
    """(attempt, delay): the wait before each retry, without jitter (which scales it by
    0.5 to 1.5)."""
    return spark.range(max_retries).select((F.col("id") + 1).cast("int").alias("attempt"), (F.lit(factor) * F.pow(F.lit(2.0), F.col("id"))).alias("delay"))
