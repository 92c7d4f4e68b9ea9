"""Cut lineage with Parquet tables in the folder that driver and executors share.

A staged table survives the loss of any executor: later stages read files, never
blocks that live on one machine.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where the setting is absent and the master is local (single-machine tests) a temporary
    folder is used, one per application. On a cluster each machine would write to a disk of
    its own, and later reads would miss rows, so there the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="quarry-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scope:
    """The tables that are staged while it is open; those not kept are deleted at its end."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def keep(self, df: DataFrame) -> DataFrame:
        """``df``, a staged table, outlives the scope."""
        self.paths.remove(df._staged)
        return df


_OPEN = threading.local()


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """Deletes at its end what was staged inside by this thread and not kept. What is
    returned from inside must read kept tables only."""
    around, own = getattr(_OPEN, "scope", None), Scope(spark)
    _OPEN.scope = own
    try:
        yield own
    finally:
        _OPEN.scope = around
        for path in own.paths:
            _delete(spark, path)


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing will read again."""
    own = getattr(_OPEN, "scope", None)
    if own and df._staged in own.paths:
        own.paths.remove(df._staged)
    _delete(df.sparkSession, df._staged)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a DataFrame over the files.

    The folder is removed by ``drop``, at the end of the scope that is open, or when the
    application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{label}-{uuid.uuid4().hex}"
    own = getattr(_OPEN, "scope", None)
    if own:
        own.paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out
