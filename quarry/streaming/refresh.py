"""Streams: source files that arrive refresh the graph, requests are admitted by rate."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.functions.text import language_of_path
from quarry.sources.store import GraphStore, rebuild, stale_only


def watch_files(spark: SparkSession, root: str, glob: str = "*.py") -> DataFrame:
    """A stream of FILES rows for files that appear below a directory. Spark's file streams leave out
    names that begin with an underscore or a dot; a build of the directory brings those."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:(//(?=/))?", "")
    return raw.select(path.alias("file_path"), language_of_path(path).alias("language"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"))


def refresh_graph(files: DataFrame, store: GraphStore, checkpoint: str, resolve_scope: str = "file"):
    """Starts the stream: each micro-batch replaces the rows of its files. A batch that is
    repeated after a failure finds the hashes of its files stored and writes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        rebuild(store, stale_only(store, batch), resolve_scope)

    return files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Window:
    """A client's sliding log, in microseconds: which of its requests are admitted, in the order of time."""

    def __init__(self, limit: int, length: int, admitted: list[int]):
        self.limit, self.length, self.admitted = limit, length, admitted

    def admit(self, at: int) -> int:
        """0 if fewer than ``limit`` were admitted in the window before, else how long it is until the
        oldest of them leaves it."""
        self.admitted = [x for x in self.admitted if at - x < self.length]
        if len(self.admitted) >= self.limit:
            return self.length - (at - self.admitted[0])
        self.admitted.append(at)
        return 0


def admit_requests(requests: DataFrame, limit: int = 30, window_seconds: float = 60.0, delay_seconds: float = 10.0) -> DataFrame:
    """(client, at, admitted, wait): a sliding log per client over a stream of (client string, at
    double, in seconds). A request is admitted if fewer than ``limit`` were admitted in the window
    before it, else it would wait until the oldest of them leaves it.

    Requests are held until the watermark, ``delay_seconds`` behind the latest one, has passed them, and
    judged in the order of their times: however the stream is cut into batches, the answers are the
    same, as long as no request comes later than that; later ones are left out. A client's state goes
    when a window has passed without requests. Null clients are one client; null times are left out."""
    length = round(window_seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, log = (list(x) for x in state.get) if state.exists else ([], [])
        for batch in batches:
            held += batch["micros"].tolist()
        watermark = state.getCurrentWatermarkMs()
        ready = sorted(x for x in held if x <= watermark * 1000)
        held = [x for x in held if x > watermark * 1000]
        window = Window(limit, length, log)
        waits = [window.admit(at) for at in ready]
        yield pd.DataFrame({"client": [key[0]] * len(ready), "at": [x / 1e6 for x in ready], "admitted": [not w for w in waits], "wait": [w / 1e6 for w in waits]})
        ends = min(held) if held else max(window.admitted, default=0) + length
        if held or ends > watermark * 1000:
            state.update((held, window.admitted))
            state.setTimeoutTimestamp(max(-(-ends // 1000), watermark + 1))
        elif state.exists:
            state.remove()

    micros = F.round(F.col("at") * 1_000_000).cast("long")
    timed = requests.where("at is not null").select("client", micros.alias("micros")).withColumn("time", F.timestamp_micros("micros")).withWatermark("time", f"{round(delay_seconds * 1000)} milliseconds")
    return timed.groupBy("client").applyInPandasWithState(step, "client string, at double, admitted boolean, wait double", "held array<long>, log array<long>", "append", GroupStateTimeout.EventTimeTimeout)
