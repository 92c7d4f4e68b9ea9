"""Exact top-k by inner product with a vector-approximation file.

Every dimension is cut into ``CELLS`` cells at quantiles of a sample (at most ``SAMPLE``
vectors: the cells only affect speed). The approximation file is written once: blocks of
``BLOCK`` vectors, each component as the number of its cell, with the least and greatest
value that each dimension has in the block. The sum over dimensions of a query's component
times the middle of the cell, give or take its magnitude times half of the cell's width,
bounds an inner product from both sides; rounding is allowed for by the product of norms,
so bounds hold under cancellation.

1. The scan reads the approximation file only. Queries are dealt into groups, blocks into
   lanes; a task meets one group with the blocks of one lane, which stream by, and keeps
   for each query the candidates whose upper bound reaches its kth lower bound so far.
   There are as many lanes as the cluster can use: more query groups, fewer lanes.
2. Over all lanes the kth lower bound of each query leaves few candidates, numbered by
   their upper bounds.
3. Exact vectors are read for candidates only, in the order of the bounds: first ``k`` for
   each query, then those whose upper bound reaches the kth exact score so far. No other
   vector can be among the k best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.bytewords import arrow_rows
from quarry.plans.staging import stage

CELLS = 64
SAMPLE = 4096
#: Queries of a group, and vectors of a block.
QUERIES = 4096
BLOCK = 1024
#: Tasks of the scan for each core of the cluster.
TASKS_A_CORE = 2
#: Sums of magnitudes up to this are exact in doubles.
_EXACT = float(1 << 53)
_FILE = "d int, ids binary, rows binary, cells binary, ends binary"


def scaled_vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): ``floor(scale * x)`` of each component; only vectors that are whole."""
    x = F.col(vector_col)
    good = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = table.where(good).select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False)))
            raw = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    return kept.mapInArrow(work, "vec_id long, v binary")


def cell_edges(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By dimensions: inner cell edges, (CELLS - 1) x d, from the sample."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    by_size: dict[int, list[np.ndarray]] = {}
    for r in rows:
        x = np.frombuffer(r.v)
        by_size.setdefault(len(x), []).append(x)
    at = np.arange(1, CELLS) / CELLS
    return {d: np.quantile(np.array(x), at, axis=0) for d, x in by_size.items() if d}


class Approximation:
    """Cell numbers of a block of vectors of whole components (n x d), and the ends of its
    dimensions (2 x d)."""

    def __init__(self, cells: np.ndarray, ends: np.ndarray, edges: np.ndarray | None):
        self.cells, d = cells, cells.shape[1]
        inner = np.zeros((0, d)) if edges is None else np.ceil(edges)
        # components are whole numbers: a cell ends at the last one before its edge
        low, high = np.maximum(np.vstack([ends[:1], inner]), ends[0]), np.minimum(np.vstack([inner - 1, ends[1:]]), ends[1])
        high = np.maximum(low, high)
        self.middle, self.half = low / 2 + high / 2, high / 2 - low / 2

    @classmethod
    def of(cls, x: np.ndarray, edges: np.ndarray | None) -> Approximation:
        cells = np.zeros(x.shape, np.uint8)
        for j in range(x.shape[1] if edges is not None else 0):
            cells[:, j] = np.searchsorted(edges[:, j], x[:, j], "right")
        return cls(cells, np.vstack([x.min(axis=0), x.max(axis=0)]), edges)

    def bounds(self, q: np.ndarray, q_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of q @ x.T, from the cells alone; q_size is |q|."""
        dims = np.arange(self.cells.shape[1])
        middle, half = self.middle[self.cells, dims], self.half[self.cells, dims]
        about, reach = q @ middle.T, q_size @ half.T
        norms = np.linalg.norm(q, axis=1)[:, None] * (np.linalg.norm(middle, axis=1) + np.linalg.norm(half, axis=1))
        reach += 4 * (len(dims) + 4) * np.finfo(float).eps * norms
        return about - reach, about + reach


def approximation_file(vectors: DataFrame, edges: dict[int, np.ndarray], label: str) -> DataFrame:
    """Staged blocks (d, ids, rows, cells, ends) of vectors (row, vec_id, v)."""
    shared = vectors.sparkSession.sparkContext.broadcast(edges)

    def block(x: list[np.ndarray], ids: list[int], rows: list[int], d: int) -> tuple:
        made = np.array(x).reshape(len(x), d)
        approximate = Approximation.of(made, shared.value.get(d))
        ends = np.vstack([made.min(axis=0), made.max(axis=0)])
        return d, np.array(ids, np.int64).tobytes(), np.array(rows, np.int64).tobytes(), approximate.cells.tobytes(), ends.tobytes()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = {}

        def batch_of(made: tuple) -> pa.RecordBatch:
            kinds = [pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(made, kinds, strict=True)], names=["d", "ids", "rows", "cells", "ends"])

        for batch in batches:
            for row, vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = np.frombuffer(v.as_buffer())
                xs, ids, rows = held.setdefault(len(x), ([], [], []))
                xs.append(x)
                ids.append(vec_id)
                rows.append(row)
                if len(xs) == BLOCK:
                    yield batch_of(block(xs, ids, rows, len(x)))
                    del held[len(x)]
        for d, (xs, ids, rows) in held.items():
            yield batch_of(block(xs, ids, rows, d))

    return stage(vectors.select("row", "vec_id", "v").mapInArrow(work, _FILE), f"{label}-cells")


class Candidates:
    """For the queries of a group and one number of dimensions: who can be among the k best."""

    def __init__(self, ids: list[int], vectors: list[bytes], k: int):
        self.ids, self.k = np.array(ids, np.int64), k
        self.q = np.frombuffer(b"".join(vectors)).reshape(len(ids), -1)
        self.size = np.abs(self.q)
        self.floor = np.full(len(ids), -np.inf)
        self.kept = tuple(np.zeros(0, t) for t in (np.int64, float, float, np.int64))
        self.more: list[tuple] = []
        self.waiting = 0

    def meet(self, block: Approximation, vec_ids: np.ndarray, rows: np.ndarray) -> None:
        least, most = block.bounds(self.q, self.size)
        own = self.ids[:, None] == vec_ids[None, :]
        least[own], most[own] = -np.inf, -np.inf
        if len(vec_ids) > self.k and np.isinf(self.floor).any():
            self.floor = np.maximum(self.floor, -np.partition(-least, self.k - 1, axis=1)[:, self.k - 1])
        at, of = np.nonzero((most >= self.floor[:, None]) & ~own)
        self.more.append((at, least[at, of], most[at, of], rows[of]))
        self.waiting += len(at)
        if self.waiting > 4 * self.k * len(self.ids):
            self.settle()

    def settle(self) -> None:
        """Raises each floor to the kth lower bound met; drops what can't reach it."""
        at, least, most, rows = (np.concatenate(x) for x in zip(self.kept, *self.more, strict=True))
        order = np.lexsort((-least, at))
        at, least, most, rows = at[order], least[order], most[order], rows[order]
        first = np.searchsorted(at, np.arange(len(self.ids)))
        kth = first + self.k - 1
        full = (kth < len(at)) & (at[np.minimum(kth, len(at) - 1)] == np.arange(len(self.ids))) if len(at) else np.zeros(len(self.ids), bool)
        self.floor[full] = np.maximum(self.floor[full], least[kth[full]])
        near = most >= self.floor[at]
        self.kept, self.more, self.waiting = (at[near], least[near], most[near], rows[near]), [], 0


def _scan(file: DataFrame, asked: DataFrame, edges: dict[int, np.ndarray], k: int, groups: int, lanes: int) -> DataFrame:
    """(query_id, row, least, most): candidates of every lane; one shuffle, streamed."""
    shared = file.sparkSession.sparkContext.broadcast(edges)
    nothing = F.lit(None).cast("binary")
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    queries = asked.select(group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("kind"), F.col("vec_id").alias("query_id"), F.lit(0).alias("d"), F.col("v").alias("ids"), nothing.alias("rows"), nothing.alias("cells"), nothing.alias("ends"))
    lane = F.pmod(F.xxhash64(F.substring("rows", 1, 8)), F.lit(lanes)).cast("int")
    blocks = file.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), lane.alias("lane"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("query_id"), "d", "ids", "rows", "cells", "ends")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, known, asked = None, {}, {}
        names = ["query_id", "row", "least", "most"]

        def found() -> Iterator[pa.RecordBatch]:
            for c in known.values():
                c.settle()
                at, least, most, rows = c.kept
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c.ids[at], rows, least, most)], names=names)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("g", "lane", "kind", "query_id", "d")), strict=True))
            ids, rows, cells, ends = (batch.column(c) for c in ("ids", "rows", "cells", "ends"))
            for i, (g, lane, kind, query_id, d) in enumerate(keys):
                if (g, lane) != open_:
                    yield from found()
                    open_, known, asked = (g, lane), {}, {}
                raw = ids[i].as_buffer()
                if kind == 0:
                    own = asked.setdefault(len(raw) // 8, ([], []))
                    own[0].append(query_id)
                    own[1].append(raw.to_pybytes())
                    continue
                if asked:
                    known, asked = {size: Candidates(*own, k) for size, own in asked.items()}, {}
                if d in known:
                    vec_ids = np.frombuffer(raw, np.int64)
                    block = Approximation(np.frombuffer(cells[i].as_buffer(), np.uint8).reshape(len(vec_ids), d), np.frombuffer(ends[i].as_buffer()).reshape(2, d), shared.value.get(d))
                    known[d].meet(block, vec_ids, np.frombuffer(rows[i].as_buffer(), np.int64))
        yield from found()

    # a lane of a group is a partition of its own, queries first
    dealt = queries.unionByName(blocks).withColumn("part", F.col("g") * lanes + F.col("lane"))
    return dealt.repartitionById(groups * lanes, F.col("part").cast("int")).sortWithinPartitions("g", "lane", "kind").drop("part").mapInArrow(work, "query_id long, row long, least double, most double")


def exact_scores(q: list[np.ndarray], x: list[np.ndarray]) -> np.ndarray:
    """Inner products of pairs as longs (saturated at the ends of a long)."""
    out = np.zeros(len(q), np.int64)
    for i, (a, b) in enumerate(zip(q, x, strict=True)):
        if np.abs(a) @ np.abs(b) < _EXACT:
            out[i] = int(a @ b)
        else:
            out[i] = max(-(1 << 63), min((1 << 63) - 1, sum(int(u) * int(v) for u, v in zip(a, b, strict=True))))
    return out


def _read(near: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, vec_id, score) of candidates (query_id, row): their exact vectors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = exact_scores(*([np.frombuffer(v.as_buffer()) for v in batch.column(c)] for c in ("q", "v")))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores)], names=["query_id", "vec_id", "score"])

    pairs = near.select("query_id", "row").join(vectors, "row").join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    return pairs.select("query_id", "vec_id", "v", "q").mapInArrow(work, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", label: str = "search") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors for each query row.

    ``is_query`` selects the query rows by id. A query meets every vector of its own
    number of components, except those of its own id; the score is the integer inner
    product of ``floor(scale * x)``, saturated at the ends of a long. Equal scores go to
    the smaller id. Fewer candidates than k give fewer rows. Vectors that are null or
    hold null or non-finite components, and null ids, take no part; an empty vector has
    score 0 with other empty ones. Repeated ids are candidates each; as queries they
    count once (the first by components). Other columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    spark = table.sparkSession
    vectors = stage(scaled_vectors(table, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), f"{label}-vectors")
    asked = stage(vectors.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), f"{label}-queries")
    groups = max(1, -(-asked.count() // QUERIES))
    lanes = max(1, -(-TASKS_A_CORE * spark.sparkContext.defaultParallelism // groups))
    edges = cell_edges(vectors)
    file = approximation_file(vectors, edges, label)
    with arrow_rows(spark, 32):
        met = stage(_scan(file, asked, edges, k, groups, lanes), f"{label}-met")
    by_least, by_most = Window.partitionBy("query_id").orderBy(F.desc("least")), Window.partitionBy("query_id").orderBy(F.desc("most"), "row")
    floor = F.max(F.when(F.col("place") == k, F.col("least"))).over(Window.partitionBy("query_id"))
    near = met.withColumn("place", F.row_number().over(by_least)).withColumn("floor", floor).where(F.col("floor").isNull() | (F.col("most") >= F.col("floor")))
    near = stage(near.withColumn("place", F.row_number().over(by_most)).select("query_id", "row", "most", "place"), f"{label}-near")
    with arrow_rows(spark, 2048):
        first = stage(_read(near.where(F.col("place") <= k), vectors, asked), f"{label}-first")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        kth = first.withColumn("place", F.row_number().over(order)).where(F.col("place") == k).select("query_id", F.col("score").cast("double").alias("kth"))
        # scores beyond 2**53 round as doubles: a little is taken off, so that none is missed
        enough = F.col("kth") - F.abs("kth") * 1e-15
        rest = near.where(F.col("place") > k).join(kth, "query_id", "left").where(F.col("kth").isNull() | (F.col("most") >= enough))
        then = stage(_read(rest, vectors, asked), f"{label}-then")
    ranked = first.unionByName(then).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


#: The rows of the op8 query in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
