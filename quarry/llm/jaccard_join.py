"""N-gram Jaccard join: which documents share at least P percent of their shingles.

Plan, for word shingles and a threshold P:

1. One pass turns each text into its sorted set of hashed shingles (staged). Equal
   sets are one node from here on, so copies cost nothing more.
2. Prefix filter: two sets that link share a shingle among the first
   ``n - ceil(P n) + 1`` of each under any one total order. The order puts shingles of
   common words late and those that many documents hold last (by mergeable summaries
   of the most frequent words and shingles of all documents); any order is exact, this
   one keeps the tiles small. One shuffle sorts
   the prefixes by shingle and size; entries without a neighbour of fitting size go.
3. Tiles: the sets that share a prefix shingle, banded by size (sizes must be within
   P percent). Hashed bitmaps bound the overlap from above by bit counts:
   ``|A and B| <= |A| - popcount(a & ~b)``. A tile keeps a spanning forest of the pairs
   that the bound lets through, never all pairs. Tiles above ``TILE`` sets are cut into
   blocks by size band and hash: each block gives its forest, then one set of each
   component found meets those of the other blocks, and only blocks that are still apart,
   in bands near enough to link, meet in pairs.
4. Components of these forests are clusters that hold every possible link. Each set
   goes to its one cluster, where exact intersections of the sorted arrays decide.
   Clusters above ``BLOCK`` sets are cut into blocks and compared in the same three
   steps: exact at any size.

Shingles are compared by hashes of 58 bits, sets by digests of 128.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.bytewords import arrow_rows, begin_work, mix, release_memory, shingle_sets, slices
from quarry.llm.components import connected_components
from quarry.llm.runs import runs
from quarry.plans.staging import scope, stage

#: Most sets that one task compares at once, exactly and by bitmaps.
BLOCK = 4096
TILE = 512
#: Documents that hold a shingle from which its entries aren't sorted to find neighbours.
HOT_SHINGLE = 65_536
#: Most ids that are broadcast (16 MB); beyond it the same join shuffles.
BROADCAST_IDS = 2_000_000
#: Entries of the heavy-hitter summary that orders shingles.
HEAVY = 262_144
#: Words of the summary that orders shingles.
WORDS = 4096
_CHUNK = 1_000_000


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _top(found: DataFrame, capacity: int) -> list[tuple[int, int]]:
    """The ``capacity`` greatest sums of partial counts (h, c)."""
    top = found.groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(capacity)
    return [(r.h, r.c) for r in top.collect()]


def _counted(held: list[np.ndarray], least: int) -> pa.RecordBatch:
    h, c = np.unique(np.concatenate(held), return_counts=True)
    keep = c >= least
    return pa.RecordBatch.from_arrays([pa.array(_signed(h[keep])), pa.array(c[keep].astype(np.int64))], names=["h", "c"])


def common_words(texts: DataFrame, capacity: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent words of all texts, and a level of 1 to 15 for
    each: half as frequent is one level less."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch.column(0)):
                starts, ends, _ = part.words()
                held.append(part.word_hashes(starts, ends, lower=True))
                size += len(starts)
                if size >= _CHUNK:
                    yield _counted(held, size // 100_000)
                    held, size = [], 0
        if held:
            yield _counted(held, max(2, size // 100_000))

    top = _top(texts.mapInArrow(work, "h long, c long"), capacity)
    h, c = np.array([x for x, _ in top], np.int64).view(np.uint64), np.array([y for _, y in top], float)
    order = np.argsort(h)
    return h[order], np.clip(15 - np.floor(np.log2(c.max(initial=1) / c[order])), 1, 15).astype(np.uint64)


def shingle_table(docs: DataFrame, id_col: str, text_col: str, width: int, label: str) -> DataFrame:
    """Staged (k, n, d1, d2, row, shingles): a row for each document."""
    source = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    fields = [source.schema["k"], T.StructField("n", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("shingles", T.BinaryType())]
    shared = docs.sparkSession.sparkContext.broadcast(common_words(source.select("t")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_work("jaccard")
        for batch in batches:
            ids = batch.column(0)
            for part in slices(batch.column(1)):
                sets, _ = shingle_sets(part, width, shared.value)
                raw = [s.tobytes() for s in sets]
                digests = np.array([divmod(xxhash.xxh3_128_intdigest(x), 1 << 64) for x in raw], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.first, part.last - part.first), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(digests[:, 0].copy())), pa.array(_signed(digests[:, 1].copy())), pa.array(raw, pa.binary())],
                    names=["k", "n", "d1", "d2", "shingles"],
                )
        release_memory()

    return stage(source.mapInArrow(work, T.StructType(fields)).withColumn("row", F.monotonically_increasing_id()), f"{label}-sets")


def _with_set_id(sets: DataFrame) -> DataFrame:
    """Adds sid, a long that is one per distinct set; null for empty sets.

    sid is half of the digest. Sets that differ and agree in that half are found
    exactly and told apart by the other half (expected: n * n / 2**65 of them).
    """
    clash = [r[0] for r in sets.where("n > 0").groupBy("d1").agg(F.min("d2").alias("x"), F.max("d2").alias("y")).where("x <> y").select("d1").take(100_001)]
    if len(clash) > 100_000:
        raise RuntimeError("more than 100,000 digests collide: the digest is broken")
    sid = F.when(F.col("d1").isin(clash), F.xxhash64("d1", "d2")).otherwise(F.col("d1")) if clash else F.col("d1")
    return sets.withColumn("sid", F.when(F.col("n") > 0, sid))


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in column]


def heavy_shingles(sets: DataFrame, capacity: int = HEAVY) -> list[tuple[int, int]]:
    """(shingle, count) of the most frequent shingles over all documents.

    Every chunk of the data reports the shingles in a thousandth of its documents (and
    2 at least); the counts are summed and the ``capacity`` greatest are kept.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for x in _arrays(batch.column(0)):
                held.append(x)
                size += len(x)
                if size >= _CHUNK:
                    yield _counted(held, max(2, len(held) // 1000))
                    held, size = [], 0
        if held:
            yield _counted(held, max(2, len(held) // 1000))

    return _top(sets.select("shingles").mapInArrow(work, "h long, c long"), capacity)


def _prefixes(sets: DataFrame, heavy: list[tuple[int, int]], percent: int) -> DataFrame:
    """(token, sid, n) of each set's prefix."""
    ranks = {np.uint64(h & (1 << 64) - 1): i for i, (h, _) in enumerate(sorted(heavy, key=lambda x: (x[1], x[0])))}
    hot = np.sort(np.array(list(ranks), np.uint64))
    rank = np.array([ranks[h] for h in hot], np.int64)
    shared = sets.sparkSession.sparkContext.broadcast((hot, rank))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank = shared.value
        for batch in batches:
            tokens, lengths = [], []
            for x in _arrays(batch.column(1)):
                k = len(x) + (-percent * len(x) // 100) + 1
                if len(hot):
                    at = np.minimum(np.searchsorted(hot, x), len(hot) - 1)
                    is_hot = hot[at] == x
                    if is_hot.any():
                        cold = x[~is_hot]
                        if len(cold) < k:
                            cold = np.concatenate((cold, x[is_hot][np.argsort(rank[at[is_hot]])]))
                        x = cold
                tokens.append(x[:k])
                lengths.append(min(k, len(x)))
            if tokens:
                sid = np.repeat(batch.column(0).to_numpy(), lengths)
                n = np.repeat(batch.column(2).to_numpy(), lengths)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(tokens))), pa.array(sid), pa.array(n.astype(np.int32))], names=["token", "sid", "n"])
        release_memory()

    return sets.select("sid", "shingles", "n").mapInArrow(work, "token long, sid long, n int")


def bitmap(shingles: np.ndarray, per_shingle: int) -> np.ndarray:
    """A bitmap of a power of two of bits, ``per_shingle`` or more for each shingle."""
    bits = 1 << max(6, int(per_shingle * len(shingles) - 1).bit_length())
    on = np.zeros(bits, bool)
    on[(mix(shingles) & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little")


class Tile:
    """Sets in ascending size with their bitmaps; labels join those found linked."""

    def __init__(self, sizes: np.ndarray, bitmaps: list[bytes], percent: int, labels: np.ndarray | None = None):
        self.n, self.percent = sizes.astype(np.int64), percent
        self.label = np.arange(len(sizes)) if labels is None else labels.copy()
        widths = np.array([len(b) for b in bitmaps])
        self.parts = [(w, a[0], a[-1] + 1, np.frombuffer(b"".join(bitmaps[a[0] : a[-1] + 1]), np.uint64).reshape(len(a), -1)) for w in np.unique(widths) for a in [np.flatnonzero(widths == w)]]
        self.bitmaps, self.width = bitmaps, widths

    def bounds(self, i: int, js: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlap of set i with each of js, all of them before i."""
        out = np.zeros(len(js), np.int64)
        mine = np.frombuffer(self.bitmaps[i], np.uint64)
        for w, a, b, rows in self.parts:
            at = (js >= a) & (js < b)
            if at.any():
                own = np.bitwise_or.reduce(mine.reshape(-1, w // 8), axis=0)  # a wider bitmap folds to a narrower one
                theirs = rows[js[at] - a]
                only_i = np.bitwise_count(own & ~theirs).sum(axis=1)
                only_j = np.bitwise_count(theirs & ~own).sum(axis=1)
                out[at] = np.minimum(self.n[i] - only_i, self.n[js[at]] - only_j)
        return out

    def link(self, exact=None) -> list[tuple[int, int]]:
        """Joins labels, and returns a spanning forest, of the pairs that can link (or,
        given ``exact(i, j)``, of those for which it holds). Pairs whose labels agree
        already are skipped."""
        forest, p = [], self.percent
        for i in range(1, len(self.n)):
            js = np.arange(np.searchsorted(self.n, -(-p * self.n[i] // 100)), i)
            step = 8
            while len(js := js[self.label[js] != self.label[i]]):
                now, js = js[:step], js[step:]
                step *= 16
                most = self.bounds(i, now)
                fits = most * (100 + p) >= p * (self.n[i] + self.n[now])
                for j in now[fits][np.argsort(-most[fits], kind="stable")]:
                    if self.label[j] != self.label[i] and (exact is None or exact(i, j)):
                        forest.append((i, int(j)))
                        self.label[self.label == self.label[j]] = self.label[i]
        return forest


def _pair_can_link(n1: int, b1: bytes, n2: int, b2: bytes, percent: int) -> bool:
    """Tile.link for the common tile of two, in plain integers."""
    if n1 > n2:
        n1, b1, n2, b2 = n2, b2, n1, b1
    if 100 * n1 < percent * n2:
        return False
    if len(b2) > len(b1):
        b2 = np.bitwise_or.reduce(np.frombuffer(b2, np.uint8).reshape(-1, len(b1)), axis=0).tobytes()
    x, y = int.from_bytes(b1, "little"), int.from_bytes(b2, "little")
    both = x & y
    most = min(n1 - (x ^ both).bit_count(), n2 - (y ^ both).bit_count())
    return most * (100 + percent) >= percent * (n1 + n2)


def _bounded(dealt: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Edges (a, b): in each group of ``keys`` a forest of the pairs that can link.

    dealt: keys, sid, n, bits and mark; sets of equal mark are joined already."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, keys):
            sid, n, mark, bits = table.column("sid").to_numpy(), table.column("n").to_numpy(), table.column("mark").to_numpy(), table.column("bits")
            edges = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a == 2:
                    if mark[a] != mark[a + 1] and _pair_can_link(int(n[a]), bits[a].as_py(), int(n[a + 1]), bits[a + 1].as_py(), percent):
                        edges.append((sid[a], sid[a + 1]))
                elif b - a > 2:
                    tile = Tile(n[a:b], bits[a:b].to_pylist(), percent, np.unique(mark[a:b], return_inverse=True)[1])
                    edges += [(sid[a + i], sid[a + j]) for i, j in tile.link()]
            pairs = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        release_memory()

    return dealt.select(*keys, "sid", "n", "mark", "bits").repartition(*keys).sortWithinPartitions(*keys, "n", "sid").mapInArrow(work, "a long, b long")


def _paired(rows: DataFrame, key: str, near=None) -> DataFrame:
    """rows (key, block, mark, ...) once for each pair (i, j) of blocks of its key that aren't
    of one and the same mark (and for which ``near(i, j)`` holds)."""
    spread = rows.groupBy(key, "block").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi"))
    left, right = spread.select(key, F.col("block").alias("i"), F.col("lo").alias("li"), F.col("hi").alias("hi_")), spread.select(key, F.col("block").alias("j"), F.col("lo").alias("lj"), F.col("hi").alias("hj"))
    apart = (F.col("i") < F.col("j")) & (F.least("li", "lj") < F.greatest("hi_", "hj"))
    pairs = left.join(right, key).where(apart if near is None else apart & near(F.col("i"), F.col("j"))).select(key, "i", "j")
    ends = pairs.withColumn("block", F.explode(F.array("i", "j")))
    return rows.join(ends, [key, "block"])


def _marked(rows: DataFrame, stars: DataFrame) -> DataFrame:
    """rows with ``mark``: the component of each sid, or the sid itself."""
    return rows.drop("mark").join(stars.withColumnsRenamed({"node": "sid", "component": "mark"}), "sid", "left").withColumn("mark", F.coalesce("mark", "sid"))


def _dealt(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows (key, sid, ...) with ``hand``, which cuts each key into parts of about ``most``."""
    hands = rows.groupBy(key).agg(F.ceil(F.count("*") / most).cast("long").alias("hands"))
    return rows.join(hands, key).withColumn("hand", F.pmod(F.xxhash64("sid", F.lit(1)), F.col("hands"))).drop("hands")


def _candidates(distinct: DataFrame, percent: int, label: str) -> DataFrame:
    """(node, component) of set ids: components that hold every link; each set once in."""
    heavy = heavy_shingles(distinct)
    hot = [h for h, c in heavy if c > HOT_SHINGLE]
    posted = _prefixes(distinct, heavy, percent)
    by_size = Window.partitionBy("token").orderBy("n", "sid")
    fits = (F.lag("n").over(by_size) * 100 >= F.col("n") * percent) | (F.lead("n").over(by_size) * percent <= F.col("n") * 100)
    if hot:  # known ones, so a list of bounded length: their entries all stay
        listed = distinct.sparkSession.createDataFrame([(h,) for h in hot], "token long")
        cold, warm = posted.join(F.broadcast(listed), "token", "left_anti"), posted.join(F.broadcast(listed), "token", "left_semi")
        posted = cold.withColumn("fits", fits).where("fits").select("token", "sid", "n").unionByName(warm)
    else:
        posted = posted.withColumn("fits", fits).where("fits").select("token", "sid", "n")
    tiles = stage(posted, f"{label}-tiles")
    # two near copies share many shingles: of tiles with the same members one is enough
    members = tiles.groupBy("token").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y"))
    one = stage(members.groupBy("c", "x", "y").agg(F.min("token").alias("token")).select("token", "c"), f"{label}-tokens")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signed = [bitmap(x, 2).tobytes() for x in _arrays(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(signed, pa.binary())], names=["sid", "n", "bits"])
        release_memory()

    signed = distinct.select("sid", "n", "shingles").mapInArrow(sign, "sid long, n long, bits binary")
    small = tiles.select("token", "sid").join(one.where(F.col("c") <= TILE).select("token"), "token", "left_semi").join(signed, "sid")
    edges = _bounded(small.withColumn("mark", F.col("sid")), ["token"], percent)
    large = one.where(F.col("c") > TILE)
    if large.isEmpty():
        return connected_components(edges, f"{label}-clusters")
    # a band holds the sizes up to one link's ratio, so links are in one band or the next
    band = F.floor(F.log(F.col("n").cast("double")) / -math.log(percent / 100)).cast("long") if percent < 100 else F.col("n").cast("long")
    entries = stage(tiles.join(_small(large.select("token")), "token").withColumn("band", band), f"{label}-entries")
    counts = entries.groupBy("token", "band").agg(F.ceil(F.count("*") / TILE).cast("long").alias("salts"))
    block = F.col("band") * (1 << 32) + F.pmod(F.xxhash64("sid"), F.col("salts"))
    entries = stage(entries.join(_small(counts), ["token", "band"]).select("token", "sid", block.alias("block")).join(signed, "sid").withColumn("mark", F.col("sid")), f"{label}-blocks")
    found = edges.unionByName(_bounded(entries, ["token", "block"], percent))
    near = lambda i, j: F.abs(F.shiftright(i, 32) - F.shiftright(j, 32)) <= 2  # noqa: E731  a band of slack for rounding
    for step in ("leaders", "rest"):
        stars = stage(connected_components(found, f"{label}-{step}"), f"{label}-{step}-stars")
        marked = _marked(entries, stars)
        apart = stage(marked.groupBy("token").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("token"), f"{label}-{step}-apart")
        if apart.isEmpty():
            return stars
        marked = marked.join(_small(apart), "token")
        if step == "leaders":
            first = marked.groupBy("token", "mark").agg(F.min(F.struct("sid", "n", "bits")).alias("s")).select("token", "mark", "s.*")
            more = _bounded(_dealt(first, "token", TILE), ["token", "hand"], percent)
        else:
            more = _bounded(_paired(marked, "token", near), ["token", "i", "j"], percent)
        found = stage(stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), f"{label}-{step}-found")
    return connected_components(found, f"{label}-clusters")


def _exact(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Edges (a, b): a spanning forest of the true links in each group of ``keys``.

    members: keys, sid, n, shingles and mark; sets of equal mark are known to be
    joined. A set can be in many groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in runs(batches, keys):
            sid, n, mark = (table.column(c).to_numpy() for c in ("sid", "n", "mark"))
            shingles = table.column("shingles")
            edges = []
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a > 1:
                    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in shingles[a:b]]
                    tile = Tile(n[a:b], [bitmap(x, 8).tobytes() for x in sets], percent, np.unique(mark[a:b], return_inverse=True)[1])

                    def holds(i: int, j: int, sets=sets) -> bool:
                        both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                        return both * (100 + percent) >= percent * (len(sets[i]) + len(sets[j]))

                    edges += [(sid[a + i], sid[a + j]) for i, j in tile.link(holds)]
            pairs = np.array(edges, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        release_memory()

    dealt = members.select(*keys, "sid", "n", "mark", "shingles").repartition(*keys).sortWithinPartitions(*keys, "n", "sid")
    return dealt.mapInArrow(work, "a long, b long")


def _small(ids: DataFrame) -> DataFrame:
    """For the narrow side of a join: broadcast if its counted rows are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _links(distinct: DataFrame, percent: int, label: str, block: int) -> DataFrame:
    """(node, component) of the sets that link with another set."""
    clusters = _candidates(distinct, percent, label)
    of = stage(clusters.select(F.col("node").alias("sid"), F.col("component").alias("cluster")), f"{label}-members")
    sizes = of.groupBy("cluster").agg(F.count("*").alias("m"))
    members = distinct.select("sid", "n", "shingles").join(_small(of), "sid")
    large = stage(sizes.where(F.col("m") > block), f"{label}-large")
    if large.isEmpty():
        edges = _exact(members.withColumn("mark", F.col("sid")), ["cluster"], percent)
        return connected_components(edges, f"{label}-links")
    members = members.join(large, "cluster", "left").withColumn("blocks", F.ceil(F.coalesce("m", F.lit(1)) / block).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("mark", F.col("sid"))
    within = stage(_exact(members, ["cluster", "block"], percent), f"{label}-within")
    cut = members.where("blocks > 1").drop("mark")
    known = within
    for step in ("leaders", "rest"):
        open_sets = _marked(cut, connected_components(known, f"{label}-{step}"))
        if step == "leaders":
            found = _exact(_dealt(open_sets.where("sid = mark"), "cluster", block), ["cluster", "hand"], percent)
        else:
            apart = open_sets.groupBy("cluster").agg(F.min("mark").alias("x"), F.max("mark").alias("y")).where("x <> y").select("cluster")
            found = _exact(_paired(open_sets.join(apart, "cluster"), "cluster"), ["cluster", "i", "j"], percent)
        known = stage(known.unionByName(found), f"{label}-known-{step}")
    return connected_components(known, f"{label}-links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85, label: str = "jaccard", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id) for each row of ``docs``.

    Texts are lowered in A-Z and cut into words at spaces and 0x09-0x0D; the set of a
    text holds its distinct shingles of ``width`` words, or its whole word sequence as
    one shingle if it is shorter. Documents link when ``100 * |A and B| >= percent *
    |A or B|``; ``component_id`` is the least id reachable by links.

    Null and empty texts (and texts of white space) have no shingles and link with
    nothing: their component is their own id. Rows may repeat ids or be repeated;
    every row is returned. A null id stays null, and doesn't count as the least. Ties
    can't change the result. Other columns of ``docs`` are ignored, whatever their
    names. An empty table gives an empty result.
    """
    with arrow_rows(docs.sparkSession, 1000), scope(docs.sparkSession) as own:
        sets = _with_set_id(shingle_table(docs, id_col, text_col, width, label))
        firsts = sets.where("n > 0").groupBy("sid").agg(F.min("row").alias("row"))
        copies = stage(sets.where("n > 0").select("row").join(firsts, "row", "left_anti"), f"{label}-copies")
        distinct = sets.where("n > 0").join(_small(copies), "row", "left_anti")
        links = _links(distinct, percent, label, block)
        classes = sets.select("k", "n", "sid").join(links.withColumnRenamed("node", "sid"), "sid", "left").withColumn("class", F.coalesce("component", "sid")).select("k", "n", "class")
        classes = own.keep(stage(classes, f"{label}-classes"))
        least = own.keep(stage(classes.where("class is not null").groupBy("class").agg(F.min("k").alias("least")), f"{label}-least"))
    out = classes.join(least, "class", "left")
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least", "k").alias("component_id"))
