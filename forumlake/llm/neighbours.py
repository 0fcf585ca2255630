"""Approximate nearest neighbours by collision-counting hashing.

Vectors are projected on PROJECTIONS random lines. An index block keeps for each
line the projections of its vectors, sorted, and every vector's place among
them, so that no buckets are needed. A query opens in every array a window
around its own projection; virtual rehashing widens all windows by RATIO until
enough vectors of the block have fallen into THRESHOLD of the arrays or more,
and those are verified: the exact cosine in double precision on the original
vectors. The first width is near what vectors of the block themselves need. All
rows are in the index, in blocks of bounded size; queries come in blocks of
bounded size that are broadcast, one pass over the index each, since shuffling
the index to as many blocks of queries would move it as often; a block of the
index answers with its nearest few for each query, and these are ranked by query.

Defined results: vectors that are null, zero or hold a null or a number that
isn't finite take no part; vectors of another dimension than the query are no
candidates; rows with a null vec_id take no part; of rows with one vec_id the
best counts once, whether they are asked or found; without candidates a query
returns no row, with fewer than k all; ties go to the smaller vec_id; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

#: Lines; arrays in which a vector has to fall into the window; growth of windows; vectors of a block that tell the first width.
PROJECTIONS, THRESHOLD, RATIO, SAMPLE = 256, 200, 1.1, 8
#: Vectors verified in a block at least, and as a share of it; vectors of a block at most; queries in a block.
VERIFIED, SHARE, BLOCK, QUERIES = 100, 0.02, 20_000, 8192


def lines(dimension: int) -> np.ndarray:
    return np.random.default_rng(dimension).standard_normal((dimension, PROJECTIONS))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the batch's usable rows for each dimension."""
    column = batch.column("embedding")
    ids, sizes = batch.column("vec_id").to_numpy(zero_copy_only=False), np.diff(np.asarray(column.offsets))
    usable = ~np.array([x is None for x in column.to_pylist()], dtype=bool) if column.null_count else np.ones(len(ids), dtype=bool)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null number becomes NaN
    starts = np.asarray(column.offsets)[:-1]
    for d in np.unique(sizes[usable & (sizes > 0)]):
        rows = np.flatnonzero(usable & (sizes == d))
        vectors = values[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
        if good.any():
            yield ids[rows][good].astype(np.int64), vectors[good]


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors divided by powers of two near their largest number, which keeps cosines and avoids overflow, and their norms."""
    exponent = np.frexp(np.abs(vectors).max(axis=1))[1]
    even = np.ldexp(vectors, -exponent[:, None])
    return even, np.sqrt((even * even).sum(axis=1))


def wanted(n: int) -> int:
    """Vectors of a block that are verified for a query at least."""
    return min(n, max(VERIFIED, int(SHARE * n)))


def first_width(projected: np.ndarray) -> float:
    """Somewhat less than the width at which windows around some of the block's own vectors hold as many as are wanted."""
    n = projected.shape[1]
    found = []
    for i in np.linspace(0, n - 1, min(n, SAMPLE)).astype(int):
        met = np.partition(np.abs(projected - projected[:, i : i + 1]), THRESHOLD - 1, axis=0)[THRESHOLD - 1]
        found.append(np.partition(met, wanted(n) - 1)[wanted(n) - 1])
    return max(float(np.median(found)) * 0.95, 1e-3)


def build_index(vectors: DataFrame) -> DataFrame:
    """One row for each block: dimension, ids, vectors, the sorted projections and the vectors' places on each line, and the first width."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for all_ids, all_found in _groups(batch):
                for a in range(0, len(all_ids), BLOCK):
                    ids, found = all_ids[a : a + BLOCK], all_found[a : a + BLOCK]
                    even, norms = scaled(found)
                    projected = np.ascontiguousarray(((even / norms[:, None]) @ lines(found.shape[1])).T.astype(np.float32))
                    order = np.argsort(projected, axis=1, kind="stable")
                    places = np.empty(order.shape, dtype=np.uint16)
                    np.put_along_axis(places, order, np.arange(len(ids), dtype=np.uint16)[None, :], axis=1)
                    data = [ids, found, np.take_along_axis(projected, order, axis=1), places]
                    columns = [pa.array([found.shape[1]], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in data), pa.array([first_width(projected)])]
                    yield pa.RecordBatch.from_arrays(columns, ["dimension", "ids", "vectors", "sorted", "places", "width"])

    rows = vectors.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return cut(rows.mapInArrow(block, "dimension int, ids binary, vectors binary, sorted binary, places binary, width double"), "index")


class Block:
    """One block of the index in memory."""

    def __init__(self, dimension: int, ids: bytes, vectors: bytes, sorted: bytes, places: bytes, width: float):  # noqa: A002
        self.ids = np.frombuffer(ids, dtype=np.int64)
        self.vectors, self.norms = scaled(np.frombuffer(vectors, dtype=np.float64).reshape(-1, dimension))
        self.sorted = np.frombuffer(sorted, dtype=np.float32).reshape(PROJECTIONS, -1)
        self.places = np.frombuffer(places, dtype=np.uint16).reshape(PROJECTIONS, -1)
        self.lines, self.width = lines(dimension), width
        self.distinct, self.which = np.unique(self.ids, return_inverse=True)

    def _counts(self, counts: np.ndarray, query_id: int) -> np.ndarray:
        """The collisions of each other id of the block: of a repeated one the most of its rows."""
        of_id = np.zeros(len(self.distinct), dtype=counts.dtype)
        np.maximum.at(of_id, self.which, counts)
        return of_id[self.distinct != query_id]

    def candidates(self, projected: np.ndarray, query_ids: np.ndarray) -> list[np.ndarray]:
        """For each query, given its projections, the rows that collide with it in THRESHOLD arrays or more, as soon as they are as many as are wanted.

        In a block with repeated ids the other ids are counted and not the rows."""
        repeated = len(self.distinct) < len(self.ids)
        target, width, active = wanted(len(self.ids)), self.width, np.arange(len(projected))
        found: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(projected)
        while len(active):
            at = projected[active].T.astype(np.float32)
            low = np.stack([np.searchsorted(s, x - width) for s, x in zip(self.sorted, at)], axis=1)
            size = np.stack([np.searchsorted(s, x + width, side="right") for s, x in zip(self.sorted, at)], axis=1) - low
            left = []
            for i, q in enumerate(active):
                # A place below the window wraps round to a large number.
                inside = (self.places - low[i, :, None].astype(np.uint16)) < size[i, :, None].astype(np.uint16)
                counts = np.add.reduce(inside, axis=0, dtype=np.uint16)
                of_id = self._counts(counts, query_ids[q]) if repeated else counts
                n, most = len(of_id), min(target, len(of_id))
                if np.count_nonzero(of_id >= THRESHOLD) >= most:
                    # If the last widening let in many more, the highest threshold that leaves as many as are wanted.
                    found[q] = np.flatnonzero(counts >= max(THRESHOLD, np.partition(of_id, n - most)[n - most])) if most else found[q]
                else:
                    left.append(q)
            active, width = np.array(left, dtype=np.int64), width * RATIO
        return found

    def nearest(self, query_ids: np.ndarray, queries: np.ndarray, norms: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the nearest few for each query."""
        for a in range(0, len(queries), 256):
            some = slice(a, a + 256)
            for rows, query_id, query, norm in zip(self.candidates((queries[some] / norms[some, None]) @ self.lines, query_ids[some]), query_ids[some], queries[some], norms[some]):
                rows = rows[self.ids[rows] != query_id]
                scores = (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)
                best = np.lexsort((self.ids[rows], -scores))
                best = best[np.sort(np.unique(self.ids[rows][best], return_index=True)[1])[:k]]  # the best row of each id
                yield self.ids[rows][best], scores[best]


def search_block(spark: SparkSession, index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score): the nearest few of every block of the index for one block of queries."""
    known = spark.sparkContext.broadcast((ids, *scaled(queries)))  # at most QUERIES vectors

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors, norms = known.value
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(**row)
                found = list(block.nearest(query_ids, vectors, norms, k))
                owner = np.repeat(query_ids, [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([s for _, s in found]))], ["query_id", "vec_id", "score"])

    return index.filter(F.col("dimension") == queries.shape[1]).mapInArrow(answer, "query_id long, vec_id long, score double")


def nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k nearest of vectors, other than itself."""
    index = build_index(vectors)
    asked = queries.filter("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    asked = cut(asked, "queries")
    found = spark.createDataFrame([], "query_id long, vec_id long, score double")
    waiting: dict[int, list[tuple[int, list[float]]]] = {}

    def send(dimension: int) -> None:
        nonlocal found
        block = waiting.pop(dimension)
        ids, rows = np.array([i for i, _ in block], dtype=np.int64), np.array([v for _, v in block], dtype=np.float64)
        found = found.unionByName(cut(search_block(spark, index, ids, rows, k), "found"))

    for row in asked.toLocalIterator():  # a block of queries at a time
        v = row.embedding
        if v and None not in v and np.isfinite(v).all() and any(v):
            waiting.setdefault(len(v), []).append((row.vec_id, v))
            if len(waiting[len(v)]) == QUERIES:
                send(len(v))
    for dimension in list(waiting):
        send(dimension)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
