"""Approximate search by cosine: lists around trained centres, short codes of residuals, exact cosines of the best.

The centres are fitted in rounds of assigning and averaging over a sample of a
stated size, and so are the codebooks for parts of the residuals. Every vector
goes to the folder of its nearest centre, with a code of one byte for each part.
A search reads the codes of the lists nearest to each query, adds up estimates
of the inner products, and compares only a short list in full.

How many lists are probed is measured when the index is built: as many as hold
the nearest of the sample for HELD of its pairs. Data with structure need few,
data without any need most of them, and then the codes do the work.

Vectors that are null or zero, have null or non-finite numbers or another length
than the first one aren't indexed. Ids are distinct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import versions
from ..sources.store import new_folder
from .keyword import top
from .vectors import QUERIES, dot, norm

#: Lists for the square root of the number of vectors, and the least and most of them.
LISTS, LEAST_LISTS, MOST_LISTS = 1.0, 8, 4096
#: Vectors of the sample for each list, and at most; rounds of fitting.
SAMPLE_OF_LIST, SAMPLE, ROUNDS = 64, 200_000, 5
#: Numbers of a part; codes of a part.
PART, CODES = 4, 256
#: Vectors, numbers, queries and neighbours by which the number of probed lists is measured, and the share that has to be held.
MEASURED, NUMBERS, ASKED, NEAREST, HELD = 5000, 4_000_000, 200, 10, 0.98
#: The short list: so many times k, or this share of the vectors, but no more than so many times k.
SHORT, SHARE, LONG = 4, 0.02, 200
#: Vectors of a task that writes one list, about; candidates that are broadcast at most.
TASK_VECTORS, BROADCAST = 1_000_000, 1_000_000


def _matrix(column: pa.ListArray) -> np.ndarray:
    at = np.asarray(column.offsets)
    return column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)


def _parts(x: np.ndarray) -> np.ndarray:
    """(part, row, PART): the numbers in parts, filled up with zeros."""
    wide = np.zeros((len(x), -(-x.shape[1] // PART) * PART))
    wide[:, : x.shape[1]] = x
    return wide.reshape(len(x), wide.shape[1] // PART, PART).transpose(1, 0, 2)


def _fitted(sample: DataFrame, centres: np.ndarray, split) -> np.ndarray:
    """centres (part, code, number) after ROUNDS of assigning and averaging the sample's vectors (x), of which split gives the parts."""
    for _ in range(ROUNDS):

        def sums(batches: Iterator[pa.RecordBatch], centres=centres) -> Iterator[pa.RecordBatch]:
            total = np.zeros((*centres.shape[:2], centres.shape[2] + 1))
            for batch in batches:
                if batch.num_rows:
                    for part, x in enumerate(split(_matrix(batch.column("x")))):
                        np.add.at(total[part], _nearest(x, centres[part]), np.hstack([x, np.ones((len(x), 1))]))
            part, code = np.nonzero(total[:, :, -1])
            values = total[part, code]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * total.shape[2], pa.int32()), pa.array(values.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(code, pa.int32()), lists], ["part", "code", "s"])

        found = sample.mapInArrow(sums, "part int, code int, s array<double>").select("part", "code", F.posexplode("s").alias("i", "s"))
        summed = found.groupBy("part", "code", "i").agg(F.sum("s").alias("s")).toPandas()  # as many numbers as the centres have
        total = np.zeros((*centres.shape[:2], centres.shape[2] + 1))
        total[summed.part, summed.code, summed.i] = summed.s
        n = total[:, :, -1:]
        centres = np.where(n > 0, total[:, :, :-1] / np.maximum(n, 1), centres)
    return centres


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, x) of the vectors that can be indexed, of unit length."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select("vec_id", x.alias("x")).filter(sound & F.col("vec_id").isNotNull()).withColumn("size", norm(F.col("x")))
    return rows.filter("size > 0").select("vec_id", F.transform(F.array("size"), lambda n: F.transform("x", lambda v: v / n))[0].alias("x"))


@dataclass(frozen=True)
class VectorIndex:
    """rows (list, vec_id, codes, x) with centres, codebooks (part, code, number), lists that a search probes, and the number of vectors."""

    rows: DataFrame
    centres: np.ndarray
    books: np.ndarray
    probes: int
    n: int


def _probes(sample: np.ndarray, centres: np.ndarray) -> int:
    """Lists to probe so that HELD of the pairs of a vector and one of its nearest are held."""
    asked = sample[:ASKED]
    scores = asked @ sample.T
    scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-scores, axis=1)[:, : min(NEAREST, len(sample) - 1)]
    lists, order = _nearest(sample, centres), np.argsort(-(asked @ centres.T - (centres**2).sum(axis=1) / 2), axis=1)
    place = np.argsort(order, axis=1)
    ranks = np.sort(np.take_along_axis(place, lists[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(HELD * len(ranks)))]) + 1 if len(ranks) else len(centres)


def build(vectors: DataFrame, path: str) -> None:
    """Write the index of vectors (vec_id, embedding) below a path, as its next version."""
    spark, name = vectors.sparkSession, versions.draft(vectors.sparkSession, path)
    units = _units(vectors)
    first = units.select(F.size("x").alias("d")).first()
    d = first.d if first else 1
    units = units.filter(F.size("x") == d)
    n = units.count()
    lists = max(1, min(n, MOST_LISTS, max(LEAST_LISTS, round(LISTS * math.sqrt(n)))))
    wanted, mixed = min(SAMPLE, SAMPLE_OF_LIST * lists), F.xxhash64("vec_id", F.lit(17))
    kept = new_folder(spark, "sample")
    units.filter(F.pmod(mixed, F.lit(1 << 20)) <= (1 << 20) * min(1.0, wanted / max(n, 1))).write.parquet(kept)
    sample = spark.read.schema(units.schema).parquet(kept).select("vec_id", "x")
    starts = sample.orderBy(mixed, "vec_id").limit(max(lists, CODES, min(MEASURED, NUMBERS // d))).select("x").collect()
    seen = np.array([r.x for r in starts], dtype=np.float64).reshape(-1, d) if starts else np.zeros((1, d))
    lists = min(lists, len(seen))
    centres = _fitted(sample.select("x"), seen[None, :lists], lambda x: x[None])[0]

    residuals = lambda x: _parts(x - centres[_nearest(x, centres)])
    books = _fitted(sample.select("x"), residuals(seen[:CODES]), residuals)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                of = _nearest(x, centres)
                codes = np.stack([_nearest(p, b) for p, b in zip(_parts(x - centres[of]), books)], axis=1).astype(np.uint8)
                ends = pa.array(np.arange(len(x) + 1) * codes.shape[1], pa.int32())
                packed = pa.Array.from_buffers(pa.binary(), len(x), [None, ends.buffers()[1], pa.py_buffer(np.ascontiguousarray(codes).tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed, batch.column("x"), pa.array(of, pa.int32())], ["vec_id", "codes", "x", "list"])

    kind = dict(units.dtypes)["vec_id"]
    rows = units.mapInArrow(encode, f"vec_id {kind}, codes binary, x array<double>, list int")
    tasks = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, math.ceil(n / lists / TASK_VECTORS))))
    rows.repartition("list", tasks).sortWithinPartitions("list", "vec_id").write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows/{name}")
    for kept, table in (("centres", centres[None]), ("books", books)):
        flat = [(p, c, x.tolist()) for p, part in enumerate(table) for c, x in enumerate(part)]
        spark.createDataFrame(flat, "part int, code int, x array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/{kept}/{name}")
    versions.publish(spark, path, {"version": versions.number(name), "name": name, "kind": kind, "n": n, "probes": _probes(seen[:MEASURED], centres)})


def open_vectors(spark: SparkSession, path: str, version: int | None = None) -> VectorIndex:
    content = versions.read(spark, path, version)
    if content is None:
        raise ValueError(f"there is no index at {path}")

    def table(name: str) -> np.ndarray:
        rows = sorted(spark.read.parquet(f"{path}/{name}/{content['name']}").collect())
        return np.array([r.x for r in rows]).reshape(rows[-1].part + 1, rows[-1].code + 1, -1)

    rows = spark.read.schema(f"vec_id {content['kind']}, codes binary, x array<double>, list int").parquet(f"{path}/rows/{content['name']}")
    return VectorIndex(rows, table("centres")[0], table("books"), content["probes"], content["n"])


def candidates(index: VectorIndex, queries: DataFrame, short: int, probes: int | None = None) -> DataFrame:
    """(query_id, vec_id, list, estimate): the short list of each of queries (query_id, query), QUERIES at most, from the codes of its nearest lists."""
    asked = queries.select("query_id", F.transform("query", lambda v: v.cast("double")).alias("query")).limit(QUERIES + 1).collect()
    if len(asked) > QUERIES:
        raise ValueError(f"more than {QUERIES} queries: search them in parts")
    width = index.centres.shape[1]
    asked = [r for r in asked if r.query is not None and len(r.query) == width and all(v is not None and math.isfinite(v) for v in r.query) and any(r.query)]
    q = np.array([r.query for r in asked], dtype=np.float64).reshape(-1, width)
    q /= np.linalg.norm(q, axis=1, keepdims=True)
    ids, centres, books = [r.query_id for r in asked], index.centres, index.books
    nearness = q @ centres.T - (centres**2).sum(axis=1) / 2
    probed = np.argsort(-nearness, axis=1)[:, : min(len(centres), probes or index.probes)]
    of_list: dict[int, list[int]] = {}
    for i, own in enumerate(probed.tolist()):
        for x in own:
            of_list.setdefault(x, []).append(i)
    parts = _parts(q)

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        schema = None
        for batch in batches:
            schema, lists = batch.schema, batch.column("list").to_numpy()
            vec = batch.column("vec_id").to_numpy(zero_copy_only=False)
            codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, len(books))
            for x in np.unique(lists).tolist():
                rows = np.flatnonzero(lists == x)
                for i in of_list.get(x, ()):
                    # An inner product is that with the centre and, part by part, those with the residual's codes.
                    table = np.einsum("pd,pcd->pc", parts[:, i], books)
                    scores = q[i] @ centres[x] + table[np.arange(len(books)), codes[rows]].sum(axis=1)
                    held = best.get(i)
                    all_ = (vec[rows], np.full(len(rows), x, np.int32), scores)
                    all_ = tuple(map(np.concatenate, zip(held, all_))) if held else all_
                    some = np.argpartition(-all_[2], short - 1)[:short] if len(all_[2]) > short else slice(None)
                    best[i] = tuple(a[some] for a in all_)
        for i, (vec, lists, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(vec), id_type), pa.array(vec, schema.field("vec_id").type), pa.array(lists), pa.array(scores)], ["query_id", "vec_id", "list", "estimate"])

    kinds, id_kind = dict(index.rows.dtypes), dict(queries.dtypes)["query_id"]
    id_type = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[id_kind]
    rows = index.rows.filter(F.col("list").isin(sorted(of_list))).select("vec_id", "list", "codes")
    found = rows.mapInArrow(estimate, f"query_id {id_kind}, vec_id {kinds['vec_id']}, list int, estimate double")
    return top(found, short, score="estimate", key="vec_id").drop("rank")


def approximate(index: VectorIndex, queries: DataFrame, k: int, probes: int | None = None, short: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each of queries (query_id, query) by their exact cosines; ties go to the smaller id."""
    short = short or max(SHORT * k, min(math.ceil(SHARE * index.n), LONG * k))
    some = candidates(index, queries, short, probes)
    if queries.limit(QUERIES + 1).count() * short <= BROADCAST:
        some = F.broadcast(some)
    found = index.rows.select("list", "vec_id", "x").join(some.select("query_id", "vec_id", "list"), ["list", "vec_id"])
    query = F.transform("query", lambda v: v.cast("double"))
    asked = F.broadcast(queries.select("query_id", query.alias("query")))  # QUERIES at most
    score = dot(F.col("x"), F.col("query")) / norm(F.col("query"))
    return top(found.join(asked, "query_id").select("query_id", "vec_id", score.alias("score")), k, key="vec_id").select("query_id", "rank", "vec_id", "score")
