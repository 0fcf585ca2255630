"""Exact and approximate vector search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from forumlake.api import Engine
from forumlake.operators import vector_index, vectors

SCHEMA = "vec_id long, embedding array<double>"


def exact(x, q, k):
    """The k nearest by cosine, ties to the smaller id."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = u @ (q / np.linalg.norm(q))
    return [int(i) for i in np.lexsort((np.arange(len(x)), -scores))[:k]]


def recall(spark, path, x, queries, k):
    """The share of the nearest that is found, and the share of the vectors that is compared in full."""
    index = vector_index.open_vectors(spark, path)
    asked = spark.createDataFrame([(i, q.tolist()) for i, q in enumerate(queries)], "query_id int, query array<double>")
    found = {}
    for r in vector_index.approximate(index, asked, k).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
        assert abs(r.score - x[r.vec_id] @ queries[r.query_id] / np.linalg.norm(x[r.vec_id]) / np.linalg.norm(queries[r.query_id])) < 1e-9
    short = max(vector_index.SHORT * k, min(int(np.ceil(vector_index.SHARE * index.n)), vector_index.LONG * k))
    return np.mean([len(set(found[i]) & set(exact(x, q, k))) / k for i, q in enumerate(queries)]), short / index.n, index


def test_recall_without_structure(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    assert [r.vec_id for r in rows] == list(range(len(x)))
    vector_index.build(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), str(tmp_path / "v"))
    queries = np.concatenate([x[::50] + 0.05 * np.random.default_rng(0).standard_normal(x[::50].shape), np.random.default_rng(1).standard_normal((20, x.shape[1]))])
    found, compared, _ = recall(spark, str(tmp_path / "v"), x, queries, 5)
    assert found >= 0.9 and compared <= 0.05


def test_recall_with_structure_probes_few_lists(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 30))[rng.integers(0, 40, 4000)] + 0.25 * rng.standard_normal((4000, 30))) * rng.uniform(0.1, 9, (4000, 1))
    vector_index.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), str(tmp_path / "v"))
    found, compared, index = recall(spark, str(tmp_path / "v"), x, x[:60] + 0.01, 5)
    assert found >= 0.9 and compared <= 0.05 and len(index.centres) == 63 and index.probes <= 0.3 * len(index.centres)
    plan = vector_index.approximate(index, spark.createDataFrame([(1, x[0].tolist())], "query_id int, query array<double>"), 3)._jdf.queryExecution().toString()
    codes = next(p for p in plan.splitlines() if "FileScan" in p and "codes" in p)
    assert "PartitionFilters: [isnotnull(list" in codes or "PartitionFilters: [list" in codes


def test_everything_probed_is_exact(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.integers(-2, 3, (700, 6)).astype(float)  # many ties
    x[(x == 0).all(axis=1)] = 1
    vector_index.build(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA), str(tmp_path / "v"))
    index = vector_index.open_vectors(spark, str(tmp_path / "v"))
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 700, 70)], "query_id int, query array<double>")
    found = vector_index.approximate(index, asked, 9, probes=len(index.centres), short=700)
    for i in range(0, 700, 70):
        scores = {r.vec_id: r.score for r in found.collect() if r.query_id == i}
        best = np.sort((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (x[i] / np.linalg.norm(x[i])))[::-1][:9]
        assert np.allclose(sorted(scores.values(), reverse=True), best)


def test_odd_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (None, [1.0, 1.0]), (7, [0.0, float("inf")]), (8, [0.0, -2.0]), (9, [3.0, 0.0])]
    vector_index.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), str(tmp_path / "v"))
    index = vector_index.open_vectors(spark, str(tmp_path / "v"))
    asked = spark.createDataFrame([("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("n", None)], "query_id string, query array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in vector_index.approximate(index, asked, 5, probes=9).collect()] == [("a", 1, 1, 1.0), ("a", 2, 9, 1.0), ("a", 3, 8, 0.0)]
    vector_index.build(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert vector_index.approximate(vector_index.open_vectors(spark, str(tmp_path / "e")), asked, 5).count() == 0
    with pytest.raises(ValueError):
        vector_index.open_vectors(spark, str(tmp_path / "nothing"))


def test_near_ties_are_ranked_before_rounding(spark):
    points = spark.createDataFrame([(1, [1.0]), (2, [1.0000003]), (3, [0.9999999])], SCHEMA)
    query = spark.createDataFrame([(0, [1.0])], "query_id int, query array<double>")
    assert [r.vec_id for r in vectors.nearest(points, query, 3).orderBy("rank").collect()] == [2, 1, 3]
    assert [r.vec_id for r in vectors.nearest(points, query, 3, at_least=1.0).orderBy("rank").collect()] == [2, 1]


def test_engine_with_an_index(spark, tmp_path):
    points = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.cos("id"), F.sin("id")).alias("embedding"))
    vector_index.build(points, str(tmp_path / "v"))
    chunks = spark.range(40).selectExpr("id AS doc_id", "concat('wort', id) AS text", "'s' AS source")
    engine = Engine(spark, chunks, points, near=vector_index.open_vectors(spark, str(tmp_path / "v")))
    found = engine.search("wort3", [1.0, 0.0], k_dense=3).collect()
    assert {r.id for r in found if r.qtype == "dense"} == {0, 19, 25}
