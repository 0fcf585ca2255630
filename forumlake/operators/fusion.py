"""Fusing dense and keyword hits, reranking, and late lookup of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .keyword import min_max


def linear(dense: DataFrame, sparse: DataFrame, alpha: float = 0.6, k: int = 8) -> DataFrame:
    """(id, fused): alpha * dense + (1 - alpha) * sparse / (largest sparse score + 1e-9) over the dense hits; larger ids win ties."""
    most = sparse.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("most"))
    joined = dense.select("id", F.col("score").alias("d")).join(sparse.select("id", F.col("score").alias("s")), "id", "left").join(F.broadcast(most), how="cross")
    fused = alpha * F.col("d") + (1 - alpha) * F.coalesce("s", F.lit(0.0)) / (F.col("most") + 1e-9)
    return joined.select("id", fused.alias("fused")).orderBy(F.desc("fused"), F.desc("id")).limit(k)


def concatenate(sparse: DataFrame, dense: DataFrame) -> DataFrame:
    """Both lists under each other with their own normalised scores; an id that both found stays twice."""
    both = [min_max(x.withColumn("qtype", F.lit(name)), ("qtype",)) for name, x in (("sparse", sparse), ("dense", dense))]
    return both[0].unionByName(both[1], allowMissingColumns=True)


def rerank(hits: DataFrame, score: Column, n: int = 10) -> DataFrame:
    """The n best by a reranker's score; ties by lower normalised score, keyword hits before dense ones, then rank."""
    return hits.withColumn("rerank", score).orderBy(F.desc("rerank"), "score_norm", F.desc("qtype"), "rank").limit(n)


def deduplicate(dense: DataFrame, sparse: DataFrame) -> DataFrame:
    """One row for each id with both scores, null where an engine hasn't found it; other columns from the dense side first."""
    d = dense.withColumnRenamed("score", "score_v").drop("rank")
    s = sparse.withColumnRenamed("score", "score_b").drop("rank")
    more = [c for c in dict.fromkeys([*d.columns, *s.columns]) if c not in ("id", "score_v", "score_b")]
    both = d.alias("d").join(s.alias("s"), "id", "full_outer")
    return both.select("id", "score_v", "score_b", *[F.coalesce(*[F.col(f"{side}.{c}") for side, x in (("d", d), ("s", s)) if c in x.columns]).alias(c) for c in more])


def best_of(hits: DataFrame, score: Column, n: int) -> DataFrame:
    """The n best of deduplicated hits by a reranker's score; smaller ids win ties."""
    return hits.withColumn("rerank", score).orderBy(F.desc("rerank"), "id").limit(n)


def allowed(hits: DataFrame, permissions: str, groups: list[str]) -> DataFrame:
    """Only rows that share a permission with the user's groups."""
    return hits.filter(F.arrays_overlap(F.col(permissions), F.array(*[F.lit(g) for g in groups])))


#: Hits whose ids are broadcast to look their texts up; more are joined by a shuffle.
BROADCAST_HITS = 100_000


def with_texts(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """The hits with their texts, looked up after the cut to k; a miss has an empty text and no source.

    Only the texts of the hits leave the scan: their ids are broadcast below BROADCAST_HITS."""
    ids = hits.select("id").distinct()
    if ids.limit(BROADCAST_HITS + 1).count() <= BROADCAST_HITS:
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    return hits.join(texts, "id", "left").withColumn("text", F.coalesce("text", F.lit("")))


def lexical_score(words: Column, query: list[str]) -> Column:
    """A reranker that needs no model: the share of the query's words that a text holds."""
    asked = F.array(*[F.lit(w) for w in query])
    return F.round(F.size(F.array_intersect(asked, words)) / F.lit(float(len(set(query)))), 6)


def first_of(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter("_r = 1").drop("_r")
