"""Vector search: normalising, exact inner products, filtered and two-level search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyword import top


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, in the order of the numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, x: s + x))


def normalise(a: Column) -> Column:
    """Of unit length; a zero vector stays."""
    # Bound to a variable, so that the norm is worked out once and not for every number.
    whole = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))
    return F.element_at(whole, 1)


def centroids(vectors: DataFrame, by: str | None = None) -> DataFrame:
    """The mean vector of each group, or of all: (group, query)."""
    places = vectors.select(*([by] if by else []), F.posexplode("embedding").alias("i", "x"))
    means = places.groupBy(*([by] if by else []), "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return means.groupBy(*([by] if by else [])).agg(listed.alias("query"))


#: Queries of one exact search at most.
QUERIES = 10_000


def nearest(vectors: DataFrame, queries: DataFrame, k: int, at_least: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): exact inner products of a stated set of at most QUERIES queries with all vectors, k best each."""
    if (asked := queries.limit(QUERIES + 1).count()) > QUERIES:
        raise ValueError(f"more than {QUERIES} queries ({asked} and on): search them in parts")
    scored = vectors.join(F.broadcast(queries), how="cross").select("query_id", "vec_id", dot(F.col("embedding"), F.col("query")).alias("score"))
    if at_least is not None:
        scored = scored.filter(F.col("score") >= at_least)
    return top(scored, k, key="vec_id")


def two_level(summaries: DataFrame, chunks: DataFrame, queries: DataFrame, k_top: int = 5, k_chunk: int = 8) -> DataFrame:
    """The nearest summaries and, apart from them, the nearest chunks, each tagged."""
    levels = [nearest(x, queries, k).withColumn("level", F.lit(name)) for name, x, k in (("top", summaries, k_top), ("chunk", chunks, k_chunk))]
    return levels[0].unionByName(levels[1])
