"""The engine's front door: search, context for answers, exploring proposals, ingestion.

Every call returns a lazy DataFrame and keeps no state between calls.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import snippet, tokens
from .operators import filters, fusion, keyword, proposals, vector_index, vectors
from .sources.sinks import append_new


class Engine:
    """Over a table of chunks (doc_id, text, source and what is filtered by) and, if there is one, a table of vectors (vec_id, embedding).

    index: the chunks' keyword index; without one it is made for each call, which suits small tables only.
    near: an index of the vectors for approximate search by cosine; without one, and under filters, all vectors are compared."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, points: DataFrame | None = None, index: keyword.Index | None = None, near: vector_index.VectorIndex | None = None):
        self.spark, self.chunks, self.points, self.near = spark, chunks, points, near
        self.index = index or keyword.lazy_index(chunks)

    def _hits(self, query: str, vector, k_sparse: int, k_dense: int, equal, ranges) -> tuple[DataFrame, DataFrame]:
        """Keyword and dense hits (id, rank, score) among the chunks that the filters leave."""
        if not query.strip():
            raise ValueError("the query is empty")
        some = self.chunks.filter(filters.matches(equal, ranges)).select("doc_id") if equal or ranges else None
        asked = self.spark.createDataFrame([(0, query)], "query_id int, query string")
        sparse = keyword.search(self.index, asked, k_sparse, allowed=some).select(F.col("doc_id").alias("id"), "rank", "score")
        if vector is None or self.points is None:
            return sparse, sparse.limit(0)
        points = self.points if some is None else self.points.join(some.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
        wanted = self.spark.createDataFrame([(0, [float(x) for x in vector])], "query_id int, query array<double>")
        found = vectors.nearest(points, wanted, k_dense) if some is not None or self.near is None else vector_index.approximate(self.near, wanted, k_dense)
        return sparse, found.select(F.col("vec_id").alias("id"), "rank", "score")

    def _texts(self) -> DataFrame:
        return self.chunks.select(F.col("doc_id").alias("id"), "text", "source")

    def search(self, query: str, vector: list[float] | None = None, k_sparse: int = 100, k_dense: int = 20, n: int = 10, equal: dict | None = None, ranges: dict | None = None, include_text: bool = True) -> DataFrame:
        """(query, id, qtype, hit_score, hit_score_norm, score, source, text_betr): keyword and dense hits, reranked.

        equal and ranges filter the chunks for both sides and don't change scores; texts are joined to the hits only.
        """
        hits = fusion.with_texts(fusion.concatenate(*self._hits(query, vector, k_sparse, k_dense, equal, ranges)), self._texts())
        text = F.concat_ws(". ", "source", "text")
        words = list(dict.fromkeys(query.lower().split()))
        found = fusion.rerank(hits.withColumn("text_betr", text), fusion.lexical_score(tokens(text), words), n)
        columns = ["id", "qtype", F.col("score").alias("hit_score"), F.col("score_norm").alias("hit_score_norm"), F.col("rerank").alias("score"), "source"]
        return found.select(F.lit(query).alias("query"), *columns, *(["text_betr"] if include_text else []))

    def hybrid(self, query: str, vector: list[float] | None = None, k_sparse: int = 100, k_dense: int = 20, n: int = 10, permissions: DataFrame | None = None, groups: list[str] | None = None, equal: dict | None = None, ranges: dict | None = None) -> DataFrame:
        """(id, score_v, score_b, source, snippet, rerank): each id once, those that the groups may see by permissions (id, permissions), the n best reranked."""
        sparse, dense = self._hits(query, vector, k_sparse, k_dense, equal, ranges)
        merged = fusion.deduplicate(dense, sparse)
        if permissions is not None:
            merged = fusion.allowed(merged.join(permissions, "id"), "permissions", groups or []).drop("permissions")
        named = fusion.with_texts(merged, self._texts())
        words = list(dict.fromkeys(query.lower().split()))
        found = fusion.best_of(named, fusion.lexical_score(tokens(F.concat_ws(". ", "source", "text")), words), n)
        return found.select("id", "score_v", "score_b", "source", snippet(F.col("text")).alias("snippet"), "rerank")

    def respond(self, query: str, **options) -> dict:
        """A response as a service gives it: the query, its items with their scores first, and the milliseconds it took."""
        began = time.monotonic()
        items = [(r["score"], r.asDict()) for r in self.search(query, **options).collect()]
        return {"query": query, "items": items, "took_ms": int(1000 * (time.monotonic() - began))}

    def rag_prompt(self, question: str, vector: list[float] | None = None, n: int = 2) -> DataFrame:
        """One row: the prompt with the texts of the n best hits."""
        best = self.search(question, vector, n=n).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "text_betr"))).alias("hits"))
        return best.select(proposals.prompt(F.lit(question), F.transform("hits", lambda h: h["text_betr"])).alias("prompt"))

    @staticmethod
    def explore(items: DataFrame, least: int = 1, first: str | None = None, last: str | None = None, meeting: str | None = None) -> DataFrame:
        """Proposals with their items between two days and, in any case, of meetings whose name contains a text."""
        if first is not None:
            items = items.filter(F.col("meeting_date") >= first)
        if last is not None:
            items = items.filter(F.col("meeting_date") <= last)
        if meeting:
            items = items.filter(F.lower("meeting").contains(meeting.lower()))
        return proposals.reference_rollup(items, least).orderBy(F.desc("num_tops"), "referenzvorlage")

    @staticmethod
    def ingest(rows: DataFrame, path: str, key: list[str]) -> DataFrame:
        """Adds the rows whose key isn't there yet and returns them."""
        return append_new(rows, path, key)
