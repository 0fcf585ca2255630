"""Search queries: keyword, vector, fused."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Engine
from ..functions.text import fold, tokens
from ..operators import fusion, keyword, vector_index, vectors
from ..sources.store import new_folder

#: The probe queries.
PROBES = ((1, "thing of ertion"), (2, "die und der heit"), (3, "les de la eau"), (4, "ción de las"))
#: Terms for fuzzy matching.
TERMS = ("the", "und", "ertion", "thing", "pathetic", "de")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROBES), "query_id int, query string")


def _listed(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "doc_id", "score")


def _scored(hits: DataFrame, k: int) -> DataFrame:
    return _listed(keyword.top(hits.withColumn("score", F.round("score", 6)), k))


_indexes: dict[tuple, str] = {}
#: Versions written so far of an index that is written in parts.
_written: dict[tuple, int] = {}


def index(spark: SparkSession, sf: str, kind: str = "text") -> keyword.Index:
    """The keyword index of documents, built at its first use in a session and read from then on."""
    column, words = {"text": ("text", tokens), "source": ("source", tokens), "words": ("text", keyword.split_words)}[kind]
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _indexes:
        path = new_folder(spark, f"index-{kind}")
        keyword.build_index(table(spark, sf, "documents"), path, column, words)
        _indexes[key] = path
    return keyword.open_index(spark, _indexes[key], words)


def bm25_topk(spark, sf):
    return _listed(keyword.search(index(spark, sf), probes(spark), 100))


def bm25_and_operator(spark, sf):
    return _listed(keyword.search(index(spark, sf), probes(spark), 100, every_term=True))


def bm25_okapi(spark, sf):
    return _listed(keyword.search(index(spark, sf, "words"), probes(spark), 100, "okapi"))


def bm25_benchmark(spark, sf):
    """Every item of the benchmark as a query."""
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _listed(keyword.search(index(spark, sf), asked, 10))


def bm25_multifield_boost(spark, sf):
    queries = spark.createDataFrame([(1, "src1 the"), (2, "src2 und")], "query_id int, query string")
    return _scored(keyword.multi_field({x: index(spark, sf, x) for x in ("source", "text")}, queries, {"source": 1.0, "text": 3.0}), 100)


def index_statistics(spark, sf):
    """The stored index: terms with their documents, and the corpus."""
    found = index(spark, sf)
    return found.terms.join(F.broadcast(found.stats), how="cross").select("term", "df", "n", F.round("avgdl", 6).alias("avgdl"))


def fuzzy_term_match(spark, sf):
    """Terms of the stored index, without marks, that a table of variants finds near given ones."""
    key = (spark.sparkContext.applicationId, sf, "fuzzy")
    if key not in _indexes:
        path = new_folder(spark, "fuzzy")
        keyword.build_fuzzy(index(spark, sf).terms.select(fold(F.col("term")).alias("term")), path)
        _indexes[key] = path
    asked = spark.range(1).select(F.explode(F.array(*map(F.lit, TERMS))).alias("query_term"))  # rows of a Python list would take workers of their own
    return keyword.fuzzy_terms(keyword.open_fuzzy(spark, _indexes[key]), asked).withColumn("edits", F.col("edits").cast("long"))


def _halves(spark, sf, version):
    """Where the index that is written in parts lies, up to a version: the even ids with another text first, then all even ids as they are and the odd ones, then without the ids that 10 divides, then merged."""
    key = (spark.sparkContext.applicationId, sf, "halves")
    if key not in _indexes:
        _indexes[key] = new_folder(spark, "index-halves")
        _written[key] = 0
    path, docs = _indexes[key], table(spark, sf, "documents").select("doc_id", "text")
    writes = (
        lambda: keyword.build_index(docs.filter("doc_id % 2 = 0").withColumn("text", F.concat(F.lit("thing "), F.reverse("text"))), path),
        lambda: keyword.update_index(docs, path),
        lambda: keyword.update_index(docs.limit(0), path, deleted=docs.filter("doc_id % 10 = 0")),
        lambda: keyword.merge_index(spark, path),
    )
    for write in writes[_written[key] : version]:
        write()
        _written[key] += 1
    return path


def bm25_replaced(spark, sf):
    """Search in an index whose documents have been replaced, added and taken out, before they are merged."""
    return _listed(keyword.search(keyword.open_index(spark, _halves(spark, sf, 3), version=3), probes(spark), 100))


def bm25_merged(spark, sf):
    """The same after its segments have been merged into one."""
    return _listed(keyword.search(keyword.open_index(spark, _halves(spark, sf, 4), version=4), probes(spark), 100))


def bm25_past_version(spark, sf):
    """The same before any of it: the first version."""
    return _listed(keyword.search(keyword.open_index(spark, _halves(spark, sf, 1), version=1), probes(spark), 100))


def minmax_normalise(spark, sf):
    hits = keyword.min_max(bm25_topk(spark, sf))
    return hits.select("query_id", "doc_id", F.round("score_norm", 5).alias("score_norm"))


def _label_queries(spark, sf):
    return vectors.centroids(table(spark, sf, "embeddings"), "label").withColumnRenamed("label", "query_id")


def _mean_query(spark, sf):
    return vectors.centroids(table(spark, sf, "embeddings")).withColumn("query_id", F.lit(0))


def _ranked(hits):
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def knn_topk(spark, sf):
    return _ranked(vectors.nearest(table(spark, sf, "embeddings"), _mean_query(spark, sf), 20))


def knn_per_query(spark, sf):
    return _ranked(vectors.nearest(table(spark, sf, "embeddings"), _label_queries(spark, sf), 5))


def knn_filtered(spark, sf):
    some = table(spark, sf, "embeddings").filter(F.col("label").isin(1, 3) & (F.col("vec_id") >= 100))
    return _ranked(vectors.nearest(some, _mean_query(spark, sf), 10))


def knn_threshold(spark, sf):
    return _ranked(vectors.nearest(table(spark, sf, "embeddings"), _label_queries(spark, sf), 50, at_least=0.02))


def approximate_knn(spark, sf):
    """The nearest of each label's mean by lists and codes."""
    return _ranked(vector_index.approximate(_vectors(spark, sf), _label_queries(spark, sf), 5))


def approximate_knn_everything(spark, sf):
    """The same with every list probed and nothing cut off by the estimates, which is exact."""
    found = _vectors(spark, sf)
    return _ranked(vector_index.approximate(found, _label_queries(spark, sf), 5, probes=len(found.centres), short=max(5, found.n)))


def _vectors(spark, sf):
    """The vector index of embeddings, built at its first use in a session."""
    key = (spark.sparkContext.applicationId, sf, "vectors")
    if key not in _indexes:
        path = new_folder(spark, "vectors")
        vector_index.build(table(spark, sf, "embeddings"), path)
        _indexes[key] = path
    return vector_index.open_vectors(spark, _indexes[key])


def l2_normalise(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double") * 3)
    length = F.round(vectors.norm(v), 6)
    first = F.round(F.get(vectors.normalise(v), F.lit(0)), 6)
    return table(spark, sf, "embeddings").select("vec_id", length.alias("norm"), first.alias("first"))


def dense_two_level(spark, sf):
    rows = table(spark, sf, "embeddings")
    level = vectors.centroids(rows, "label").select(F.col("label").cast("long").alias("vec_id"), F.col("query").alias("embedding"))
    found = vectors.two_level(level, rows, _mean_query(spark, sf))
    return found.select("level", F.col("rank").cast("long").alias("rank"), "vec_id", F.round("score", 6).alias("score"))


def _sparse(spark, sf, k=100):
    one = probes(spark).filter("query_id = 1")
    return _listed(keyword.search(index(spark, sf), one, k)).withColumnRenamed("doc_id", "id")


def _dense(spark, sf, k=20):
    return knn_topk(spark, sf).filter(F.col("rank") <= k).withColumnRenamed("vec_id", "id")


def linear_fusion(spark, sf):
    every = keyword.bm25(index(spark, sf), probes(spark).filter("query_id = 1")).select(F.col("doc_id").alias("id"), F.round("score", 6).alias("score"))
    dense = vectors.nearest(table(spark, sf, "embeddings"), _mean_query(spark, sf), 20).select(F.col("vec_id").alias("id"), "rank", "score")
    return fusion.linear(dense, every).select("id", F.round("fused", 6).alias("fused"))


def concat_fusion_rerank(spark, sf):
    hits = fusion.concatenate(_sparse(spark, sf).select("id", "rank", "score"), _dense(spark, sf).select("id", "rank", "score"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    named = fusion.with_texts(hits, texts)
    score = fusion.lexical_score(tokens(F.concat_ws(". ", "source", "text")), PROBES[0][1].split())
    return fusion.rerank(named, score).select("id", "qtype", "rank", F.round("score_norm", 5).alias("score_norm"), "rerank")


def dedupe_fusion(spark, sf):
    merged = fusion.deduplicate(_dense(spark, sf), _sparse(spark, sf))
    groups = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    permissions = F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string")))
    return fusion.allowed(merged.join(groups, "id").withColumn("permissions", permissions), "permissions", ["q1", "t1"]).select("id", "score_v", "score_b")


def late_text_lookup(spark, sf):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    return fusion.with_texts(_dense(spark, sf), texts).select("id", "rank", "source", F.concat_ws(". ", "source", "text").alias("text_betr"))


def union_all_sources(spark, sf):
    a = table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", "source")
    b = table(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"), F.col("item_id").alias("id"), "text")
    return a.unionByName(b, allowMissingColumns=True).select("kind", "id", "source", F.length("text").cast("long").alias("n_chars"))


def _engine(spark, sf):
    return Engine(spark, table(spark, sf, "documents"), table(spark, sf, "embeddings"), index(spark, sf))


def engine_search(spark, sf):
    """The engine's search, with the mean vector as the query's."""
    vector = _mean_query(spark, sf).first().query
    return _engine(spark, sf).search(PROBES[0][1], vector).select("id", "qtype", F.round("hit_score_norm", 5).alias("hit_score_norm"), "score", "source")


#: One language, a list of sources, and a range of the characters, with an open end in the other one.
_EQUAL, _RANGES = {"lang": "en", "source": ["src1", "src2", "src3", "src4", "src5"]}, {"n_chars": (100, 20000), "doc_id": (10, None)}


def filtered_search(spark, sf):
    vector = _mean_query(spark, sf).first().query
    found = _engine(spark, sf).search(PROBES[0][1], vector, k_sparse=50, k_dense=10, n=60, equal=_EQUAL, ranges=_RANGES)
    return found.select("id", "qtype", F.round("hit_score", 6).alias("hit_score"), "score", "source")


def hybrid_search(spark, sf):
    """Deduplicated hits that a user's groups may see, reranked, the ten best."""
    groups = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    permissions = groups.select("id", F.array(F.concat(F.lit("q"), F.col("quality").cast("string")), F.concat(F.lit("t"), F.col("toxic").cast("string"))).alias("permissions"))
    found = _engine(spark, sf).hybrid(PROBES[0][1], _mean_query(spark, sf).first().query, permissions=permissions, groups=["q1", "t1"])
    return found.select("id", F.round("score_v", 6).alias("score_v"), F.round("score_b", 6).alias("score_b"), "source", "snippet", "rerank")


def rag_prompt(spark, sf):
    return _engine(spark, sf).rag_prompt(PROBES[0][1])


_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in PROBES) + ") v(query_id, query))"
_TEXT = "coalesce(text, '')"
_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _bm25_sql(queries: str, text: str = "text", every: bool = False, where: str = "true") -> str:
    return f"""{queries}, d AS (SELECT doc_id, {_TOK.format(f"coalesce({text}, '')")} toks FROM documents WHERE {where}),
st AS (SELECT count(*) n, avg(len(toks)) avgdl FROM d),
ex AS (SELECT doc_id, len(toks) dl, unnest(toks) term FROM d),
p AS (SELECT doc_id, term, count(*) tf, any_value(dl) dl FROM ex GROUP BY ALL),
df AS (SELECT term, count(*) df FROM p GROUP BY term),
qt AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest({_TOK.format("query")}) term FROM q) GROUP BY ALL),
qn AS (SELECT query_id, count(*) terms FROM qt GROUP BY ALL),
h AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) score, count(*) matched
FROM p JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY ALL){", hits AS (SELECT h.* FROM h JOIN qn USING (query_id) WHERE matched = terms)" if every else ", hits AS (SELECT * FROM h)"}"""


#: reverse() turns signs with their marks around as one; the texts' signs are turned one by one.
_REVERSED = "'thing ' || array_to_string(list_reverse(string_split(text, '')), '')"
_TOP = "SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) rank FROM {}) WHERE rank <= {}"
_ONE = _Q.replace("FROM (VALUES", "FROM (VALUES", 1).replace(") v(query_id, query))", ") v(query_id, query) WHERE query_id = 1)")
_DOT = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: embedding[i]::DOUBLE * query[i]))"
_CENTRE = "SELECT {g}i, avg(x) x FROM (SELECT {g}unnest(range(1, len(embedding) + 1)) i, unnest(embedding)::DOUBLE x FROM embeddings) GROUP BY ALL"
_MEAN = "mq AS (SELECT 0 query_id, list(x ORDER BY i) query FROM (" + _CENTRE.format(g="") + "))"
_LABELS = "lq AS (SELECT label query_id, list(x ORDER BY i) query FROM (" + _CENTRE.format(g="label, ") + ") GROUP BY label)"


def _near(queries: str, vectors_: str = "embeddings", k: int = 20, where: str = "true") -> str:
    return f"SELECT query_id, rank, vec_id, round(score, 6) score, score exact FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) rank FROM (SELECT query_id, vec_id, {_DOT} score FROM {vectors_} CROSS JOIN {queries}) WHERE {where}) WHERE rank <= {k}"


_RANKED = "SELECT query_id, rank, vec_id, score FROM ({})"
_COSINE = _DOT + " / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) / sqrt(list_sum(list_transform(query, lambda x: x * x)))"
_DENSE = "dn AS (SELECT vec_id id, rank, score, exact FROM (" + _near("mq") + "))"
_SPARSE = "sp AS (SELECT doc_id id, rank, score FROM (" + _TOP.format("hits", 100) + "))"
_BOTH = f"WITH {_MEAN}, {_DENSE}, {_bm25_sql(_ONE)}, {_SPARSE}"

SQL = {
    "bm25_topk": f"WITH {_bm25_sql(_Q)} {_TOP.format('hits', 100)}",
    "bm25_replaced": f"WITH {_bm25_sql(_Q, where='doc_id % 10 <> 0')} {_TOP.format('hits', 100)}",
    "bm25_merged": f"WITH {_bm25_sql(_Q, where='doc_id % 10 <> 0')} {_TOP.format('hits', 100)}",
    "bm25_past_version": f"WITH {_bm25_sql(_Q, _REVERSED, where='doc_id % 2 = 0')} {_TOP.format('hits', 100)}",
    "bm25_and_operator": f"WITH {_bm25_sql(_Q, every=True)} {_TOP.format('hits', 100)}",
    "bm25_okapi": rf"""WITH {_Q}, d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') toks FROM documents),
st AS (SELECT count(*) n, avg(len(toks)) avgdl FROM d), ex AS (SELECT doc_id, len(toks) dl, unnest(toks) term FROM d),
p AS (SELECT doc_id, term, count(*) tf, any_value(dl) dl FROM ex GROUP BY ALL),
r AS (SELECT term, ln((n - df + 0.5) / (df + 0.5)) raw FROM (SELECT term, count(*) df FROM p GROUP BY term) CROSS JOIN st),
m AS (SELECT avg(raw) mean FROM r),
qt AS (SELECT query_id, term, count(*) qtf FROM (SELECT query_id, unnest(string_split(query, ' ')) term FROM q) GROUP BY ALL),
hits AS (SELECT query_id, doc_id, round(sum(qtf * CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) score
FROM p JOIN r USING (term) JOIN qt USING (term) CROSS JOIN st CROSS JOIN m GROUP BY ALL) {_TOP.format("hits", 100)}""",
    "bm25_multifield_boost": "WITH a AS (WITH {0} SELECT query_id, doc_id, score FROM hits), b AS (WITH {1} SELECT query_id, doc_id, score3 score FROM (SELECT *, score score3 FROM hits)), u AS (SELECT query_id, doc_id, round(max(score), 6) score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL) {2}".format(
        _bm25_sql("q AS (SELECT * FROM (VALUES (1, 'src1 the'), (2, 'src2 und')) v(query_id, query))", "source"),
        _bm25_sql("q AS (SELECT * FROM (VALUES (1, 'src1 the'), (2, 'src2 und')) v(query_id, query))").replace("round(sum(", "round(3.0 * sum("),
        _TOP.format("u", 100),
    ),
    "bm25_benchmark": f"WITH {_bm25_sql('q AS (SELECT item_id query_id, text query FROM benchmark)')} {_TOP.format('hits', 10)}",
    "index_statistics": f"WITH d AS (SELECT doc_id, {_TOK.format(_TEXT)} toks FROM documents), t AS (SELECT term, count(DISTINCT doc_id) df FROM (SELECT doc_id, unnest(toks) term FROM d) GROUP BY term) SELECT term, df, (SELECT count(*) FROM d) n, (SELECT round(avg(len(toks)), 6) FROM d) avgdl FROM t",
    # Edits are counted in bytes, so that letters beyond ASCII stand as signs, which no term has.
    "fuzzy_term_match": f"WITH v AS (SELECT DISTINCT strip_accents(unnest({_TOK.format('text')})) term FROM documents), t AS (SELECT query_term, CASE WHEN length(query_term) <= 2 THEN 0 WHEN length(query_term) <= 5 THEN 1 ELSE 2 END most FROM (VALUES "
    + ", ".join(f"('{t}')" for t in TERMS)
    + ") x(query_term)), m AS (SELECT query_term, term, most FROM v JOIN t ON length(term) BETWEEN length(query_term) - most AND length(query_term) + most) SELECT query_term, m.term, edits FROM (SELECT *, damerau_levenshtein(query_term, translate(term, 'ßæœøđðłþıŋ', '!#$%&()*+,')) edits FROM m) m WHERE edits <= most",
    "minmax_normalise": f"WITH {_bm25_sql(_Q)}, t AS ({_TOP.format('hits', 100)}) SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 5) score_norm FROM t WINDOW w AS (PARTITION BY query_id)",
    "knn_topk": f"WITH {_MEAN} {_RANKED.format(_near('mq'))}",
    "knn_per_query": f"WITH {_LABELS} {_RANKED.format(_near('lq', k=5))}",
    "approximate_knn_everything": f"WITH {_LABELS} {_RANKED.format(_near('lq', k=5).replace(_DOT, _COSINE))}",
    "knn_filtered": f"WITH {_MEAN} {_RANKED.format(_near('mq', '(SELECT * FROM embeddings WHERE label IN (1, 3) AND vec_id >= 100)', 10))}",
    "knn_threshold": f"WITH {_LABELS} {_RANKED.format(_near('lq', k=50, where='score >= 0.02'))}",
    "l2_normalise": "SELECT vec_id, round(sqrt(s), 6) norm, round(embedding[1]::DOUBLE * 3 / sqrt(s), 6) AS first FROM (SELECT *, list_sum(list_transform(embedding, lambda x: (x::DOUBLE * 3) * (x::DOUBLE * 3))) s FROM embeddings)",
    "dense_two_level": f"WITH {_MEAN}, {_LABELS}, tops AS (SELECT query_id::BIGINT vec_id, query embedding FROM lq) SELECT 'top' AS level, rank, vec_id, score FROM ({_near('mq', 'tops', 5)}) UNION ALL SELECT 'chunk', rank, vec_id, score FROM ({_near('mq', k=8)})",
    "linear_fusion": _BOTH + " SELECT dn.id, round(0.6 * dn.exact + 0.4 * coalesce(hits.score, 0.0) / ((SELECT coalesce(max(score), 0.0) FROM hits) + 1e-9), 6) fused FROM dn LEFT JOIN hits ON dn.id = hits.doc_id ORDER BY 0.6 * dn.exact + 0.4 * coalesce(hits.score, 0.0) / ((SELECT coalesce(max(score), 0.0) FROM hits) + 1e-9) DESC, id DESC LIMIT 8",
    "concat_fusion_rerank": _BOTH
    + ", c AS (SELECT id, rank, score, 'sparse' qtype FROM sp UNION ALL SELECT id, rank, score, 'dense' FROM dn), m AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END score_norm FROM c WINDOW w AS (PARTITION BY qtype)), "
    + "n AS (SELECT m.*, round(len(list_intersect(['thing', 'of', 'ertion'], " + _TOK.format("concat_ws('. ', source, coalesce(text, ''))") + ")) / 3.0, 6) rerank FROM m LEFT JOIN documents ON id = doc_id) "
    + "SELECT id, qtype, rank, round(score_norm, 5) score_norm, rerank FROM n ORDER BY rerank DESC, score_norm, qtype DESC, rank LIMIT 10",
    "dedupe_fusion": _BOTH + ", f AS (SELECT id, dn.score score_v, sp.score score_b FROM dn FULL JOIN sp USING (id)), g AS (SELECT doc_id id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY ALL) SELECT id, score_v, score_b FROM f JOIN g USING (id) WHERE quality = 1 OR toxic = 1",
    "late_text_lookup": f"WITH {_MEAN}, {_DENSE} SELECT id, rank, source, concat_ws('. ', source, coalesce(text, '')) text_betr FROM dn LEFT JOIN documents ON id = doc_id",
    "union_all_sources": "SELECT 'document' kind, doc_id id, source, length(text) n_chars FROM documents UNION ALL SELECT 'benchmark', item_id, NULL, length(text) FROM benchmark",
}

# The engine's vector scores aren't rounded before they are normalised.
SQL["engine_search"] = SQL["concat_fusion_rerank"].replace("SELECT id, rank, score, 'dense' FROM dn", "SELECT id, rank, exact, 'dense' FROM dn").replace("SELECT id, qtype, rank, round(score_norm, 5) score_norm, rerank FROM n ORDER BY", "SELECT id, qtype, round(score_norm, 5) hit_score_norm, rerank score, source FROM n ORDER BY").replace("SELECT m.*, round", "SELECT m.*, source, round")
_SOME = "sel AS (SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3', 'src4', 'src5') AND n_chars BETWEEN 100 AND 20000 AND doc_id >= 10)"
_RERANK = "round(len(list_intersect(['thing', 'of', 'ertion'], " + _TOK.format("concat_ws('. ', source, coalesce(text, ''))") + ")) / 3.0, 6)"
SQL["filtered_search"] = (
    f"WITH {_MEAN}, {_SOME}, {_bm25_sql(_ONE)}, fh AS (SELECT hits.* FROM hits JOIN sel USING (doc_id)), sp AS (SELECT doc_id id, rank, score FROM (" + _TOP.format("fh", 50) + ")), dn AS (SELECT vec_id id, rank, exact AS score FROM (" + _near("mq", "(SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM sel))", 10) + ")), "
    + "c AS (SELECT id, rank, score, 'sparse' qtype FROM sp UNION ALL SELECT id, rank, score, 'dense' FROM dn), m AS (SELECT *, CASE WHEN max(score) OVER w = min(score) OVER w THEN 0.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END score_norm FROM c WINDOW w AS (PARTITION BY qtype)) "
    + f"SELECT id, qtype, round(m.score, 6) hit_score, {_RERANK} score, source FROM m LEFT JOIN documents ON id = doc_id ORDER BY 4 DESC, score_norm, qtype DESC, rank LIMIT 60"
)
SQL["hybrid_search"] = (
    _BOTH + ", f AS (SELECT id, dn.score score_v, sp.score score_b FROM dn FULL JOIN sp USING (id)), g AS (SELECT doc_id id, max(quality) quality, max(toxic) toxic FROM labels GROUP BY ALL) "
    + f"SELECT id, score_v, score_b, source, CASE WHEN length(coalesce(text, '')) > 400 THEN substr(text, 1, 400) || '…' ELSE coalesce(text, '') END snippet, {_RERANK} rerank FROM f JOIN g USING (id) LEFT JOIN documents ON id = doc_id WHERE quality = 1 OR toxic = 1 ORDER BY rerank DESC, id LIMIT 10"
)
SQL["rag_prompt"] = (
    f"WITH {_bm25_sql(_ONE)}, sp AS (SELECT doc_id id, rank, score FROM (" + _TOP.format("hits", 100) + ")), m AS (SELECT *, CASE WHEN max(score) OVER () = min(score) OVER () THEN 0.0 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END score_norm FROM sp), "
    + f"b AS (SELECT id, concat_ws('. ', source, coalesce(text, '')) t, {_RERANK} rerank, score_norm, rank FROM m LEFT JOIN documents ON id = doc_id ORDER BY rerank DESC, score_norm, rank LIMIT 2) "
    + "SELECT 'Kontext:' || chr(10) || coalesce(nullif(string_agg(t, chr(10) || chr(10) ORDER BY rerank DESC, id), ''), '(Kein Kontext gefunden.)') || chr(10) || chr(10) || 'Frage: ' || 'thing of ertion' AS prompt FROM b"
)

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_and_operator, bm25_okapi, bm25_benchmark, bm25_replaced, bm25_merged, bm25_past_version, bm25_multifield_boost, index_statistics, fuzzy_term_match, minmax_normalise, knn_topk, knn_per_query, knn_filtered, knn_threshold, approximate_knn, approximate_knn_everything, l2_normalise, dense_two_level, linear_fusion, concat_fusion_rerank, dedupe_fusion, hybrid_search, filtered_search, late_text_lookup, union_all_sources, engine_search, rag_prompt)}
