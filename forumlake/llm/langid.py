"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1; for each place of the code a binary
classifier over hashed runs of bytes predicts the sign. Decoding sums for each
language the logistic losses of all places, weighted by how well each classifier
does on the sample, and takes the language of the least loss; a small gap to the
next marks the text as ambiguous. The classifiers are fitted on a bounded sample
of labelled documents; every text is read whole.

Defined results: a null text and one without a letter get `und` and score 0; if
no language can be learnt all texts do; a single language learnt is predicted
for all others with score 1; rows with a null doc_id are predicted and never
learnt from; repeated rows get equal results; an empty table gives no rows;
columns besides doc_id, text and (to learn) lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .ngrams import byte_features, slices

#: 2 ** BITS buckets of runs of ORDERS bytes; labelled documents of each language and of all at most; gap of losses that is ambiguous.
BITS, ORDERS, PER_LANGUAGE, SAMPLE, AMBIGUOUS = 12, (2, 3), 400, 16_000, 1.0
#: Times the documents wanted of a language that are ranked.
MARGIN = 4
#: Languages up to which all dichotomies make the code; places of longer codes for each doubling of the languages.
EXHAUSTIVE, PLACES = 5, 12
#: Passes over the sample, step, weight decay.
PASSES, STEP, DECAY = 150, 1.0, 1e-4


def codewords(n: int) -> np.ndarray:
    """A row of signs for each of n languages: all dichotomies for few, else the best of some random codes."""
    if n <= EXHAUSTIVE:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, dtype=np.float64).reshape(-1, n).T
    rng, best, most = np.random.default_rng(7), None, -1
    for _ in range(50):
        code = rng.choice([-1.0, 1.0], size=(n, PLACES * int(np.ceil(np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code @ code.T - np.eye(n) * 1e9).max() if n > 1 else 0
        if best is None or -apart > most:
            best, most = code, -apart
    return best


def vectors(column: pa.Array) -> Iterator[np.ndarray]:
    """Rows of square roots of counts, of unit length, for slices of texts."""
    for _, text, offsets in slices(column):
        for a in range(0, len(offsets) - 1, 256):
            part = offsets[a : a + 257]
            counts = np.zeros((len(part) - 1) << BITS)
            for bucket, row in byte_features(text[part[0] : part[-1]], part - part[0], BITS, ORDERS):
                counts += np.bincount((row << BITS) | bucket, minlength=len(counts))
            found = np.sqrt(counts.reshape(-1, 1 << BITS)).astype(np.float32)
            yield found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)


def held_out(parts: int, which: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == which, F.lit(False))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, vector) of the sample: for each language the documents whose ids have the least hashes."""
    known = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL").filter(~held_out(3, 1)).select("doc_id", "lang").distinct()  # a document counts once, however often its row is repeated
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(1), F.least(F.lit(PER_LANGUAGE), F.floor(F.lit(SAMPLE) / F.count("*").over(W.partitionBy())))).cast("long")
    sizes = sizes.withColumn("each", each)
    # Hashes are even, so that about MARGIN times as many as are wanted lie below the cut, and a language is never gathered.
    part = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32))).cast("double") / (1 << 32)
    few = known.join(sizes, "lang").filter(part * F.col("n") <= F.col("each") * MARGIN).select("doc_id", "lang", "each")
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)), "doc_id"))
    chosen = few.withColumn("rank", rank).filter("rank <= each").select("doc_id", "lang")  # SAMPLE rows at most, and one for each language

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.astype(np.float16).tobytes() for rows in vectors(batch.column("text")) for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(found, pa.binary())], ["doc_id", "lang", "vector"])

    rows = docs.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi").filter(F.col("text").rlike(r"\p{L}"))
    rows = rows.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))  # one row of each chosen document
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(read, "doc_id long, lang string, vector binary")


def train(docs: DataFrame) -> dict | None:
    rows = sample(docs).toPandas().sort_values(["lang", "doc_id", "vector"])
    languages = sorted(rows.lang.unique())
    if len(languages) < 2:
        return {"languages": languages} if languages else None
    code = codewords(len(languages))
    x = np.frombuffer(b"".join(rows.vector), dtype=np.float16).reshape(-1, 1 << BITS).astype(np.float32)
    which = np.searchsorted(languages, rows.lang.to_numpy())
    y = code[which].astype(np.float32)
    even = (1.0 / np.bincount(which)[which] / len(languages)).astype(np.float32)[:, None]
    w, b, speed, speed_b = (np.zeros(s, dtype=np.float32) for s in ((x.shape[1], y.shape[1]), y.shape[1], (x.shape[1], y.shape[1]), y.shape[1]))
    for _ in range(PASSES):
        g = -y * even / (1 + np.exp(np.clip(y * (x @ w + b), -30, 30)))
        speed, speed_b = 0.9 * speed - STEP * 4 * (x.T @ g + DECAY * w), 0.9 * speed_b - STEP * g.sum(axis=0)
        w, b = w + speed, b + speed_b
    right = ((y * (x @ w + b)) > 0).astype(np.float32)
    accuracy = np.clip((right * even).sum(axis=0), 0.5, 0.999)
    weight = np.log(accuracy / (1 - accuracy))
    weight = weight / weight.mean() if weight.sum() else np.ones_like(weight)
    return {"languages": languages, "code": code, "w": w, "b": b, "weight": weight}


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every row of docs."""
    model = spark.sparkContext.broadcast(train(docs))  # 2 ** BITS weights for each place of the code

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            letters = np.array([bool(x) for x in batch.column("letters").to_pylist()])
            lang, score, vague = np.full(len(letters), "und", dtype=object), np.zeros(len(letters)), np.zeros(len(letters), dtype=bool)
            if m and "code" not in m:
                lang[letters], score[letters] = m["languages"][0], 1.0
            elif m and len(letters):
                margins = np.concatenate([x @ m["w"] + m["b"] for x in vectors(batch.column("text"))])
                losses = np.stack([(np.logaddexp(0, -c * margins) * m["weight"]).sum(axis=1) for c in m["code"]], axis=1)
                best = losses.argmin(axis=1)
                two = np.sort(losses, axis=1)[:, :2]
                lang[letters] = np.array(m["languages"], dtype=object)[best][letters]
                score[letters] = (1 / np.exp(two[:, :1] - losses).sum(axis=1))[letters]
                vague = letters & (two[:, 1] - two[:, 0] < AMBIGUOUS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(vague)], ["doc_id", "lang_pred", "score", "ambiguous"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters.alias("letters")).mapInArrow(predict, "doc_id long, lang_pred string, score double, ambiguous boolean")
    return found.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")
