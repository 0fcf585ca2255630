"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document's features are the buckets of its words, of pairs of neighbours and
of pairs with one word between, each counted once. Training passes over a
bounded sample of labelled documents, taken in an order that hashes the id, with
a learning rate for each coordinate and L1 that leaves most weights at zero; the
other weights are at most as many as buckets, and are broadcast. Every text is
scored whole, a slice of texts at a time.

Defined results: null and empty texts have no features and get the score of the
bias; without labels of both kinds every score is 0; rows with a null doc_id are
scored and never learnt from; repeated rows get equal scores; an empty table
gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ngrams import slices, word_features, word_hashes

#: 2 ** BITS buckets; labelled documents of each kind at most; passes over them; least score that counts as toxic.
BITS, MOST_TOXIC, MOST_CLEAN, PASSES, TOXIC = 20, 3000, 9000, 8, 0.3
#: Characters of a document of the sample at most, which bounds what training gathers; every text is scored whole.
SAMPLE_CHARS = 16_000
#: FTRL-proximal: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1


def fold(parts: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % parts


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the sample: no row whose fold is 2 of 4."""
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(fold(4) != 2).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = known.filter("toxic = 1").orderBy(*order).limit(MOST_TOXIC).unionByName(known.filter("toxic = 0").orderBy(*order).limit(MOST_CLEAN))
    short = docs.filter(F.length("text") <= SAMPLE_CHARS).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # One row of each chosen document, however often it is repeated: bounded by the two limits.
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def features(rows: DataFrame) -> DataFrame:
    """(doc_id, toxic, buckets): distinct buckets of each text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, text, offsets in slices(batch.column("text")):
                bucket, row = word_features(*word_hashes(text, offsets), BITS)
                both = np.unique((row << BITS) | bucket)
                ends = np.searchsorted(both >> BITS, np.arange(len(offsets)))
                found += [(both[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], ["doc_id", "toxic", "buckets"])

    return rows.mapInArrow(find, "doc_id long, toxic int, buckets binary")


def ftrl(examples: list[tuple[np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets with a weight, their weights, and the bias, which has no L1."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(PASSES):
        for at, y in examples:
            zi, ni = z[at], n[at]
            w, b = weights(zi, ni, L1), -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - y
            grown = np.sqrt(ni + g * g)
            z[at] = zi + g - (grown - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
            grown = np.sqrt(bias_n + g * g)
            bias_z, bias_n = bias_z + g - (grown - np.sqrt(bias_n)) / ALPHA * b, bias_n + g * g
    w = weights(z, n, L1)
    kept = np.flatnonzero(w)
    return kept, w[kept], float(-bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float] | None:
    rows = features(training_rows(docs, labels)).toPandas()
    if rows.toxic.nunique() < 2:
        return None
    rows = rows.assign(order=(rows.doc_id.astype("int64") * 2654435761) % (1 << 32)).sort_values(["order", "doc_id", "buckets"])
    return ftrl([(np.frombuffer(b, dtype=np.int32), int(y)) for b, y in zip(rows.buckets, rows.toxic)])


def score(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs."""
    model = spark.sparkContext.broadcast(train(docs, labels))  # at most 2 ** BITS weights

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = np.zeros(1 << BITS), 0.0
        if model.value:
            at, w, bias = model.value
            dense[at] = w
        for batch in batches:
            sums = np.zeros(batch.num_rows)
            for first, text, offsets in slices(batch.column("text")):
                bucket, row = word_features(*word_hashes(text, offsets), BITS)
                weighty = dense[bucket] != 0
                both = np.unique((row[weighty] << BITS) | bucket[weighty])
                sums[first : first + len(offsets) - 1] += np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=len(offsets) - 1)
            found = 1 / (1 + np.exp(-np.clip(sums + bias, -35, 35))) if model.value else sums
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, "doc_id long, score double")
    held_out = F.coalesce(fold(4) == 2, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
