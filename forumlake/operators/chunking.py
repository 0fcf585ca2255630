"""Cutting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse

#: Characters of the chunks that are handed on together, about.
AT_ONCE = 1 << 20


def spans(n: int, find_end, window: int, least: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Spans over n characters; find_end(a, b) gives the place of the last sentence end in them or -1."""
    a = 0
    while n:
        b = min(n, a + window)
        if b < n:
            end = find_end(a, b)
            if end >= a + least:
                b = end
        yield a, b
        if b >= n:
            return
        a = b - overlap


def by_characters(docs: DataFrame, window: int = 1200, least: int = 600, overlap: int = 150) -> DataFrame:
    """(doc_id, chunk, char_start, char_end, text): windows of characters over collapsed text.

    A window ends before the last ". " if that is at least `least` characters in;
    the next begins `overlap` before the end. How far depends on the text before,
    so the loop runs in Python. Chunks are handed on AT_ONCE characters at a time,
    so that a task holds no more than a batch and these.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 5, kinds)], ["doc_id", "chunk", "char_start", "char_end", "text"])

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                doc_id, text = doc_id.as_py(), text.as_py()
                for i, (a, b) in enumerate(spans(len(text), lambda x, y: text.rfind(". ", x, y), window, least, overlap)):  # noqa: B023
                    rows.append((doc_id, i, a, b, text[a:b].strip()))
                    size += b - a
                    if size >= AT_ONCE:
                        yield handed(rows)
                        rows, size = [], 0
            yield handed(rows)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(collapse(F.col("text")), F.lit("")).alias("text"))
    return texts.mapInArrow(cut, "doc_id long, chunk int, char_start int, char_end int, text string")


def by_sentences(text: Column, budget: int = 500, carried: int = 8) -> Column:
    """Array of chunks: sentences up to a budget of words; the last few sentences are carried over."""
    sentences = F.filter(F.split(F.trim(F.coalesce(text, F.lit(""))), r"(?<=[.!?])\s+"), lambda s: s != "")
    count = lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("n"))

    def step(s, sentence):
        full = (s["n"] + count(sentence) > budget) & (F.size(s["open"]) > 0)
        kept = F.array().cast("array<string>") if carried == 0 else F.when(F.size(s["open"]) > carried, F.slice(s["open"], -carried, carried)).otherwise(s["open"])
        kept_n = F.aggregate(F.transform(kept, count), F.lit(0), lambda a, b: a + b)
        return F.struct(
            F.when(full, F.concat(s["done"], F.array(F.array_join(s["open"], " ")))).otherwise(s["done"]).alias("done"),
            F.when(full, F.concat(kept, F.array(sentence))).otherwise(F.concat(s["open"], F.array(sentence))).alias("open"),
            F.when(full, kept_n + count(sentence)).otherwise(s["n"] + count(sentence)).alias("n"),
        )

    return F.aggregate(sentences, state, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(F.array_join(s["open"], " ")))).otherwise(s["done"]))
