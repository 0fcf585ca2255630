"""Token-ID output: Parquet files of ids in document order, for selective reads.

Documents are dealt out by range of doc_id, encoded and written in that order,
one list of ids a row. The column of ids has dictionary pages (the vocabulary
is small beside the rows), the counts are delta encoded when a dictionary
doesn't pay, row groups are of a set size, and the writer adds page indexes, so
that a reader of few documents or of counts only touches few pages.

Defined results: null text counts as empty and holds the end id alone; rows
with a null doc_id come first; repeated doc_ids follow each other, ordered by
text; an empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path
from .encode import encoder

#: Bytes of a row group and of a page, as the writer counts them.
ROW_GROUP_BYTES, PAGE_BYTES = 32 << 20, 256 << 10
#: Bytes of text that a Python worker encodes before it passes rows on.
CHUNK_BYTES = 2_000_000


def chunks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list[str]]]:
    """Slices of a batch's texts of about CHUNK_BYTES: first row and texts, null as empty."""
    values = batch.column(column)
    sizes = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(values):
        before = sizes[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(sizes, before + CHUNK_BYTES, side="right")))
        yield first, [x or "" for x in values[first:last].to_pylist()]
        first = last


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write (doc_id, n_tokens, file_part, file_start, ids) in ascending doc_id order.

    file_start counts the ids before the document in its file; file_part orders the files.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, tokens = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for first, texts in chunks(batch, "text"):
                ids = tokens.encode(texts, end_id)
                counts = np.array([len(x) for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                columns = [batch.column("doc_id").slice(first, len(texts)), pa.array(counts), pa.array(np.full(len(ids), part, dtype=np.int32)), pa.array(ends - counts + before), lists]
                before += int(ends[-1])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "file_part", "file_start", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = ordered.mapInArrow(encode, "doc_id long, n_tokens long, file_part int, file_start long, ids array<int>")
    options = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "compression": "snappy"}
    rows.write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before.

    The only thing gathered and broadcast is a row of 12 bytes for each file. Without ids selected, the scan skips their pages.
    """
    rows = spark.read.schema("doc_id long, n_tokens long, file_part int, file_start long, ids array<int>").parquet(path)
    sizes = rows.groupBy("file_part").agg(F.max(F.col("file_start") + F.col("n_tokens")).alias("size"))
    offsets = sizes.selectExpr("file_part", "sum(size) OVER (ORDER BY file_part) - size AS file_offset")
    return rows.join(F.broadcast(offsets), "file_part").select("doc_id", (F.col("file_offset") + F.col("file_start")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Only the documents with ids from first to last: row groups and pages outside are skipped."""
    rows = spark.read.schema("doc_id long, n_tokens long, file_part int, file_start long, ids array<int>").parquet(path)
    return rows.filter(F.col("doc_id").between(first, last)).select("doc_id", "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replaces ids by ids_crc32, the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    columns = [c for c in rows.columns if c != "ids"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, values = np.asarray(ids.offsets), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False)).astype("<u4", copy=False)
            found = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found, pa.int64())], [*columns, "ids_crc32"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(digest, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", ids_crc32 long")


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the token files in the shared folder and return (doc_id, start, n_tokens, ids) as read back."""
    path = new_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return read_token_files(spark, path)
