"""Audit of how filters interact: what each removes, in every order that they may be applied in.

Every document gets a mask with a bit for each filter that it fails: A under
LEAST_WORDS words, B too few distinct words, C too many capitals, D a sign of
SIGNS, E a copy of a text with a smaller doc_id. All counts follow from the
number of documents of each part and mask, whatever the order of the filters, so
the documents are read once and the rest is sums: counters are additive, and a
part has 2 ** 5 of them at most.

Copies are found by sorting. Rows are dealt out by range of the text's
fingerprint and doc_id, so that a group of copies of any size spreads over
partitions, and sorted in them by fingerprint, full text and doc_id; each row is
compared with the one before it. A row of a partition's first fingerprint may
have its predecessor in an earlier partition: each partition passes on the texts
of its last fingerprint, one row for each partition and text, which tell the
later ones whether the text has begun before.

Defined results: a null text counts as empty and is a copy of other empty ones; a
null source is the part with the empty name; a row with a null doc_id is no copy
and has none; rows of one doc_id count each and aren't copies of each other;
several labels of a document count if one says so; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, words

#: Filters in the order of their bits.
FILTERS = "ABCDE"
#: Words at least; distinct words in hundredths of all at least; capitals in hundredths of all characters at most; signs that aren't allowed.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 50, 65, 5, "[#$%&*|]"


def own_failures(text: Column) -> Column:
    """The bits of the filters that look at one text alone, A to D."""
    conditions = lambda w: (
        F.size(w) < LEAST_WORDS,
        100 * F.size(F.array_distinct(w)) < DISTINCT * F.size(w),
        100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > CAPITALS * F.char_length(text),
        text.rlike(SIGNS),
    )
    # Bound to a variable, so that a text is split once.
    bits = F.transform(F.array(words(text)), lambda w: sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions(w))), F.lit(0)))
    return F.element_at(bits, 1)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (doc_id, part, mask, fingerprint, text) without texts; see copies()."""
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    before, opening = None, None  # (fingerprint, text, doc_id of the run's first row); the partition's first fingerprint
    tail, of = [], None  # the texts of the latest fingerprint
    digest = b""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids, prints = (batch.column(c).to_numpy() for c in ("doc_id", "fingerprint"))
        text = batch.column("text")
        opening = int(prints[0]) if opening is None else opening
        new = np.ones(n, dtype=bool)
        new[1:] = (prints[1:] != prints[:-1]) | ~pc.equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False)
        if before is not None and before[0] == prints[0] and before[1] == text[0].as_py():
            new[0] = False
        starts = np.flatnonzero(new)
        run = np.cumsum(new)  # 0: the run that began before this batch
        first = np.concatenate([[before[2] if before else 0], ids[starts]])
        copy = ids > first[run]
        # Runs of the first fingerprint are told apart by a digest, made once for each run.
        digests: list[bytes | None] = [None] * n
        for i in range(n):
            if prints[i] != opening:
                break
            if new[i]:
                digest = sha256(text[i].as_py().encode()).digest()
            digests[i] = digest
        if of != prints[-1]:
            tail, of = [], prints[-1]
        tail += [text[i].as_py() for i in starts[prints[starts] == of].tolist()]
        before = (int(prints[-1]), text[n - 1].as_py(), int(first[run[-1]]))
        yield _batch(batch.column("part"), ids, batch.column("mask"), copy, prints, digests, task, False)
    if tail:
        ends = [sha256(x.encode()).digest() for x in tail]
        n = len(ends)
        yield _batch(pa.nulls(n, pa.string()), np.zeros(n, np.int64), pa.nulls(n, pa.int32()), np.zeros(n, bool), np.full(n, of), ends, task, True)


def _batch(part, ids, mask, copy, prints, digests, task: int, tail: bool) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(ids, pa.int64()), part, mask, pa.array(copy), pa.array(prints, pa.int64()), pa.array(digests, pa.binary()), pa.array(np.full(n, task, np.int32)), pa.array(np.full(n, tail))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "mask", "copy", "fingerprint", "digest", "task", "tail"])


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row; bit k of the mask is set if the document fails filter k."""
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    named = rows.filter("doc_id IS NOT NULL").withColumn("fingerprint", F.xxhash64("text"))
    sorted_ = named.repartitionByRange("fingerprint", "doc_id").sortWithinPartitions("fingerprint", "text", "doc_id")
    # The texts' own failures are found after the sort, whose ranges are drawn from a first pass over its input.
    judged = sorted_.select("doc_id", "part", own_failures(F.col("text")).cast("int").alias("mask"), "fingerprint", "text")
    kind = "doc_id long, part string, mask int, copy boolean, fingerprint long, digest binary, task int, tail boolean"
    found = cut(judged.mapInArrow(_compared, kind), "filter-copies")
    # A row for each partition of the sort, and for each of several texts of one fingerprint.
    begun = found.filter("tail").groupBy("fingerprint", "digest").agg(F.min("task").alias("begun"))
    seen = found.filter("NOT tail").join(F.broadcast(begun), ["fingerprint", "digest"], "left")
    copy = F.col("copy") | F.coalesce(F.col("begun") < F.col("task"), F.lit(False))
    seen = seen.select("doc_id", "part", F.col("mask").bitwiseOR(F.when(copy, 16).otherwise(0)).alias("mask"))
    return seen.unionByName(rows.filter("doc_id IS NULL").select("doc_id", "part", own_failures(F.col("text")).cast("int").alias("mask")))


def counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): the documents of each part and mask, those of good quality and the toxic ones."""
    marks = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    marked = rows.join(marks, "doc_id", "left")
    of = lambda mark: F.sum(F.when(F.col(mark) == 1, F.col("n")).otherwise(0)).alias(mark)
    return marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), of("good"), of("toxic"))


def _steps() -> str:
    """Every order of the filters with its steps: the filter, and those before it."""
    found = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            found.append({"filter_order": "".join(order), "step": step, "own": 1 << FILTERS.index(letter), "before": before})
            before |= found[-1]["own"]
    return json.dumps(found)


def audit(counted: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step from counters (part, mask, n, good, toxic)."""
    # A part's counters are 32 at most; the steps of all orders are a literal of 600.
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))
    steps = F.from_json(F.lit(_steps()), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = parts.select("part", "counts", F.explode(steps).alias("s")).select("part", "counts", "s.*")
    total = lambda column, which: F.expr(f"aggregate(counts, 0L, (a, x) -> a + IF({which}, x.{column}, 0L))")
    removed = "(x.mask & own) <> 0 AND (x.mask & before) = 0"
    return rows.select(
        "part", "filter_order", "step",
        total("n", "(x.mask & (before | own)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(x.mask & own) <> 0 AND (x.mask & before) <> 0").alias("redundant"),
        total("n", "x.mask = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # Of a document's failing filters each comes first in as many of the orders.
        F.expr("aggregate(counts, 0L, (a, x) -> a + IF((x.mask & own) <> 0, x.n * (120 DIV bit_count(x.mask)), 0L))").alias("shapley"),
    )
