"""Best-fit packing of documents' tokens into sequences of a fixed capacity.

Bulk-synchronous best fit. Pieces are range-sorted by length, so that those of
one length are a run of positions; gaps of open sequences are kept as runs of
sequences with the same room. In every round each run of unplaced pieces looks
up its successor, the least room that holds it, in the gaps as they were at the
round's start; of the runs that want the same gap the longer pieces rank first;
placed pieces shrink their gaps, and the rest tries again. Pieces that no gap
holds open sequences. Lengths and rooms are at most the capacity, so the rounds
work on a number of runs that the capacity bounds, whatever the number of
documents; the pieces themselves are only sorted once and looked up once.

Defined results: null text counts as empty and holds the end id alone; a null
doc_id is a document like others; repeated rows are packed each; an empty table
gives no rows; columns besides doc_id and text are ignored. Pieces of equal
length are ordered by doc_id, piece and start.

pack_in_order packs documents that have a slot and a place in a mixture: best fit
within windows of successive slots, whose sequences are numbered by the first
place that they hold, so that the order of the mixture is that of the sequences.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, with_earlier
from .encode import encoder
from .token_files import chunks


#: A round takes the pieces of at least this share of the longest that waits; shorter ones fill what those leave.
SHARE = 0.75
#: Slots that are counted together, and documents of a window of slots at least.
SLOTS, WINDOW = 64, 2048


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document and the long columns in keep; only the first piece of a long one may be short."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer)
        for batch in batches:
            for first, texts in chunks(batch, "text"):
                rows: list[tuple[int, int, int, int, int]] = []
                for i, ids in enumerate(tokens.encode(texts, end_id)):
                    n, ids = len(ids), ids.astype("<u4")
                    head = n % capacity or capacity
                    for piece, a in enumerate([0, *range(head, n, capacity)]):
                        b = head if piece == 0 else a + capacity
                        rows.append((i, piece, a, b - a, zlib.crc32(ids[a:b])))
                row, *rest = (np.array(x, dtype=np.int64) for x in zip(*rows))
                columns = [batch.column("doc_id").slice(first, len(texts)).take(pa.array(row)), pa.array(rest[0].astype(np.int32)), *(pa.array(x) for x in rest[1:])]
                columns += [batch.column(c).slice(first, len(texts)).take(pa.array(row)) for c in keep]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", *keep])

    return docs.select(F.col("doc_id").cast("long"), "text", *(F.col(c).cast("long") for c in keep)).mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + "".join(f", {c} long" for c in keep))


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Rounds over runs. counts: pieces of each length; positions number them from the longest on.

    Returns runs (first position, number, first sequence, offset), one piece to a sequence, and the number of sequences.
    """
    placed: list[tuple[int, int, int, int]] = []
    waiting: list[tuple[int, int, int]] = []  # length, first position, number
    at = opened = 0
    for length in sorted(counts, reverse=True):
        waiting.append((length, at, counts[length]))
        at += counts[length]
    gaps: dict[int, list[tuple[int, int]]] = {}  # room: runs of sequences (first, number)

    def put(length: int, first: int, n: int, room: int, runs: list[tuple[int, int]], new: dict) -> int:
        """Put up to n pieces into the runs of sequences with that room; how many found a place."""
        done = 0
        while done < n and runs:
            sequence, free = runs.pop()
            k = min(free, n - done)
            placed.append((first + done, k, sequence, capacity - room))
            if free > k:
                runs.append((sequence + k, free - k))
            if room > length:
                new.setdefault(room - length, []).append((sequence, k))
            done += k
        return done

    while waiting:
        rooms, new, left, homeless = sorted(gaps), {}, [], []
        least = waiting[0][0] * SHARE
        for length, first, n in waiting:  # the longest first: rank among those that want a gap
            if length < least:
                left.append((length, first, n))
                continue
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                homeless.append((length, first, n))
                continue
            done = put(length, first, n, rooms[i], gaps[rooms[i]], new)
            if done < n:
                left.append((length, first + done, n - done))
        if homeless:
            # Pieces over half a sequence can't share one. The others wait for the room that these leave;
            # without such, as many open one as their tokens fill.
            large = [x for x in homeless if 2 * x[0] > capacity]
            budget = 0 if large else -(-sum(length * n for length, _, n in homeless) // capacity)
            for length, first, n in homeless:
                k = n if 2 * length > capacity else min(n, budget)
                if k:
                    budget -= k if 2 * length <= capacity else 0
                    put(length, first, k, capacity, [(opened, k)], new)
                    opened += k
                if k < n:
                    left.append((length, first + k, n - k))
        for room, runs in new.items():
            gaps.setdefault(room, []).extend(runs)
        gaps = {room: runs for room, runs in gaps.items() if runs}
        waiting = sorted(left, key=lambda x: x[1])
    return sorted(placed), opened


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    found = cut(pieces(docs, tokenizer, end_id, capacity), "pieces")
    ordered = found.repartitionByRange(F.desc("length"), "doc_id", "piece", "start").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start")
    numbered = cut(ordered.withColumn("row", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("row", 33)
    sizes = numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # a row for each partition
    offsets, before = {}, 0
    for part_id, n in sorted((r.part, r.n) for r in sizes):
        offsets[part_id] = before
        before += n
    counts = {r.length: r.n for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    runs, _ = best_fit(counts, capacity)
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    known = spark.sparkContext.broadcast((offsets, table))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, runs = known.value
        for batch in batches:
            row = batch.column("row").to_numpy()
            position = (row & ((1 << 33) - 1)) + np.array([before[p] for p in (row >> 33).tolist()], dtype=np.int64)
            run = np.searchsorted(runs[:, 0], position, side="right") - 1
            sequence = runs[run, 2] + position - runs[run, 0]
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(runs[run, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_in_order(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of docs, which have slot and place."""
    found = cut(pieces(docs, tokenizer, end_id, capacity, ("slot", "place")), "pieces")
    stretch = F.floor(F.col("slot") / SLOTS)
    # A row for SLOTS units of documents; successive ones are a window from WINDOW documents on.
    sizes = found.filter("piece = 0").groupBy(stretch.alias("stretch")).agg(F.count("*").alias("n"))
    windows = with_earlier(cut(sizes, "stretches"), "stretch").select("stretch", F.floor(F.col("earlier") / WINDOW).alias("window"))
    dealt = found.withColumn("stretch", stretch).join(windows, "stretch")

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), *((c, "ascending") for c in ("doc_id", "piece", "start", "slot", "place"))])
        lengths, piece, slot, place = (rows.column(c).to_numpy() for c in ("length", "piece", "slot", "place"))
        runs = np.array(best_fit(dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)))), capacity)[0], dtype=np.int64).reshape(-1, 4)
        position = np.arange(len(lengths))
        run = np.searchsorted(runs[:, 0], position, side="right") - 1
        sequence = runs[run, 2] + position - runs[run, 0]
        # Sequences by the first place in the mixture that they hold.
        first = np.unique(sequence[np.lexsort((piece, place, slot))], return_index=True)[1]
        rank = np.argsort(np.argsort(first))
        sequence = rank[np.searchsorted(np.unique(sequence), sequence)]
        kept = [rows.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "window")]
        return pa.Table.from_arrays([*kept, pa.array(sequence), pa.array(runs[run, 3])], ["doc_id", "piece", "start", "length", "ids_crc32", "window", "sequence", "offset"])

    fitted = dealt.select("doc_id", "piece", "start", "length", "ids_crc32", "slot", "place", "window").groupBy("window").applyInArrow(fit, "doc_id long, piece int, start long, length long, ids_crc32 long, window long, sequence long, offset long")
    fitted = cut(fitted, "fitted")
    opened = cut(fitted.groupBy("window").agg((F.max("sequence") + 1).alias("n")), "windows")
    numbered = fitted.join(with_earlier(opened, "window").select("window", F.col("earlier").alias("before")), "window")
    return numbered.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("sequence")).alias("sequence_id"), "offset")
