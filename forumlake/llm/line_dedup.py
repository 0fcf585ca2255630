"""Line dedup with a log-template tree.

A line goes down a tree of fixed depth: the count of its tokens, then its leading
token, where a token with a digit is a variable field. At a leaf a line's tokens
are dealt into CELLS cells of neighbours; a template is what a line has in all
cells but VARIABLE, which become fields as well. A line has a template for each
choice of these cells, so that a leaf holds any number of templates and lines
that agree meet whatever else is there. A template recurs if so many documents
have it:

* lines under SHORT_TOKENS tokens, which must agree in all: SHORT_DOCUMENTS
* lines under LONG_TOKENS: three, or two that agree token by token
* longer ones: two.

Lines with few tokens that aren't fields, such as rows of numbers, only recur as
they are. Of the lines of a recurring template the first stays, or none without
keep_first: a line goes if one before it shares a recurring template. Lines that
differ in VARIABLE cells at most agree in one of VARIABLE + 1 groups of cells, so
keys of the leaf with each group tell in a first pass which lines can have a
template in common. Lines with equal cells are one class, of which the first
place and the first three documents stand for all; only classes that share a
group with another one get a key for each choice of cells. Keys are 64-bit
hashes, counted with partial aggregates; no leaf and no template is ever
gathered, and what the documents are joined with is the list of their dropped
lines.

without_recurring_lines, the pipeline's stage, also leaves out the documents of
which that leaves hardly anything: copies of others, line by line.

Defined results: a null text stays null and an empty one empty; lines without a
token, or of one or two fields, always stay, and so do lines that repeat within
one document only; rows with equal doc_id and text are one document and lose the
same lines; the smallest doc_id (null first) keeps a recurring line; an empty
table gives no rows; other columns pass through unchanged, but drop_lines
replaces an input column named n_dropped_lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut, words
from .ngrams import NOT_SPACE, mixed, powers, slices, spans

#: Cells of a line at most; cells that may differ, in lines of CELLS tokens and in shorter ones.
CELLS, VARIABLE, VARIABLE_SHORT = 10, 2, 1
#: Tokens from which a line has fields besides tokens with digits, and documents of shorter ones; tokens of a long line.
SHORT_TOKENS, SHORT_DOCUMENTS, LONG_TOKENS = 8, 10, 20
#: Tokens without a digit that a line with fields has at least; they are half of its tokens at least.
LEAST_FIXED = 3
#: Words, and hundredths of its words, that a document which lost lines keeps at least, or it goes.
LEAST_WORDS, LEAST_SHARE = 20, 20

_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_FIELD = np.uint64(0x2545F4914F6CDD1D)
#: What a line is, in the lowest two bits of its keys.
_SHORT, _FEW, _MIDDLE, _LONG = range(4)


def line_keys(text: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, line in the row) of every line, (line's place among them, key) of every key, those of whole lines first, and a signature and the leaf of each line.

    A signature is four bytes for the tokens as they are and two for each cell. The leaf is 0 for lines that have no cells."""
    starts, ends, hashes = spans(text, offsets, NOT_SPACE)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[text])])
    field = digits[ends] > digits[starts]
    heads = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(text == 10) + 1]))
    line_of = np.searchsorted(heads, starts, side="right") - 1
    lines, first, n = np.unique(line_of, return_index=True, return_counts=True)
    fields = np.concatenate([[0], np.cumsum(field)])
    fixed = n - (fields[first + n] - fields[first])
    enough = (n >= LEAST_FIXED) | (fixed > 0)
    lines, first, n, fixed = lines[enough], first[enough], n[enough], fixed[enough]
    row = np.searchsorted(offsets, heads[lines], side="right") - 1
    line = lines - np.searchsorted(heads, offsets[row])

    up, down = powers(len(hashes) + 1)
    masked = np.where(field, _FIELD, hashes)
    sums, plain = (np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(x * up[: len(x)])]) for x in (masked, hashes))

    def run(a: np.ndarray, b: np.ndarray, of: np.ndarray = sums) -> np.ndarray:
        return mixed((of[b] - of[a]) * down[a] + (b - a).astype(np.uint64))

    general = (fixed >= LEAST_FIXED) & (2 * fixed >= n)
    exact = run(first, first + n, plain)
    whole = np.where(general, run(first, first + n), mixed(exact ^ np.uint64(0xA0761D6478BD642F)))
    kind = np.select([n < SHORT_TOKENS, n < CELLS, n < LONG_TOKENS], [_SHORT, _FEW, _MIDDLE], _LONG).astype(np.uint64)
    at, keys, leaves = [np.arange(len(n))], [whole], np.zeros(len(n), dtype=np.uint64)
    cells = np.minimum(n, CELLS)
    for chosen, groups in ((general & (n >= SHORT_TOKENS) & (n < CELLS), VARIABLE_SHORT + 1), (general & (n >= CELLS), VARIABLE + 1)):
        where = np.flatnonzero(chosen)
        a, m, c = first[where], n[where], cells[where]
        leaf = mixed(masked[a] * np.uint64(0xD6E8FEB86659FD93) + m.astype(np.uint64))
        leaves[where] = leaf | np.uint64(1)
        for g in range(groups):
            low, high = (x * m // c for x in (g * c // groups, (g + 1) * c // groups))
            at.append(where)
            keys.append(mixed(leaf + run(a + low, a + high) * np.uint64(2 * g + 3)))
    at, keys = np.concatenate(at), np.concatenate(keys)
    keys = ((keys & ~np.uint64(3)) | kind[at]).view(np.int64)

    signature = np.zeros((len(n), 2 + CELLS), dtype="<u2")
    signature[:, :2] = (exact >> np.uint64(32)).astype("<u4").view("<u2").reshape(-1, 2)
    where = np.flatnonzero(general & (n >= SHORT_TOKENS))
    bounds = np.minimum(np.arange(CELLS + 1)[None, :], cells[where, None]) * n[where, None] // cells[where, None] + first[where, None]
    signature[where, 2:] = (run(bounds[:, :-1], bounds[:, 1:]) >> np.uint64(48)).astype("<u2")
    return row, line, at, keys, signature, leaves.view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).filter("text IS NOT NULL")


def keys_of_documents(docs: DataFrame) -> DataFrame:
    """(key) of every key of a document, once."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text, offsets in slices(batch.column("text"), lower=False):
                row, _, at, keys, *_ = line_keys(text, offsets)
                order = np.lexsort((keys, row[at]))
                keys, row = keys[order], row[at][order]
                new = np.ones(len(keys), dtype=bool)
                new[1:] = (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(keys[new])], ["key"])

    return _rows(docs).select("text").mapInArrow(find, "key long")


def keys_of_lines(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text_hash, line, signature, leaf, whole) of every key of every line."""
    names = ["key", "doc_id", "text_hash", "line", "signature", "leaf", "whole"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, text, offsets in slices(batch.column("text"), lower=False):
                row, line, at, keys, signature, leaf = line_keys(text, offsets)
                of, size = pa.array(row[at] + start), signature.itemsize * signature.shape[1]
                ends = np.arange(len(at) + 1, dtype=np.int32) * size
                taken = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(signature[at]))])
                whole = pa.array(np.arange(len(at)) < len(row))
                yield pa.RecordBatch.from_arrays([pa.array(keys), batch.column("doc_id").take(of), batch.column("text_hash").take(of), pa.array(line[at].astype(np.int32)), taken, pa.array(leaf[at]), whole], names)

    return _rows(docs).mapInArrow(find, "key long, doc_id long, text_hash long, line int, signature binary, leaf long, whole boolean")


def _templates(classes: DataFrame) -> DataFrame:
    """(template, class, kind, first) of classes (class, kind, leaf, cells, first): one for each choice of the cells that may vary."""
    pairs = list(combinations(range(CELLS), VARIABLE))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.frombuffer(b"".join(batch.column("cells").to_pylist()), dtype="<u2").reshape(-1, CELLS).astype(np.uint64)
            leaf, kind = batch.column("leaf").to_numpy().view(np.uint64), batch.column("kind").to_numpy()
            each = mixed((cells + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) + np.arange(CELLS, dtype=np.uint64) * _FIELD)
            all_ = mixed(leaf) + each.sum(axis=1, dtype=np.uint64)
            at, found = [], []
            for chosen, choices in ((np.flatnonzero(kind == _FEW), [(c,) for c in range(CELLS)]), (np.flatnonzero(kind != _FEW), pairs)):
                for number, left_out in enumerate(choices, 1):
                    at.append(chosen)
                    found.append(mixed(all_[chosen] - each[chosen][:, left_out].sum(axis=1, dtype=np.uint64) + np.uint64(number * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)))
            at, found = pa.array(np.concatenate(at)), pa.array(np.concatenate(found).view(np.int64))
            yield pa.RecordBatch.from_arrays([found, *(batch.column(c).take(at) for c in ("class", "kind", "first"))], ["template", "class", "kind", "first"])

    return classes.select("class", "kind", "leaf", "cells", "first").mapInArrow(choose, "template long, class long, kind int, first struct<doc_id:long,text_hash:long,line:int>")


_LEAST = "CASE kind WHEN 0 THEN {} WHEN 3 THEN 2 ELSE 3 END"


def _recurring(documents: DataFrame, *by: str, least: str) -> DataFrame:
    """The values of by that so many distinct documents have, of (by, kind, document)."""
    return documents.select(*by, "kind", "document").distinct().groupBy(*by, "kind").agg(F.count("*").alias("n")).filter(f"n >= {least}").select(*by)


def dropped_lines(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """(doc_id, text_hash, drop): the places of the lines that go, for the documents that lose any."""
    kind = F.col("key").bitwiseAND(F.lit(3)).cast("int")
    counts = keys_of_documents(docs).groupBy("key").agg(F.count("*").alias("n"))
    recurring = counts.filter(F.col("n") >= F.when(kind == _SHORT, SHORT_DOCUMENTS).otherwise(2)).select("key")
    met = cut(keys_of_lines(docs).join(recurring, "key"), "lines").withColumn("kind", kind)
    met = met.withColumns({"place": F.struct("doc_id", "text_hash", "line"), "document": F.struct("doc_id", "text_hash")})
    after = (lambda first: F.col("place") > first) if keep_first else (lambda first: F.lit(True))
    least = _LEAST.format(SHORT_DOCUMENTS)
    gone = []

    # Lines that agree in all tokens that aren't fields, and in all tokens.
    lines = met.filter("whole").withColumn("exact", F.substring("signature", 1, 4))
    for by, some, enough in ((["key"], lines, least), (["key", "exact"], lines.filter(F.col("kind").isin(_FEW, _MIDDLE)), "2")):
        firsts = some.groupBy(*by).agg(F.min("place").alias("first")).join(_recurring(some, *by, least=enough), by)
        gone.append(some.join(firsts, by).filter(after(F.col("first"))).select("doc_id", "text_hash", "line"))

    # Classes that share a group of cells with another one, and their templates.
    general = met.filter("leaf <> 0").withColumn("cells", F.substring("signature", 5, 2 * CELLS)).withColumn("class", F.xxhash64("leaf", "cells"))
    groups = general.filter("NOT whole").groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low <> high").select("key")
    near = cut(general.filter("NOT whole").join(groups, "key").select("class", "kind", "leaf", "cells", "place", "document"), "near")
    classes = near.groupBy("class", "kind", "leaf", "cells").agg(F.min("place").alias("first"))
    # A class's first three documents tell whether its templates have three.
    rank = F.row_number().over(W.partitionBy("class").orderBy("document"))
    few = near.select("class", "document").distinct().withColumn("rank", rank).filter("rank <= 3").drop("rank")
    templates = cut(_templates(classes), "templates")
    shared = templates.groupBy("template").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.min("first").alias("begins")).filter("low <> high").select("template", "begins")
    templates = cut(templates.select("template", "class", "kind").join(shared, "template"), "shared")
    recur = _recurring(templates.join(few, "class"), "template", least=least)
    reach = templates.join(recur, "template").groupBy("class").agg(F.min("begins").alias("first"))
    gone.append(near.join(reach, "class").filter(after(F.col("first"))).select("place.*"))
    return reduce(DataFrame.unionByName, gone).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("drop"))


def drop_lines(docs: DataFrame, keep_first: bool = True) -> DataFrame:
    """docs with the recurring lines taken out of text, and n_dropped_lines."""
    own = [c for c in docs.columns if c != "n_dropped_lines"]
    found = _dropped(docs.select(*own), keep_first)
    return found.select(*[(F.col("_text") if c == "text" else F.col("_row")[c]).alias(c) for c in own], F.col("_n").alias("n_dropped_lines"))


def _dropped(docs: DataFrame, keep_first: bool) -> DataFrame:
    """(_row, _text, _n): every row of docs, its text without the recurring lines, and their number."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("long").alias("_doc_id"), F.xxhash64("text").alias("_text_hash"))
    gone = dropped_lines(docs, keep_first)
    joined = rows.join(gone, F.col("_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_hash") == F.col("text_hash")), "left")
    kept = F.array_join(F.filter(F.split("_row.text", "\n"), lambda x, i: ~F.array_contains("drop", i)), "\n")
    text = F.when(F.col("drop").isNull(), F.col("_row.text")).otherwise(kept)
    return joined.select("_row", text.alias("_text"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("_n"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs without their recurring lines, with its own columns only; n_chars, where there is one, counts what is left.

    A document that lost lines goes if fewer than LEAST_WORDS words or LEAST_SHARE hundredths of its words are left."""
    found = _dropped(docs, keep_first=True)
    left, had = F.size(words(F.col("_text"))), F.size(words(F.col("_row.text")))
    found = found.filter((F.col("_n") == 0) | ((left >= LEAST_WORDS) & (100 * left >= LEAST_SHARE * had)))
    own = {c: F.col("_row")[c] for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in own:
        own["n_chars"] = F.length("_text").cast(dict(docs.dtypes)["n_chars"])
    return found.select(*[v.alias(c) for c, v in own.items()])
