import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from forumlake.llm import packing, token_files
from forumlake.llm.common import new_path
from forumlake.llm.encode import Encoder
from forumlake.llm.queries import op3_token_files, op5_best_fit_packing, tokenizer_path

_library = Tokenizer.from_file(tokenizer_path())
_encoder = Encoder(tokenizer_path())


def ids(text):
    return _library.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from(list("abZé ß漢,.!'\n\t   \x1c1²Ġ<|>")), max_size=40), max_size=5))
@settings(max_examples=300, deadline=None)
def test_encoder_equals_library(texts):
    assert [x.tolist() for x in _encoder.encode(texts, 7)] == [[*ids(t), 7] for t in texts]


def test_encoder_on_special_strings():
    for text in ("it's a dog's <|endoftext|> x", "a<|endoftext|>b", "<|endoftext|>", "<|endoftext| >", "foo.\nBar, baz!!", "a  b", " lead", "trail ", "\n", "", "don't 've", "A" * 300 + " b"):
        assert _encoder.encode([text], 2)[0].tolist() == [*ids(text), 2]


def test_token_files_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas().sort_values("doc_id")
    found = op3_token_files(spark, small).toPandas().sort_values("doc_id")
    start = 0
    for r, text in zip(found.itertuples(), docs.text):
        own = [*ids(text), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_file_format(spark, small):
    path = new_path(spark, "format")
    token_files.write_token_files(spark.read.parquet(f"{small}/documents.parquet"), path, tokenizer_path(), 2)
    from pathlib import Path

    file = next(Path(path).glob("*.parquet"))
    group = pq.ParquetFile(file).metadata.row_group(0)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    of_ids = next(v for k, v in columns.items() if k.startswith("ids"))
    assert of_ids.has_column_index and of_ids.has_offset_index and any("DICTIONARY" in e for e in of_ids.encodings)
    some = token_files.read_documents(spark, path, 10, 12)
    assert sorted(r.doc_id for r in some.collect()) == [10, 11, 12]


def test_odd_rows(spark, odd):
    found = token_files.with_crc32(token_files.token_files(spark, odd, tokenizer_path())).collect()
    assert len(found) == odd.count() and min(r.n_tokens for r in found) == 1
    assert sorted((r.start, r.n_tokens) for r in found)[0][0] == 0
    empty = odd.limit(0)
    assert token_files.token_files(spark, empty, tokenizer_path()).count() == 0
    assert packing.pack(spark, empty, tokenizer_path()).count() == 0
    check_packing(packing.pack(spark, odd, tokenizer_path()).toPandas(), 2048)


def check_packing(found, capacity):
    assert found.length.between(1, capacity).all()
    ordered = found.sort_values(["sequence_id", "offset"])
    by = ordered.groupby("sequence_id").length
    assert (ordered.offset == by.cumsum() - ordered.length).all() and by.sum().max() <= capacity


def test_packing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    found = op5_best_fit_packing(spark, small).toPandas()
    check_packing(found, 2048)
    for doc_id, text in zip(docs.doc_id, docs.text):
        own = [*ids(text), 0]
        mine = found[found.doc_id == doc_id].sort_values("piece")
        assert mine.length.sum() == len(own) and (mine.length.iloc[1:] == 2048).all()
        for r in mine.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())


def decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [g for g in gaps if g >= n]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=200))
@settings(max_examples=100, deadline=None)
def test_best_fit_is_about_as_good_as_one_by_one(lengths):
    counts = {n: lengths.count(n) for n in lengths}
    runs, opened = packing.best_fit(counts, 64)
    assert sum(r[1] for r in runs) == len(lengths)
    assert opened <= decreasing(lengths, 64) * 1.05 + 1


def test_best_fit_keeps_a_bounded_plan():
    """The rounds' state and plan depend on the lengths, not on how many pieces have them; sequences are about as few as the tokens need."""
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.clip(rng.lognormal(5.8, 1.1, 200_000).astype(int), 1, 2048), return_counts=True)
    for times in (1, 1000, 10**6):
        runs, opened = packing.best_fit({int(n): int(k) * times for n, k in zip(lengths, counts)}, 2048)
        assert len(runs) <= 6 * 2048 and opened <= 1.001 * (lengths * counts).sum() * times / 2048 + 1


def test_selective_reads(spark, small):
    """Counts are read without the ids, and a range of documents is pushed to the scan."""
    path = new_path(spark, "selective")
    token_files.write_token_files(spark.read.parquet(f"{small}/documents.parquet"), path, tokenizer_path(), 2)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    counts = plan(token_files.read_token_files(spark, path).select("doc_id", "n_tokens"))
    assert "ids:array" not in counts and "n_tokens:bigint" in counts
    some = plan(token_files.read_documents(spark, path, 10, 12))
    assert "GreaterThanOrEqual(doc_id,10)" in some and "LessThanOrEqual(doc_id,12)" in some


@pytest.mark.parametrize("capacity", [1, 2, 7])
def test_best_fit_small_capacities(capacity):
    counts = {n: 5 for n in range(1, capacity + 1)}
    runs, opened = packing.best_fit(counts, capacity)
    used: dict[int, list[tuple[int, int]]] = {}
    length_at = [n for n in sorted(counts, reverse=True) for _ in range(counts[n])]
    for first, n, sequence, offset in runs:
        for i in range(n):
            used.setdefault(sequence + i, []).append((offset, length_at[first + i]))
    assert len(used) == opened
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= capacity
