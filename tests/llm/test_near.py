import re

import numpy as np
import pytest

from forumlake.llm import near_dedup as N

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    words = _WORD.findall((text or "").translate(_LOWER))
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def brute(docs):
    """docs: {id: text}. Set sizes and smallest reachable ids."""
    sets = {i: shingles(t) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in docs if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in docs}


def check(spark, docs):
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(rows).collect()}
    assert found == brute(docs)


def test_tables_equal_brute_force(spark, small):
    check(spark, {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()})


def test_five_words_equal_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    base = [f"w{i}" for i in range(120)]
    near = [w + "x" * (k % 20 == 7) for k, w in enumerate(base)]  # alike on pairs, not on five words
    docs |= {-1: " ".join(base), -2: " ".join(near), -3: " ".join(base[:-1]), -4: "one two three", -5: "three one two one", -6: "", -7: "a b c d e"}
    sets = {}
    for i, text in docs.items():
        words = _WORD.findall((text or "").translate(_LOWER))
        sets[i] = set(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else {tuple(words)} - {()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in docs if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(rows, width=5).collect()}
    assert found == {i: (len(sets[i]), top(i)) for i in docs}
    assert found[-2][1] == -2 and found[-1][1] == -3
    assert sorted(r.doc_id for r in N.keep_one(rows, width=5).collect()) == sorted(i for i in docs if top(i) == i)


def test_chains_and_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 400, 120)]
    docs, words = {}, list(base)
    for i in range(60):  # a chain: the ends have little in common
        words = list(words)
        words[int(rng.integers(0, 120))] = f"new{i}"
        docs[i] = " ".join(words)
    for i in range(60, 160):  # copies with more and fewer changes
        copy = list(base)
        for k in rng.integers(0, 120, int(rng.integers(0, 14))):
            copy[int(k)] = f"other{i}"
        docs[i] = " ".join(copy)
    docs[200], docs[201] = " ".join(base).upper(), " ".join(base)
    check(spark, docs)


@pytest.mark.parametrize("pivots", [1])
def test_blocks_find_what_pivots_miss(spark, monkeypatch, pivots):
    monkeypatch.setattr(N, "PIVOTS", pivots)
    monkeypatch.setattr(N, "BLOCK_DOCUMENTS", 16)
    test_chains_and_groups(spark)


def test_sets_met_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST", 0)
    test_chains_and_groups(spark)


def test_odd_rows(spark, odd):
    found = N.near_duplicates(odd).collect()
    assert len(found) == odd.count()
    by = {r.doc_id: r for r in found}
    assert (by[6].component_id, by[6].kept) == (1, False) and by[2].n_shingles == by[4].n_shingles == 0 and by[3].kept and by[5].n_shingles == 1
    assert by[None].component_id is None and by[None].kept
    kept = N.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 7, 8]
    assert N.near_duplicates(odd.limit(0)).count() == 0 and N.keep_one(odd.limit(0)).count() == 0


def test_texts_of_one_id_are_linked(spark):
    one, two, other = ("a b c d e f g h", "k l m n o p q r s", "t u v w x y z")
    rows = spark.createDataFrame([(1, one), (5, one), (5, two), (9, two), (9, other), (12, other), (13, "else where")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(rows).collect()} == {1: 1, 5: 1, 9: 1, 12: 1, 13: 13}
    assert sorted((r.doc_id, r.text) for r in N.keep_one(rows).collect()) == [(1, one), (13, "else where")]
    assert N.keep_one(rows.filter("doc_id = 5")).count() == 1


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, 4000).astype(np.uint64)) for _ in range(2))
    both = np.unique(np.concatenate([a, b[:500]]))
    assert (N.registers(np.unique(np.concatenate([a, b]))) == np.maximum(N.registers(a), N.registers(b))).all()
    true = len(np.intersect1d(a, both)) / len(np.union1d(a, both))
    found = N.likely_similarity(N.registers(a)[None], N.registers(both)[None], np.array([float(len(a))]), np.array([float(len(both))]))
    assert abs(found[0] - true) < 0.1


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)]
    found = {r.id: r.component for r in N.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
