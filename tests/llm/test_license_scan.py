import random
import re

import pytest

from forumlake.llm import license_scan as scan
from forumlake.llm.queries import op12_license_scan

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute_force(text, templates, phrases):
    """(n_words, places, matches) by trying every template on every block and every window of it."""
    all_, blocks, open_ = [], [], False
    for line in (text or "").split("\n"):
        own = words(line)
        if own and not open_:
            blocks.append([])
        open_ = bool(own)
        if own:
            blocks[-1] += [(len(all_) + k, w) for k, w in enumerate(own)]
            all_ += own
    places = sorted((label, i) for phrase, label in phrases for i in range(len(all_)) if all_[i : i + len(words(phrase))] == words(phrase))
    matches = []
    for label, template in templates:
        wanted, width = set(words(template)), scan.WINDOW * len(words(template))
        for block in blocks:
            best = max(len({w for _, w in block[max(0, k - width + 1) : k + 1]} & wanted) for k in range(len(block)))
            if 100 * best >= scan.CONTAINED * len(wanted):
                matches.append((label, round(best / len(wanted), 9)))
    return len(all_), places, sorted(matches)


def told(row):
    return row.n_words, sorted((x.label, x.first) for x in row.places), sorted((x.label, round(x.share, 9)) for x in row.matches)


def test_scan_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = {r.doc_id: told(r) for r in scan.scan(docs).collect()}
    assert found == {r.doc_id: brute_force(r.text, scan.TEMPLATES, scan.PHRASES) for r in docs.collect()}
    assert any(x[2] for x in found.values())


def test_random_texts(spark, monkeypatch):
    """Templates of common and rare words, words repeated, blocks cut anywhere; every filter of the join is at its edge."""
    rng = random.Random(5)
    monkeypatch.setattr(scan, "CONTAINED", 70)
    letters = "abcdefghijkl"
    templates = tuple((f"t{k}", " ".join(rng.choices(letters, k=rng.randint(1, 9)))) for k in range(25))
    phrases = (("a b", "ab"), ("c", "c"), ("a a a", "aaa"))
    texts = ["".join(rng.choice(letters + "AB") + rng.choice([" ", " ", " ", "\n", "\n-\n", ", "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r.doc_id: told(r) for r in scan.scan(rows, templates, phrases).collect()}
    assert found == {i: brute_force(t, templates, phrases) for i, t in enumerate(texts)}


def test_labels(spark):
    texts = {
        1: "x\nLicensed under the Apache License, Version 2.0.", 2: "Released under the MIT License.", 3: "Licensed under CC BY-NC 4.0.", 4: "ALL rights, reserved", 5: "nothing of the kind, version 2 of a text",
        6: "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles, to deal in the Software without any restriction", 7: "apache " + "word " * 90 + "licensed under the license version 2 0",
    }
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r for r in scan.labelled(scan.scan(rows)).collect()}
    assert {i: r.labels for i, r in found.items()} == {1: "apache", 2: "mit", 3: "cc-by,cc-by-nc", 4: "reserved", 5: "", 6: "mit", 7: ""}
    assert {i: r.base_labels for i, r in found.items() if r.base_labels} == {3: "cc-by", 4: "reserved"}
    assert (found[4].first_word, found[4].last_word, found[4].n_base, found[4].score) == (0, 0, 1, 1.0)
    assert (found[5].first_word, found[5].n_base, found[5].score) == (None, 0, 0.0) and found[2].score == 1.0


def test_query_equals_brute_force(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in op12_license_scan(spark, small).collect():
        n, places, matches = brute_force(texts[r.doc_id], scan.TEMPLATES, scan.PHRASES)
        at = [i for _, i in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for x, _ in places})) and r.labels == ",".join(sorted({x for x, _ in places + matches}))
        assert r.score == (1.0 if at else max((s for _, s in matches), default=0.0)) or abs(r.score - max(s for _, s in matches)) < 1e-6


def test_odd_rows(spark, odd):
    rows = odd.collect()
    found = sorted(((r.doc_id or -1, *told(r)) for r in scan.scan(odd).collect()), key=str)
    assert found == sorted(((r.doc_id or -1, *brute_force(r.text, scan.TEMPLATES, scan.PHRASES)) for r in rows), key=str)
    assert scan.labelled(scan.scan(odd.limit(0))).count() == 0
    assert scan.scan(odd, templates=()).count() == len(rows)
    with pytest.raises(ValueError):
        scan.scan(odd, templates=(), phrases=())
    with pytest.raises(ValueError):
        scan.scan(odd, templates=(("x", " ".join(f"w{i}" for i in range(scan.VOCABULARY + 1))),))
