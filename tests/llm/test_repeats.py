"""Repeated rows, and both classifiers' scores worked out number by number."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from forumlake.llm import langid, near_dedup, neighbours, ngrams, toxicity

MASK = (1 << 64) - 1


def test_repeated_ids_leave_all_neighbours(spark):
    """Copies of one id, and of the query's own, take one place, whether they are the same vector or not."""
    rng = np.random.default_rng(8)
    others = {i: rng.standard_normal(12) for i in range(60)}
    query = rng.standard_normal(12)
    rows = [(100, query.tolist())] * 12 + [(100, rng.standard_normal(12).tolist())] + [(i, v.tolist()) for i, v in others.items()]
    for k in range(14):
        rows.append((200, (query + 0.01 * k * rng.standard_normal(12)).tolist()))
    schema = "vec_id long, embedding array<double>"
    found = neighbours.nearest(spark, spark.createDataFrame(rows, schema).coalesce(1), spark.createDataFrame([(100, query.tolist())] * 3, schema), k=5).orderBy("rank").collect()
    cosine = lambda v: float(np.dot(query, v) / np.linalg.norm(query) / np.linalg.norm(v))
    best = sorted([(-cosine(v), i) for i, v in others.items()] + [(-max(cosine(np.array(v)) for i, v in rows if i == 200), 200)])[:5]
    assert [(r["rank"], r.vec_id) for r in found] == [(k + 1, i) for k, (_, i) in enumerate(best)] and found[0].vec_id == 200
    only = spark.createDataFrame([(1, [1.0, 0.0])] * 9, schema)
    assert neighbours.nearest(spark, only, only.limit(1)).count() == 0


def learnable():
    from zlib import crc32

    return [i for i in range(400) if crc32(str(i).encode()) % 3 != 1]


def test_copies_of_a_document_are_one_example(spark):
    """A language whose documents are copies of one id is learnt, and the sample holds one of them."""
    ids = learnable()
    rows = [(ids[0], "die und der ist nicht mit einem wort " * 3, "de")] * 20_000 + [(i, f"the and of is not with a word {i} " * 3, "en") for i in ids[1:80]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    sample = langid.sample(docs).collect()
    assert len(sample) == 80 and sum(r.lang == "de" for r in sample) == 1
    found = langid.identify(spark, docs).select("doc_id", "lang_pred").distinct().collect()
    assert {r.lang_pred for r in found if r.doc_id == ids[0]} == {"de"}
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, toxic int")
    chosen = toxicity.training_rows(docs, marks)
    assert chosen.count() == chosen.select("doc_id").distinct().count() <= 80


def test_rows_that_stay_with_any_column_name(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 9), (2, "a b c d e f g", 8), (None, "x", 7)], "doc_id long, text string, _kept_id int")
    assert sorted((r.doc_id or 0, r._kept_id) for r in near_dedup.keep_one(docs).collect()) == [(0, 7), (1, 9)]


def lowered(text):
    data = bytearray((text or "").encode())
    for i, c in enumerate(data):
        if 65 <= c <= 90 or (i and data[i - 1] == 0xC3 and 0x80 <= c <= 0x9E and c != 0x97):
            data[i] += 32
    return bytes(data)


def is_word(c):
    return 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128


def test_languages_equal_brute_force(spark, small):
    """Counts, roots, margins and losses by dictionaries and loops."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    m = langid.train(docs)
    found = {r.doc_id: r for r in langid.identify(spark, docs).collect()}
    for r in docs.collect():
        data, counts = [c if is_word(c) else 32 for c in lowered(r.text)], Counter()
        for n in langid.ORDERS:
            for i in range(len(data) - n + 1):
                code = 0
                for c in data[i : i + n]:
                    code = code * 257 + c & 0xFFFFFFFF
                counts[((code + n) * 2654435769 & 0xFFFFFFFF) >> (32 - langid.BITS)] += 1
        length = math.sqrt(sum(counts.values())) or 1.0
        margins = [sum(math.sqrt(n) / length * float(m["w"][b, k]) for b, n in counts.items()) + float(m["b"][k]) for k in range(len(m["b"]))]
        losses = [sum(math.log1p(math.exp(-c * x)) * float(w) for c, x, w in zip(code, margins, m["weight"])) for code in m["code"]]
        best = min(range(len(losses)), key=losses.__getitem__)
        if any(c.isalpha() for c in r.text or ""):
            share = 1 / sum(math.exp(min(losses) - x) for x in losses)
            assert abs(found[r.doc_id].score - share) < 1e-3
            assert found[r.doc_id].lang_pred == m["languages"][best] or abs(sorted(losses)[1] - min(losses)) < 1e-3
        else:
            assert found[r.doc_id].lang_pred == "und"


def mixed(x):
    return int(ngrams.mixed(np.array([x & MASK], dtype=np.uint64))[0])


def test_toxicity_equals_brute_force(spark, small):
    """Distinct features of each text and their weights, one by one."""
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    at, w, bias = toxicity.train(docs, labels)
    weight = dict(zip(at.tolist(), w.tolist()))
    found = {r.doc_id: r.score for r in toxicity.score(spark, docs, labels).collect()}
    for r in docs.filter(F.length("text") < 4000).collect():
        words = "".join(chr(c) if is_word(c) else " " for c in lowered(r.text)).split(" ")
        words = [x.encode("latin-1").decode() for x in words if x]
        hashes = [int(ngrams.word_hashes(lowered_word, np.array([0, len(lowered_word)]))[0][0]) for lowered_word in (next(ngrams.slices(pa.array([x])))[1] for x in words)]
        features = set(hashes)
        for gap, factor in ((1, 0xD6E8FEB86659FD93), (2, 0xA0761D6478BD642F)):
            features |= {mixed(a * factor + b) for a, b in zip(hashes, hashes[gap:])}
        total = bias + sum(weight.get(b, 0.0) for b in {x >> (64 - toxicity.BITS) for x in features})
        assert abs(found[r.doc_id] - 1 / (1 + math.exp(-total))) < 1e-9
