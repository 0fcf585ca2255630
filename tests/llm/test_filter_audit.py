import itertools
import random
import re

from forumlake.llm import filter_audit as audit
from forumlake.llm.queries import op13_filter_audit

COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(rows):
    """The letters of the filters that each row fails."""
    found = []
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            t = r["text"] or ""
            least[t] = min(least.get(t, r["doc_id"]), r["doc_id"])
    for r in rows:
        t = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        conditions = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search(r"[#$%&*|]", t), r["doc_id"] is not None and least[t] < r["doc_id"])
        found.append("".join(x for x, c in zip("ABCDE", conditions) if c))
    return found


def brute_force(rows, labels):
    """Every order applied to the documents one by one."""
    good = {x["doc_id"] for x in labels if x["quality"] == 1} - {None}
    toxic = {x["doc_id"] for x in labels if x["toxic"] == 1} - {None}
    failed, found = fails(rows), {}
    parts = {}
    for r, f in zip(rows, failed):
        parts.setdefault(r["source"] or "", []).append((r["doc_id"], f))
    for part, docs in parts.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = list(docs), []
            for step, x in enumerate(order, 1):
                out = [d for d in left if x in d[1]]
                earlier = sum(x in d[1] for d in gone)
                left, gone = [d for d in left if x not in d[1]], gone + out
                shapley[x] += len(out)
                found[part, "".join(order), step] = [len(left), len(out), earlier, sum(d[1] == x for d in docs), sum(d[0] in good for d in out), sum(d[0] in toxic for d in out), x]
        for key, value in found.items():
            if key[0] == part:
                value[-1] = shapley[value[-1]]
    return found


def told(frame):
    return {(r.part, r.filter_order, r.step): [r[c] for c in COLUMNS] for r in frame.collect()}


def test_query_equals_brute_force(spark, small):
    docs, labels = ([r.asDict() for r in spark.read.parquet(f"{small}/{t}.parquet").collect()] for t in ("documents", "labels"))
    assert told(op13_filter_audit(spark, small)) == brute_force(docs, labels)


def test_copies_across_partitions(spark):
    """Groups of copies over several partitions of the sort, with repeated ids at their ends, many times over."""
    rng = random.Random(3)
    for turn in range(3):
        texts = ["hot"] * 30 + ["warm", "", None, "x y z", "Ünï"]
        rows = [(rng.randrange(150) if rng.random() < 0.95 else None, rng.choice(texts), rng.choice(["a", None, ""])) for _ in range(400)] + [(i, f"only {i}", "b") for i in range(20)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        spark.conf.set("spark.sql.shuffle.partitions", str(5 + 8 * turn))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            found = sorted((str(r.doc_id), r.part, r.mask) for r in audit.failures(docs).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        named = [{"doc_id": a, "text": b, "source": c} for a, b, c in rows]
        assert found == sorted((str(r["doc_id"]), r["source"] or "", sum(1 << "ABCDE".index(x) for x in f)) for r, f in zip(named, fails(named)))


def test_fingerprints_that_collide(spark, monkeypatch):
    """Different texts of one fingerprint are no copies, wherever partitions end."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(audit.F, "xxhash64", lambda c: F.length(c).cast("long"))
    rows = [(i, "abcdef"[i * 7 % 6] * 3, "s") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        copies = {r.doc_id for r in audit.failures(docs).collect() if r.mask & 16}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert copies == {i for i, t, _ in rows if any(u == t for _, u, _ in rows[:i])}


def test_odd_rows(spark, odd, marks):
    docs, labels = [r.asDict() for r in odd.collect()], [r.asDict() for r in marks.collect()]
    assert told(audit.audit(audit.counters(audit.failures(odd), marks))) == brute_force(docs, labels)
    assert audit.audit(audit.counters(audit.failures(odd.limit(0)), marks.limit(0))).count() == 0
    assert told(audit.audit(audit.counters(audit.failures(odd), marks.limit(0)))) == brute_force(docs, [])
