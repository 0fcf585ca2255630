import hashlib
import zlib

from pyspark.sql import functions as F

from forumlake.llm import merkle
from forumlake.llm.queries import op11_merkle_manifest

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in FIELDS))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        found.append([h(*found[-1][i : i + 3]) for i in range(0, len(found[-1]), 3)])
    return found


def way(tree, i):
    found = []
    for level in tree[:-1]:
        a = i // 3 * 3
        found.append((level[a:i], level[i + 1 : a + 3]))
        i //= 3
    return found


def brute_force(rows):
    """What the contract says, in plain Python: (doc_id, leaf, subroot, root, proof, folded, verified) by row."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    top, found = levels([t[-1][0] for t in trees]), []
    for k, s in enumerate(sources):
        for i, (known, doc_id, own, row) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            proof = way(trees[k], i) + way(top, k)
            changed = row["text"] is not None and known and zlib.crc32(str(doc_id).encode()) % 2 == 0
            node = leaf({**row, "text": row["text"].replace("\n", "")}) if changed else own
            for before, after in proof:
                node = h(*before, node, *after)
            found.append((row["doc_id"], own, trees[k][-1][0], top[-1][0], h(*(x for p in proof for y in p for x in y)), node, node == top[-1][0]))
    return sorted(found, key=str)


def told(frame):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in frame.collect()), key=str)


def test_manifest_equals_brute_force(spark, small):
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert told(op11_merkle_manifest(spark, small)) == brute_force(rows)


def test_odd_rows(spark, odd):
    rows = [r.asDict() for r in odd.collect()]
    assert told(merkle.verified(odd)) == brute_force(rows)
    assert told(merkle.verified(odd.limit(0))) == []
    one = odd.filter("doc_id = 1")
    assert told(merkle.verified(one)) == brute_force([r.asDict() for r in one.collect()])


def test_deep_tries_split_buckets_and_copies(spark, monkeypatch):
    """Several rounds of blocks, several digits, buckets that are split, runs of copies longer than a block, negative and wide ids."""
    monkeypatch.setattr(merkle, "HEAVY", 40)
    monkeypatch.setattr(merkle, "DIGIT_BITS", 4)
    rows = [(i * 7 - 300, f"a\n{i}", "hot") for i in range(1200)] + [(5, f"t{i}", "hot") for i in range(90)] + [(5, "same\n", "hot")] * 900
    rows += [(1 << 62, "far\n", "b"), (-(1 << 62), "far", "b"), (None, "n\n", "ü"), (None, "m", "ü"), (3, None, None)] + [(i, "x", f"s{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).repartition(5)
    assert told(merkle.verified(docs)) == brute_force([r.asDict() for r in docs.collect()])


def test_ranks_without_one_large_window(spark):
    """No window goes over a whole source."""
    plan = merkle.ranked(spark.createDataFrame([("s", 1, b"ab", None, 1)], "key string, doc_id long, leaf binary, other binary, copies long"))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
