"""Merkle manifest of a dataset: leaves ranked by digits of doc_id, tries of ranks, a proof for each row.

A row's leaf is the hash of its fields, each with its length. The leaves of a
source are ordered by doc_id and, among equal ones, by the leaf; every FANOUT
consecutive nodes of a level become one node of the next, until one is left, the
source's subroot. The subroots, ordered by source, give the root likewise.

Ranks need no global sort. A histogram counts a source's leaves by the high
digits of doc_id (its buckets of 2 ** LOW_BITS ids), and is summed up digit by
digit, so that every running sum goes over the 2 ** DIGIT_BITS children of one
prefix at most. The start of a leaf's bucket is the sum of what stands before it
at each digit; in its bucket a leaf is counted among at most 2 ** LOW_BITS ids.
Buckets of more than HEAVY leaves, which only repeated ids make, are split by
the id itself and by leading digits of the leaf. Equal rows are one row with a
count before any of this, so no number of copies meets in one task.

The digits of a rank to the base FANOUT are a leaf's way through the trie. The
nodes below a common prefix, SPAN levels of them, are one block, reduced in one
task; blocks' nodes are the leaves of the next round, and a round leaves
FANOUT ** -SPAN of the nodes. On the way back each block hands its nodes the
siblings on their way to the root; leaves are folded with them.

Defined results: a null source is a source of its own and comes first; a null
doc_id comes before the others of its source and is never tampered with; rows
that are equal in all fields stand next to each other, each with its own place
and proof; null fields differ from empty ones; a dataset of one row has the leaf
as its root and the hash of nothing as its proof; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import cut

#: Children of a node; levels that one task reduces, so that a block has FANOUT ** SPAN nodes at most.
FANOUT, SPAN = 3, 6
#: Bits of a doc_id inside a bucket, bits of a digit above, leaves of a bucket from which it is split, bits of the leaf that split it.
LOW_BITS, DIGIT_BITS, HEAVY, LEAF_BITS = 9, 11, 8192, 16
#: The fields of a leaf in their order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_NODES = FANOUT**SPAN
_MANIFEST = "doc_id long, source string, rank long, leaf string, subroot string, root string, proof array<string>, folded_root string"


def digest(*values: Column) -> Column:
    """The hash of fields, each "-" if null, else its number of UTF-8 bytes, ":" and itself."""
    told = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (x.cast("string") for x in values)]
    return F.sha2(F.concat(*told).cast("binary"), 256)


def without_line_ends(docs: DataFrame) -> DataFrame:
    """docs with a column _other: the text without line ends where 2 divides the id's CRC-32, null if that changes nothing."""
    marked = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return docs.withColumn("_other", F.when(marked & F.col("text").contains("\n"), F.replace("text", F.lit("\n"), F.lit(""))))


def leaves(docs: DataFrame) -> DataFrame:
    """(key, doc_id, leaf, other, copies) of the distinct rows: other is the leaf with the text of a column _other, if it has one; key tells sources apart and orders them."""
    own = [F.col(c) for c in FIELDS]
    other = F.when(F.col("_other").isNotNull(), F.unhex(digest(*own[:-1], F.col("_other")))) if "_other" in docs.columns else F.lit(None).cast("binary")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    rows = docs.select(key.alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(digest(*own)).alias("leaf"), other.alias("other"))
    return rows.groupBy("key", "doc_id", "leaf", "other").agg(F.count("*").alias("copies"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (key, doc_id, leaf, other, copies) with start, the place of the first copy in its key, and total, the key's number of copies."""
    ends = rows.select(F.shiftright("doc_id", LOW_BITS).alias("b")).agg(F.min("b").alias("low"), F.max("b").alias("high")).first()
    low, high = (0, 0) if ends.low is None else (ends.low, ends.high)
    # Buckets from 1 on; 0 is that of null ids.
    bucket = F.coalesce(F.shiftright("doc_id", LOW_BITS) - F.lit(low) + 1, F.lit(0))
    rows = rows.withColumns({"bucket": bucket, "part": F.lit(0).cast("long")})
    at = cut(rows.groupBy("key", "bucket").agg(F.sum("copies").alias("n"), F.count("*").alias("distinct")), "merkle-counts")
    heavy = at.filter(F.col("distinct") > HEAVY).select("key", "bucket", F.lit(1).alias("heavy"))
    levels = []  # of the histogram: nodes with what stands before them below the same prefix
    if not heavy.isEmpty():
        within = F.coalesce(F.col("doc_id").bitwiseAND((1 << LOW_BITS) - 1), F.lit(0)) * (1 << LEAF_BITS)
        within = within + F.conv(F.hex(F.substring("leaf", 1, LEAF_BITS // 8)), 16, 10).cast("long")
        rows = cut(rows.join(heavy, ["key", "bucket"], "left").withColumn("part", F.when(F.col("heavy") == 1, within).otherwise(0)).drop("heavy"), "merkle-leaves")
        parts = rows.groupBy("key", "bucket", "part").agg(F.sum("copies").alias("n")).withColumn("part_high", F.shiftright("part", DIGIT_BITS))
        parts = cut(parts, "merkle-counts")
        levels.append(_before(parts, ["key", "bucket", "part_high"], "part"))
        levels.append(_before(parts.groupBy("key", "bucket", "part_high").agg(F.sum("n").alias("n")), ["key", "bucket"], "part_high"))
    at = at.drop("distinct")
    digits, digit_levels, child, width = [], [], "bucket", high - low + 2
    while True:
        parent = f"prefix{len(digits)}"
        at = at.withColumn(parent, F.shiftright(child, DIGIT_BITS))
        digit_levels.append(_before(at, ["key", parent], child))
        digits.append((child, parent))
        at = at.groupBy("key", parent).agg(F.sum("n").alias("n"))
        child, width = parent, ((width - 1) >> DIGIT_BITS) + 1
        if width == 1:
            break
    starts = at.select("key", child, F.col("n").alias("total"), F.lit(0).cast("long").alias("start"))
    for level, (lower, parent) in zip(reversed(digit_levels), reversed(digits)):
        starts = level.join(starts, ["key", parent]).select("key", lower, "total", (F.col("start") + F.col("before")).alias("start"))
    for level, prefix, lower in zip(reversed(levels), (["key", "bucket"], ["key", "bucket", "part_high"]), ("part_high", "part")):
        starts = level.join(starts, prefix).select(*prefix, lower, "total", (F.col("start") + F.col("before")).alias("start"))
    if not levels:
        starts = starts.withColumn("part", F.lit(0).cast("long"))
    starts = starts.select("key", "bucket", "part", "total", F.col("start").alias("bucket_start"))
    same = W.partitionBy("key", "bucket", "part").orderBy("doc_id", "leaf", "other").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = rows.withColumn("upto", F.sum("copies").over(same)).join(starts, ["key", "bucket", "part"])
    return found.select("key", "doc_id", "leaf", "other", "copies", "total", (F.col("bucket_start") + F.col("upto") - F.col("copies")).alias("start"))


def _before(counts: DataFrame, prefix: list[str], digit: str) -> DataFrame:
    """counts with before: what the smaller digits below the same prefix count."""
    running = W.partitionBy(*prefix).orderBy(digit).rowsBetween(W.unboundedPreceding, W.currentRow)
    return counts.withColumn("before", F.sum("n").over(running) - F.col("n")).drop("n")


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """(key, block, total, nodes) of nodes (key, total, rank, hash, ...): those below one prefix in their order, FANOUT ** SPAN at most."""
    one = F.struct(F.col("rank"), F.col("hash"), *[F.col(c) for c in more])
    found = nodes.groupBy("key", F.floor(F.col("rank") / _NODES).alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(one)).alias("nodes"))
    return cut(found, "merkle-blocks")


def _levels(hashes: list[str], whole: bool) -> list[list[str]]:
    """The levels from a block's nodes up: to its single node if the block holds its key whole, else SPAN of them."""
    found = [hashes]
    while len(found[-1]) > 1 if whole else len(found) <= SPAN:
        last = found[-1]
        found.append([sha256("".join(last[i : i + FANOUT]).encode()).hexdigest() for i in range(0, len(last), FANOUT)])
    return found


def _siblings(levels: list[list[str]], i: int) -> list[str]:
    """What stands before and after node i in its run, level by level."""
    way = []
    for level in levels[:-1]:
        first = i - i % FANOUT
        way += ["".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])]
        i //= FANOUT
    return way


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One block at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _by_block(blocks: DataFrame, of, kind: str) -> DataFrame:
    """What of() gives for each row of blocks and its levels: lists of values, one batch a block."""
    names = [x.split(" ")[0] for x in kind.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(x.split(" ")[0], types[x.split(" ")[1]]) for x in kind.split(", ")])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            hashes = [n["hash"] if isinstance(n["hash"], str) else n["hash"].hex() for n in row["nodes"]]
            found = of(row, _levels(hashes, row["total"] <= _NODES))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), schema.types)], names)

    return blocks.mapInArrow(work, kind)


def _reduced(blocks: DataFrame) -> DataFrame:
    """(key, total, rank, hash): the node of each block; total is the number of its key's blocks."""
    return _by_block(blocks, lambda row, levels: [(row["key"], -(-row["total"] // _NODES), row["block"], levels[-1][0])], "key string, total long, rank long, hash string")


def _tries(nodes: DataFrame, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, and (key, hash) of the keys' last nodes."""
    rounds, done = [], None
    while True:
        rounds.append(_blocks(nodes, *more) if not rounds else _blocks(nodes))
        nodes = cut(_reduced(rounds[-1]), "merkle-nodes")
        ended = nodes.filter("total = 1").select("key", "hash")
        done = ended if done is None else done.unionByName(ended)
        nodes = nodes.filter("total > 1")
        if nodes.isEmpty():
            return rounds, done


def _ways(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(key, block, way) of the blocks of the first round, way being the siblings before and after, level by level, from the block's node to the root.

    tops: (key, way) of the keys' last nodes."""

    def descend(row: dict, levels: list[list[str]]) -> list[tuple]:
        return [(row["key"], n["rank"], _siblings(levels, i) + row["way"]) for i, n in enumerate(row["nodes"])]

    ways = None
    for i in reversed(range(len(rounds))):
        # Keys that end with this round have one block, whose node is their last.
        own = rounds[i].filter(F.col("total") <= _NODES).select("key", "block").join(tops, "key")
        ways = own if ways is None else own.unionByName(ways)
        if i:
            ways = cut(_by_block(rounds[i].join(ways, ["key", "block"]), descend, "key string, block long, way array<string>"), "merkle-ways")
    return ways


def _ordered(tops: DataFrame) -> DataFrame:
    """The nodes of the sources' trie: (key, total, rank, hash, source), ranked by a range sort of the distinct sources."""
    placed = tops.repartitionByRange("key").sortWithinPartitions("key").withColumn("at", F.monotonically_increasing_id())
    placed = cut(placed.select("key", "hash", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "merkle-sources")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition of the sort
    offsets = sizes.select("part", F.sum("n").over(W.orderBy("part")).alias("upto"), F.col("n"), F.sum("n").over(W.partitionBy()).alias("total"))
    found = placed.join(F.broadcast(offsets), "part")
    return found.select(F.lit("").alias("key"), "total", (F.col("upto") - F.col("n") + F.col("at")).alias("rank"), "hash", F.col("key").alias("source"))


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, source, rank, leaf, subroot, root, proof, folded_root) of every row of docs.

    proof is the siblings on the way to the root, two texts a level: the hashes before and those after. With a column _other, the leaf that is folded is that of the text in it, where it isn't null."""
    found = cut(ranked(cut(leaves(docs), "merkle-leaves")), "merkle-ranked")
    if found.isEmpty():
        return docs.sparkSession.createDataFrame([], _MANIFEST)
    # A run of copies is cut at the ends of blocks before it is dealt out.
    last = F.col("start") + F.col("copies") - 1
    runs = found.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / _NODES), F.floor(last / _NODES))))
    first = F.greatest(F.col("start"), F.col("block") * _NODES)
    runs = runs.withColumn("rank", F.explode(F.sequence(first, F.least(last, (F.col("block") + 1) * _NODES - 1))))
    rounds, tops = _tries(runs.select("key", "total", "rank", F.col("leaf").alias("hash"), "doc_id", "other"), "doc_id", "other")
    tops = cut(tops, "merkle-subroots")
    above, end = _tries(_ordered(tops), "source")
    root = end.first().hash
    none = docs.sparkSession.createDataFrame([("", [])], "key string, way array<string>")
    above = above[0].join(_ways(above, none), ["key", "block"])
    sources = cut(_by_block(above, lambda row, levels: [(n["source"], _siblings(levels, i) + row["way"]) for i, n in enumerate(row["nodes"])], "key string, way array<string>"), "merkle-tops")
    ways = _ways(rounds, sources).join(tops.withColumnRenamed("hash", "subroot"), "key")

    def fold(row: dict, levels: list[list[str]]) -> list[tuple]:
        found, source = [], row["key"][1:] if row["key"] else None
        for i, n in enumerate(row["nodes"]):
            proof = _siblings(levels, i) + row["way"]
            node = levels[0][i] if n["other"] is None else n["other"].hex()
            for k in range(0, len(proof), 2):
                node = sha256((proof[k] + node + proof[k + 1]).encode()).hexdigest()
            found.append((n["doc_id"], source, n["rank"], levels[0][i], row["subroot"], root, proof, node))
        return found

    return _by_block(rounds[0].join(ways, ["key", "block"]), fold, _MANIFEST)


def verified(docs: DataFrame) -> DataFrame:
    """The manifest of docs with proofs as hashes and whether the rows, some of them tampered with, fold to the root."""
    found = manifest(without_line_ends(docs))
    proof = F.sha2(F.array_join("proof", "").cast("binary"), 256)
    return found.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "source", "rank")
