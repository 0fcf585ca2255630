"""MinHash near-dedup with SetSketch registers.

A document's set holds its distinct shingles of a given number of words (two in
op4_near_dedup, five in the pipeline), as 64-bit hashes. A sketch has M registers; a register is the least of exponentially distributed
hashes of the set's elements on a scale of powers of BASE, truncated to 16 bits.
The register of a union is the larger of two, and equal registers are the more
likely the more two sets have in common.

Documents with equal sets are one class, and only the class's smallest doc_id
goes on. Bands of registers deal the classes into buckets. In every round each
bucket has a pivot, by another order in each band, and the members are compared
with the pivot: by size, by the likelihood of the registers given the similarity
and both sizes, and at last on the full sets. Links are contracted to components.
Members of buckets that still hold several components are compared once more, in
blocks: all pairs of which one is outside its group's largest component, unless
what the two share with any open document is already too little. So no bucket is
gathered, and no pair of a bucket is left out unless both are in one component.

Defined results: null and empty texts and texts without words have an empty set
and are linked with nothing; a text of fewer words than a shingle is the set's one element; rows with equal
doc_id are one document, so that their texts are of one component; a null doc_id is linked with nothing; repeated rows are
returned each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard
from .ngrams import NOT_SPACE, mixed, slices, word_hashes

#: Registers, bands, registers in a band, base of the scale, rate of the exponentials.
M, BANDS, ROWS, BASE, RATE = 256, 32, 4, 1.001, 20.0
#: Least similarity in hundredths, and least estimate that is still compared on full sets (4.4 standard deviations lower).
SIMILAR, ESTIMATE = 80, 0.69
#: Rounds of pivots; documents of a block in which those that are left are compared.
PIVOTS, BLOCK_DOCUMENTS = 2, 1024
#: Rounds of labels after each round of pivots.
STEPS = 2
#: Documents of pairs whose ids are broadcast, so that texts stay in place; more are joined by a shuffle.
BROADCAST = 1_000_000
#: Elements whose hashes are made at once.
BLOCK = 4096

_FACTORS = mixed(np.arange(1, M + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, width: int = 2) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's distinct shingles of width words."""
    for _, text, offsets in slices(column, latin=False):
        words, rows = word_hashes(text, offsets, NOT_SPACE)
        at = np.searchsorted(rows, np.arange(len(offsets)))
        runs = words[: max(0, len(words) - width + 1)]
        for k in range(1, width):
            runs = mixed(runs * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(runs)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            if b - a >= width:
                yield np.unique(runs[a : b - width + 1])
            else:  # all its words are the one element
                whole = words[a : min(a + 1, b)]
                for k in range(a + 1, b):
                    whole = mixed(whole * np.uint64(0xD6E8FEB86659FD93) + words[k])
                yield whole


def registers(elements: np.ndarray) -> np.ndarray:
    """M 16-bit registers of a set that isn't empty. The least exponential goes with the largest uniform hash."""
    largest = np.zeros(M, dtype=np.uint64)
    for i in range(0, len(elements), BLOCK):
        np.maximum(largest, (elements[None, i : i + BLOCK] * _FACTORS[:, None]).max(axis=1), out=largest)
    below = (np.float64(2**64) - largest.astype(np.float64) + 1) / 2.0**64
    least = -np.log1p(-np.minimum(below, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, 65535).astype("<u2")


def likely_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """The similarity of most likelihood for rows of registers, given the sets' sizes."""
    larger, smaller = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    grid = np.linspace(0.0, 1.0, 101)[None, :] * np.minimum(u / v, v / u)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    up, down = p(u - v * grid), p(v - u * grid)
    value = larger * np.log(up) + smaller * np.log(down) + (M - larger - smaller) * np.log(np.clip(1 - up - down, 1e-12, 1))
    return np.take_along_axis(grid, value.argmax(axis=1)[:, None], axis=1)[:, 0]


def sketches(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n, f1, f2, registers) of every row; f1 and f2 are sums over the set, which tell sets apart."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, f1, f2, found = [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                f1.append(int(s.sum().astype(np.int64)))
                f2.append(int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
                found.append(registers(s).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n", "f1", "f2", "registers"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sketch, "doc_id long, n long, f1 long, f2 long, registers binary")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and registers allow the similarity."""
    one, two = (classes.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}")) for x in "ab")
    sized = pairs.join(one, "a").join(two, "b").filter(100 * F.least("n_a", "n_b") >= SIMILAR * F.greatest("n_a", "n_b"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(f"r_{x}").to_pylist()), dtype="<u2").reshape(-1, M) for x in "ab")
            found = likely_similarity(a, b, *(batch.column(f"n_{x}").to_numpy().astype(np.float64) for x in "ab"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(found >= ESTIMATE))

    return sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(estimate, "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of some documents."""
    wanted = cut(ids, "wanted")
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")


def _sets(docs: DataFrame, ids: DataFrame, width: int, short: bool = False) -> DataFrame:
    """(doc_id, elements) of some documents: the hashes as bytes. short: their distinct upper halves."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, size = [], [], 0
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width)):
                ids.append(i)
                sets.append((np.unique(s >> np.uint64(32)).astype(np.uint32) if short else s).tobytes())
                size += len(sets[-1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "elements"])
                    ids, sets, size = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "elements"])

    return _texts(docs, ids).mapInArrow(collect, "doc_id long, elements binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= SIMILAR * (len(a) + len(b) - common)


def _open_links(open_: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The links (a, b) between open documents of one group of buckets, of which one isn't in the group's largest component.

    A group is dealt out in blocks of documents; each task holds one block of the
    documents outside the largest component against one block of the group. Half
    of each hash bounds what two sets share; the pairs left are confirmed on full sets.
    """
    firsts = open_.groupBy("band").agg(F.min("id").alias("b"))
    near = open_.select("band", F.col("id").alias("a")).join(firsts, "band").select("a", "b")
    roots = components(near).withColumnRenamed("component", "root")
    people = cut(open_.select("id", "component", "n", "shared").distinct().join(roots, "id"), "people")
    shares = people.groupBy("root", "component").agg(F.count("*").alias("k"))
    groups = shares.groupBy("root").agg(F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("most")).filter("all > most.k")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK_DOCUMENTS)).cast("int")
    groups = groups.select("root", F.col("most.component").alias("main"), blocks(F.col("all")).alias("of_all"), blocks(F.col("all") - F.col("most.k")).alias("of_minor"))
    sets = _sets(docs, people.select(F.col("id").alias("doc_id")).distinct(), width, short=True)
    rows = people.join(groups, "root").join(classes.select("id", "registers"), "id").join(sets.withColumnRenamed("doc_id", "id"), "id")
    rows = cut(rows, "open")
    own = [c for c in rows.columns if c not in ("of_all", "of_minor", "main")]
    spot = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    minors = rows.filter("component <> main").select(*own, spot("of_minor", 1).alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("j"))
    everyone = rows.select(*own, F.explode(F.sequence(F.lit(0), F.col("of_minor") - 1)).alias("i"), spot("of_all", 2).alias("j"))

    def compare(left, right):
        import pandas as pd

        found = []
        if len(left) and len(right):
            sets = [np.frombuffer(x, dtype=np.uint32) for x in right.elements]
            theirs = np.frombuffer(b"".join(right.registers), dtype="<u2").reshape(-1, M)
            ids, of, n, shared = (right[c].to_numpy() for c in ("id", "component", "n", "shared"))
            for x in left.itertuples():
                common = np.minimum(shared, x.shared)
                rows = np.flatnonzero((of != x.component) & (100 * common >= SIMILAR * (n + x.n - common)))
                mine = np.frombuffer(x.registers, dtype="<u2")[None, :]
                rows = rows[np.count_nonzero(theirs[rows] == mine, axis=1) >= ESTIMATE * M]
                own = np.frombuffer(x.elements, dtype=np.uint32)
                for r in rows.tolist():
                    # Elements whose halves coincide within a set may be common too.
                    most = len(np.intersect1d(own, sets[r], assume_unique=True)) + min(x.n - len(own), n[r] - len(sets[r]))
                    if 100 * most >= SIMILAR * (n[r] + x.n - most):
                        found.append((min(x.id, ids[r]), max(x.id, ids[r])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    key = ["root", "i", "j"]
    found = minors.groupBy(*key).cogroup(everyone.groupBy(*key)).applyInPandas(compare, "a long, b long").distinct()
    return _linked(cut(found, "likely"), docs, width)


def _alone(open_: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(id, alone): how many elements of a document's set stand in no other open document's.

    Two open documents have no more in common than the fewer of their other elements.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), width)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(s.view(np.int64))], ["id", "element"])

    found = _texts(docs, open_.select(F.col("id").alias("doc_id")).distinct()).mapInArrow(elements, "id long, element long")
    owners = found.groupBy("element").agg(F.min("id").alias("id"), F.max("id").alias("other"))
    return owners.filter("id = other").groupBy("id").agg(F.count("*").alias("alone"))


def _linked(pairs: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity. Only the documents of pairs are read into sets."""
    sets = cut(_sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width), "sets")
    one, two = (sets.select(F.col("doc_id").alias(x), F.col("elements").alias(f"s_{x}")) for x in "ab")
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "s_a", "s_b")

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s_a"), batch.column("s_b")):
                keep.append(similar(*(np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirm, "a long, b long").distinct()


def _step(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Labels (id, component, was) after a look at the neighbours and one at the label's own label."""
    near = edges.join(found.select(F.col("id").alias("b"), F.col("component").alias("other")), "b").groupBy(F.col("a").alias("id")).agg(F.min("other").alias("other"))
    lower = found.join(near, "id", "left").select("id", F.least("component", "other").alias("component"), "was")
    onward = found.select(F.col("id").alias("component"), F.col("component").alias("further"))
    return lower.join(onward, "component", "left").select("id", F.least("component", "further").alias("component"), "was")


def components(links: DataFrame, steps: int | None = None) -> DataFrame:
    """(id, component) of the ids in links (a, b): the smallest id reachable. Each round halves the ways at least.

    steps: only so many rounds, after which labels of a component with longer ways may still differ."""
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    first = F.least(F.col("a"), F.min("b"))
    found = cut(edges.groupBy(F.col("a").alias("id")).agg(first.alias("component"), first.alias("was")), "labels")
    turn = 0
    while True:
        lower = cut(_step(edges, found.withColumn("was", F.col("component"))), "labels")
        discard(found)
        found, turn = lower, turn + 1
        if turn == steps or (steps is None and found.filter("component <> was").isEmpty()):
            discard(edges)
            return found.select("id", "component")


def near_duplicates(docs: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row, by shingles of width words."""
    rows = cut(sketches(docs, width), "sketches")
    full = rows.filter("n > 0 AND doc_id IS NOT NULL")
    classes = cut(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("id"), F.first("registers").alias("registers")), "classes")
    size = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.xxhash64(j, F.substring(F.col("registers"), j * size + 1, F.lit(size))))
    members = classes.select("id", F.explode(bands).alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1").select("band")
    members = cut(members.join(crowded, "band"), "members")
    links, found, sizes = None, None, None
    for turn in range(PIVOTS + 1):
        last = turn == PIVOTS
        if found is None:
            open_ = members.select("id", "band", F.col("id").alias("component"), F.lit(1).alias("n"), F.lit(0).alias("shared"))
        else:
            named = members.join(found, "id", "left").select("id", "band", F.coalesce("component", "id").alias("component"))
            shares = named.groupBy("band", "component").agg(F.count("*").alias("k"))
            whole = shares.groupBy("band").agg(F.sum("k").alias("all"), F.max(F.struct("k", "component")).alias("most")).filter("all > most.k")
            whole = cut(whole.select("band"), "buckets")
            if whole.isEmpty():
                break
            open_ = named.join(whole, "band")
            if sizes is None:
                sizes = classes.select("id", "n").join(_alone(open_, docs, width), "id", "left")
                sizes = cut(sizes.select("id", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")), "sizes")
            open_ = cut(open_.join(sizes, "id"), "open")
        if last:
            new = cut(_open_links(open_, classes, docs, width), "links")
            links = new if links is None else links.unionByName(new)
            break
        # The pivot of a group of copies is best the text that the others come from, which has least of its own.
        order = F.struct(F.col("shared") / F.col("n") * -1, F.xxhash64("id", F.lit(turn)), "id", "component")
        pivots = open_.groupBy("band").agg(F.min(order).alias("pivot")).select("band", F.col("pivot.id").alias("b"), F.col("pivot.component").alias("of"))
        pairs = open_.select("band", F.col("id").alias("a"), "component").join(pivots, "band").filter("of <> component")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = cut(_likely(pairs, classes), "likely")
        new = cut(_linked(likely, docs, width), "links")
        links = new if links is None else links.unionByName(new)
        found = components(links, STEPS)  # what these rounds leave apart is compared once more

    # Rows of one doc_id are one document, so the classes of its texts are linked.
    repeated = cut(full.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id"), "repeated")
    if not repeated.isEmpty():
        of = full.join(repeated, "doc_id").join(classes.select("n", "f1", "f2", "id"), ["n", "f1", "f2"]).select("doc_id", "id").distinct()
        edges = of.join(of.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").filter("id <> a").select("a", F.col("id").alias("b"))
        links = cut(edges if links is None else edges.unionByName(links), "links")
    found = components(links)

    named = classes.join(found, "id", "left").select("n", "f1", "f2", F.coalesce("component", "id").alias("component_id"))
    of_id = full.join(named, ["n", "f1", "f2"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    joined = rows.select("doc_id", F.col("n").alias("n_shingles")).join(of_id, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, width: int = 2) -> DataFrame:
    """The rows of docs that stay: of each group the document with the smallest id, once, of several texts that of the least hash; rows with a null doc_id all stay."""
    kept = near_duplicates(docs, width).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.filter("doc_id IS NOT NULL").alias("d").join(kept.alias("k"), F.col("d.doc_id").cast("long") == F.col("k._kept_id"), "left_semi")
    whole = named.select("doc_id", F.xxhash64("text").alias("_hash"), F.struct(*docs.columns).alias("_row"))
    once = whole.groupBy("doc_id").agg(F.min_by("_row", "_hash").alias("_row")).select("_row.*")
    return once.unionByName(docs.filter("doc_id IS NULL"))
