"""Quality rules: base counts, then a log-likelihood ratio of hashed n-grams.

Single words and pairs of neighbours are hashed into a fixed number of buckets.
One multinomial counts the buckets over a trusted target, documents labelled
good, of which a bounded number is taken in an order that hashes the id; the
other counts the whole raw corpus. A document's score is the mean over its
n-grams of log(target share / raw share), and every document is held against
one threshold. All of it is built-in functions: the corpus pass is one partial
aggregation by bucket, and the model is a literal of as many numbers as buckets.
The prior keeps what is rare in the corpus near 0, in the target or not.

Defined results: null and empty texts have no words, fail the base rules and
are not kept; without labels all weights are 0 and the base rules alone decide;
repeated rows are judged each; an empty table gives no rows. A column of the
input whose name clashes with one made here is not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

#: Buckets of n-grams, labelled good documents at most, least mean log ratio.
BUCKETS, TARGET_DOCUMENTS, THRESHOLD = 1 << 15, 20_000, -0.075
#: Added to a bucket's count in the target and to the count that the raw share makes one expect there.
PRIOR = 20.0
#: Words of a window; least words; most repeated words in a hundred.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30


def let(value: Column, use) -> Column:
    """use(value) with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def pairs_of(hashes: Column) -> Column:
    """Hashes of each word with the next one; the last place has none that counts."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + 1)))


def repeated_words(pairs: Column) -> Column:
    """Words in windows that occur twice or more. pairs: of the words, in order. A text without equal runs of half a window has none."""

    def covered(starts: Column) -> Column:  # starts: sorted places of windows found again
        steps = F.transform(starts, lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, k + 1) - s, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def again(found: Column) -> Column:  # found: (window's hash, place), sorted
        same = F.filter(found, lambda p, k: F.coalesce((F.get(found, k - 1)["h"] == p["h"]), F.lit(False)) | F.coalesce((F.get(found, k + 1)["h"] == p["h"]), F.lit(False)))
        return let(F.sort_array(F.transform(same, lambda p: p["i"])), covered)

    def of_windows(found: Column) -> Column:
        placed = F.sort_array(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(let(placed, again))

    def of_halves(halves: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(pairs) - WINDOW)
        windows = F.transform(places, lambda i: F.xxhash64(F.get(halves, i), F.get(halves, i + WINDOW // 2)))
        return F.when(F.size(F.array_distinct(halves)) == F.size(halves), F.lit(0)).otherwise(let(windows, of_windows))

    halves = F.transform(F.slice(pairs, 1, F.size(pairs) - (WINDOW // 2 - 1)), lambda p, i: F.xxhash64(p, F.get(pairs, i + 2)))
    return F.when(F.size(pairs) <= WINDOW, F.lit(0)).otherwise(let(halves, of_halves))


def grams(hashes: Column, pairs: Column) -> Column:
    """Buckets of single words and of pairs of neighbours."""
    both = F.concat(hashes, F.slice(pairs, 1, F.greatest(F.size(hashes) - 1, F.lit(0))))
    return F.transform(both, lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int"))


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def bucket_weights(docs: DataFrame, labels: DataFrame) -> list[float]:
    """log(target share / raw share) of each bucket, from counts over all documents."""
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_DOCUMENTS).withColumn("target", F.lit(1))
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(good), "doc_id", "left")  # bounded by TARGET_DOCUMENTS
    buckets = marked.select("target", F.explode(let(hashed(F.col("text")), lambda h: let(pairs_of(h), lambda p: grams(h, p)))).alias("bucket"))
    counts = buckets.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("good")).collect()  # BUCKETS rows at most
    raw, good_n = [0] * BUCKETS, [0] * BUCKETS
    for r in counts:
        raw[r.bucket], good_n[r.bucket] = r.raw, r.good
    if not sum(good_n):
        return [0.0] * BUCKETS
    share = sum(good_n) / sum(raw)
    return [math.log((g + PRIOR) / (n * share + PRIOR)) for g, n in zip(good_n, raw)]


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    weights = ",".join(f"{x:.6f}" for x in bucket_weights(docs, labels))
    model = F.split(F.lit(weights), ",").cast("array<double>")  # folded to a literal

    def mean(found: Column) -> Column:
        total = F.aggregate(found, F.lit(0.0), lambda a, b: a + F.get(model, b))
        return F.when(F.size(found) == 0, F.lit(0.0)).otherwise(total / F.size(found))

    def of_words(found: Column) -> Column:
        return let(
            F.transform(found, lambda w: F.xxhash64(w)),
            lambda h: let(
                pairs_of(h),
                lambda p: F.struct(
                    F.size(found).cast("long").alias("n_words"),
                    F.length(F.array_join(found, "")).cast("long").alias("word_chars"),
                    repeated_words(p).cast("long").alias("n_repeat_words"),
                    let(grams(h, p), mean).alias("llr"),
                ),
            ),
        )

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = [c for c in docs.columns if c not in RESULTS]
    found = docs.select(*own, let(words(text), of_words).alias("_found"), F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"), let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    found = found.select(*own, "_found.n_words", "_found.word_chars", "n_symbols", "n_dup_lines", "_found.n_repeat_words", "_found.llr")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))


#: Columns that judge() makes.
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept", "_found"]


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.col("text"))
    return judge(rows, labels).filter("kept").select("_row.*")
