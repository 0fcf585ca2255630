"""Parties in texts: names of a list as whole words of a text, exactly or by similarity.

Longer and shorter names of one family all match. Names are a small table, NAMES
at most. Exact ones are found in one pass over each text, whatever their number
and length. Similar ones are a similarity join of the texts' distinct n-grams,
as long as the longest name, with the names:

* Texts whose ratio is high have most pairs of neighbouring characters in common:
  putting in or leaving out a character changes two of them. The pairs of both
  sides are ordered, the rarest among names first, and two texts can only be
  similar if they share one of their first few (prefix filter), if their lengths
  allow it (length filter), and if enough pairs are left behind the first common
  one on either side (position filter).
* Texts of which one holds the other's words, but for a short one, share one of
  its rarest words.

Each is an equi-join with the names' table, which goes to all tasks, so that a
frequent pair of characters moves no rows. The weighted ratio is worked out for
the pairs left only, and no pair that reaches it is missed.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_form, ngrams
from ..sources.store import spread

#: Names of a list at most; words of an n-gram at least as long as the longest name's; least similarity.
NAMES, WORDS, LEAST = 10_000, 6, 92.0


def _form(text: Column) -> Column:
    """For the join: besides, any sign that isn't a letter, digit, underscore or slash separates words."""
    return F.trim(F.regexp_replace(match_form(text), r"[^\p{L}\p{N}_/]+", " "))


def _known(aliases: DataFrame) -> list[tuple[str, str]]:
    """(form, canon) of the list, which is NAMES rows at most."""
    rows = aliases.select(_form(F.col("alias")).alias("form"), "canon").filter("form <> ''").distinct().limit(NAMES + 1).collect()
    if len(rows) > NAMES:
        raise ValueError(f"more than {NAMES} names")
    return sorted((r.form, r.canon) for r in rows)


def exact(texts: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, canon): names of (alias, canon) that a text of (id, title) holds as whole words, also beside a slash; each once."""
    known = _known(aliases)
    if not known:
        return texts.select("id", F.lit("").alias("canon")).limit(0)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        # Names with a slash are looked for in the text as it is, others in one whose slashes separate words.
        finders = []
        for with_slash in (True, False):
            canons: dict[str, list[str]] = {}
            for form, canon in known:
                if ("/" in form) == with_slash:
                    canons.setdefault(f" {form} ", []).append(canon)
            finder = ahocorasick.Automaton()
            for form, own in canons.items():
                finder.add_word(form, own)
            finder.make_automaton()
            finders.append((finder if canons else None, "/" if with_slash else " / "))
        for batch in batches:
            rows, found = [], []
            for i, form in enumerate(batch.column("form")):  # one text at a time is a Python object
                form = form.as_py()
                if form:
                    held = {c for finder, slash in finders if finder for _, own in finder.iter(f" {form} ".replace("/", slash)) for c in own}
                    rows += [i] * len(held)
                    found += sorted(held)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows, pa.int32())), pa.array(found, pa.string())], ["id", "canon"])

    formed = spread(texts.select("id", "title")).select("id", _form(F.col("title")).alias("form"))
    return formed.mapInArrow(find, f"id {dict(texts.dtypes)['id']}, canon string").distinct()


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, in one pass over b with a bit for each character of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met) | (row - met)
    return len(a) - (row & ((1 << len(a)) - 1)).bit_count()


def ratio(a: str, b: str) -> float:
    """100 less the share of characters that inserting and deleting takes."""
    return 200 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def weighted_ratio(a: str, b: str) -> float:
    """The best of the ratio and, at 0.95, those of the sorted words and of common and other words; texts of very different length reach 90 at most."""
    if not a or not b:
        return 0.0
    plain = ratio(a, b)
    if max(len(a), len(b)) >= 1.5 * min(len(a), len(b)):
        return min(plain, 90.0)
    one, two = a.split(), b.split()
    best = ratio(" ".join(sorted(one)), " ".join(sorted(two)))
    both, left, right = (sorted(x) for x in (set(one) & set(two), set(one) - set(two), set(two) - set(one)))
    if both and (not left or not right):
        best = 100.0
    else:
        shared = " ".join(both)
        sides = [" ".join([shared, *x]).strip() for x in (left, right)]
        best = max(best, ratio(*sides), *(ratio(shared, x) for x in sides if shared))
    return max(plain, 0.95 * best)


class Signatures:
    """What a text is found by; names gives the order of pairs of characters and words, those of few names first."""

    def __init__(self, names: list[str], least: float):
        if not 80 < least <= 100:
            raise ValueError("the least similarity is over 80, so that lengths differ by less than half")
        self.least = least
        self.pairs = Counter(p for n in names for p in set(self._pairs(n)))
        self.words = Counter(w for n in names for w in set(n.split()))

    @staticmethod
    def _pairs(text: str) -> list[tuple[str, int]]:
        """The pairs of neighbouring characters in each word and at its ends, numbered if they come again."""
        seen: Counter = Counter()
        found = []
        for word in text.split():
            padded = f"\x02{word}\x03"
            for i in range(len(padded) - 1):
                pair = padded[i : i + 2]
                found.append((pair, seen[pair]))
                seen[pair] += 1
        return found

    def of(self, text: str, name: bool) -> list[tuple[str, int, int, int]]:
        """(signature, place, number of pairs, length): a name's are joined to those of n-grams."""
        found = []
        t = self.least / 100
        for form in {text, " ".join(dict.fromkeys(text.split()))}:
            pairs = sorted(self._pairs(form), key=lambda p: (self.pairs[p], p))
            # So many edits at most, by the longest text that is similar enough.
            edits = math.floor(2 * len(form) * (1 - t) / t + 1e-9)
            found += [(f"p{a}{i}", k, len(pairs), len(form)) for k, (a, i) in enumerate(pairs[: 2 * edits + 1])]
        words = sorted(set(text.split()), key=lambda w: (self.words[w], w))
        # Words that can be missing on the side that the other holds.
        high = min(1.0, self.least / 95)
        missing = math.floor(len(text) * (1 - high) / (2 - high) + 1e-9)
        for role, some in (("n", words[: missing + 1] if name else words), ("g", words if name else words[: missing + 1])):
            found += [(f"{role}{w}", 0, 0, len(text)) for w in some]
        return found


def candidates(grams: DataFrame, known: list[tuple[str, str]], least: float = LEAST) -> DataFrame:
    """(gram, number, form): the pairs of a distinct n-gram and a name, by its number, that no filter leaves out."""
    forms = [form for form, _ in known]
    signatures = Signatures(forms, least)
    spark = grams.sparkSession
    rows = [(s, k, form, place, size, length) for k, form in enumerate(forms) for s, place, size, length in signatures.of(form, True)]
    names = spark.createDataFrame(rows, "signature string, number int, form string, own_place int, own_size int, own_length int")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(gram, *s) for gram in batch.column("gram").to_pylist() for s in signatures.of(gram, False)]
            columns = list(zip(*found)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()))], ["gram", "signature", "place", "size", "length"])

    signed = grams.select("gram").filter("gram <> ''").distinct().mapInArrow(sign, "gram string, signature string, place int, size int, length int")
    met = signed.join(F.broadcast(names), "signature")  # signatures of NAMES names at most
    shorter, longer = F.least(F.length("gram"), F.length("form")), F.greatest(F.length("gram"), F.length("form"))
    edits = F.floor((1 - least / 100) * (F.col("length") + F.col("own_length")) + 1e-9)
    left = F.least(F.col("size") - F.col("place"), F.col("own_size") - F.col("own_place"))
    near = 200 * F.least("length", "own_length") >= least * (F.col("length") + F.col("own_length"))
    enough = ~F.startswith("signature", F.lit("p")) | (near & (left >= F.greatest("size", "own_size") - 2 * edits))
    return met.filter((longer < 1.5 * shorter) & enough).select("gram", "number", "form").distinct()


def similar(grams: DataFrame, known: list[tuple[str, str]], least: float = LEAST) -> DataFrame:
    """(gram, canon, score): the most similar name of each distinct n-gram, if it is similar enough; the first of equal ones."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([weighted_ratio(a, b) for a, b in zip(batch.column("gram").to_pylist(), batch.column("form").to_pylist())], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("gram"), batch.column("number"), scores], ["gram", "number", "score"])

    scored = candidates(grams, known, least).mapInArrow(compare, "gram string, number int, score double").filter(F.col("score") >= least)
    best = scored.groupBy("gram").agg(F.max(F.struct("score", (-F.col("number")).alias("first"))).alias("best"))
    canons = grams.sparkSession.createDataFrame([(-k, canon) for k, (_, canon) in enumerate(known)], "first int, canon string")
    return best.select("gram", "best.*").join(F.broadcast(canons), "first").select("gram", "canon", "score")


def fuzzy(texts: DataFrame, aliases: DataFrame, least: float = LEAST) -> DataFrame:
    """(id, canon): as exact, but an n-gram matches its most similar name; the order of words counts little."""
    known = _known(aliases)
    if not known:
        return texts.select("id", F.lit("").alias("canon")).limit(0)
    longest = max(WORDS, *(len(form.split(" ")) for form, _ in known))
    grams = texts.select("id", F.explode(ngrams(F.split(_form(F.col("title")), " "), longest)).alias("gram")).filter("gram <> ''")
    return grams.join(similar(grams, known, least), "gram").select("id", "canon").distinct()


def detect(texts: DataFrame, aliases: DataFrame, tags: DataFrame | None = None, fuzzy_too: bool = False) -> DataFrame:
    """(id, parties): sorted names, or tags if a table (canon, tag) is given; texts without any have an empty list."""
    found = exact(texts, aliases)
    if fuzzy_too:
        found = found.unionByName(fuzzy(texts, aliases)).distinct()
    name = "canon"
    if tags is not None:
        found = found.join(tags, "canon", "left").select("id", F.coalesce("tag", "canon").alias("tag"))
        name = "tag"
    sets = found.groupBy("id").agg(F.sort_array(F.collect_set(name)).alias("parties"))
    return texts.select("id").join(sets, "id", "left").withColumn("parties", F.coalesce("parties", F.array().cast("array<string>")))


def lookup(people: DataFrame, aliases: DataFrame, parties: DataFrame, name: str) -> DataFrame:
    """Alias to name to attributes, both left joins: a person without a known party stays, with nulls."""
    return people.join(aliases.withColumnRenamed("alias", name), name, "left").join(parties, "canon", "left")
