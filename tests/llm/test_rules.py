import collections
import itertools
import math
import random
import re
import time
from fractions import Fraction

import pytest
import xxhash
from pyspark.sql import functions as F

from forumlake.llm import langid, line_dedup, mixing, quality, toxicity
from forumlake.llm.queries import op7_mix_sources, op8_quality_rules, op9_language_id, op10_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    words = WORD.findall(text or "")
    windows = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    seen, repeated = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(covered)


def signed(n):
    return n - (1 << 64) if n >= 1 << 63 else n


def test_quality_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    labels = spark.read.parquet(f"{small}/labels.parquet").toPandas()

    def word(w):
        return xxhash.xxh64(w.encode(), seed=42).intdigest()

    def pair(a, b):  # the hash of a long goes in as the next one's seed
        return xxhash.xxh64(b.to_bytes(8, "little"), seed=xxhash.xxh64(a.to_bytes(8, "little"), seed=42).intdigest()).intdigest()

    def grams(text):
        h = [word(w) for w in WORD.findall(text or "")]
        return [signed(x) % quality.BUCKETS for x in h + [pair(a, b) for a, b in zip(h, h[1:])]]

    good = set(labels[labels.quality == 1].doc_id)
    raw, target = collections.Counter(), collections.Counter()
    for i, text in zip(docs.doc_id, docs.text):
        found = grams(text)
        raw.update(found)
        target.update(found if i in good else [])
    share = sum(target.values()) / sum(raw.values())
    weight = {k: math.log((target[k] + quality.PRIOR) / (raw[k] * share + quality.PRIOR)) for k in raw}
    found = {r.doc_id: r for r in op8_quality_rules(spark, small).collect()}
    for i, text in zip(docs.doc_id, docs.text):
        r, g = found[i], grams(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text)
        llr = sum(weight[k] for k in g) / len(g) if g else 0.0
        assert r.llr == pytest.approx(llr, abs=1e-5)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


@pytest.mark.parametrize("text", ["a " * 9, "a b c d e f g h " * 3, "1 2 3 4 5 6 7 8 9", "x\nx\n \n \ny", "", None, " \n", "a b c d e f g h i a b c d e f g h", "# <b> |"])
def test_base_counts(spark, text):
    rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = quality.judge(rows, spark.createDataFrame([], "doc_id long, quality int, toxic int")).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(text)


def test_odd_rows(spark, odd, marks):
    n = odd.count()
    judged = quality.judge(odd, marks)
    assert judged.count() == n and not [r for r in judged.collect() if r.n_words == 0 and r.kept]
    kept = quality.keep_good(odd, marks)
    assert kept.columns == odd.columns
    lines = line_dedup.drop_lines(odd)
    assert lines.count() == n
    same = line_dedup.without_recurring_lines(odd)
    assert same.columns == odd.columns and same.filter("doc_id = 2").first().text is None
    mixed = mixing.mixed(odd)
    assert mixed.columns == odd.columns and sorted(r.slot for r in mixed.collect()) == [7] * n
    assert mixing.mix(odd).filter("slot IS NOT NULL AND block <= 1 AND _row = 'r'").count() == n and mixing.mixed(odd, {"s1": 1.0}).count() == odd.filter("source = 's1'").count()
    tox = toxicity.score(spark, odd, marks).collect()
    assert len(tox) == n and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in tox)
    lang = langid.identify(spark, odd).collect()
    assert len(lang) == n and {r.doc_id: r.lang_pred for r in lang}[2] == "und" and all(0 <= r.score <= 1 for r in lang)
    empty = odd.limit(0)
    for f in (lambda d: quality.judge(d, marks), line_dedup.drop_lines, mixing.mixed, mixing.mix, lambda d: toxicity.score(spark, d, marks), lambda d: langid.identify(spark, d)):
        assert f(empty).count() == 0


def lines_gone(docs):
    """The rule of line dedup, template by template over all lines: the (doc_id, line) that go."""
    owners = collections.defaultdict(list)
    for i, text in docs.items():
        for k, v in enumerate((text or "").split("\n")):
            w = WORD.findall(v)
            t = ["<*>" if re.search("[0-9]", x) else x for x in w]
            n, fixed = len(t), sum(x != "<*>" for x in t)
            if n >= 3 or fixed:
                general, c, least = fixed >= 3 and 2 * fixed >= n, min(n, 10), 10 if n < 8 else 3 if n < 20 else 2
                owners[(least, "=", *t) if general else (least, "!", *w)].append((i, k))
                if n >= 8:
                    owners[2, '"', *w].append((i, k))
                if general and n >= 8:
                    cells = [tuple(t[j * n // c : (j + 1) * n // c]) for j in range(c)]
                    for left_out in itertools.combinations(range(c), 1 if n < 10 else 2):
                        owners[least, n, t[0], left_out, *(x for j, x in enumerate(cells) if j not in left_out)].append((i, k))
    gone = set()
    for (least, *_), at in owners.items():
        if len({i for i, _ in at}) >= least:
            gone |= set(at) - {min(at)}
    return gone


def lines_gone_by_pairs(docs):
    """For lines of 20 tokens and more, line against line: one goes if one before it, in another document or one that a third shares, differs in two cells at most."""
    lines = []
    for i, text in sorted(docs.items()):
        for k, v in enumerate((text or "").split("\n")):
            t = ["<*>" if re.search("[0-9]", x) else x for x in WORD.findall(v)]
            if len(t) >= 20 and 2 * sum(x != "<*>" for x in t) >= len(t):
                lines.append((i, k, len(t), t[0], [t[j * len(t) // 10 : (j + 1) * len(t) // 10] for j in range(10)]))
    alike = lambda a, b: a[2:4] == b[2:4] and sum(x != y for x, y in zip(a[4], b[4])) <= 2
    return {(b[0], b[1]) for k, b in enumerate(lines) if any(a[0] != b[0] and alike(a, b) for a in lines[:k])}


def test_a_template_does_not_depend_on_other_lines(spark):
    """Six lines of one template with two varying cells lose five, also after a line that agrees with them in some cells only."""
    words = [f"w{chr(97 + i)}" for i in range(20)]
    lines = []
    for i in range(6):
        own = list(words)
        own[5], own[12] = f"x{'abcdef'[i]}", f"y{'abcdef'[i]}"
        lines.append(" ".join(own))
    other = [words[0], *(f"q{chr(97 + i)}" for i in range(12)), *words[13:]]
    docs = {0: " ".join(other)} | {i + 1: line for i, line in enumerate(lines)}
    rng = random.Random(21)
    for i in range(7, 200):  # lines near several templates at once
        own = list(words)
        for k in rng.sample(range(1, 20), rng.randint(0, 5)):
            own[k] = rng.choice("klmnop")
        docs[i] = " ".join(own)
    found = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string").repartition(3)).collect()}
    gone = lines_gone(docs)
    assert gone == lines_gone_by_pairs(docs) and {(i, 0) for i in range(2, 7)} <= gone and not {(0, 0), (1, 0)} & gone
    assert found == {i: "" if (i, 0) in gone else t for i, t in docs.items()}


def test_line_dedup(spark):
    passage = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    near = passage.replace("wordza", "other")
    docs = [(1, f"first own line of one\n{passage}\nAll rights reserved."), (2, f"{passage}\nsecond own line of two\nsecond own line of two"), (3, f"third own line\n{near}"), (4, "Page 3 of 10 in the minutes of the council"), (5, "Page 7 of 12 in the minutes of the council"), (6, "short line"), (7, "short line"), (8, None)]
    docs += [(9, "Page 9 of 14 in the minutes of the council")]
    docs += [(10 + i, f"own line number {'abcdefghijkl'[i]} of this text\nAll rights reserved.\nmore") for i in range(12)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_dedup.drop_lines(rows).collect()}
    assert found[1] == docs[0][1] and found[2] == "second own line of two\nsecond own line of two" and found[3] == "third own line"
    assert found[4] == docs[3][1] and found[5] == found[9] == "" and found[6] == found[7] == "short line" and found[8] is None
    assert found[10] == "own line number a of this text\nmore" and all(found[10 + i] == f"own line number {'abcdefghijkl'[i]} of this text" for i in range(1, 12))
    none = {r.doc_id: r.text for r in line_dedup.drop_lines(rows, keep_first=False).collect()}
    assert none[1] == "first own line of one" and none[4] == "" and none[10] == "own line number a of this text" and none[6] == "short line"


def test_templates_need_all_positions(spark):
    """Fields in both halves are a template; sentences that share a half, rows of numbers, and prose of two documents aren't."""
    logs = [f"worker {a} has finished its long task on {b} without an error" for a, b in (("amber", "zinc"), ("birch", "iron"), ("cedar", "lead"))]
    docs = {1: logs[0], 2: logs[1] + "\nits own end", 3: logs[2]}
    docs |= {4: "In this chapter we will discuss the history of Rome", 5: "In this chapter we will discuss the theory of sets"}
    docs |= {6: "one two three four five six seven eight nine ten eleven twelve", 7: "one two three four five six and then some other words here", 8: "one two three four five six while none of these stays the"}
    rows = ["\n".join(" ".join(str((i * 37 + k * 11 + j) % 977) for k in range(8)) for i in range(20)) for j in range(3)]
    docs |= {9 + j: rows[j] for j in range(3)}
    found = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert found == docs | {2: "its own end", 3: ""}


def test_planted_templates_are_found(spark):
    """Recall on planted lines with up to two fields, and clean lines left alone."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    planted, docs = [], {}
    for _ in range(60):
        planted.append([word() for _ in range(rng.randint(12, 70))])
    fields = [rng.sample(range(1, len(t)), 2) for t in planted]
    for i in range(300):
        lines = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(4)]
        t = list(planted[i % 60])
        for k in fields[i % 60]:
            t[k] = word()
        docs[i] = "\n".join([*lines, " ".join(t)])
    found = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    gone = sum(docs[i] != found[i] for i in docs)
    assert gone == 240 and all(docs[i].startswith(found[i]) and found[i].count("\n") >= 3 for i in docs)


def test_lines_equal_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    docs |= {-1: "a b c d e f g h i j 1 2", -2: "a b c d e f g h x y 3 4", -3: "a b c d e f g h i z 5 6", -4: "a b c d e f g h i j 7 8", -5: "1 2 3", -6: "x", -7: ""}
    found = {r.doc_id: r.text for r in line_dedup.drop_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    gone = lines_gone(docs)
    assert found == {i: "\n".join(v for k, v in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in docs.items()}


def test_copies_go_with_their_lines(spark):
    text = "\n".join(" ".join(f"w{'abcdefghijklmnopqrst'[k % 20]}{'abcdefghijklmnopqrst'[i]}{'xyz'[k // 20]}" for k in range(30)) for i in range(10))
    near = "\n".join(" ".join("changed" if k == i % 7 + 2 else w for k, w in enumerate(line.split())) for i, line in enumerate(text.split("\n")))
    own = "\n".join(" ".join(f"o{'abcdefghijklmnopqrst'[k % 20]}{'abcdefghijklmnopqrst'[i]}" for k in range(20)) for i in range(5))
    docs = {1: text, 2: text, 3: near, 4: own + "\n" + text.split("\n")[0], 5: None, 6: "", 7: "short"}
    found = {r.doc_id: r.text for r in line_dedup.without_recurring_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert found == {1: text, 4: own, 5: None, 6: "", 7: "short"}


def edf(weights, slots):
    """Earliest deadline first slot by slot over exact weights: the source of each slot."""
    total, done, out = sum(weights), [0] * len(weights), []
    for t in range(slots):
        open_ = [(math.ceil((done[i] + 1) * total / w), i) for i, w in enumerate(weights) if w and done[i] * total // w <= t]
        out.append(min(open_)[1])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("weights", [[1], [9, 1], [5, 3, 2], [1, 1, 1, 1], [7, 0, 2], [13, 8, 5, 3, 2, 1, 1]])
def test_schedule_equals_brute_force(weights):
    total = sum(weights) // math.gcd(*weights)
    length, plans = mixing.schedules(mixing.whole(weights), [total] * len(weights))
    assert length == total
    of = {t: i for i, own in enumerate(plans) for t in own.slots}
    assert [of[t] for t in range(total)] == edf([Fraction(w) for w in weights], total)
    assert mixing.in_turn(mixing.whole(weights), 3 * total) == [[t + k * total for k in range(3) for t in own.slots] for own in plans]


@pytest.mark.parametrize("weights", [None, {"a": 0.5, "b": 0.3, None: 0.2}, {"a": 1.0}])
def test_mixing(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "UNIT", 2)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    monkeypatch.setattr(mixing, "STRETCH", 4)
    sizes = {"a": 300, "b": 150, "c": 41, None: 77}
    rows = [(f"{s}{i}", s) for s, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame([(k, "t", s, 1) for k, (_, s) in enumerate(rows)], "doc_id long, text string, source string, _bucket int")
    given = weights or {s: n**0.5 for s, n in sizes.items()}
    found = mixing.mix(docs, weights).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(rows))) and {r._bucket for r in found} == {1}
    slots, blocks = collections.defaultdict(set), collections.Counter()
    for r in found:
        assert (r.slot is None) == (r.source not in given)
        if r.slot is not None:
            slots[r.source].add(r.slot)
            blocks[r.source, r.slot] += 1
    assert max(blocks.values()) == 2 and all(len(v) == -(-sizes[s] // 2) for s, v in slots.items())
    every = [s for v in slots.values() for s in v]
    assert len(every) == len(set(every))
    end = min(max(v) for v in slots.values())
    assert set(range(end + 1)) == {s for s in every if s <= end}
    for source, own in slots.items():
        done = 0
        for t in range(end + 1):
            done += t in own
            assert abs(done - given[source] * (t + 1) / sum(given.values())) < 1
    ordered = [r.doc_id for r in mixing.mixed(docs, weights).collect()]
    at = {r.doc_id: (r.slot, r.place) for r in found if r.slot is not None}
    assert ordered == sorted(at, key=at.get)


def test_query_equals_brute_force(spark, small):
    found = op7_mix_sources(spark, small).toPandas()
    docs = spark.read.parquet(f"{small}/documents.parquet").toPandas()
    sizes = docs.source.value_counts().sort_index()
    assert sorted(found.doc_id) == sorted(docs.doc_id)
    of = edf(mixing.whole([n**0.5 for n in sizes]), 2000)
    places = collections.defaultdict(list)
    for t, i in enumerate(of):
        places[sizes.index[i]].append(t)
    for source, own in found.groupby("source"):
        n = len(own)
        assert sorted(zip(own.block, own.place)) == [(k // mixing.UNIT, k % mixing.UNIT) for k in range(n)]
        assert (own.slot == [places[source][b] for b in own.block]).all()


def deviation(weights, plan, length, unit):
    """How far a source of a weight is off, in units, before and after a unit, by exact fractions."""
    share = weights[0] / sum(weights, Fraction(0))
    slot = plan.slot(unit, length)
    done = sum(1 for t in plan.free if t < slot)
    done += min(plan.regular, slot // length * plan.parts + sum(t < slot % length for t in plan.slots)) if plan.parts else 0
    return max(abs(done - share * slot), abs(done + 1 - share * (slot + 1)))


@pytest.mark.parametrize("sizes", [[1_000_003, 777, 12_345], [400_000_000, 9, 31_337, 5_000_001], [10**9, 10**6, 10**3, 3, 2]])
def test_less_than_a_block_off_the_weights_after_many_slots(sizes):
    """By the square roots themselves, after up to 10 ** 8 slots and more: less than the four units of a block."""
    weights = [n**0.5 for n in sizes]
    exact, units, rng = [Fraction(repr(w)) for w in weights], [-(-n // mixing.UNIT) for n in sizes], random.Random(2)
    length, plans = mixing.schedules(mixing.whole(weights), units)
    furthest = 0
    for i, (plan, n) in enumerate(zip(plans, units)):
        assert plan.regular + len(plan.free) == n and plan.free == sorted(plan.free)
        for unit in {0, n - 1, plan.regular - 1 if plan.regular else 0, *(rng.randrange(n) for _ in range(20))}:
            assert deviation([exact[i], *exact[:i], *exact[i + 1 :]], plan, length, unit) < 3
            furthest = max(furthest, plan.slot(unit, length))
    assert furthest > sum(units) / 2


def test_every_slot_is_given_once_and_small_weights_are_not_lifted(monkeypatch):
    monkeypatch.setattr(mixing, "PARTS", 64)
    for weights in ([2**0.5, 3**0.5, 5**0.5, 0.0, 1e-3], [1.0, 1e-9, 7**0.5], [rng / 997 for rng in range(1, 30)]):
        exact = [Fraction(repr(float(w))) for w in weights]
        units = [int(3000 * w / sum(weights)) for w in weights]
        length, plans = mixing.schedules(mixing.whole(weights), units)
        slots = [[p.slot(u, length) for u in range(p.regular + len(p.free))] for p in plans]
        assert [len(x) for x in slots] == [n if w else 0 for n, w in zip(units, weights)]
        every = sorted(t for own in slots for t in own)
        assert len(every) == len(set(every)) and every[:2500] == list(range(2500))
        for own, w in zip(slots, exact):
            own, done = set(own), 0
            for t in range(2500):
                done += t in own
                assert abs(done - w / sum(exact) * (t + 1)) < 3


def test_many_sources_in_bounded_time():
    rng, began = random.Random(1), time.time()
    weights = [rng.random() for _ in range(20_000)]
    length, plans = mixing.schedules(mixing.whole(weights), [50] * len(weights))
    assert all(p.regular + len(p.free) == 50 for p in plans) and length == mixing.PARTS and time.time() - began < 60


def test_language_held_out(spark):
    found = op9_language_id(spark, "/root/testdata/sf0.01")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").filter("held_out").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98


@pytest.mark.parametrize("n", [2, 3, 5, 6, 40])
def test_codewords_differ(n):
    code = langid.codewords(n)
    assert len({tuple(r) for r in code}) == n
    assert (code != code[0]).any(axis=0).all() or n == 2


def test_toxicity_of_the_tables_held_out(spark):
    """Held-out documents of sf0.1, whose toxic ones are in four languages: most are found, hardly any clean one is flagged."""
    path = "/root/testdata/sf0.1"
    found = op10_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out")
    r = found.agg(*[F.avg(F.when(F.col("toxic") == k, F.col("predicted"))).alias(f"p{k}") for k in (0, 1)]).first()
    assert r.p1 > 0.78 and r.p0 < 0.01


def test_many_languages_keep_their_samples(spark, monkeypatch):
    """The sample is shared among all languages, whatever their names and sizes, and no language is left out."""
    monkeypatch.setattr(langid, "SAMPLE", 60)
    rows = [(i, f"l{i % 11:02d}" if i % 3 else "zz", f"{'abcdefghijkl'[i % 11] * 4} wort {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    counts = {r.lang: r["count"] for r in langid.sample(docs).groupBy("lang").count().collect()}
    assert len(counts) == 12 and set(counts.values()) == {5}


def test_toxicity_held_out(spark):
    words = ["idiot", "scum", "trash", "moron"]
    docs = [(i, " ".join([f"w{(i * 7 + k) % 97}" for k in range(40)] + ([words[i % 4], words[i % 3]] if i % 5 == 0 else []))) for i in range(2000)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(2000)], "doc_id long, quality int, toxic int")
    found = toxicity.score(spark, rows, labels).filter("held_out").collect()
    assert len(found) > 300 and all(r.predicted == int(r.doc_id % 5 == 0) for r in found)
    none = toxicity.score(spark, rows, labels.limit(0)).agg(F.max("score")).first()[0]
    assert none == 0
