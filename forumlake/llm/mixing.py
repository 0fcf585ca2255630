"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in an order that hashes them, are cut into blocks, and the
blocks into units of UNIT documents, which are scheduled. With a weight of w, a
part of 1, unit j of a source may not be placed before slot floor(j / w) and has
to be placed before slot ceil((j + 1) / w). Earliest deadline first over the
released units meets all deadlines, so that after any number of slots every
source is less than one unit off its weight, until a source runs out of units.

Weights whose common denominator is at most PARTS are whole parts of a period.
After a period every source has exactly its parts and all lags are 0, so the
schedule repeats, and only one period is worked out, whatever the number of
documents.

Other weights, such as square roots, are split: of a period's PARTS slots a
source has the whole number of its parts for good, and the fractions that are
left make up some free slots, fewer than there are sources. The period schedules
the free slots like a source of their own. Which source gets the next free slot
is one more Pfair schedule, by the exact fractions, which doesn't repeat: it has
one entry for each free slot that the mixture comes to, a few in 2 ** 16 slots.
So no weight is rounded, and a source is less than one unit off by its whole
parts, less than one by its fractions, and less than one by the free slots:
together less than three units, and with four units to a block less than one
block, after any number of slots.

Places within a source come from counts of hash buckets, summed over stretches
of buckets first, and a row number inside a bucket; a source with any share of
the rows is spread over many buckets.

Defined results: a null source is a source of its own; null texts and repeated
rows are documents like others; a source whose weight is 0 or isn't given is not
in the mixture: mix() keeps its rows with a null slot, mixed() leaves them out;
where a source has no unit left, its slots stay empty; ties of the hash are
ordered by doc_id and a hash of the text; an empty table gives no rows; other
columns pass through, but mix() replaces input columns named block, slot and place.
"""

from __future__ import annotations

import heapq
import json
import math
from bisect import bisect_left
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Documents that are scheduled together, four of which are a block; documents in a hash bucket, about; buckets in a stretch; power of a source's size that gives its weight.
UNIT, BUCKET_ROWS, STRETCH, POWER = 4, 2000, 1024, 0.5
#: Slots of a period for weights without a small common denominator.
PARTS = 1 << 16


def _key() -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col("_source")), F.lit(""))


def _fraction(w: float) -> Fraction:
    """The decimal that a weight prints as, or the fraction of small terms that it is the nearest number to."""
    exact = Fraction(repr(float(w)))
    small = exact.limit_denominator(10_000)
    return small if abs(small - exact) <= exact / 10**15 else exact


def whole(weights: list[float]) -> list[int]:
    """The weights in their exact proportions as whole numbers without a common divisor."""
    exact = [_fraction(w) for w in weights]
    scale = math.lcm(*(w.denominator for w in exact)) if exact else 1
    found = [int(w * scale) for w in exact]
    common = math.gcd(*found) or 1
    return [x // common for x in found]


def in_turn(of: list[int], steps: int) -> list[list[int]]:
    """The slots of each source among the first steps, by earliest deadline first; of: the weights as whole numbers."""
    total, slots = sum(of), [[] for _ in of]
    waiting = [(0, i) for i, q in enumerate(of) if q]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(steps if waiting else 0):
        while waiting and waiting[0][0] <= t:
            i = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * total // of[i]), i))
        i = heapq.heappop(ready)[1]
        slots[i].append(t)
        heapq.heappush(waiting, (len(slots[i]) * total // of[i], i))
    return slots


@dataclass
class Schedule:
    """Of one source: units it has in each period and their slots; units that it has by these in all; the slots of its other units."""

    parts: int
    slots: list[int] = field(default_factory=list)
    regular: int = 0
    free: list[int] = field(default_factory=list)

    def slot(self, unit: int, length: int) -> int:
        return unit // self.parts * length + self.slots[unit % self.parts] if unit < self.regular else self.free[unit - self.regular]


def schedules(weights: list[int], units: list[int]) -> tuple[int, list[Schedule]]:
    """The length of a period and each source's schedule, for its number of units. weights: whole numbers."""
    total = sum(weights)
    # So many slots go by before every source has had its units; of a period only what comes before is needed.
    last = max([-(-(n + 3) * total // w) for n, w in zip(units, weights) if w], default=0)
    if total <= PARTS:
        slots = in_turn(weights, min(total, last))
        return max(1, total), [Schedule(q, own[:n], n if q else 0) for q, own, n in zip(weights, slots, units)]
    parts, rest = [w * PARTS // total for w in weights], [w * PARTS % total for w in weights]
    free = sum(rest) // total
    *slots, between = in_turn([*parts, free], PARTS)
    turns = in_turn(rest, (last // PARTS + 1) * free) if free else [[] for _ in rest]
    found = []
    for q, own, n, turn in zip(parts, slots, units, turns):
        schedule = Schedule(q, own)
        for m, at in enumerate(turn):
            slot = at // free * PARTS + between[at % free]
            if m + slot // PARTS * q + bisect_left(own, slot % PARTS) >= n:
                break  # its units have run out before this slot
            schedule.free.append(slot)
        schedule.regular = n - len(schedule.free) if q or schedule.free else 0
        schedule.slots = own[: schedule.regular]
        found.append(schedule)
    return PARTS, found


def shares(rows: DataFrame, weights: dict[str | None, float] | None = None) -> list[tuple[str, int, int]]:
    """(key, documents, weight) of each source, by key, weights as whole numbers; without weights they go by size ** POWER. A row for each source is collected."""
    sizes = sorted((r.key, r.n) for r in rows.groupBy(_key().alias("key")).agg(F.count("*").alias("n")).collect())
    if weights is None:
        given = [n**POWER for _, n in sizes]
    else:
        known = {"" if k is None else f"s{k}": w for k, w in weights.items()}
        given = [known.get(k, 0.0) for k, _ in sizes]
    return [(k, n, q) for (k, n), q in zip(sizes, whole(given))]


def _placed(rows: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    """rows (_doc_id, _source, _tie and others) with _block, _slot and _place in place of these."""
    sources = shares(rows, weights)
    length, plans = schedules([q for _, _, q in sources], [-(-n // UNIT) for _, n, _ in sources])
    buckets = max(1, sum(n for _, n, _ in sources) // BUCKET_ROWS)
    # The plan as a literal: PARTS numbers at most, one for each source, and one for each free slot.
    plan = json.dumps([{"key": k, "parts": p.parts, "regular": p.regular, "slots": p.slots, "free": p.free} for (k, _, _), p in zip(sources, plans)])
    plan = rows.sparkSession.range(1).select(F.explode(F.from_json(F.lit(plan), "array<struct<key:string,parts:long,regular:long,slots:array<long>,free:array<long>>>")).alias("p"))
    known = plan.select(F.col("p.key").alias("_key"), F.col("p.parts").alias("_parts"), F.col("p.regular").alias("_regular"))
    at = plan.select(F.col("p.key").alias("_key"), F.posexplode("p.slots").alias("_of", "_slot"))
    # Units in free slots are numbered from -1 down.
    at = at.unionByName(plan.select(F.col("p.key").alias("_key"), F.posexplode("p.free").alias("_of", "_slot")).withColumn("_of", -1 - F.col("_of")))

    keyed = rows.select("*", _key().alias("_key"), F.xxhash64("_doc_id", "_tie").alias("_hash")).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    sizes = keyed.groupBy("_key", "_bucket").agg(F.count("*").alias("_n")).withColumn("_stretch", F.floor(F.col("_bucket") / STRETCH))
    running = F.sum("_n").over(W.partitionBy("_key", "_stretch").orderBy("_bucket")) - F.col("_n")
    stretches = sizes.groupBy("_key", "_stretch").agg(F.sum("_n").alias("_all"))
    stretches = stretches.select("_key", "_stretch", (F.sum("_all").over(W.partitionBy("_key").orderBy("_stretch")) - F.col("_all")).alias("_earlier"))
    before = sizes.withColumn("_before", running).join(stretches, ["_key", "_stretch"]).select("_key", "_bucket", "_n", (F.col("_before") + F.col("_earlier")).alias("_before"))
    before = before.join(known, "_key").withColumn("_first", F.floor(F.col("_before") / UNIT))
    # A bucket's units with their slots, so that the rows are joined by bucket, as they are already dealt out.
    last = F.floor((F.col("_before") + F.col("_n") - 1) / UNIT)
    blocks = before.select("_key", "_bucket", "_before", "_first", "_parts", "_regular", F.explode(F.sequence("_first", last)).alias("_block"))
    cycle = F.expr("CASE WHEN _block < _regular THEN _block DIV _parts ELSE 0 END")
    blocks = blocks.withColumn("_of", F.expr("CASE WHEN _block < _regular THEN _block % _parts ELSE _regular - _block - 1 END")).join(at, ["_key", "_of"], "left")
    blocks = blocks.withColumn("_slot", cycle * length + F.col("_slot"))
    before = blocks.groupBy("_key", "_bucket", "_before", "_first").agg(F.sort_array(F.collect_list(F.struct("_block", "_slot"))).alias("_slots"))
    rank = F.row_number().over(W.partitionBy("_key", "_bucket").orderBy("_hash", "_doc_id", "_tie"))
    placed = keyed.withColumn("_rank", rank).join(before, ["_key", "_bucket"]).withColumn("_at", F.col("_before") + F.col("_rank") - 1)
    placed = placed.withColumn("_block", F.floor(F.col("_at") / UNIT)).withColumn("_place", (F.col("_at") % UNIT).cast("int"))
    slot = F.get("_slots", (F.col("_block") - F.col("_first")).cast("int"))["_slot"]
    own = [c for c in rows.columns if c not in ("_doc_id", "_source", "_tie")]
    return placed.select(*own, "_block", slot.alias("_slot"), "_place")


def _rows(docs: DataFrame) -> DataFrame:
    """The columns by number, whose names clash with none made here; those that nobody asks for aren't read."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)], F.col("doc_id").alias("_doc_id"), F.col("source").alias("_source"), F.xxhash64("text").alias("_tie"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """docs with columns block, slot and place: the unit in its source, its slot in the mixture, the row's place in the unit."""
    own = [F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns) if c not in ("block", "slot", "place")]
    return _placed(_rows(docs), weights).select(*own, F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_place").alias("place"))


def mixed(docs: DataFrame, weights: dict[str | None, float] | None = None) -> DataFrame:
    """The rows of docs that are in the mixture, in its order."""
    found = _placed(_rows(docs), weights).filter("_slot IS NOT NULL")
    return found.repartitionByRange("_slot").sortWithinPartitions("_slot", "_place").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(docs.columns)])
