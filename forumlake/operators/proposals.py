"""Proposals, agenda items and meetings: joins, roll-ups, reshaping and graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def item_payload(items: DataFrame, meetings: DataFrame) -> DataFrame:
    """Search payload of agenda items joined to their meetings; items without a meeting go."""
    m = meetings.select(F.col("Sitzung").alias("_key"), F.coalesce(F.col("Gremium"), F.col("Gremien")).alias("gremium"), F.col("Datum").alias("_datum"), F.col("location").alias("ort"), F.col("source_url").alias("url"))
    party = F.nullif(F.array_join("antrag_party", ", "), F.lit(""))
    joined = items.join(m, items["meeting_id"] == m["_key"])
    return joined.select(
        "name", "top_id", "meeting_id", "vorlage_id", F.col("type").alias("typ"), party.alias("partei"),
        F.col("beschluss.beratungsergebnis_1").alias("beratungsergebnis"), F.col("beschluss.stimmenverteilung").alias("stimmenverteilung"),
        "gremium", X.epoch_seconds(X.german_date(F.col("_datum"))).alias("datum"), "ort", "url",
    )


def match_rate(rows: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """One row: rows, those whose key the other table has, and their share."""
    known = other.select(key).distinct().withColumn("_hit", F.lit(1))
    joined = rows.join(known, key, "left")
    return joined.agg(F.count("*").alias("total"), F.count("_hit").alias("matched"), F.round(F.count("_hit") / F.count("*"), 6).alias("rate"))


def referenced(items: DataFrame, least: int) -> DataFrame:
    """The items of proposals that have at least `least` of them."""
    enough = items.groupBy("referenzvorlage").agg(F.count("*").alias("num_tops")).filter(F.col("num_tops") >= least)
    return items.join(enough.select("referenzvorlage"), "referenzvorlage", "left_semi")


def reference_rollup(items: DataFrame, least: int) -> DataFrame:
    """For each proposal the number of items and meetings and the items themselves, from `least` items on.

    items: (referenzvorlage, top_id, name, meeting, vorlage_url, vorlage, meeting_date).
    """
    listed = F.sort_array(F.collect_list(F.struct("top_id", "name", "meeting", "vorlage_url", "vorlage", "meeting_date")))
    found = referenced(items, least).groupBy("referenzvorlage").agg(listed.alias("tops"))
    meetings = F.size(F.array_distinct(F.filter(F.transform("tops", lambda t: t["meeting"]), lambda m: m.isNotNull()))).cast("long")
    return found.select("referenzvorlage", F.size("tops").cast("long").alias("num_tops"), meetings.alias("num_meetings"), "tops")


def label(date: Column, proposal: Column, item: Column) -> Column:
    """`date · proposal`, else whichever there is, else the item's id."""
    day = F.nullif(F.substring(date, 1, 10), F.lit(""))
    known = F.nullif(proposal, F.lit(""))
    return F.coalesce(F.when(day.isNotNull() & known.isNotNull(), F.concat_ws(" · ", day, known)), day, known, item)


def _tops(found: DataFrame) -> DataFrame:
    """(referenzvorlage, t) for every item, of a roll-up with its lists or of the items as rows, which gathers none."""
    return found.select("referenzvorlage", F.explode("tops").alias("t")) if "tops" in found.columns else found.select("referenzvorlage", F.struct("top_id", "meeting_date", "vorlage").alias("t"))


def graph_nodes(found: DataFrame) -> DataFrame:
    """(id, label, kind): proposals and their items, each once, of a roll-up or of the items that `referenced` leaves."""
    refs = (found if "tops" in found.columns else found.select("referenzvorlage").distinct()).select(F.concat(F.lit("r:"), "referenzvorlage").alias("id"), F.col("referenzvorlage").alias("label"), F.lit("reference").alias("kind"))
    tops = _tops(found).select(F.concat(F.lit("t:"), "t.top_id").alias("id"), label(F.col("t.meeting_date"), F.col("t.vorlage"), F.col("t.top_id")).alias("label"), F.lit("item").alias("kind"))
    return refs.unionByName(tops.groupBy("id").agg(F.min("label").alias("label"), F.min("kind").alias("kind")))


def graph_edges(found: DataFrame) -> DataFrame:
    """(source, target) for every item of every proposal, of a roll-up or of the items that `referenced` leaves; repeated ones stay."""
    return _tops(found).select(F.concat(F.lit("r:"), "referenzvorlage").alias("source"), F.concat(F.lit("t:"), "t.top_id").alias("target"))


def typed_edges(rows: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(kind, source, target) along columns: committee to meeting, meeting to person and so on; each edge once."""
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target")) for kind, a, b in pairs])
    return rows.select(F.explode(kinds).alias("e")).select("e.*").filter("source IS NOT NULL AND target IS NOT NULL").distinct()


def summary_text(parts: list[tuple[str, Column, int]]) -> Column:
    """Labelled lines: of each list at most so many entries, joined by semicolons; empty lists give no line."""
    lines = [F.when(F.size(values) > 0, F.concat(F.lit(f"{name}: "), F.array_join(F.slice(values, 1, most), "; "))) for name, values, most in parts]
    return F.concat_ws("\n", *lines)


def prompt(question: Column, texts: Column, empty: str = "(Kein Kontext gefunden.)") -> Column:
    """The context's texts with an empty line between, or a note that there are none, before the question."""
    context = F.coalesce(F.nullif(F.array_join(texts, "\n\n"), F.lit("")), F.lit(empty))
    return F.concat(F.lit("Kontext:\n"), context, F.lit("\n\nFrage: "), question)


def consultation(header: Column) -> Column:
    """From a consultation's header line: date at its start, intent after the last hyphen or the whole line, committee up to the last TOP, empty without one."""
    day = F.regexp_extract(header, r"^(\d{2}\.\d{2}\.\d{4})", 1)
    parts = F.split(F.regexp_replace(header, r"\d{2}\.\d{2}\.\d{4}", ""), "TOP ")
    cut = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), " ")
    return F.struct(X.german_date(F.nullif(day, F.lit(""))).alias("datum"), F.trim(F.element_at(F.split(header, "-"), -1)).alias("intent"), F.trim(cut).alias("gremium"))


def item_record(items: DataFrame) -> DataFrame:
    """Agenda items as they are stored: the id without slashes, public, empty lists for what is missing, and when it was saved."""
    empty = F.array().cast("array<string>")
    return items.select(
        F.replace("top_id", F.lit("/"), F.lit("_")).alias("top_id"), "meeting_id", F.col("top_name").alias("name"), F.lit(True).alias("public"), "type", F.coalesce("antrag", empty).alias("antrag_party"),
        "aktenzeichen", "vorlage_id", "vorlage_url", "beschluss", F.coalesce("files", F.array().cast(dict(items.dtypes)["files"])).alias("files"), X.now_iso().alias("saved_at"),
    )
