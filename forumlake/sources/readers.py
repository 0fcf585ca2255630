"""Readers: one JSON object a file, lenient JSON lines, objects after each other, and files by name.

Every reader goes through Spark's own file sources, so that paths in any store work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def entities(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder with one pretty-printed JSON object in each file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def meetings(spark: SparkSession, path: str) -> DataFrame:
    """Meetings; both spellings of the attendance field are read."""
    rows = entities(spark, path, schemas.MEETINGS)
    return rows.withColumn("attendance", F.coalesce("attendance", "attendence")).drop("attendence")


def agenda_items(spark: SparkSession, path: str) -> DataFrame:
    """Agenda items; both spellings of the decision fields are read."""
    b = F.col("beschluss")
    fixed = F.struct(
        F.coalesce(b["beratungsergebnis_1"], b["beraturngsergebnis_1"]).alias("beratungsergebnis_1"),
        F.coalesce(b["beratungsergebnis_2"], b["beraturngsergebnis_2"]).alias("beratungsergebnis_2"),
        b["stimmenverteilung"].alias("stimmenverteilung"),
    )
    return entities(spark, path, schemas.TOPS).withColumn("beschluss", F.when(b.isNotNull(), fixed))


def llm_runs(spark: SparkSession, path: str) -> DataFrame:
    """Logged model runs with their key; positions are read from whichever name the run used."""
    rows = entities(spark, path, schemas.LLM_RUNS)
    positions = F.coalesce(*[F.try_variant_get("output_json", f"$.{name}", "array<struct<partei_fraktion string, haltung string>>") for name in ("parteipositionen", "partei_positionen", "partep_positionen")])
    return rows.withColumn("parteipositionen", positions).withColumn("top_key", F.concat_ws("_", "meta.meeting_date", "meta.top_id"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, in which strings may have single quotes."""
    return spark.read.schema(schemas.MANIFEST).json(path)


def concatenated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pretty-printed objects that follow each other in one file, each beginning and ending in the first column."""
    parts = spark.read.option("lineSep", "\n}\n").text(path).withColumn("value", F.rtrim(F.regexp_replace("value", r"^\s+", "")))
    whole = F.when(F.col("value").rlike(r"(?s)\n\}\s*$"), F.col("value")).otherwise(F.concat("value", F.lit("\n}")))
    return parts.filter("value <> ''").select(F.from_json(whole, schema).alias("o")).select("o.*")


def files(spark: SparkSession, path: str, pattern: str | None = None, suffix: str | None = None, years: tuple[int, int] | None = None) -> DataFrame:
    """(path, name, length, modified) of the files below a folder: with a part of the path, a suffix, or a year in a name of three parts."""
    # The listing itself leaves other suffixes out; contents aren't read.
    source = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    found = (source.option("pathGlobFilter", f"*{suffix}") if suffix else source).load(path).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))
    if pattern:
        found = found.filter(F.col("path").contains(pattern))
    if years:
        year = F.try_to_number(F.substring("name", 1, 4), F.lit("9999")).cast("int")
        found = found.filter(F.size(F.split("name", "_")) == 3).filter(year.between(*years))
    return found


def prompt(spark: SparkSession, path: str) -> DataFrame:
    """(text) of a prompt file."""
    from ..functions.text import prompt_text

    return spark.read.option("wholetext", True).text(path).select(prompt_text(F.col("value")).alias("text"))
