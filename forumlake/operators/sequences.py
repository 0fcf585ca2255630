"""Operators along an order: filling forward, grouping pages into items, history windows, neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def fill_forward(rows: DataFrame, by: str, order: str, heading: Column, name: str) -> DataFrame:
    """Every row gets the last heading before or at it."""
    return rows.withColumn(name, F.last(heading, ignorenulls=True).over(W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def items_of_pages(pages: DataFrame, by: str, order: str, starts: Column, text: str = "text") -> DataFrame:
    """(by, item, first, last, body): an item begins where `starts` holds and takes the pages after it.

    Pages before the first item are dropped; those that continue an item are joined
    by a space and then follow the first page's text without a separator.
    """
    numbered = pages.withColumn("item", F.sum(starts.cast("int")).over(W.partitionBy(by).orderBy(order))).filter("item > 0")
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("at"), F.coalesce(text, F.lit("")).alias("text"))))
    grouped = numbered.groupBy(by, "item").agg(listed.alias("pages"))
    texts = F.transform("pages", lambda p: p["text"])
    body = F.concat(F.get(texts, F.lit(0)), F.array_join(F.slice(texts, 2, F.greatest(F.size(texts) - 1, F.lit(0))), " "))
    return grouped.select(by, "item", F.get("pages", F.lit(0))["at"].alias("first"), F.element_at("pages", -1)["at"].alias("last"), body.alias("body"))


def last_rows(rows: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("_r") <= n).drop("_r")


def next_value(rows: DataFrame, by: str, order: str, value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.lead(value).over(W.partitionBy(by).orderBy(order)))


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last written row of each key: what an upsert leaves."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")
