"""Minutes of meetings: from positioned words and horizontal rules of pages to agenda items.

words: (doc, page, ord, text, x0, x1, top, bottom); rules: (doc, page, y).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: The word that opens an agenda item, and the one before a printed paper's number.
MARKER, NUMBER = "Tagesordnungspunkt", "Nr."


def dates(words: DataFrame) -> DataFrame:
    """(doc, date): of the first page, if exactly one word begins with a date."""
    found = words.filter("page = 0").groupBy("doc").agg(F.collect_list(F.when(F.col("text").rlike(r"^\d{2}\.\d{2}\.\d{4}"), F.col("text"))).alias("d"))
    return found.select("doc", F.when(F.size("d") == 1, F.get("d", F.lit(0))).alias("date"))


def markers(words: DataFrame, n: int = 1) -> DataFrame:
    """The first n words of each page that begin with the marker, in any case."""
    found = words.filter(F.lower("text").startswith(MARKER.lower()))
    return found.withColumn("_r", F.row_number().over(W.partitionBy("doc", "page").orderBy("ord"))).filter(F.col("_r") <= n).drop("_r")


def text_below(words: DataFrame, lines: DataFrame, zoom: float = 1.0) -> DataFrame:
    """(doc, page, body): the words under a line (doc, page, y), joined by a space in their order."""
    below = words.join(lines, ["doc", "page"]).filter(F.col("top") * zoom > F.col("y"))
    listed = F.sort_array(F.collect_list(F.struct("ord", "text")))
    return below.groupBy("doc", "page").agg(F.array_join(F.transform(listed, lambda w: w["text"]), " ").alias("body"))


def frames(rules: DataFrame) -> DataFrame:
    """(doc, page, rect_y_min, rect_y_max): the first two rules of pages that have two."""
    sorted_ = rules.groupBy("doc", "page").agg(F.sort_array(F.collect_list("y")).alias("ys")).filter(F.size("ys") >= 2)
    return sorted_.select("doc", "page", F.get("ys", F.lit(0)).alias("rect_y_min"), F.get("ys", F.lit(1)).alias("rect_y_max"))


def item_headers(words: DataFrame, rules: DataFrame, zoom: float = 1.0) -> DataFrame:
    """(doc, page, top_nr, drucksache_nr, person_resp, topic, rect_y_min, rect_y_max) of pages whose first marker lies between the first two rules.

    The words between the rules: after the marker comes the item's number, after "Nr." in the first line that of the
    printed paper; the lowest line names who is responsible, and the lines after the first are the topic."""
    low, high = F.col("rect_y_min"), F.col("rect_y_max")
    opened = markers(words).select("doc", "page", F.col("top").alias("m_top"), F.col("bottom").alias("m_bottom"))
    frame = frames(rules).join(opened, ["doc", "page"]).filter((F.col("m_top") * zoom > low) & (F.col("m_bottom") * zoom < high)).drop("m_top", "m_bottom")
    inside = words.join(frame, ["doc", "page"]).filter((F.col("top") * zoom > low) & (F.col("top") * zoom < high))
    pages = inside.groupBy("doc", "page", "rect_y_min", "rect_y_max").agg(F.sort_array(F.collect_list(F.struct("ord", "text", "top", "bottom"))).alias("w"), F.max("bottom").alias("lowest"))
    line = F.get("w", F.lit(0))["top"]
    after = lambda wanted: F.element_at(F.filter(F.transform("w", lambda x, i: F.when(wanted(x), F.get("w", i + 1)["text"])), lambda x: x.isNotNull()), -1)
    safe = lambda c: F.when(F.size(F.filter("w", c)) > 0, after(c))
    person = F.filter("w", lambda x: x["bottom"] == F.col("lowest"))
    content = F.filter("w", lambda x: (x["top"] > line) & (x["text"] != MARKER))
    texts = lambda x: F.array_join(F.transform(x, lambda y: y["text"]), " ")
    named = F.col("lowest") > 20
    topic = F.when(named, F.slice(content, 1, F.greatest(F.size(content) - F.size(person), F.lit(0)))).otherwise(content)
    return pages.select(
        "doc", "page", "rect_y_min", "rect_y_max", safe(lambda x: x["text"] == MARKER).alias("top_nr"), safe(lambda x: (x["text"] == NUMBER) & (x["top"] == line)).alias("drucksache_nr"),
        F.when(named, texts(person)).alias("person_resp"), texts(topic).alias("topic"),
    )


def protocol_items(words: DataFrame, rules: DataFrame, zoom: float = 1.0) -> DataFrame:
    """(doc, date, page_start, end_page, top_nr, drucksache_nr, person_resp, topic, content1, len_content1, rect_y_min, rect_y_max).

    Page 0 has the date only. An item begins on a page with a header, and its text is what lies below the second rule;
    pages without a header before the next one continue it with what lies below its first rule, joined by spaces and put
    after it without one. Pages before the first item are dropped. An item that goes on has an end page and a length."""
    headers = item_headers(words.filter("page > 0"), rules, zoom)
    pages = words.filter("page > 0").select("doc", "page").distinct().join(headers.select("doc", "page", "rect_y_min", "rect_y_max", F.lit(1).alias("starts")), ["doc", "page"], "left")
    w = W.partitionBy("doc").orderBy("page")
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    owned = pages.select("doc", "page", "starts", last(F.when(F.col("starts") == 1, F.col("page"))).alias("page_start"), last("rect_y_min").alias("low"), "rect_y_max").filter("page_start IS NOT NULL")
    lines = owned.select("doc", "page", "page_start", "starts", F.when(F.col("starts") == 1, F.col("rect_y_max")).otherwise(F.col("low")).alias("y"))
    texts = lines.join(text_below(words, lines.select("doc", "page", "y"), zoom), ["doc", "page"], "left").withColumn("body", F.coalesce("body", F.lit("")))
    listed = F.sort_array(F.collect_list(F.when(F.col("starts").isNull(), F.struct("page", "body"))))
    grouped = texts.groupBy("doc", "page_start").agg(F.max(F.when(F.col("starts") == 1, F.col("body"))).alias("own"), listed.alias("more"))
    more = F.aggregate("more", F.lit(""), lambda done, x: F.when(done == "", x["body"]).otherwise(F.concat(done, F.lit(" "), x["body"])))
    found = grouped.withColumn("added", more).withColumn("content1", F.concat("own", "added"))
    going = F.col("added") != ""
    found = found.select("doc", "page_start", "content1", F.when(going, F.element_at("more", -1)["page"]).alias("end_page"), F.when(going, F.length("content1")).alias("len_content1"))
    joined = headers.withColumnRenamed("page", "page_start").join(found, ["doc", "page_start"]).join(dates(words), "doc", "left")
    return joined.select("doc", "date", "page_start", "end_page", "top_nr", "drucksache_nr", "person_resp", "topic", "content1", "len_content1", "rect_y_min", "rect_y_max")


def rules_of_images(images: DataFrame, dark: int = 200, run: int = 100, width: int = 500, height: int = 10) -> DataFrame:
    """(doc, page, y): tops of horizontal rules in gray images (doc, page, width, height, pixels).

    A rule is a connected group of dark runs of at least `run` pixels that is wider than `width` and lower than `height`."""

    def find(frames_: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames_:
            rows = [(r.doc, r.page, y) for r in frame.itertuples() for y in rules_in(np.frombuffer(r.pixels, dtype=np.uint8).reshape(r.height, r.width), dark, run, width, height)]
            yield pd.DataFrame(rows, columns=["doc", "page", "y"])

    return images.select("doc", "page", "width", "height", "pixels").mapInPandas(find, "doc string, page int, y int")


def rules_in(gray: np.ndarray, dark: int, run: int, width: int, height: int) -> list[int]:
    groups: list[list[int]] = []  # left, right, top, bottom, of those that may go on
    done: list[list[int]] = []
    for y, line in enumerate(gray <= dark):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], line.view(np.int8), [0]])))
        spans = [(a, b) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= run]
        now: list[list[int]] = []
        for a, b in spans:
            met = [g for g in [*groups, *now] if g[3] >= y - 1 and any(x <= b and a <= z for x, z in g[4])]
            one = [min([a, *(g[0] for g in met)]), max([b, *(g[1] for g in met)]), min([y, *(g[2] for g in met)]), y, [(a, b)] + [s for g in met if g[3] == y for s in g[4]]]
            groups = [g for g in groups if g not in met]
            now = [g for g in now if g not in met] + [one]
        done += [g for g in groups if g[3] < y]
        groups = now
    return sorted(g[2] for g in [*done, *groups] if g[1] - g[0] > width and g[3] - g[2] + 1 < height)
