"""Tables, links and titles of raw pages.

Links come from regular expressions in the plan; label and value rows need a
parser, which runs an Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_url, collapse


class _Rows(HTMLParser):
    """Cells' texts and links by table row; the title."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list[tuple[str, str | None]]] = []
        self.title = ""
        self._cell: list[str] | None = None
        self._href: str | None = None
        self._in_title = False

    def _close(self) -> None:
        if self._cell is not None and self.rows:
            self.rows[-1].append((" ".join("".join(self._cell).split()), self._href))
        self._cell = self._href = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._close()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._close()
            self._cell = []
        elif tag == "a" and self._cell is not None and self._href is None:
            self._href = dict(attrs).get("href")
        elif tag == "title":
            self._in_title = True

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._close()
        elif tag == "title":
            self._in_title = False

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)
        elif self._in_title:
            self.title += data


def label_values(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, labels): a map from rows of exactly two cells; a label that comes again overwrites."""

    def parse(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            found = []
            for source in frame.html:
                p = _Rows()
                p.feed(source or "")
                p.close()
                found.append({row[0][0].rstrip(":"): row[1][0] for row in p.rows if len(row) == 2})
            yield pd.DataFrame({key: frame[key], "labels": found})

    return pages.select(key, "html").mapInPandas(parse, f"{key} {dict(pages.dtypes)[key]}, labels map<string,string>")


def table_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, row, cells, links): every table row with its cells' texts and first links."""

    def parse(frames: Iterator) -> Iterator:
        import pandas as pd

        for frame in frames:
            rows = []
            for k, source in zip(frame[key], frame.html):
                p = _Rows()
                p.feed(source or "")
                p.close()
                rows += [(k, i, [c for c, _ in row], [h for _, h in row]) for i, row in enumerate(p.rows)]
            yield pd.DataFrame(rows, columns=[key, "row", "cells", "links"])

    return pages.select(key, "html").mapInPandas(parse, f"{key} {dict(pages.dtypes)[key]}, row int, cells array<string>, links array<string>")


def attendance(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, name, id, party, role, extra) from table rows of two cells or more; empty texts become null."""
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    person = F.nullif(F.regexp_extract(F.coalesce(F.get("links", F.lit(0)), F.lit("")), r"__kpenr=(\d+)", 1), F.lit(""))
    return rows.filter(F.size("cells") >= 2).select(key, cell(0).alias("name"), person.alias("id"), cell(1).alias("party"), cell(2).alias("role"), cell(3).alias("extra"))


def titles(pages: DataFrame) -> DataFrame:
    """(page_id, title)."""
    return pages.select("page_id", collapse(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"))


#: An anchor's href, in double quotes, single ones or none, and what it holds.
ANCHOR = r"(?is)<a\s(?:[^>]*?\s)?href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))([^>]*)>(.*?)</a>"


def links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, url, label): every anchor in page order, absolute; the label is its text, else its title, its aria-label, or "Dokument"."""
    parts = [F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(i)) for i in range(6)]
    names = ["whole", "double", "single", "bare", "rest", "inner"]
    found = pages.select("page_id", "url", F.posexplode(F.arrays_zip(*[x.alias(n) for n, x in zip(names, parts)])).alias("pos", "a"))
    opening = F.regexp_extract("a.whole", r"(?s)^<[^>]*>", 0)
    named = lambda name: F.trim(F.regexp_extract(opening, rf"(?is)\s{name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    text = collapse(F.regexp_replace("a.inner", r"<[^>]*>", " "))
    label = F.coalesce(*[F.nullif(x, F.lit("")) for x in (text, named("title"), named("aria-label"))], F.lit("Dokument"))
    href = F.trim(F.concat("a.double", "a.single", "a.bare"))
    return found.select("page_id", "pos", href.alias("href"), absolute_url(href, F.col("url")).alias("url"), label.alias("label"))


def attachments(found: DataFrame) -> DataFrame:
    """Links to documents once for each page and id of the document, else its address, the first of them; with id and type from the address."""
    from ..functions.text import query_parameter
    from ..operators.fusion import first_of

    named = found.withColumns({"id": query_parameter(F.col("url"), "id"), "type": query_parameter(F.col("url"), "type")})
    return first_of(named.withColumn("_key", F.coalesce("id", "url")), ["page_id", "_key"], ["pos"]).drop("_key")


def chosen_protocol(found: DataFrame) -> DataFrame:
    """(page_id, href): the last link whose label speaks of minutes and isn't a mere record of results or cancelled."""
    name = F.lower("label")
    fits = name.contains("niederschrift") & ~name.contains("ergebnisprotokoll") & ~name.contains("abgesagt")
    return found.filter(fits).groupBy("page_id").agg(F.max_by("href", "pos").alias("href"))


def meeting_links(pages: DataFrame, part: str = "si0057") -> DataFrame:
    """(page_id, row, url): of each table row after the first its second link, if it leads to a meeting."""
    rows = pages.select("page_id", "url", F.posexplode(F.split("html", "(?i)<tr[ >]")).alias("row", "source")).filter("row > 1")
    second = F.concat(*[F.get(F.regexp_extract_all("source", F.lit(ANCHOR), F.lit(i)), F.lit(1)) for i in (1, 2, 3)])
    return rows.withColumn("href", second).filter(F.col("href").contains(part)).select("page_id", "row", absolute_url(F.col("href"), F.col("url")).alias("url"))


def people(rows: DataFrame, key: str = "page_id") -> DataFrame:
    """Persons from table rows (name, party, role): placeholders for nobody go, empty texts become null."""
    from ..functions.text import person_name

    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    named = rows.filter(F.size("cells") >= 2).withColumn("full", cell(0)).filter("full IS NOT NULL").filter(~F.lower("full").isin("n.n", "n.n.", "nn"))
    person = F.nullif(F.regexp_extract(F.coalesce(F.get("links", F.lit(0)), F.lit("")), r"__kpenr=(\d+)", 1), F.lit(""))
    return named.select(key, person.alias("person_id"), person_name(F.col("full")).alias("name"), cell(1).alias("partei"), cell(2).alias("role")).select(key, "person_id", "name.*", "partei", "role")


def multi_labels(rows: DataFrame, key: str = "page_id", link_label: str = "Internet") -> DataFrame:
    """(key, data): a map of labels to all their values in order; the one label's value is its link."""
    label = F.regexp_replace(F.trim(F.get("cells", F.lit(0))), ":$", "")
    value = F.when(label == link_label, F.coalesce(F.get("links", F.lit(1)), F.get("links", F.lit(0)))).otherwise(F.trim(F.get("cells", F.lit(1))))
    pairs = rows.filter(F.size("cells") == 2).select(key, "row", label.alias("label"), value.alias("value")).filter("label <> '' AND value IS NOT NULL")
    listed = pairs.groupBy(key, "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("row", "value"))), lambda x: x["value"]).alias("values"))
    return listed.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "values")))).alias("data"))
