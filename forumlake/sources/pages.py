"""Records from the council's pages: agendas, proposals, consultations, attachments and the way to meetings.

A page is parsed once, an Arrow batch at a time, into rows of plain texts and
links; dates, ids, inherited headings and deduplication are worked out in the plan.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import proposals, sequences
from ..operators.fusion import first_of

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ENDS = {"tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "li": {"li"}, "p": {"p"}}
_STOPS = {"table", "ul", "ol", "div", "body"}


class Element:
    """An element of a page: its tag, attributes and children, which are elements and texts. Those below it stand in a row in the page's list of all elements."""

    __slots__ = ("tag", "attributes", "names", "children", "page", "first", "end")

    def __init__(self, tag: str, attributes: dict[str, str | None], names: frozenset[str] | None = None, page: list[Element] | None = None):
        self.tag = tag
        self.attributes = attributes
        self.children = []
        self.names = frozenset((attributes.get("class") or "").split()) if names is None else names
        self.page = [] if page is None else page
        self.first = len(self.page) + 1
        self.end = None

    def walk(self) -> list[Element]:
        """The elements below, in page order."""
        return self.page[self.first : self.end]

    def classes(self) -> frozenset[str]:
        return self.names

    def find(self, tag: str = "", *classes: str, **attributes: str) -> list[Element]:
        """Elements below with a tag, all of the classes, and attributes that contain a text."""
        return _chosen(self.walk(), tag, *classes, **attributes)

    def text(self, between: str = " ") -> str:
        """All texts below, each trimmed, with something between."""
        if len(self.children) == 1 and not isinstance(self.children[0], Element):
            return self.children[0].strip()
        out, waiting = [], list(reversed(self.children))
        while waiting:
            x = waiting.pop()
            if isinstance(x, Element):
                waiting += reversed(x.children)
            elif x.strip():
                out.append(x.strip())
        return between.join(out)


def _chosen(found: list[Element], tag: str = "", *classes: str, **attributes: str) -> list[Element]:
    """Those of some elements with a tag, all of the classes, and attributes that contain a text."""
    if tag:
        found = [x for x in found if x.tag == tag]
    for c in classes:
        found = [x for x in found if c in x.names]
    for k, v in attributes.items():
        k = k.replace("_", "-")
        found = [x for x in found if v in (x.attributes.get(k) or "")]
    return found


class _Tree:
    """A page's elements, and those that are open."""

    def __init__(self):
        self.page: list[Element] = []
        self.open = [Element("", {}, frozenset(), self.page)]
        self.open[0].first = 0

    def start(self, tag, attributes, names):
        ends = _ENDS.get(tag)
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                at = self.open[i].tag
                if at in _STOPS:
                    break
                if at in ends:
                    self.shut(i)
        found = Element(tag, attributes, names, self.page)
        self.page.append(found)
        self.open[-1].children.append(found)
        if tag in _VOID:
            found.end = found.first
        else:
            self.open.append(found)

    def shut(self, i):
        for x in self.open[i:]:
            x.end = len(self.page)
        del self.open[i:]

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.shut(i)
                break


class _Builder(_Tree, HTMLParser):
    def __init__(self):
        HTMLParser.__init__(self, convert_charrefs=True)
        _Tree.__init__(self)

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        self.start(tag, attributes, frozenset((attributes.get("class") or "").split()))

    def handle_data(self, data):
        self.open[-1].children.append(data)


class _Tag(HTMLParser):
    """The attributes of a single tag."""

    def handle_starttag(self, tag, attrs):
        self.found = dict(attrs)


#: Tags that need no leniency; a page that has a "<" or a tag beside them goes through the lenient parser.
_SPLIT = re.compile(r"(<[^<>]*>)")
_START = re.compile(r"""<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z_][-a-zA-Z0-9_:.]*(?:=(?:"[^"]*"|'[^']*'|[^\s"'=<>`/]+))?)*)[ \t\n]*>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`/]+)))?""")
_END = re.compile(r"</([a-zA-Z][a-zA-Z0-9]*)[ \t\n]*>")
_RAW = set("iframe math noembed noframes noscript plaintext script style svg textarea title xmp".split())
#: Tags that a task remembers, since pages repeat them, and their length at most.
TAGS, TAG_LENGTH = 20_000, 200
_tags: dict[str, tuple | None] = {}


def _read_tag(raw: str) -> tuple | None:
    """(tag, attributes, classes) of a start tag, (tag, None, None) of an end tag, None of what isn't plain."""
    found = _START.fullmatch(raw)
    if not found:
        found = _END.fullmatch(raw)
        return (found[1].lower(), None, None) if found else None
    tag = found[1].lower()
    if tag in _RAW:
        return None
    if "&" in raw:
        one = _Tag(convert_charrefs=True)
        one.feed(raw)
        attributes = one.found
    else:
        attributes = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), None) for m in _ATTRIBUTE.finditer(found[2])}
    return tag, attributes, frozenset((attributes.get("class") or "").split())


def _plain(source: str) -> _Tree | None:
    """What the lenient parser makes of a page that holds plain tags only, in a fraction of its time; None of other pages."""
    pieces = _SPLIT.split(source)
    if source.count("<") != len(pieces) >> 1:  # one is in a text
        return None
    tree = _Tree()
    waiting, page = tree.open, tree.page
    top = waiting[0]
    for text, piece in zip(pieces[::2], pieces[1::2]):
        if text:
            top.children.append(unescape(text) if "&" in text else text)
        known = _tags.get(piece)
        if known is None:
            known = _read_tag(piece)
            if known is None:
                return None
            if len(piece) <= TAG_LENGTH:
                if len(_tags) >= TAGS:
                    _tags.clear()
                _tags[piece] = known
        tag, attributes, names = known
        if attributes is not None:
            if tag in _ENDS or tag in _VOID:
                tree.start(tag, attributes, names)
                top = waiting[-1]
            else:
                found = Element(tag, attributes, names, page)
                page.append(found)
                top.children.append(found)
                waiting.append(found)
                top = found
        elif top.tag == tag and len(waiting) > 1:
            top.end = len(page)
            waiting.pop()
            top = waiting[-1]
        else:
            tree.handle_endtag(tag)
            top = waiting[-1]
    if pieces[-1]:
        top.children.append(unescape(pieces[-1]) if "&" in pieces[-1] else pieces[-1])
    return tree


def parse(source: str | None) -> Element:
    builder = _plain(source or "")
    if builder is None:
        builder = _Builder()
        builder.feed(source or "")
        builder.close()
    return builder.open[0]


#: Characters of the pages whose rows are handed on together, about.
AT_ONCE = 1 << 20


def rows_of(pages: DataFrame, read: Callable[[Element], list[tuple]], schema: str, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The rows that `read` makes of each page (keep, html), with the columns to keep before them."""
    from pyspark.sql.pandas.types import to_arrow_schema

    made = pages.sparkSession.createDataFrame([], schema).schema
    kinds, of_rows = dict(pages.dtypes), to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def handed(batch: pa.RecordBatch, of: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(of_rows)
            own = [batch.column(k).take(pa.array(of, pa.int32())) for k in keep]
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(columns, of_rows))], [*keep, *of_rows.names])

        searched = gc.isenabled()
        gc.disable()  # no page leaves a cycle behind, and searches for some would go through all of its elements
        try:
            for batch in batches:
                of, rows, size = [], [], 0
                for i, source in enumerate(batch.column("html")):
                    source = source.as_py()
                    page = parse(source)
                    found = read(page)
                    page.page.clear()  # so that the elements go at once
                    of += [i] * len(found)
                    rows += found
                    size += len(source or "")
                    if size >= AT_ONCE:
                        yield handed(batch, of, rows)
                        of, rows, size = [], [], 0
                yield handed(batch, of, rows)
        finally:
            if searched:
                gc.enable()

    return pages.select(*keep, "html").mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keep) + ", " + schema)


#: Classes, ids and addresses of the council's pages.
AGENDA, BADGE, TITLE, DECISION, VOTE = "smc_page_si0057_contenttable2", "badge", "smc-card-header-title-simple", "smc_field_smcdv0_box2_beschluss", "smc_field_smcdv0_box2_abstimmung"
PROPOSAL, FILE, CARD, CARDS, TEXT_LINKS = "smc_datatype_vo", "getfile.asp", "smc-doc-content", ("smc-doc-content", "smc-doc", "smc-doc-ds-1"), ("smc-text-block-991", "smc-text-block")
SUBJECT, NAME, FILE_NUMBER, KIND, DOCUMENT, HEADLINE = "vobetr", "voname", "voakz", "vovaname", "smc_datatype_do", "smc_h1"
ACCORDION, CARD_LIGHT, HEADER, RESULT, VOTES, DOWNLOAD = "smcaccordion", "card-light", "btn-block", "smc_field_btname", "smc_field_totexta", "Dokument Download Dateityp:"


def _links(found: list[Element], to: str) -> list[Element]:
    """Those of some elements that are links to an address with a text."""
    return [x for x in found if x.tag == "a" and to in (x.attributes.get("href") or "")]


FILES = "files array<struct<href string, label string>>"


def _files(block: Element, cards: tuple[str, ...] = (CARD,)) -> list[tuple[str, str]]:
    """(href, label) of each card's document: the link of its text before any other."""
    found = []
    for card in [x for x in block.walk() if x.names and not x.names.isdisjoint(cards)]:
        inner = card.walk()
        named = [x for x in inner if x.names]
        links = [a for kind in TEXT_LINKS for part in named if kind in part.names for a in _links(part.walk(), FILE)] or _links(inner, FILE)
        if links:
            a = links[0]
            found.append(((a.attributes.get("href") or "").strip(), a.text() or a.attributes.get("title") or a.attributes.get("aria-label") or "Dokument"))
    return found


def _agenda(page: Element) -> list[tuple]:
    rows, first = [], lambda x: x[0] if x else None
    for table in page.find("", id=AGENDA)[:1]:
        for i, tr in enumerate(table.find("tr")):
            inner, of, labelled = tr.walk(), {}, []
            for x in inner:
                for c in x.names:
                    if c in of:
                        of[c].append(x)
                    else:
                        of[c] = [x]
                if "data-label" in x.attributes and x.attributes["data-label"] == "Vorlage":
                    labelled += [a for a in x.walk() if a.tag == "a"]
            badge = [b.text("") for td in of.get("tofnum", ()) if td.tag == "td" for b in (td.walk() if BADGE in of else ()) if b.tag == "span" and BADGE in b.names]
            title = [x.text() for x in of.get(TITLE, ())]
            decision = [p.text("") for p in of.get(DECISION, ()) if p.tag == "p"]
            votes = [p.text("") for p in of.get(VOTE, ()) if p.tag == "p"]
            link = ([a for a in labelled if PROPOSAL in a.names] or [a for a in of.get(PROPOSAL, ()) if a.tag == "a"] or _links(labelled, "vo") or _links(inner, "vo0050.asp"))[:1]
            cells = [x for x in tr.children if isinstance(x, Element) and x.tag in ("td", "th")]
            files = [{"href": h, "label": x} for h, x in (_files(cells[3]) if len(cells) > 3 else [])]
            rows.append((i, first(badge), first(title), first(decision), first(votes), votes[-1] if len(votes) > 1 else None, first([a.text() for a in link]), first([a.attributes.get("href") for a in link]), files))
    return rows


def documents(hrefs: Column, base: Column) -> Column:
    """Absolute documents (url, label, id, type) from (href, label), once for each id or else address, the first of them."""

    # In two steps, so that an address is made once and not for each column.
    named = F.transform(hrefs, lambda x: F.struct(X.absolute_url(x["href"], base).alias("url"), x["label"].alias("label")))
    found = F.transform(named, lambda x: F.struct(x["url"].alias("url"), x["label"].alias("label"), X.query_parameter(x["url"], "id").alias("id"), X.query_parameter(x["url"], "type").alias("type")))
    key = lambda x: F.coalesce(x["id"], x["url"])
    # Bound to a variable, so that the list is made once.
    once = F.transform(F.array(found), lambda xs: F.filter(xs, lambda x, i: ~F.exists(F.slice(xs, 1, i), lambda y: key(y) == key(x))))
    return F.element_at(once, 1)


def agenda(pages: DataFrame) -> DataFrame:
    """Public agenda items of meeting pages (meeting_id, url, html).

    A row without a badge whose title names a section gives the items below their type; items that aren't public go."""
    schema = f"row int, badge string, title string, beratungsergebnis_1 string, beratungsergebnis_2 string, stimmenverteilung string, vorlage_id string, vorlage_href string, {FILES}"
    rows = rows_of(pages, _agenda, schema, ("meeting_id", "url"))
    pattern = r"(?U)^([ÖN])\s*(\d+(?:\.\d+)*)"
    section, number = (F.regexp_extract(F.coalesce("badge", F.lit("")), pattern, i) for i in (1, 2))
    marked = rows.withColumn("section", section).withColumn("nr", number)
    filled = sequences.fill_forward(marked, "meeting_id", "row", F.when(F.col("section") == "", F.col("title")), "type").filter("section = 'Ö'")
    decision = F.struct(*[X.without_hard_spaces(F.col(c)).alias(c) for c in ("beratungsergebnis_1", "beratungsergebnis_2", "stimmenverteilung")])
    return filled.select(
        F.concat_ws(":", F.col("meeting_id").cast("string"), F.lit("Ö"), "nr").alias("top_id"), "meeting_id", "row", F.col("title").alias("top_name"), "type",
        "vorlage_id", X.absolute_url(F.col("vorlage_href"), F.col("url")).alias("vorlage_url"), decision.alias("beschluss"), documents(F.col("files"), F.col("url")).alias("files"),
    )


def _proposal(page: Element) -> list[tuple]:
    table = (page.find("div", "smc_page_vo0050_contenttable") or [Element("", {})])[0]
    one = lambda kind: (lambda x: x[0].text("") if x else None)(table.find("div", kind))
    headline = [x.text("") for x in page.find("h1", HEADLINE)]
    docs = [(a.text(""), (a.attributes.get("title") or "").replace(DOWNLOAD, "").strip(), a.attributes.get("href")) for d in page.find("div", DOCUMENT) for a in d.find("a")[:1]]
    more = [a.attributes.get("href") for a in page.find("a") if a.attributes.get("aria-label") == "Beratungen"]
    return [(one(SUBJECT) or (headline[0] if headline else None), one(NAME), one(FILE_NUMBER), one(KIND), [dict(zip(("title", "dtype", "href"), d)) for d in docs], more[0] if more else None)]


def proposal_details(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposals of pages (vorlage_id, url, html), and in a second table those whose page names another id."""
    schema = "betreff string, name string, aktenzeichen string, typ string, docs array<struct<title string, dtype string, href string>>, more string"
    rows = rows_of(pages, _proposal, schema, ("vorlage_id", "url"))
    docs = F.transform("docs", lambda d: F.struct(d["title"].alias("title"), d["dtype"].alias("dtype"), X.absolute_url(d["href"], F.col("url")).alias("url")))
    found = rows.select("vorlage_id", "name", "typ", "betreff", "aktenzeichen", docs.alias("docs"), X.absolute_url(F.col("more"), F.col("url")).alias("url"))
    same = F.col("name").eqNullSafe(F.col("vorlage_id"))
    return found.filter(same).drop("name"), found.filter(~same)


def _consultations(page: Element) -> list[tuple]:
    rows = []
    for i, card in enumerate(x for a in page.find("", id=ACCORDION) for x in a.find("div", CARD_LIGHT)):
        header = [c.strip() for b in card.find("button", HEADER)[:1] for c in b.children[:1] if isinstance(c, str)]
        # The value follows the field's name.
        after = lambda kind: next((c.strip() if isinstance(c, str) else c.text() for p in card.find("p", kind)[:1] for c in p.children[1:2]), None)  # noqa: B023, E731
        files = [{"title": a.text(), "href": a.attributes.get("href")} for d in card.find("div", DOCUMENT) for a in d.find("a")[:1]]
        rows.append((i, header[0] if header else "", after(RESULT), after(VOTES), files))
    return rows


def consultations(pages: DataFrame) -> DataFrame:
    """(vorlage_id, row, datum, intent, gremium, title, ergebnis, stimmen, dateien) of a proposal's page of consultations (vorlage_id, url, html)."""
    rows = rows_of(pages, _consultations, "row int, title string, ergebnis string, stimmen string, files array<struct<title string, href string>>", ("vorlage_id", "url"))
    files = F.transform("files", lambda f: F.struct(f["title"].alias("title"), X.absolute_url(f["href"], F.col("url")).alias("href")))
    return rows.select("vorlage_id", "row", proposals.consultation(F.col("title")).alias("c"), "title", "ergebnis", X.without_hard_spaces(F.col("stimmen")).alias("stimmen"), files.alias("dateien")).select("vorlage_id", "row", "c.*", "title", "ergebnis", "stimmen", "dateien")


def discover(committees: DataFrame, years: DataFrame, pages: DataFrame, address: Column) -> DataFrame:
    """(committee, year, url): meetings of committees in years, from the pages (url, html) at the addresses that a committee and a year make.

    Two literal tables are combined, so the cross join has as many rows as there are pages to read."""
    from .html_tables import meeting_links

    asked = committees.select("committee").distinct().join(F.broadcast(years.select("year").distinct()), how="cross").withColumn("url", address)
    found = meeting_links(pages.join(asked, "url").select(F.struct("committee", "year").alias("page_id"), "url", "html"))
    return found.select("page_id.committee", "page_id.year", "row", "url").dropDuplicates(["committee", "year", "url"])


def first_pdf(links: DataFrame) -> DataFrame:
    """(page_id, url): the first link of each page that names a PDF file."""
    return first_of(links.filter(F.lower("href").contains(".pdf")), ["page_id"], ["pos"]).select("page_id", "url")
