"""Main text of web pages by union-free regular-expression inference.

A page is a tree of blocks: elements that set text apart, and the texts between
them. A text that most pages of a host have, on at least three pages of different
articles, is a token of the template; any other is a slot. Equal neighbours,
single or in groups, fold into a repeated group, where elements of nothing but
template tokens only equal those of the same tokens. The folded patterns of a
host's pages are aligned one after another into its wrapper: what one side lacks
becomes optional, and repetition on either side makes a group repeated. All
pages go into it: equal patterns are summed up where they are found, and the
others meet in a tree of aggregations, by the hash of their shape, so that the
result doesn't depend on how the pages are dealt out. An element with more than
WIDE children is generalised to a repeated group of its kinds of children.

The wrapper decides which elements hold the article: the article or main
elements if they hold enough of the text that varies over the host, else the
smallest element with most of it; names of classes count as a tie-break there.
Inside, template tokens go, and so do elements that the wrapper shows to be
links for the most part, and those whose tag, or whose class name as a whole,
says that they are no part of an article: menus, headers, footers, sidebars,
notices, adverts, forms and comments. Every page is read with the decisions of
its host; a page of which they'd leave less than half of the text that varies is
judged by its own tree.

Defined results: null and empty html give an empty text; a null url or one
without a host is a host of its own kind; a host of one or two pages has no
template tokens; elements deeper than DEPTH blocks count as part of their
ancestors; repeated rows are read each; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Longest group that is folded; children from which an element is a general group; levels of blocks.
GROUP, WIDE, DEPTH = 8, 64, 60
#: Pages that have a template token at least. Part of the varying text for an article element, for the next element down, and for a page to fit; part of links that makes a menu.
CONSTANT_PAGES, ARTICLE, INNER, FITS, LINKS = 3, 0.3, 0.6, 0.5, 0.8
#: Bytes of hosts' decisions that are broadcast; more are joined over SALTS salts.
BROADCAST, SALTS = 32 << 20, 32
#: Patterns that a worker sums up at most before it passes them on.
HELD = 2000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+)|["'])*+)>|<[!?/][^>]*>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = set((
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav "
    "ol p pre section summary table tbody td tfoot th thead tr ul"
).split())
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that don't hold others of an article.
_LEAVES = {"p", "ul", "ol", "dl", "table", "blockquote", "pre", "figure", *_HEADINGS}
#: A start tag ends these open elements, up to one of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements that aren't part of an article.
_OUT = set("nav footer aside form button select dialog menu object audio video canvas map head".split())
#: Words of class names, ids and roles that say the same, and words that go with them without a meaning of their own.
_OUT_WORDS = set((
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices alert "
    "alerts popup modal overlay newsletter subscribe subscription signup login paywall nav navbar navigation menu menus breadcrumb breadcrumbs pagination "
    "pager sidebar aside rail related recommended recommendations share sharing social comment comments commentlist reply replies respond disqus discussion "
    "reactions footer copyright widget widgets toolbar search skip complementary contentinfo"
).split())
_PLAIN_WORDS = set((
    "area bar block body bottom box btn button buttons col column container form group header heading holder inner item items label left link links list "
    "main message module outer page panel post posts right row section site slot stories text title to top unit wrap wrapper zone"
).split())
_HEAD_WORDS = {"header", "masthead", "banner", "topbar"}
_IN_WORDS = {"article", "main", "content", "post", "story", "entry"}


class Node:
    __slots__ = ("tag", "key", "out", "within", "head", "children")

    def __init__(self, tag: str, key: str, out: bool, within: bool, head: bool):
        #: out, within, head: whether its names say that it is no part of an article, that it is one, that it is a page's header; the key tells them after ~.
        self.tag, self.key, self.out, self.within, self.head, self.children = tag, key, out, within, head, []


_nodes: dict[tuple[str, str], tuple] = {}


def _node(tag: str, attributes: str) -> Node:
    if (known := _nodes.get((tag, attributes))) is None:
        names: dict[str, list[list[str]]] = {"class": [], "id": [], "role": []}
        for m in _ATTRIBUTE.finditer(attributes):
            for name in (m[2] or m[3] or m[4] or "").split():
                names[m[1].lower()].append(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower()))
        # Generated ids tell elements of one kind apart.
        told = names["class"] + names["role"] + ([] if re.search(r"\d", attributes) else names["id"])
        key = ".".join([tag, *dict.fromkeys(w for words in told for w in words)])
        # Headings, sections and paragraphs have ids that say what they are about.
        said = names["class"] + names["role"] + (names["id"] if tag not in _HEADINGS | {"section", "p"} else [])
        out = any(set(words) & _OUT_WORDS and set(words) <= _OUT_WORDS | _PLAIN_WORDS for words in said)
        words = {w for words in said for w in words}
        flags = out and tag not in _HEADINGS, bool(words & _IN_WORDS), bool(words & _HEAD_WORDS)
        known = (tag, key + "~" + "".join("oih"[k] for k in range(3) if flags[k]) if any(flags) else key, *flags)
        if len(_nodes) < 50_000:
            _nodes[tag, attributes] = known
    return Node(*known)


def parse(source: str) -> Node:
    """A tree of the page; end tags that are missing are supplied, others without a start are dropped."""
    root = Node("", "", False, False, False)
    stack, at = [root], 0

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].children.append(source[a:b])

    for m in _TOKEN.finditer(source):
        text(at, m.start())
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _BLOCKS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in _BLOCKS:
                    break
        closes, stop = _ENDS.get(tag, ((), ()))
        for i in range(len(stack) - 1, 0, -1):
            if not closes or stack[i].tag in stop:
                break
            if stack[i].tag in closes:
                del stack[i:]
                break
        node = _node(tag, m[4])
        stack[-1].children.append(node)
        if tag not in _VOID and not m[4].endswith("/"):
            stack.append(node)
    text(at, len(source))
    return root


class Text:
    """A text between blocks: white space is one space, and link counts its characters in links."""

    __slots__ = ("text", "hash", "link")

    def __init__(self, text: str, link: int):
        self.text, self.hash, self.link = text, int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), link


def skipped(node: Node) -> bool:
    """Whether an element isn't part of an article by its tag or its names."""
    return node.tag in _OUT or node.out and not node.within and node.tag not in ("html", "body", "main", "article")


def blocks(source: str) -> Node:
    """The page as a tree of blocks and texts. Inline marks are gone, and so are blocks below DEPTH, whose texts stay apart."""
    page = parse(source)
    root = Node("", "", False, False, False)
    parts: list[str] = []
    linked: list[str] = []

    def flush(into: Node) -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            into.children.append(Text(text, len(" ".join(entities.unescape("".join(linked)).split()))))
        parts.clear()
        linked.clear()

    stack = [(iter(page.children), root, False, 0, False)]  # without recursion, since pages nest at any depth
    while stack:
        children, block, link, depth, own = stack[-1]
        child = next(children, None)
        if child is None:
            if own:
                flush(block)
            stack.pop()
        elif isinstance(child, str):
            parts.append(child)
            if link:
                linked.append(child)
        elif child.tag in _BLOCKS:
            flush(block)
            into = block
            if depth < DEPTH:
                into = Node(child.tag, child.key, child.out, child.within, child.head)
                block.children.append(into)
            if child.tag not in _VOID:
                stack.append((iter(child.children), into, link, depth + 1, True))
        elif child.tag == "br":
            parts.append(" ")
        elif child.tag not in _VOID and not skipped(child):
            stack.append((iter(child.children), block, link or child.tag == "a", depth, False))
    flush(root)
    return root


def texts(block: Node) -> Iterator[Text]:
    """All texts below a block."""
    for child in block.children:
        if isinstance(child, Text):
            yield child
        else:
            yield from texts(child)


# Patterns: [key, repeated, optional, children, pages, general]. A slot has key "#" and [characters, characters in links] for
# children, a token of the template "=" with its hash. An element of nothing but such tokens has their hash in its key.


def fold(items: list) -> list:
    """Folds equal neighbours, single or in groups, into one repeated group."""
    for size in range(1, min(GROUP, len(items) // 2) + 1):
        out: list = []
        for item in items:
            out.append(item)
            while len(out) >= 2 * size and [x[0] for x in out[-size:]] == [x[0] for x in out[-2 * size : -size]]:
                last, out = out[-size:], out[:-size]
                out[-size:] = [merge(a, b, 0) for a, b in zip(out[-size:], last)]
                for x in out[-size:]:
                    x[1] = True
        items = out
    return items


def _general(items: list) -> list:
    """Each kind of child once, optional and repeated."""
    found: dict[str, list] = {}
    for x in items:
        found[x[0]] = merge(found[x[0]], x, 0) if x[0] in found else x
    return [[x[0], True, True, *x[3:]] for x in found.values()]


def pattern(block: Node, constants: frozenset[int] | set[int] = frozenset()) -> list:
    """The folded pattern of one page's block."""
    items: list = []
    for child in block.children:
        if isinstance(child, Text):
            items.append([f"={child.hash:x}" if child.hash in constants else "#", False, False, [len(child.text), child.link], 1, False])
        else:
            items.append(pattern(child, constants))
    key = block.key
    if items and all("=" in x[0] for x in items):
        key += "=" + blake2b(" ".join(x[0] for x in items).encode(), digest_size=4).hexdigest()
    children = fold(items)
    wide = len(children) > WIDE
    return [key, False, False, _general(children) if wide else children, 1, wide]


def merge(a: list, b: list, pages: int = 1) -> list:
    """One pattern for both: optional what one side lacks, repeated what either repeats. pages: 0 within a page."""
    many = a[4] + b[4] if pages else max(a[4], b[4])
    if a[0][0:1] in ("#", "="):
        return [a[0], a[1] or b[1], a[2] or b[2], [a[3][0] + b[3][0], a[3][1] + b[3][1]], many, False]
    left, right, children, general = a[3], b[3], [], a[5] or b[5]
    if general:
        ours = {x[0]: x for x in _general(left)}
        for x in _general(right):
            ours[x[0]] = merge(ours[x[0]], x, pages) if x[0] in ours else x
        children = list(ours.values())
    else:
        keys = [x[0] for x in left], [x[0] for x in right]
        if keys[0] == keys[1]:
            children = [merge(x, y, pages) for x, y in zip(left, right)]
        else:
            for what, i, j, k, m in SequenceMatcher(None, *keys, autojunk=False).get_opcodes():
                if what == "equal":
                    children += [merge(x, y, pages) for x, y in zip(left[i:j], right[k:m])]
                else:
                    children += [[x[0], x[1], True, *x[3:]] for x in left[i:j] + right[k:m]]
            children = fold(children)
        if len(children) > WIDE:
            children, general = _general(children), True
    return [a[0], a[1] or b[1], a[2] or b[2], children, many, general]


def shape(p: list) -> str:
    """A pattern as a regular expression over tags: # for a slot, = and a hash for a token of the template."""
    if p[0][0:1] in ("#", "="):
        body = p[0]
    else:
        body = "".join(map(shape, p[3]))
        body = f"<{p[0]}>" + (f"({body})+" if p[5] else body) + "</>"
    return (f"({body})" if p[1] or p[2] else body) + "+" * p[1] + "?" * p[2]


class Place:
    """What the wrapper has at a path: characters that vary outside links, that vary in links, of the template; pages; whether repeated."""

    __slots__ = ("node", "plain", "link", "fixed", "pages", "repeated", "below")

    def __init__(self, node: Node):
        self.node, self.plain, self.link, self.fixed, self.pages, self.repeated, self.below = node, 0, 0, 0, 0, False, {}

    def add(self, p: list) -> None:
        self.pages, self.repeated = self.pages + p[4], self.repeated or p[1]
        for child in p[3]:
            if child[0][0] == "#":
                self.plain, self.link = self.plain + child[3][0] - child[3][1], self.link + child[3][1]
            elif child[0][0] == "=":
                self.fixed += child[3][0]
            else:
                key = child[0].split("=")[0]
                if key not in self.below:
                    self.below[key] = Place(_of_key(key))
                self.below[key].add(child)

    def total(self) -> None:
        """Sums over what lies below and may be part of an article."""
        for x in self.below.values():
            x.total()
            if not skipped(x.node) and not _header(x.node):
                self.plain, self.link, self.fixed = self.plain + x.plain, self.link + x.link, self.fixed + x.fixed


def _of_key(key: str) -> Node:
    names, _, flags = key.partition("~")
    return Node(names.split(".")[0], key, *(x in flags for x in "oih"))


def _header(node: Node) -> bool:
    return node.tag not in _HEADINGS and (node.tag == "header" or node.head) and not node.within


def decide(wrapper: list) -> dict[str, list[str]]:
    """Paths of the elements that hold the article, and of those within them that are links for the most part."""
    root = Place(Node("", "", False, False, False))
    root.add(wrapper)
    root.total()

    def outermost(place: Place, path: str, want) -> Iterator[tuple[str, Place]]:
        for key, x in place.below.items():
            if not skipped(x.node):
                if want(x.node):
                    yield f"{path}/{key}", x
                else:
                    yield from outermost(x, f"{path}/{key}", want)

    keep: list[tuple[str, Place]] = []
    for want in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.tag != "body" and "main" in n.key.split("~")[0].split(".")[1:]):
        found = list(outermost(root, "", want))
        if found and sum(x.plain + x.link for _, x in found) >= max(1, ARTICLE * (root.plain + root.link)):
            keep = found
            break
    if not keep:
        path, place, headlines = "", root, []
        while True:
            inner = [(k, x) for k, x in place.below.items() if not skipped(x.node) and not _header(x.node)]
            best = max(inner, key=lambda x: (x[1].plain * (1.3 if x[1].node.within else 1), x[0]), default=None)
            if best is None or best[1].node.tag in _LEAVES or best[1].repeated or best[1].plain < INNER * max(1, place.plain):
                break
            headlines += [(f"{path}/{k}", x) for k, x in inner if x.node.tag == "h1"]
            path, place = f"{path}/{best[0]}", best[1]
        keep = [(path, place), *headlines]

    menus: list[str] = []

    def links(place: Place, path: str) -> None:
        for key, x in place.below.items():
            if x.node.tag not in ("p", "li", "td", "tr", *_HEADINGS) and x.pages >= CONSTANT_PAGES and x.link >= LINKS * (x.plain + x.link) and x.link:
                menus.append(f"{path}/{key}")
            else:
                links(x, f"{path}/{key}")

    for path, place in keep:
        links(place, path)
    return {"keep": sorted(p for p, _ in keep), "drop": sorted(menus)}


def main_text(page: Node, found: dict[str, list[str]], constants: frozenset[int] | set[int]) -> tuple[str, int]:
    """The texts in the elements kept, and the characters of all texts that vary and may be part of an article."""
    keep, drop, kept, available = set(found["keep"]), set(found["drop"]), [], 0

    def walk(block: Node, path: str, inside: bool, headings: bool) -> None:
        nonlocal available
        for child in block.children:
            if isinstance(child, Text):
                if child.hash not in constants and not headings:
                    available += len(child.text) - child.link
                    if inside:
                        kept.append(child.text)
            elif not skipped(child):
                here = f"{path}/{child.key}"
                if not (inside and here in drop):
                    only = (headings or child.tag == "header" or child.head and not child.within) and child.tag not in _HEADINGS
                    walk(child, here, inside or here in keep, only)

    walk(page, "", "" in keep, False)
    return "\n\n".join(kept), available


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def _hosts(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))


def constants(pages: DataFrame) -> DataFrame:
    """(host, constants): the hashes of the texts that most pages of a host have; less than twice a page's texts on average."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, longest = [], [], []
            for i, source in enumerate(batch.column("html")):
                own = list(texts(blocks(source.as_py() or "")))
                if own:
                    most = max(own, key=lambda x: (len(x.text), x.hash)).hash
                    distinct = {x.hash for x in own}
                    rows += [i] * len(distinct)
                    hashes += distinct
                    longest += [most] * len(distinct)
            yield pa.RecordBatch.from_arrays([batch.column("host").take(pa.array(rows, pa.int64())), pa.array(hashes, pa.int64()), pa.array(longest, pa.int64())], ["host", "text", "longest"])

    found = pages.select("host", "html").mapInArrow(find, "host string, text long, longest long")
    found = found.groupBy("host", "text").agg(F.count("*").alias("n"), F.min("longest").alias("one"), F.max("longest").alias("other"))
    sizes = pages.groupBy("host").agg(F.count("*").alias("pages")).filter(F.col("pages") >= CONSTANT_PAGES)
    # Copies of one page have the same longest text, and don't make its texts a template.
    found = found.filter((F.col("n") >= CONSTANT_PAGES) & (F.col("one") != F.col("other"))).join(sizes, "host").filter("2 * n > pages")
    return cut(found.groupBy("host").agg(F.sort_array(F.collect_list("text")).alias("constants")), "constants")


def _with(rows: DataFrame, known: DataFrame, bytes_of: Column) -> DataFrame:
    """rows with their host's columns; the hosts' table is broadcast below BROADCAST bytes, else each host is spread over salts."""
    size = known.agg(F.sum(bytes_of + F.length("host") + 64)).first()[0] or 0
    if size <= BROADCAST:
        return rows.join(F.broadcast(known), "host", "left")
    spread = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("url", "html"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"], "left").drop("salt")


def page_patterns(pages: DataFrame) -> DataFrame:
    """(host, shape, pattern): the patterns of pages (host, html, constants), those of one shape summed up."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def passed_on() -> pa.RecordBatch:
            rows = [(h, blake2b(s.encode(), digest_size=16).hexdigest(), json.dumps(p)) for (h, s), p in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*rows) if rows else ([], [], []))], ["host", "shape", "pattern"])

        for batch in batches:
            for name, source, fixed in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("constants").to_pylist()):
                p = pattern(blocks(source.as_py() or ""), set(fixed or ()))
                key = name, shape(p)
                held[key] = merge(held[key], p) if key in held else p
                if len(held) >= HELD:
                    yield passed_on()
        yield passed_on()

    return pages.select("host", "html", "constants").mapInArrow(find, "host string, shape string, pattern string")


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper, constants, decisions): the aligned pattern of each host as a regular expression, and what it says."""
    pages = _hosts(pages)
    fixed = constants(pages)
    rows = _with(pages.select("host", "url", "html"), fixed, 8 * F.size("constants"))

    def align(group: pa.Table) -> str:
        found: dict[str, list] = {}
        for s, text in sorted(zip(group.column("shape").to_pylist(), group.column("pattern").to_pylist())):
            p = json.loads(text)
            found[s] = merge(found[s], p) if s in found else p
        wrapper = None
        for s in sorted(found):
            wrapper = found[s] if wrapper is None else merge(wrapper, found[s])
        return json.dumps(wrapper)

    def level(key: tuple, group: pa.Table) -> pa.Table:
        return pa.table({"host": [key[0].as_py()], "shape": [key[1].as_py()], "pattern": [align(group)]})

    def last(key: tuple, group: pa.Table) -> pa.Table:
        wrapper = json.loads(align(group))
        return pa.table({"host": [key[0].as_py()], "wrapper": [shape(wrapper)], "decisions": [json.dumps(decide(wrapper))]})

    # Patterns of one shape first, spread by what they sum up; then by the shape's hash, so that a hot host has many groups.
    found = page_patterns(rows).withColumn("spread", F.pmod(F.xxhash64("pattern"), F.lit(SALTS)))
    found = found.groupBy("host", "shape", "spread").applyInArrow(level, "host string, shape string, pattern string")
    found = found.withColumn("part", F.substring("shape", 1, 2)).groupBy("host", "part").applyInArrow(level, "host string, shape string, pattern string")
    found = found.groupBy("host").applyInArrow(lambda key, group: last((*key, None), group), "host string, wrapper string, decisions string")
    return cut(found.join(fixed, "host", "left").select("host", "wrapper", "constants", "decisions"), "wrappers")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    rows = _hosts(pages)
    known = wrappers(pages).select("host", "constants", "decisions")
    joined = _with(rows, known, 8 * F.coalesce(F.size("constants"), F.lit(0)) + F.length("decisions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[str, tuple[dict, set[int]]] = {}
        for batch in batches:
            out = []
            for name, source, text, fixed in zip(batch.column("host").to_pylist(), batch.column("html"), batch.column("decisions").to_pylist(), batch.column("constants").to_pylist()):
                if name not in ready:
                    if len(ready) > 1000:
                        ready.clear()
                    ready[name] = json.loads(text) if text else {"keep": [], "drop": []}, set(fixed or ())
                found, own = ready[name]
                page = blocks(source.as_py() or "")
                body, available = main_text(page, found, own)
                if len(body) < FITS * available:  # a page that its host's wrapper doesn't fit
                    body = main_text(page, decide(pattern(page, own)), own)[0]
                out.append(body)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "constants", "decisions").mapInArrow(read, "page_id long, url string, text string, n_chars long")
