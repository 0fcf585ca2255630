"""Queries on texts, pages and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, parties, party_tables, proposals
from ..sources import html_tables
from .search import table

#: Names for the list join, with the one that they stand for.
ALIASES = (("the with", "WITH"), ("of the", "OF"), ("and of", "AND"), ("die und", "UND"), ("les/de", "DE"), ("de la", "LA"), ("la", "LA"))
#: Forms of links, and what they are beside /a/b/c.asp.
LINK_FORMS = {"d": "/a/b/d", "../d": "/a/d", "../../../d?p=../q": "/d?p=../q", "./d/./e": "/a/b/d/e", "/x/../y": "/y", "?n=2": "/a/b/c.asp?n=2", "#z": "/a/b/c.asp?x=1#z", "d/..": "/a/b/"}
#: Texts with names, by turns.
PARTY_TEXTS = ("Antrag der SPD-Fraktion", "TR/DAL", "Fraktion Bündnis 90 / Die Grünen und CDU", "Die Linke./ Die PARTEI;", "ohne", "(FDP), Junges Duisburg", "Sozialdemokratischen Partei Deutschlands")
#: A document's text with the words of motions put before.
_TITLE = "CASE doc_id % 6 WHEN 0 THEN 'Antrag; hier: ' WHEN 1 THEN 'Prüfantrag zum ' WHEN 2 THEN 'Anfrage; ' WHEN 3 THEN 'DRINGLICHKEITSANTRAG - ' WHEN 4 THEN 'Bericht ' ELSE 'Antragsteller; Hier: ' END || source || ' – ' || text || '.'"


def normalise_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.collapse(F.col("text")).alias("clean"))


def slug_and_filename(spark, sf):
    name = F.concat(F.col("source"), F.lit(" / Ä:b?* "), F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", X.slugify(name).alias("slug"), X.sanitize_filename(name).alias("filename"))


def fold_diacritics(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


def match_form(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.match_form(F.col("text")).alias("form"))


def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


def token_counts(spark, sf):
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
    return table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("text_length"), words.alias("n_words"), F.size(X.tokens(F.col("text"))).cast("long").alias("n_tokens"))


def motion_type(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.motion_type(F.expr(_TITLE)).alias("kind"))


def subject(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.subject(F.expr(_TITLE)).alias("subject"))


def _named(spark, sf):
    """Every document's whole text, with names of the council's parties put into it by turns."""
    names = F.array(*[F.lit(x) for x in PARTY_TEXTS])
    named = F.concat_ws(" ", F.element_at(names, (F.col("doc_id") % len(PARTY_TEXTS) + 1).cast("int")), "text")
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), named.alias("title"))


def ngram_alias_join(spark, sf):
    aliases = spark.createDataFrame(list(ALIASES), "alias string, canon string")
    return parties.exact(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title")), aliases)


def detected_parties(spark, sf):
    """By the council's tables of names and tags."""
    found = parties.detect(_named(spark, sf), party_tables.aliases(spark), party_tables.tags(spark))
    return found.select("id", F.array_join("parties", ",").alias("parties"))


def fuzzy_parties(spark, sf):
    """Names of customers' segments and nations, words turned round, against the list of the straight ones."""
    nations = table(spark, sf, "nation").select("n_name")
    customers = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    titles = customers.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", F.lit("Antrag"), "n_name", F.lit("Liste Duisburg")).alias("title"))
    aliases = nations.select(F.concat(F.lit("Duisburg Liste "), "n_name").alias("alias"), F.col("n_name").alias("canon"))
    return parties.fuzzy(titles, aliases)


def _misspelt(spark, sf):
    """Customers' titles by turns: a made-up name for their nation with its last letter twice, as it is, turned round, and with another word in it."""
    made = F.translate(F.substring(F.md5("n_name"), 1, 14), "0123456789", "ghijklmnop")
    nations = table(spark, sf, "nation").select("n_nationkey", made.alias("alias"), F.lower("n_name").alias("canon"))
    customers = table(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    turn = F.col("c_custkey") % 4
    name = F.when(turn == 0, F.concat("alias", F.substring("alias", -1, 1))).when(turn == 1, F.col("alias")).when(turn == 2, F.reverse("alias")).otherwise(F.concat(F.substring("alias", 1, 7), F.lit(" xq "), F.substring("alias", 8, 99)))
    titles = customers.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", F.lit("Antrag:"), name, F.lit("zzq")).alias("title"))
    return titles, nations.select("alias", "canon")


def fuzzy_parties_misspelt(spark, sf):
    """Similar names only, of titles of which most hold none."""
    return parties.fuzzy(*_misspelt(spark, sf))


def detected_both_ways(spark, sf):
    """The union of the names that stand in a title and of similar ones; titles without any have an empty list."""
    titles, aliases = _misspelt(spark, sf)
    again = aliases.unionByName(aliases.select(F.concat(F.lit("die zzq partei mit sieben worten "), "alias").alias("alias"), "canon"))
    found = parties.detect(titles, again, fuzzy_too=True)
    return found.select("id", F.array_join("parties", ",").alias("parties"))


def url_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.expr("parse_url(url, 'PROTOCOL')").alias("scheme"), F.expr("parse_url(url, 'HOST')").alias("host"), F.nullif(F.expr("parse_url(url, 'PATH')"), F.lit("")).alias("path"), F.nullif(X.page_slug(url), F.lit("")).alias("slug"))


def query_param(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.query_parameter(F.col("url"), "page").alias("page"), X.query_parameter(F.col("url"), "ref").alias("ref"))


def html_links(spark, sf):
    return html_tables.links(table(spark, sf, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href", "label")


def absolute_links(spark, sf):
    return html_tables.attachments(html_tables.links(table(spark, sf, "pages"))).select("page_id", "href", "url")


def resolved_links(spark, sf):
    """Links of all forms on every page."""
    forms = F.array(*[F.lit(x) for x in LINK_FORMS])
    rows = table(spark, sf, "pages").select("page_id", "url", F.posexplode(forms).alias("form", "href"))
    return rows.select("page_id", "form", X.absolute_url(F.col("href"), F.regexp_replace("url", r"^([^/]*//[^/]*).*$", "$1/a/b/c.asp?x=1#y")).alias("url"))


def html_title_text(spark, sf):
    return html_tables.titles(table(spark, sf, "pages"))


def label_values(spark, sf):
    """Rows of two cells made of every order, read by the parser."""
    row = lambda name, value: F.concat(F.lit(f"<tr><th>{name}:</th><td> <b>"), value, F.lit("</b></td></tr>"))
    orders = table(spark, sf, "orders")
    html = F.concat(F.lit("<table><tr><td>nur eine</table><table>"), row("Status", F.lit("alt")), row("Datum", F.date_format("o_orderdate", "dd.MM.yyyy")), row("Status", F.col("o_orderstatus")), row("Art", F.concat("o_orderpriority", F.lit(" &amp; mehr"))), F.lit("</table>"))
    found = html_tables.label_values(orders.select(F.col("o_orderkey").alias("page_id"), html.alias("html")))
    return found.select("page_id", *[F.try_element_at("labels", F.lit(x)).alias(x.lower()) for x in ("Datum", "Status", "Art")])


def extension_guess(spark, sf):
    kind = F.expr("CASE page_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html; charset=utf-8' WHEN 2 THEN NULL WHEN 3 THEN 'application/msword' ELSE 'x/y' END")
    url = F.expr("'https://' || coalesce(parse_url(url, 'HOST'), 'h') || CASE page_id % 4 WHEN 0 THEN '/a.PDF' WHEN 1 THEN '/b.docx?x=1' WHEN 2 THEN '/getfile.asp?id=1.zip' ELSE '/c' END")
    return table(spark, sf, "pages").select("page_id", X.extension(kind, url).alias("ext"))


def sha256_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"), X.short_sha1(F.col("text")).alias("short"))


def uuid5_id(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.uuid5_url(F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))).alias("uuid"))


def chunk_chars(spark, sf):
    found = chunking.by_characters(table(spark, sf, "documents"))
    return found.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "text")


def chunk_stats(spark, sf):
    found = chunk_chars(spark, sf)
    return found.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum(F.length("text").cast("long")).alias("chars"), F.max("char_end").alias("last"))


def chunk_sentences(spark, sf):
    chunks = chunking.by_sentences(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunks).alias("chunk", "text"))


def summary_text(spark, sf):
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(*[F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"]).alias(r) for r in ("user", "assistant")])
    return grouped.select("conv_id", proposals.summary_text([("Fragen", F.col("user"), 6), ("Antworten", F.col("assistant"), 3)]).alias("summary"))


def prompt_build(spark, sf):
    listed = F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))), lambda x: x["text"])
    asked = F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))
    grouped = table(spark, sf, "conversations").groupBy("conv_id").agg(listed.alias("texts"), F.coalesce(asked, F.lit("")).alias("question"))
    return grouped.select("conv_id", proposals.prompt(F.col("question"), F.col("texts")).alias("prompt"))


def language_guess(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.coalesce(X.language(F.col("text")), F.lit("?")).alias("guess"))


_ANCHOR = html_tables.ANCHOR.replace("'", "''")
_WS = r"[\s\x0B\x85\p{Z}]+"
_LINKS = rf"""l AS (SELECT page_id, url base, unnest(range(0, len(h))) pos, unnest(h) w, unnest(i) inn FROM (SELECT *, regexp_extract_all(html, '{_ANCHOR}', 0) h, regexp_extract_all(html, '{_ANCHOR}', 5) i FROM pages)),
k AS (SELECT page_id, base, pos, trim(regexp_extract(w, '{_ANCHOR}', 1) || regexp_extract(w, '{_ANCHOR}', 2) || regexp_extract(w, '{_ANCHOR}', 3)) href, coalesce(nullif(trim(regexp_replace(regexp_replace(inn, '<[^>]*>', ' ', 'g'), '{_WS}', ' ', 'g')), ''), 'Dokument') AS label FROM l)"""
_TITLES = f"(SELECT doc_id, {_TITLE} t FROM documents)"
_SIGNS = "translate({}, '" + X.PUNCTUATION.replace("'", "''") + f"', '{' ' * len(X.PUNCTUATION)}')"


def _form(column: str) -> str:
    slashed = rf"regexp_replace(regexp_replace({column}, '\s*{chr(160)}\s*', ' ', 'g'), '\s+/\s+', '/', 'g')"
    return r"trim(regexp_replace(" + _SIGNS.format(f"strip_accents(lower({slashed}))") + r", '\s+', ' ', 'g'))"


def _words(column: str) -> str:
    return rf"trim(regexp_replace({_form(column)}, '[^\p{{L}}\p{{N}}_/]+', ' ', 'g'))"


def _held(texts: str, names: str) -> str:
    """n: names that stand in a text between spaces, or between spaces and slashes if they have none."""
    return f"""t AS ({texts}), a AS (SELECT DISTINCT {_words("alias")} f, canon FROM ({names})), w AS (SELECT id, {_words("title")} w FROM t),
n AS (SELECT DISTINCT id, canon FROM w JOIN a ON CASE WHEN contains(f, '/') THEN contains(' ' || w || ' ', ' ' || f || ' ') ELSE contains(replace(' ' || w || ' ', '/', ' / '), ' ' || f || ' ') END)"""


def _values(rows, columns: str) -> str:
    quote = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") v({columns})"


_NAMES = _held("SELECT doc_id id, text title FROM documents", _values(ALIASES, "alias, canon"))
_PARTIES = _held(
    "SELECT doc_id id, (" + _values([(x,) for x in PARTY_TEXTS], "x").replace("SELECT *", "SELECT list(x)") + ")[doc_id % " + str(len(PARTY_TEXTS)) + " + 1] || ' ' || text title FROM documents",
    _values([(x, canon) for canon, own, _ in party_tables.NAMES for x in (*own, canon)], "alias, canon"),
)
#: Sentences of each text, with the words before each; a chunk is a run of sentences and begins with the last eight of the one before.
_SENTENCES = r"""d AS (SELECT doc_id, list_filter(string_split(regexp_replace(trim(text, chr(32)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') s FROM documents),
c AS (SELECT doc_id, s, list_prepend(0, list_transform(s, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda w: w <> '')))) n FROM d WHERE len(s) > 0),
p AS MATERIALIZED (SELECT doc_id, s, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])) p FROM c)"""

SQL = {
    "normalise_text": rf"SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) clean FROM documents",
    "slug_and_filename": r"""SELECT doc_id, regexp_replace(regexp_replace(lower(trim(n)), '[^\p{L}\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') slug, regexp_replace(regexp_replace(trim(n), '[\\/:*?"<>|]+', '-', 'g'), '\s+', ' ', 'g') filename FROM (SELECT doc_id, source || ' / Ä:b?* ' || lang n FROM documents)""",
    "fold_diacritics": "SELECT doc_id, strip_accents(text) folded FROM documents",
    "match_form": f"SELECT doc_id, {_form('text')} form FROM documents",
    "snippet": "SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END snippet FROM documents",
    "token_counts": r"SELECT doc_id, length(text) text_length, len(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')) n_words, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) n_tokens FROM documents",
    "motion_type": "SELECT doc_id, CASE " + " ".join(rf"WHEN regexp_matches(t, '(?i)(^|[^\p{{L}}\p{{N}}_]){k}([^\p{{L}}\p{{N}}_]|$)') THEN '{k}'" for k in X.MOTIONS) + f" END kind FROM {_TITLES}",
    "subject": rf"SELECT doc_id, regexp_replace(CASE WHEN contains(lower(t), 'hier:') THEN regexp_extract(t, '(?is)hier:(.*)$', 1) ELSE string_split(t, ';')[-1] END, '^[ .—–-]+|[ .—–-]+$', '', 'g') subject FROM {_TITLES}",
    "ngram_alias_join": f"WITH {_NAMES} SELECT id, canon FROM n",
    "url_parts": r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) scheme, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '') AS path, nullif(regexp_replace(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')[-1], '\.asp$', ''), '') slug FROM pages",
    "query_param": "SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages",
    "html_links": f"WITH {_LINKS} SELECT page_id, pos, href, label FROM k",
    "absolute_links": rf"WITH {_LINKS}, u AS (SELECT *, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN starts_with(href, '/') THEN regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_extract(base, '^([a-z]+://[^/?#]*(/[^?#]*/|/)?)', 1), '/?$', '/') || href END url FROM k) SELECT page_id, href, url FROM u QUALIFY row_number() OVER (PARTITION BY page_id, coalesce(nullif(regexp_extract(url, '[?&]id=([^&#]*)', 1), ''), url) ORDER BY pos) = 1",
    "resolved_links": "SELECT page_id, form, regexp_extract(url, '^([^/]*//[^/]*)', 1) || path AS url FROM pages CROSS JOIN (VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(LINK_FORMS.values())) + ") v(form, path)",
    "html_title_text": rf"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_WS}', ' ', 'g')) title FROM pages",
    "label_values": "SELECT o_orderkey page_id, strftime(o_orderdate, '%d.%m.%Y') datum, o_orderstatus status, o_orderpriority || ' & mehr' art FROM orders",
    "extension_guess": "SELECT page_id, CASE WHEN page_id % 5 = 0 OR page_id % 4 = 0 THEN '.pdf' WHEN page_id % 5 = 3 THEN '.doc' WHEN page_id % 4 = 1 THEN '.docx' WHEN page_id % 4 = 2 THEN '.asp' WHEN page_id % 5 = 1 THEN '.html' ELSE '.bin' END ext FROM pages",
    "uuid5_id": f"SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', instr('0123456789abcdef', substr(h, 17, 1)) % 4 + CASE instr('0123456789abcdef', substr(h, 17, 1)) % 4 WHEN 0 THEN 4 ELSE 0 END, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) uuid FROM (SELECT doc_id, sha1(unhex('{X.URL_NAMESPACE}') || encode('doc:' || doc_id)) h FROM documents)",
    "chunk_sentences": f"WITH RECURSIVE {_SENTENCES}, r AS (SELECT doc_id, 0 AS chunk, 0 AS a, greatest(1, len(list_filter(p, lambda x: x <= 500)) - 1) b FROM p UNION ALL SELECT r.doc_id, chunk + 1, greatest(r.a, b - 8), greatest(b + 1, len(list_filter(p, lambda x: x <= 500 + p[greatest(r.a, r.b - 8) + 1])) - 1) FROM r JOIN p USING (doc_id) WHERE b < len(s)) SELECT doc_id, chunk, array_to_string(s[a + 1:b], ' ') AS text FROM r JOIN p USING (doc_id)",
    "fuzzy_parties": "SELECT c_custkey id, n_name canon FROM customer JOIN nation ON c_nationkey = n_nationkey",
    # With a letter more a name is similar enough; turned round or cut in two it isn't.
    "fuzzy_parties_misspelt": "SELECT c_custkey id, lower(n_name) canon FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 4 < 2",
    "detected_both_ways": "SELECT c_custkey id, CASE WHEN c_custkey % 4 < 2 THEN lower(n_name) ELSE '' END parties FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "sha256_id": "SELECT doc_id, sha256(text) sha, substr(sha1(text), 1, 12) short FROM documents",
    "chunk_chars": r"""WITH RECURSIVE d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\s\x0B\x85\p{Z}]+', ' ', 'g')) t FROM documents),
s AS (SELECT doc_id, t, length(t) n, 0 AS chunk, 0 AS a FROM d WHERE length(t) > 0),
r(doc_id, t, n, chunk, a, b) AS (
SELECT doc_id, t, n, 0, 0, CASE WHEN n <= 1200 THEN n ELSE (SELECT CASE WHEN p > 0 AND 1200 - p - 1 >= 600 THEN 1200 - p - 1 ELSE 1200 END FROM (SELECT strpos(reverse(substr(t, 1, 1200)), ' .') p)) END FROM s
UNION ALL
SELECT doc_id, t, n, chunk + 1, b - 150, CASE WHEN n <= b - 150 + 1200 THEN n ELSE (SELECT CASE WHEN p > 0 AND 1200 - p - 1 >= 600 THEN b - 150 + 1200 - p - 1 ELSE b - 150 + 1200 END FROM (SELECT strpos(reverse(substr(t, b - 150 + 1, 1200)), ' .') p)) END FROM r WHERE b < n)
SELECT doc_id, chunk::BIGINT chunk, a::BIGINT char_start, b::BIGINT char_end, trim(substr(t, a + 1, b - a)) AS text FROM r""",
    "summary_text": "WITH g AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'user') u, list(text ORDER BY turn) FILTER (role = 'assistant') a FROM conversations GROUP BY ALL) SELECT conv_id, concat_ws(chr(10), CASE WHEN len(u) > 0 THEN 'Fragen: ' || array_to_string(u[1:6], '; ') END, CASE WHEN len(a) > 0 THEN 'Antworten: ' || array_to_string(a[1:3], '; ') END) summary FROM g",
    "prompt_build": "WITH g AS (SELECT conv_id, list(text ORDER BY turn) FILTER (role = 'assistant') a, coalesce(max_by(text, turn) FILTER (role = 'user'), '') q FROM conversations GROUP BY ALL) SELECT conv_id, 'Kontext:' || chr(10) || coalesce(nullif(array_to_string(a, chr(10) || chr(10)), ''), '(Kein Kontext gefunden.)') || chr(10) || chr(10) || 'Frage: ' || q AS prompt FROM g",
}
_COUNTS = ", ".join(f"len(list_filter(w, lambda x: list_contains({list(own)}, x))) {code}" for code, own in X.STOP_WORDS.items())
_MOST = f"greatest({', '.join(X.STOP_WORDS)})"
SQL["language_guess"] = rf"SELECT doc_id, CASE WHEN {_MOST} = 0 THEN '?' " + " ".join(f"WHEN {code} = {_MOST} THEN '{code}'" for code in X.STOP_WORDS) + rf" END guess FROM (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') w FROM documents))"
_TAGS = _values([(canon, tag) for canon, _, tag in party_tables.NAMES], "canon, tag")
SQL["detected_parties"] = f"WITH {_PARTIES}, g AS (SELECT DISTINCT id, tag FROM n JOIN ({_TAGS}) USING (canon)) SELECT id, coalesce(string_agg(tag, ',' ORDER BY tag), '') parties FROM t LEFT JOIN g USING (id) GROUP BY id"
SQL["chunk_stats"] = "SELECT doc_id, count(*) chunks, sum(length(text))::BIGINT chars, max(char_end) AS last FROM (" + SQL["chunk_chars"] + ") GROUP BY doc_id"

QUERIES = {f.__name__: f for f in (normalise_text, slug_and_filename, fold_diacritics, match_form, snippet, token_counts, motion_type, subject, ngram_alias_join, detected_parties, fuzzy_parties, fuzzy_parties_misspelt, detected_both_ways, url_parts, query_param, html_links, absolute_links, resolved_links, html_title_text, label_values, extension_guess, sha256_id, uuid5_id, chunk_chars, chunk_stats, chunk_sentences, summary_text, prompt_build, language_guess)}
