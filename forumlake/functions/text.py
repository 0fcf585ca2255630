"""Text, date, hash and URL functions over columns.

Null in gives null out unless a function says otherwise.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"


def _letters(form: str, marks: bool) -> tuple[str, str]:
    """Characters of the basic plane whose normal form is another single character, without marks if marks is set, and that one."""
    pairs = []
    for c in map(chr, [*range(0xA0, 0xD800), *range(0xF900, 0xFFF0)]):
        normal = unicodedata.normalize(form, c)
        if marks:
            normal = "".join(x for x in normal if not unicodedata.combining(x))
        if normal != c and len(normal) == 1:
            pairs.append((c, normal))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Letters with marks, and their bases; compatible forms such as full-width letters, and the plain ones.
MARKED, PLAIN = _letters("NFKD", True)
COMPATIBLE, USUAL = _letters("NFKC", False)
#: Compatible forms of several characters.
LIGATURES = {
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "…": "...", "№": "No", "½": "1⁄2", "¼": "1⁄4",
    "¾": "3⁄4", "Ⅱ": "II", "Ⅲ": "III", "Ⅳ": "IV", "Ⅵ": "VI", "Ⅶ": "VII", "Ⅷ": "VIII", "Ⅸ": "IX", "Ⅺ": "XI", "Ⅻ": "XII",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    """Runs of any white space become one space, the ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def slugify(text: Column) -> Column:
    """Lower case, every run that isn't a letter, digit or underscore becomes one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_]+", "-"), r"^-+|-+$", "")


def sanitize_filename(text: Column) -> Column:
    """Characters that file systems forbid become a hyphen, no-break spaces and runs of white space one space."""
    clean = F.regexp_replace(F.trim(F.regexp_replace(text, "\u00a0", " ")), r"[\\/:*?\"<>|]+", "-")
    return F.regexp_replace(clean, r"\s+", " ")


def fold(text: Column) -> Column:
    """Letters lose their marks, those that are part of them and those that follow; a sharp s stays."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{M}+", "")


def compatible(text: Column) -> Column:
    """Compatible forms as plain characters, no-break spaces as spaces, ` / ` as a slash, one space between words."""
    plain = F.translate(text, COMPATIBLE, USUAL)
    for form, usual in LIGATURES.items():
        plain = F.replace(plain, F.lit(form), F.lit(usual))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)\s+/\s+", "/"), r"(?U)\s+", " "))


#: The punctuation that doesn't count in comparing names.
PUNCTUATION = ".,;:()[]\"“”„‚’'–—-"


def match_form(text: Column) -> Column:
    """For comparing names: lower case, without marks, punctuation but the slash as a space, one space between words."""
    return F.trim(F.regexp_replace(F.translate(fold(F.lower(compatible(text))), PUNCTUATION, " " * len(PUNCTUATION)), r"\s+", " "))


def snippet(text: Column, n: int = 400) -> Column:
    """The first n characters, with an ellipsis if there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


#: Kinds of motion, in the order in which they are looked for.
MOTIONS = ("Prüfantrag", "Antrag", "Anfrage", "Dringlichkeitsantrag")


def motion_type(text: Column, kinds: tuple[str, ...] = MOTIONS) -> Column:
    """The first kind that stands in the text as a word, in any case; null without one."""
    return F.coalesce(*[F.when(text.rlike(rf"(?iu)(^|[^\p{{L}}\p{{N}}_]){kind}([^\p{{L}}\p{{N}}_]|$)"), F.lit(kind)) for kind in kinds])


def subject(text: Column, marker: str = "hier:") -> Column:
    """What follows the marker, else the part after the last semicolon, without spaces, stops and dashes at the ends."""
    after = F.regexp_extract(text, f"(?is){marker}(.*)$", 1)
    part = F.when(F.lower(text).contains(marker), after).otherwise(F.element_at(F.split(text, ";"), -1))
    return F.regexp_replace(part, r"^[ .—–-]+|[ .—–-]+$", "")


def ngrams(words: Column, longest: int) -> Column:
    """Distinct runs of 1 to longest words, joined by a space."""

    def of(w: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(F.size(w) >= n, F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))

    # Bound to a variable, so that the words are made once and not for every run.
    both = F.transform(F.array(words), lambda w: F.array_distinct(F.concat(*[of(w, n) for n in range(1, longest + 1)])))
    return F.element_at(both, 1)


def german_date(text: Column) -> Column:
    """dd.MM.yyyy as a date; null if it isn't one."""
    return F.try_to_date(text, "dd.MM.yyyy") if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(text, F.lit("dd.MM.yyyy")))


def epoch_seconds(date: Column) -> Column:
    return F.unix_date(date).cast("long") * 86400


def iso_epoch(text: Column) -> Column:
    """Seconds of an ISO date or time, without an offset in UTC; null if it is neither."""
    return F.unix_seconds(F.try_to_timestamp(F.when(text.rlike(r"T.*(Z|[+-]\d\d:?\d\d)$") | ~text.contains("T"), text).otherwise(F.concat(text, F.lit("Z")))))


def now_iso() -> Column:
    """The time of the query in UTC, to the second."""
    return iso_utc(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()))


def random_id() -> Column:
    """A random UUID for each row."""
    return F.uuid()


def without_hard_spaces(text: Column) -> Column:
    """No-break spaces go, as in the numbers of votes."""
    return F.replace(text, F.lit("\u00a0"), F.lit(""))


def iso_utc(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def strip_double_zone(text: Column) -> Column:
    """A zone offset that a Z follows loses the Z."""
    return F.regexp_replace(text, r"([+-]\d\d:\d\d)Z$", "$1")


#: The namespace of names that are URLs, in hexadecimal (RFC 4122).
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5_url(text: Column) -> Column:
    """The name-based UUID, version 5, of a text in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(text, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    parts = [F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12)]
    return F.concat_ws("-", *parts)


def short_sha1(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 12)


def absolute_url(href: Column, base: Column) -> Column:
    """A link on a page: absolute, of the scheme, from the host's root, a query or a part of the page, or beside the page.

    `.` and `..` in a path are resolved."""
    link = F.trim(href)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*((?:/[^?#]*/|/)?)", 1)
    path = F.when(link.startswith("/"), link).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), link))
    steps = F.split(F.regexp_extract(path, r"^([^?#]*)", 1), "/")
    last = F.element_at(steps, -1)

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    resolved = F.aggregate(F.slice(steps, 2, F.size(steps)), F.array(F.lit("")), walk)
    resolved = F.concat(F.array_join(resolved, "/"), F.when(last.isin(".", ".."), "/").otherwise(""), F.regexp_extract(path, r"^[^?#]*(.*)$", 1))
    plain = F.when(path.rlike(r"(^|/)\.\.?(/|[?#]|$)"), resolved).otherwise(path)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link == "", base)
        .when(link.startswith("?"), F.concat(page, link)).when(link.startswith("#"), F.concat(F.regexp_extract(base, r"^([^#]*)", 1), link)).otherwise(F.concat(root, plain))
    )


def page_slug(url: Column, suffix: str = ".asp") -> Column:
    """The last part of the path without the suffix."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(last, suffix.replace(".", r"\.") + "$", "")


def query_parameter(url: Column, name: str) -> Column:
    """The first value of a query-string parameter, decoded; null without one."""
    found = F.nullif(F.regexp_extract(url, rf"[?&]{re.escape(name)}=([^&#]*)", 1), F.lit(""))
    return F.coalesce(F.try_url_decode(found), found)


#: Extensions by media type.
EXTENSIONS = {
    "application/pdf": ".pdf", "application/msword": ".doc", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "text/html": ".html", "text/plain": ".txt", "image/jpeg": ".jpg", "image/png": ".png", "application/zip": ".zip",
}


def extension(media_type: Column, url: Column) -> Column:
    """PDF and Word by media type or URL, else the suffix of the URL's path whatever it is, else by media type, else .bin."""
    kind = F.lower(F.element_at(F.split(F.coalesce(media_type, F.lit("")), ";"), 1))
    link = F.coalesce(url, F.lit(""))
    path = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    suffix = F.regexp_extract(path, r"[^/](\.[^./]+)/*$", 1)
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return (
        F.when((kind == "application/pdf") | F.lower(link).endswith(".pdf"), ".pdf").when(kind.contains("msword") | (suffix == ".doc"), ".doc")
        .when(kind.contains("officedocument.wordprocessingml.document") | (suffix == ".docx"), ".docx").when(suffix != "", suffix).otherwise(F.coalesce(F.try_element_at(known, kind), F.lit(".bin")))
    )


def person_name(text: Column) -> Column:
    """`form of address, family name, given name` from "Frau Dr. Muster, Erika"."""
    words = F.split(F.element_at(F.split(text, ","), 1), " ")
    rest = F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(F.element_at(words, 1).alias("anrede"), rest.alias("nachname"), F.trim(F.get(F.split(text, ","), F.lit(1))).alias("vorname"))


def decode_email(after: Column, visible: Column, before: Column) -> Column:
    """An address that style sheets hide: what follows, what is seen, and the reverse of what precedes."""
    return F.concat(F.coalesce(after, F.lit("")), F.coalesce(visible, F.lit("")), F.reverse(F.coalesce(before, F.lit(""))))


def css_parts(html: Column) -> Column:
    """(class, pseudo, content) of a page's style rules that put text before or after spans of a class."""
    rule = r"(?i)span\.([^\s:{]+)::(before|after)\s*\{\s*content:\s*\"([^\"]*)\""
    styles = F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<style[^>]*>(.*?)</style>"), F.lit(1)), "\n")
    parts = [F.regexp_extract_all(styles, F.lit(rule), F.lit(i)).alias(n) for i, n in ((1, "class"), (2, "pseudo"), (3, "content"))]
    return F.transform(F.arrays_zip(*parts), lambda x: F.struct(x["class"].alias("class"), F.lower(x["pseudo"]).alias("pseudo"), x["content"].alias("content")))


def hidden_email(html: Column, cell: Column) -> Column:
    """The address in a cell whose span's class has parts in the page's styles, else the cell's text."""
    span = F.regexp_extract(cell, r"(?is)<span[^>]*class=[\"']([^\"']*)[\"'][^>]*>(.*?)</span>", 1)
    visible = F.trim(F.regexp_replace(F.regexp_extract(cell, r"(?is)<span[^>]*>(.*?)</span>", 1), "<[^>]*>", ""))
    classes = F.split(span, r"\s+")

    def part(pseudo: str) -> Column:
        # The last rule of a class counts, and the last class that has one.
        found = F.transform(classes, lambda c: F.try_element_at(F.filter(css_parts(html), lambda x: (x["class"] == c) & (x["pseudo"] == pseudo)), F.lit(-1))["content"])
        return F.try_element_at(F.filter(found, lambda x: x.isNotNull()), F.lit(-1))

    plain = collapse(F.regexp_replace(cell, "<[^>]*>", " "))
    return F.when(cell.rlike("(?i)<span"), decode_email(part("after"), visible, part("before"))).otherwise(plain)


def unknown_to_null(text: Column, sentinel: str = "keine Angabe") -> Column:
    return F.nullif(F.trim(text), F.lit(sentinel))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def prompt_text(text: Column) -> Column:
    """A prompt file's text: the indent that all lines have goes, three or more line ends become two, the ends are trimmed."""
    lines = F.split(text, "\n")
    indent = F.array_min(F.transform(F.filter(lines, lambda x: F.trim(x) != ""), lambda x: F.length(F.regexp_extract(x, r"^[ \t]*", 0))))
    even = F.transform(F.array(indent), lambda n: F.array_join(F.transform(lines, lambda x: F.when(x.rlike(r"^\s*$"), "").otherwise(F.substr(x, F.coalesce(n, F.lit(0)) + 1))), "\n"))
    return F.regexp_replace(F.regexp_replace(F.element_at(even, 1), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


#: Frequent words of each language.
STOP_WORDS = {
    "de": ("der", "die", "und", "das", "von", "den", "ist", "nicht", "mit", "für"),
    "en": ("the", "of", "and", "to", "is", "that", "with", "was", "for", "this"),
    "es": ("el", "los", "las", "que", "por", "una", "con", "para", "del", "y"),
    "fr": ("le", "les", "des", "est", "et", "dans", "qui", "une", "pour", "du"),
}


def language(text: Column, known: Column | None = None) -> Column:
    """The known language, else the one with most of its frequent words in the text (ties in the order of codes), else null."""
    def score(words: Column, place: int, code: str) -> Column:
        return F.struct(F.size(F.filter(words, lambda x: x.isin(*STOP_WORDS[code]))).alias("n"), F.lit(-place).alias("order"), F.lit(code).alias("code"))

    counts = F.transform(F.array(tokens(text)), lambda w: F.array(*[score(w, i, code) for i, code in enumerate(STOP_WORDS)]))
    best = F.array_max(F.element_at(counts, 1))
    guess = F.when(best["n"] > 0, best["code"])
    return guess if known is None else F.coalesce(known, guess)
