import uuid

import pytest
from pyspark.sql import functions as F

from forumlake.functions import text as X


def value(spark, column, *values):
    row = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(column(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first().x


@pytest.mark.parametrize(
    "column, text, expected",
    [
        (X.collapse, " a\u00a0 b\n\tc ", "a b c"),
        (X.slugify, "  Über den -- Platz! ", "über-den-platz"),
        (X.sanitize_filename, " a/b:\u00a0c??d  e ", "a-b- c-d e"),
        (X.fold, "Grüße, Éa", "Gruße, Ea"),
        (X.match_form, "Bündnis 90 / Die Grünen!", "bundnis 90/die grunen!"),
        (X.motion_type, "Prüfantrag zum Radweg", "Prüfantrag"),
        (X.motion_type, "ein ANTRAG", "Antrag"),
        (X.motion_type, "Antragsteller", None),
        (X.subject, "Antrag; hier: Radweg Nord.", "Radweg Nord"),
        (X.subject, "Antrag; Radweg – ", "Radweg"),
        (X.subject, "Radweg", "Radweg"),
        (X.page_slug, "http://a.de/x/si0057.asp?y=1", "si0057"),
        (X.strip_double_zone, "2026-01-01T00:00:00+00:00Z", "2026-01-01T00:00:00+00:00"),
        (X.unknown_to_null, " keine Angabe ", None),
        (X.prompt_text, "a\n\n\n\nb\n", "a\n\nb"),
    ],
)
def test_text(spark, column, text, expected):
    found = value(spark, column, text)
    assert (found.strip() if isinstance(found, str) and column is X.prompt_text else found) == expected


def test_uuid_and_names(spark):
    for name in ("", "top:1", "ä/ö"):
        assert value(spark, X.uuid5_url, name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert tuple(value(spark, X.person_name, "Frau Dr. Muster, Erika")) == ("Frau", "Dr. Muster", "Erika")
    assert value(spark, X.decode_email, "a", "@", "ed.b") == "a@b.de"
    assert str(value(spark, X.german_date, "24.02.2026")) == "2026-02-24"
    assert value(spark, X.german_date, "31.02.2026") is None
    assert value(spark, lambda c: X.ngrams(F.split(c, " "), 2), "a b a b") == ["a", "b", "a b", "b a"]
    assert value(spark, X.absolute_url, "x.pdf", "http://h/a/b") == "http://h/a/x.pdf"
    assert value(spark, X.absolute_url, "/x", "http://h/a/b") == "http://h/x"
    assert value(spark, X.absolute_url, "x", "http://h") == "http://h/x"


def test_marks_and_forms(spark):
    said = "Ṩ\u0301 ắ Ł ß ﬁ Ⅳ Ａ½ Ő\u00a0x  /  y"
    r = spark.createDataFrame([(said,)], "t string").select(X.fold(F.col("t")).alias("fold"), X.compatible(F.col("t")).alias("form")).first()
    assert r.fold.startswith("S a Ł ß") and "O" in r.fold
    assert r.form.endswith("Ő x/y") and "fi IV A1⁄2" in r.form


def test_prompt_and_links(spark):
    rows = spark.createDataFrame([("    a\n      b\n\n\n\n    c\n  \n", "../x/./y?z=..", "http://h/a/b/c.asp?q=1", "http://h/p?na.me=%C3%A4+b&x=1")], "t string, href string, base string, url string")
    r = rows.select(X.prompt_text(F.col("t")).alias("prompt"), X.absolute_url(F.col("href"), F.col("base")).alias("link"), X.absolute_url(F.lit("//g/k"), F.col("base")).alias("other"), X.query_parameter(F.col("url"), "na.me").alias("value")).first()
    assert (r.prompt, r.link, r.other, r.value) == ("a\n  b\n\nc", "http://h/a/x/y?z=..", "http://g/k", "ä b")
