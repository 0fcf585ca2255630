"""Parties and groups of the council, the spellings of their names, and their attributes."""

from __future__ import annotations

#: Names with the spellings that stand for them, and the short tag of each.
NAMES = (
    ("Sozialdemokratischen Partei Deutschlands", ("SPD",), "SPD"),
    ("Christlich-Demokratische Union", ("CDU",), "CDU"),
    ("Bündnis 90/Die Grünen", ("Bündnis 90/Die Grünen", "Bündis 90/Die Grünen", "Bündnis 90/ Die Grünen", "Bündis 90/Die Grünen ", "Bündnis 90 /Die Grünen"), "B90/GRÜNE"),
    ("Alternative für Deutschland", ("AfD",), "AfD"),
    ("Junges Duisburg", ("Junges Duisburg", "JUDU"), "JUDU"),
    ("Duisburger Alternative Liste", ("DAL",), "DAL"),
    ("Freie Demokratische Partei", ("FDP",), "FDP"),
    ("Fraktion Die Linke./Die PARTEI", ("Die Linke./Die PARTEI", "Die Linke./ Die PARTEI"), "LINKE/PARTEI"),
    ("Bündnis Sahra Wagenknecht", ("Bündnis Sahra Wagenknecht",), "BSW"),
    ("Sozial, Gerecht, Unabhängig", ("SGU",), "SGU"),
    ("Die Linke.", ("Die Linke.",), "DIE LINKE"),
    ("parteilos", ("parteilos", "Parteilos"), "PARTEILOS"),
    ("Fraktion Tierschutz/DAL", ("Tierschutz/DAL",), "Tierschutz/DAL"),
    ("Solidarität für Duisburg", ("SfD", "SFD"), "SFD"),
    ("Tierschutz", ("Tierschutz",), "Tierschutz"),
    ("Wir gestalten Duisburg", ("WGD",), "WGD"),
    ("Fraktion TR/DAL", ("TR/DAL", "TR / DAL"), "TR/DAL"),
    ("Aktive Bürgerinitiative", ("ABI",), "ABI"),
    ("Müslüman Türkler Birligi", ("MTB",), "MTB"),
    ("Tükische Repräsentanz", ("TR",), "TR"),
    ("Bündinis für Innovations und Gerechtigkeit", ("BIG-DERGAH",), "BIG-DERGAH"),
    ("AG-Handicap", ("AG-Handicap",), "AG-Handicap"),
    ("AG-Handicap / VKM-Duisburg e.V.", ("AG-Handicap / VKM-Duisburg e.V.",), "AG-Handicap/VKM"),
    ("Bürgerlich-Liberale", ("BL",), "BL"),
    ("Die PARTEI", ("Die PARTEI",), "Die PARTEI"),
)

#: Name, handle, kind and page.
ATTRIBUTES = (
    ("Sozialdemokratischen Partei Deutschlands", "SPD", "partei", "https://www.spd-duisburg.de/"),
    ("Christlich-Demokratische Union", "CDU", "partei", "https://www.cdu-duisburg.de/"),
    ("Bündnis 90/Die Grünen", "Grüne", "partei", "https://gruene-duisburg.de/"),
    ("Alternative für Deutschland", "AfD", "partei", "https://afd-duisburg.de/"),
    ("Junges Duisburg", "JUDU", "wählergemeinschaft", "https://junges-duisburg.de/"),
    ("Duisburger Alternative Liste", "DAL", "wählergemeinschaft", "https://www.dal-politik.de/"),
    ("Freie Demokratische Partei", "FDP", "partei", "https://fdp-duisburg.de/"),
    ("Die Linke.", "Linke", "partei", "https://www.dielinke-duisburg.de/"),
    ("Die PARTEI", "Partei", "partei", "https://www.die-partei-duisburg.de/"),
    ("Fraktion Die Linke./Die PARTEI", "linke/partei", "fraktion", None),
    ("Bündnis Sahra Wagenknecht", "BSW", "partei", "https://www.fraktion-bsw-duisburg.de/"),
    ("Sozial, Gerecht, Unabhängig", "SGU", "wählergemeinschaft", "https://www.sgu-duisburg.de/"),
    ("parteilos", "parteilos", "parteilos", None),
    ("Fraktion Tierschutz/DAL", "Fraktion Ts/DAL", "fraktion", "https://tierschutz-hier.de/ratsfraktion-tierschutz-dal-duisburg"),
    ("Solidarität für Duisburg", "SfD", "wählergemeinschaft", None),
    ("Wir gestalten Duisburg", "WGD", "wählergemeinschaft", "http://dalduisburg.de/"),
    ("Aktive Bürgerinitiative", "ABI", "wählergemeinschaft", "https://abi-für-duisburg.de/"),
    ("Müslüman Türkler Birligi", "MTB", "wählergemeinschaft", None),
    ("Tükische Repräsentanz", "TR", "wählergemeinschaft", None),
    ("Fraktion TR/DAL", "TR/DAL", "fraktion", None),
    ("Bündinis für Innovations und Gerechtigkeit", "BIG-DERGAH", "fraktioin", None),
    ("AG-Handicap", "AG-Handicap", "wählergemeinschaft", None),
    ("AG-Handicap / VKM-Duisburg e.V.", "AG-Handicap", "wählergemeinschaft", None),
    ("Bürgerlich-Liberale", "BL", "wählergemeinschaft", None),
    ("Tierschutz", "Tierschutz", "partei", "https://tierschutz-hier.de"),
)


def aliases(spark):
    """(alias, canon): every spelling, and every name as one of itself."""
    rows = [(a, canon) for canon, own, _ in NAMES for a in (*own, canon)]
    return spark.createDataFrame(list(dict.fromkeys(rows)), "alias string, canon string")


def tags(spark):
    """(canon, tag)."""
    return spark.createDataFrame([(canon, tag) for canon, _, tag in NAMES], "canon string, tag string")


def attributes(spark):
    """(canon, handle, typ, url)."""
    return spark.createDataFrame(list(ATTRIBUTES), "canon string, handle string, typ string, url string")


#: Groups of committees, and the committees of each.
COMMITTEES = (
    ("Hauptorgane & Aufsichtsgremien", ("Rat der Stadt", "Haupt- und Finanzausschuss", "Rechnungsprüfungsausschuss")),
    (
        "Verwaltung & Soziales",
        (
            "Ausschuss für Ordnungs- und Bürgerangelegenheiten", "Ausschuss für Arbeit, Soziales und Gesundheit", "Gleichstellungsausschuss", "Integrationsrat",
            "Beirat für Menschen mit Behinderungen", "Seniorenbeirat",
        ),
    ),
    ("Digitalisierung, Stadtentwicklung & Umwelt", ("Digitalisierungsausschuss", "Ausschuss für Stadtentwicklung und Verkehr", "Ausschuss für Umwelt, Klima und Naturschutz")),
    ("Kultur & Jugend", ("Kulturausschuss", "Jugendhilfeausschuss")),
    ("Steuerung & Organisation", ("Vergabeausschuss", "Wahlausschuss", "Wahlprüfungsausschuss")),
    (
        "Betriebsausschüsse",
        ("Betriebsausschuss DuisburgSport", "Betriebsausschuss für das Immobilien-Management Duisburg", "Betriebsausschuss für städtische Immobilien"),
    ),
    (
        "Bezirksvertretungen",
        (
            "Bezirksvertretung Mitte", "Bezirksvertretung Rheinhausen", "Bezirksvertretung Meiderich/Beeck", "Bezirksvertretung Süd", "Bezirksvertretung Hamborn",
            "Bezirksvertretung Homberg/Ruhrort/Baerl", "Bezirksvertretung Walsum",
        ),
    ),
)


def committees(spark):
    """(grp, committee): every committee with its group."""
    return spark.createDataFrame([(group, name) for group, names in COMMITTEES for name in names], "grp string, committee string")
