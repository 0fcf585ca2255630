import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from forumlake.operators import chunking, fusion, keyword, minutes, models, parties, proposals, sequences, vectors
from forumlake.sources import html_tables, pages, readers, schemas, sinks
from forumlake.streaming import streams


def python_spans(text, window=1200, least=600, overlap=150):
    return list(chunking.spans(len(text), lambda a, b: text.rfind(". ", a, b), window, least, overlap))


def test_character_chunks():
    assert python_spans("x" * 2500) == [(0, 1200), (1050, 2250), (2100, 2500)]
    assert python_spans("x" * 700 + ". " + "x" * 798) == [(0, 700), (550, 1500)]
    assert python_spans("x" * 300 + ". " + "x" * 1198) == [(0, 1200), (1050, 1500)]
    assert python_spans("") == []


@given(st.text(alphabet="ab. ", max_size=4000))
@settings(max_examples=60, deadline=None)
def test_spans_cover(text):
    found = python_spans(text)
    assert not text or (found[0][0] == 0 and found[-1][1] == len(text))
    assert all(b[0] == a[1] - 150 for a, b in zip(found, found[1:]))


def test_sentence_chunks(spark):
    def golden(text, budget=12, carried=2):
        out, cur = [], []
        n = lambda xs: sum(len(x.split()) for x in xs)
        for s in [x for x in re.split(r"(?<=[.!?])\s+", text.strip()) if x]:
            if cur and n(cur) + len(s.split()) > budget:
                out.append(" ".join(cur))
                cur = cur[-carried:]
            cur.append(s)
        return out + ([" ".join(cur)] if cur else [])

    texts = ["One two three. " * 9, "A b c d e f g h i j k l m n o p! Q r? S.", "", "no end"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunking.by_sentences(F.col("text"), 12, 2).alias("c")).collect()
    assert {r.i: r.c for r in rows} == {i: golden(t) for i, t in enumerate(texts)}


def test_min_max_and_rerank_ties(spark):
    hits = spark.createDataFrame([(1, "a", 3.0), (1, "b", 3.0), (2, "a", 1.0), (2, "b", 2.0), (2, "c", 3.0)], "query_id int, doc_id string, score double")
    assert sorted(r.score_norm for r in keyword.min_max(hits).collect()) == [0.0, 0.0, 0.0, 0.5, 1.0]
    tied = spark.createDataFrame([("s", 0.2, "sparse", 1), ("d", 0.2, "dense", 1), ("e", 0.1, "dense", 2)], "id string, score_norm double, qtype string, rank int")
    assert [r.id for r in fusion.rerank(tied, F.lit(1.0)).collect()] == ["e", "s", "d"]


def test_deduplicating_fusion(spark):
    one = lambda ids: spark.createDataFrame([(i, 1.0) for i in ids], "id string, score double")
    found = {r.id: (r.score_v, r.score_b) for r in fusion.deduplicate(one("ab"), one("bc")).collect()}
    assert found == {"a": (1.0, None), "b": (1.0, 1.0), "c": (None, 1.0)}


def test_forward_fill_and_items(spark):
    rows = spark.createDataFrame([(1, i, h) for i, h in enumerate([None, "A", None, None, "B", None])], "k int, i int, h string")
    assert [r.t for r in sequences.fill_forward(rows, "k", "i", F.col("h"), "t").orderBy("i").collect()] == [None, "A", "A", "A", "B", "B"]
    pages = spark.createDataFrame([(1, 1, False, "x"), (1, 2, True, "a"), (1, 3, False, "b"), (1, 4, False, "c"), (1, 5, True, "d")], "k int, p int, s boolean, text string")
    found = [(r.first, r.last, r.body) for r in sequences.items_of_pages(pages, "k", "p", F.col("s")).orderBy("item").collect()]
    assert found == [(2, 4, "ab c"), (5, 5, "d")]


def test_parties(spark):
    aliases = spark.createDataFrame([("TR", "TR"), ("DAL", "DAL"), ("TR/DAL", "TR/DAL"), ("die runden", "Runde")], "alias string, canon string")
    titles = spark.createDataFrame([(1, "Antrag TR/DAL"), (2, "Antrag der Fraktion Die Runden!"), (3, "nichts"), (4, "die rundem")], "id int, title string")
    assert {r.id: r.parties for r in parties.detect(titles, aliases).collect()} == {1: ["DAL", "TR", "TR/DAL"], 2: ["Runde"], 3: [], 4: []}
    assert {r.id for r in parties.fuzzy(titles, aliases, least=85.0).collect()} >= {2, 4}


def test_rollup_and_graph(spark):
    items = [("V1", f"t{i}", "n", "m", "", "V1", "2026-01-01") for i in range(3)] + [("V2", f"t{i}", "n", "m", "", "V2", "2026-01-02") for i in (3, 4)]
    rows = spark.createDataFrame(items, "referenzvorlage string, top_id string, name string, meeting string, vorlage_url string, vorlage string, meeting_date string")
    assert proposals.reference_rollup(rows, 2).count() == 2 and proposals.reference_rollup(rows, 3).count() == 1
    rollup = proposals.reference_rollup(rows, 2)
    assert proposals.graph_nodes(rollup).count() == 7 and proposals.graph_edges(rollup).count() == 5


def test_consultation_and_payload(spark):
    row = spark.createDataFrame([("24.02.2026 Bauausschuss Nord TOP 3 - Beschluss",)], "h string").select(proposals.consultation(F.col("h")).alias("c")).first().c
    assert (str(row.datum), row.intent, row.gremium) == ("2026-02-24", "Beschluss", "Bauausschuss Nord")
    items = spark.createDataFrame([("n", "t", "S/1", "v", "Antrag", [], ("a", "b", "c")), ("n", "u", "S/9", "v", "Antrag", ["X", "Y"], None)], "name string, top_id string, meeting_id string, vorlage_id string, type string, antrag_party array<string>, beschluss struct<beratungsergebnis_1:string,beratungsergebnis_2:string,stimmenverteilung:string>")
    meetings = spark.createDataFrame([("S/1", None, "Rat", "24.02.2026", "Saal", "u")], "Sitzung string, Gremium string, Gremien string, Datum string, location string, source_url string")
    found = proposals.item_payload(items, meetings).collect()
    assert len(found) == 1 and found[0].gremium == "Rat" and found[0].partei is None and found[0].datum == 1771891200


def test_minutes(spark):
    words = [("24.02.2026", 1.0), ("Text", 1.0)]
    rows = [("d", 0, i, w, 0.0, 0.0, y, y) for i, (w, y) in enumerate(words)]
    page = [("Tagesordnungspunkt", 10), ("3.1", 10), ("Nr.", 10), ("55/26", 10), ("Radweg", 20), ("Nord", 20), ("Frau", 30), ("Muster", 30), ("Beschluss", 60), ("gefasst", 60)]
    rows += [("d", 1, i, w, 0.0, 0.0, float(y), float(y)) for i, (w, y) in enumerate(page)]
    words = spark.createDataFrame(rows, schemas.PDF_WORDS)
    rules = spark.createDataFrame([("d", 1, 50), ("d", 1, 5)], schemas.PDF_RULES)
    assert minutes.dates(words).first().date == "24.02.2026"
    head = minutes.item_headers(words, rules).first()
    assert (head.top_nr, head.drucksache_nr, head.topic, head.person_resp) == ("3.1", "55/26", "Radweg Nord", "Frau Muster")
    assert minutes.text_below(words, head and minutes.item_headers(words, rules).select("doc", "page", F.col("rect_y_max").alias("y"))).first().body == "Beschluss gefasst"


def test_html_tables(spark):
    html = "<title> Sitzung\u00a0 1 </title><table><tr><th>Datum:</th><td>1.1.</td></tr><tr><td>a<td>b<td>c</tr><tr><td>Datum:</td><td>2.1.</td></tr></table><a href='x'></a><a href=\"si0057.asp?a\">Niederschrift <b>A</b></a><a href=\"y\"></a><a href=\"y\">z</a>"
    pages = spark.createDataFrame([(1, "http://h/d/p.asp", html), (2, "http://h/", None)], "page_id long, url string, html string")
    assert {r.page_id: r.labels for r in html_tables.label_values(pages).collect()} == {1: {"Datum": "2.1."}, 2: {}}
    assert html_tables.titles(pages).filter("page_id = 1").first().title == "Sitzung 1"
    links = html_tables.links(pages)
    assert [(r.url, r.label) for r in links.orderBy("pos").collect()] == [("http://h/d/x", "Dokument"), ("http://h/d/si0057.asp?a", "Niederschrift A"), ("http://h/d/y", "Dokument"), ("http://h/d/y", "z")]
    assert html_tables.attachments(links).count() == 3
    others = spark.createDataFrame([(1, "http://h/d/p.asp", "<a href=getfile.asp?id=7 title='Plan'><img></a><a class=x aria-label=\"Bild\" href='../getfile.asp?id=7&amp;type=do'> </a><a name='n'>kein</a>")], "page_id long, url string, html string")
    assert [(r.url, r.label, r.id) for r in html_tables.attachments(html_tables.links(others)).collect()] == [("http://h/d/getfile.asp?id=7", "Plan", "7")]
    assert html_tables.chosen_protocol(links).first().href == "si0057.asp?a"


def test_agenda(spark):
    row = '<tr><td class="tofnum"><span class="badge">{}</span><td><div class="smc-card-header-title-simple">{}</div>{}</tr>'
    html = '<table id="smc_page_si0057_contenttable2">' + row.format("", "Anträge", "") + row.format("Ö\u00a03.2", "Radweg <b>Nord</b>", '<p class="smc_field_smcdv0_box2_abstimmung">5\u00a0ja</p><td><a href="vo0050.asp?__kvonr=9">24-0009</a>') + row.format("N 1", "geheim", "") + row.format("Ö 4", "ohne", "") + "</table>"
    pages_ = spark.createDataFrame([("77", "http://h/b/si.asp", html), ("78", None, None)], "meeting_id string, url string, html string")
    found = pages.agenda(pages_).orderBy("row").collect()
    assert [(r.top_id, r.top_name, r.type, r.vorlage_id, r.vorlage_url, r.beschluss.beratungsergebnis_2, r.beschluss.stimmenverteilung) for r in found] == [("77:Ö:3.2", "Radweg Nord", "Anträge", "24-0009", "http://h/b/vo0050.asp?__kvonr=9", "5ja", None), ("77:Ö:4", "ohne", "Anträge", None, None, None, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "two.jsonl").write_text('{\n  "file": "a",\n  "url": "u"\n}\n{\n  "file": "b",\n  "url": "v"\n}\n')
    assert sorted(r.file for r in readers.concatenated(spark, str(tmp_path / "two.jsonl"), schemas.MANIFEST).collect()) == ["a", "b"]
    (tmp_path / "m.jsonl").write_text("{\"file\": \"a\", \"url\": 'x'}\n")
    assert readers.manifest(spark, str(tmp_path / "m.jsonl")).first().url == "x"
    (tmp_path / "top").mkdir()
    (tmp_path / "top" / "1.json").write_text('{\n "top_id": "1", "beschluss": {"beraturngsergebnis_1": "ja"}\n}')
    assert readers.agenda_items(spark, str(tmp_path / "top")).first().beschluss.beratungsergebnis_1 == "ja"
    (tmp_path / "p").mkdir()
    for name in ("2024_1_a.pdf", "1999_1_a.pdf", "x.pdf"):
        (tmp_path / "p" / name).write_text("x")
    assert [r.name for r in readers.files(spark, str(tmp_path / "p"), suffix=".pdf", years=(2002, 2026)).collect()] == ["2024_1_a.pdf"]


def test_sinks_and_streams(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, at int")
    for batch in (rows((1, "a", 1), (2, "b", 1)), rows((1, "z", 2), (2, "old", 0), (3, "c", 1))):
        sinks.upsert(batch, str(tmp_path / "t"), ["k"], "at")
    assert sorted((r.k, r.v) for r in sinks.read(spark, str(tmp_path / "t")).collect()) == [(1, "z"), (2, "b"), (3, "c")]
    sinks.log(rows((1, "a", 1)), str(tmp_path / "log"), ["k"])
    assert spark.read.json(str(tmp_path / "log")).first().v == "a"
    sinks.snapshots(rows((1, "a", 1)).withColumn("fetched_at", F.lit("2024-01-02 10:00:00").cast("timestamp")), str(tmp_path / "raw"))
    assert str(spark.read.parquet(str(tmp_path / "raw")).first().day) == "2024-01-02"
    sinks.append_new(rows((1, "a", 1)), str(tmp_path / "n"), ["k"])
    assert [r.k for r in sinks.append_new(rows((1, "z", 2), (3, "c", 1)), str(tmp_path / "n"), ["k"]).collect()] == [3]
    assert sorted(r.k for r in sinks.read(spark, str(tmp_path / "n")).collect()) == [1, 3]
    rows((5, "e", 1), (1, "q", 1)).write.parquet(str(tmp_path / "in"))
    streams.ingest(spark, str(tmp_path / "in"), "k int, v string, at int", str(tmp_path / "n"), str(tmp_path / "c"), ["k"]).awaitTermination()
    assert sorted(r.k for r in sinks.read(spark, str(tmp_path / "n")).collect()) == [1, 3, 5]


def test_models(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id int, text string")
    found = {r.doc_id: r.v for r in docs.select("doc_id", models.hashed_encoder(F.col("text"), 16).alias("v")).collect()}
    assert abs(sum(x * x for x in found[1]) - 1) < 1e-5 and not any(found[2])
    items = spark.createDataFrame([("d", "1", "hi"), ("d", "2", "x")], "meeting_date string, top_id string, user_input string")
    complete = lambda m: {"output_text": '{"a": 1}' if m[1]["content"].endswith("hi") else "oops", "output_tokens": 3}
    log = {r.run_key: (r.error, r.output_tokens, r.input_tokens, r.params) for r in models.run_llm(items, complete, "sys", "m", "v").collect()}
    assert log == {"d_1_v_m": (None, 3, None, {"temperature": 0.2}), "d_2_v_m": ("not JSON", 3, None, {"temperature": 0.2})}
    assert models.request("m", "x") == ("/api/generate", {"model": "m", "prompt": "x", "stream": False}) and models.request("m", models.chat("s", "u"), True, {"t": 1})[0] == "/api/chat"
    assert vectors.nearest(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>"), spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, query array<double>"), 1).first().vec_id == 1


def test_words_whose_signs_cancel_out(spark):
    near = spark.range(400).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("w")).withColumn("h", F.xxhash64("w")).filter(F.pmod("h", F.lit(16)) == 3)
    pair = f"{near.filter('h > 0').first().w} {near.filter('h < 0').first().w}"
    found = spark.createDataFrame([(pair,)], "text string").select(models.hashed_encoder(F.col("text"), 16).alias("v")).first().v
    assert abs(sum(x * x for x in found) - 1) < 1e-5


def test_engine(spark, tmp_path):
    import pytest

    from forumlake.api import Engine

    chunks = spark.createDataFrame([(1, "Radweg Nord wird gebaut", "a"), (2, "Der Radweg im Norden", "b"), (3, "Haushalt", "a"), (4, None, "a")], "doc_id long, text string, source string")
    points = spark.createDataFrame([(1, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    engine = Engine(spark, chunks, points)
    found = engine.search("radweg nord", [0.0, 1.0]).collect()
    assert found[0].id == 1 and {(r.id, r.qtype) for r in found} == {(1, "sparse"), (2, "sparse"), (1, "dense"), (3, "dense")}
    assert {r.id for r in engine.search("radweg", equal={"source": ["b", "c"]}, ranges={"doc_id": (2, None)}).collect()} == {2}
    assert "Radweg Nord" in engine.rag_prompt("radweg nord").first().prompt and "(Kein Kontext gefunden.)" in engine.rag_prompt("xyz").first().prompt
    with pytest.raises(ValueError):
        engine.search(" ")
    allowed = spark.createDataFrame([(1, ["x"]), (3, ["y"])], "id long, permissions array<string>")
    assert [(r.id, r.score_v is None, r.score_b is None) for r in engine.hybrid("radweg nord", [0.0, 1.0], permissions=allowed, groups=["x"]).collect()] == [(1, False, False)]
    said = engine.respond("haushalt")
    assert said["query"] == "haushalt" and said["items"][0][1]["id"] == 3 and said["took_ms"] >= 0
    items = spark.createDataFrame([("V1", "t1", "n", "Rat Nord", "", "V1", "2026-01-01"), ("V1", "t2", "n", "Rat", "", "V1", "2026-02-01")], "referenzvorlage string, top_id string, name string, meeting string, vorlage_url string, vorlage string, meeting_date string")
    assert engine.explore(items, 2).count() == 1 and engine.explore(items, 1, first="2026-01-15").first().num_tops == 1 and engine.explore(items, meeting="nord").first().num_tops == 1
    assert engine.ingest(items, str(tmp_path / "i"), ["top_id"]).count() == 2


def test_crawled_tables(spark):
    page = '<table><tr><th>x</th></tr><tr><td><a href="k.asp">1</a></td><td><a href="si0057.asp?__ksinr=7">Sitzung</a></td></tr><tr><td><a href="a">b</a></td></tr></table>'
    pages = spark.createDataFrame([(1, "http://h/b/si0046.asp", page)], "page_id long, url string, html string")
    assert [r.url for r in html_tables.meeting_links(pages).collect()] == ["http://h/b/si0057.asp?__ksinr=7"]
    rows = spark.createDataFrame([(1, 0, ["Frau Dr. Muster, Erika", "AB", ""], ["p.asp?__kpenr=12", None, None]), (1, 1, ["n.n.", "", ""], [None, None, None])], "page_id long, row int, cells array<string>, links array<string>")
    found = html_tables.people(rows).collect()
    assert [(r.person_id, r.nachname, r.partei, r.role) for r in found] == [("12", "Dr. Muster", "AB", None)]
    labels = spark.createDataFrame([(1, 0, ["Tel:", "1"], [None, None]), (1, 1, ["Tel:", "2"], [None, None]), (1, 2, ["Internet:", "x"], [None, "http://x"])], "page_id long, row int, cells array<string>, links array<string>")
    assert html_tables.multi_labels(labels).first().data == {"Tel": ["1", "2"], "Internet": ["http://x"]}


def test_approximate_search(spark):
    """Recall of inverted lists against the exact search."""
    from forumlake.plans import search

    sf = "/root/testdata/sf0.1"
    exact = {(r.query_id, r.vec_id) for r in search.knn_per_query(spark, sf).collect()}
    found = {(r.query_id, r.vec_id) for r in search.approximate_knn(spark, sf).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


def test_pdf_words(spark, tmp_path):
    from forumlake.sources import attachments

    (tmp_path / "a.pdf").write_bytes(b"Eins zwei|drei")
    (tmp_path / "b.txt").write_bytes(b"nein")
    read = lambda content: [[(w, 0.0, 1.0, 2.0, 3.0) for w in page.split()] for page in content.decode().split("|")]
    assert [(r.doc, r.page, r.ord, r.text) for r in attachments.pdf_words(spark, str(tmp_path), read).collect()] == [("a.pdf", 0, 0, "Eins"), ("a.pdf", 0, 1, "zwei"), ("a.pdf", 1, 0, "drei")]
    assert attachments.text_of(b"<p>x", "a", None, "text/html; charset=utf-8") == "x" and attachments.text_of(b"%PDF", "a.bin", lambda b: "gelesen", "application/pdf") == "gelesen"


def test_exact_names(spark):
    from forumlake.operators import party_tables

    said = ["Antrag der SPD-Fraktion", "TR / DAL und TR", "Tierschutz/DAL, BÜNDNIS 90/ die Grünen!", "die linke./Die PARTEI (Fraktion)", "spdcdu", "", None]
    texts = spark.createDataFrame(list(enumerate(said)), "id long, title string")
    found = sorted((r.id, r.canon) for r in parties.exact(texts, party_tables.aliases(spark)).collect())
    assert {i for i, _ in found} == {0, 1, 2, 3} and (1, "Fraktion TR/DAL") in found and (2, "Duisburger Alternative Liste") in found


def test_names_of_any_number_and_length(spark):
    """As a look at every name finds them, with ten names and with 9,000, of one word and of nine."""
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3)))
    for n in (10, 9000):
        names = {" ".join(word() for _ in range(rng.choice([1, 2, 3, 9]))) for _ in range(n)} | {"aa bb cc dd ee aa bb cc dd", "ab/cd"}
        titles = [" ".join(rng.choice([word(), word() + "/" + word()]) for _ in range(rng.randint(0, 25))) for _ in range(60)] + ["x aa bb cc dd ee aa bb cc dd y", "q ab/cd", "q ab/cdx"]
        found = parties.exact(spark.createDataFrame(list(enumerate(titles)), "id int, title string"), spark.createDataFrame([(x, x.upper()) for x in names], "alias string, canon string"))
        held = lambda t, x: f" {x} " in (f" {t} " if "/" in x else f" {t} ".replace("/", " / "))
        assert sorted((r.id, r.canon) for r in found.collect()) == sorted((i, x.upper()) for i, t in enumerate(titles) for x in names if held(t, x))
        assert (60, "AA BB CC DD EE AA BB CC DD") in [(r.id, r.canon) for r in found.collect()]


def test_similarity_join_equals_brute_force(spark):
    """Names and n-grams that differ by letters, words, their order and their number; every pair that reaches the ratio is found."""
    import random

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    names = [" ".join(word() for _ in range(rng.randint(1, 9))) for _ in range(150)] + ["a a a a b", "aaaaaaaaaaaaaaaaaaaaaaaa", "x " + "abcdefgh" * 5]

    def changed(text):
        for _ in range(rng.randint(0, 4)):
            words = text.split()
            kind, k = rng.randrange(6), rng.randrange(max(1, len(text)))
            text = [text[:k] + rng.choice("abcdefgh ") + text[k:], text[:k] + text[k + 1 :], " ".join(rng.sample(words, len(words))), text + " " + rng.choice("ab"), " ".join(words[1:]), text + " " + (words or ["a"])[0]][kind]
        return " ".join(text.split())

    grams = sorted({changed(rng.choice(names)) for _ in range(900)} | {word() for _ in range(60)} | {"abcdefgh" * 5} - {""})
    for least in (92.0, 84.0):
        known = sorted((x, x.upper()) for x in names)
        found = parties.similar(spark.createDataFrame([(g,) for g in grams], "gram string"), known, least)
        wanted = []
        for gram in grams:
            best = max((parties.weighted_ratio(gram, form), -k, canon) for k, (form, canon) in enumerate(known))
            if best[0] >= least and max(len(gram), len(best[2])) < 1.5 * min(len(gram), len(best[2])):
                wanted.append((gram, best[2], round(best[0], 6)))
        assert sorted((r.gram, r.canon, round(r.score, 6)) for r in found.collect()) == sorted(wanted) and 100 < len(wanted) < len(grams)


def test_few_pairs_are_compared(spark):
    """Of all pairs of n-grams and 10,000 names next to none get to the ratio."""
    import random

    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(3, 9))) for _ in range(n))
    known = sorted({(x, x) for x in (text(rng.randint(1, 4)) for _ in range(10_000))})
    grams = [text(rng.randint(1, 4)) for _ in range(300)] + [known[5][0] + "x"]
    met = parties.candidates(spark.createDataFrame([(g,) for g in grams], "gram string"), known).count()
    assert met < 0.06 * len(grams) * len(known)  # random letters, the worst case
    found = parties.similar(spark.createDataFrame([(g,) for g in grams], "gram string"), known)
    assert known[5][0] in {r.canon for r in found.collect()}


def test_names():
    from forumlake.operators.parties import ratio, weighted_ratio

    assert ratio("abc", "abc") == 100 and round(ratio("abcd", "abd"), 2) == 85.71 and ratio("", "") == 100
    assert weighted_ratio("die grunen bundnis 90", "bundnis 90 die grunen") == 95 and weighted_ratio("spd", "cdu") < 50 and weighted_ratio("tierschutz", "tierschutz partei duisburg") <= 90


def test_rules_in_images(spark):
    import numpy as np

    gray = np.full((60, 700), 255, dtype=np.uint8)
    gray[10:12, 50:600] = 0  # a rule
    gray[20, 50:400] = 0  # too short
    gray[30:45, 50:600] = 0  # too high
    gray[50, 50:300] = gray[50, 320:640] = 0
    gray[51, 250:420] = 150  # joins both halves
    images = spark.createDataFrame([("d", 0, 700, 60, bytearray(gray.tobytes()))], "doc string, page int, width int, height int, pixels binary")
    assert sorted(r.y for r in minutes.rules_of_images(images).collect()) == [10, 50]


def test_plans_of_search(spark, tmp_path):
    """Texts are fetched without a shuffle of theirs, and a search reads postings only."""
    docs = spark.range(2000).selectExpr("id AS doc_id", "concat('wort', id % 50, ' und mehr') AS text", "'s' AS source")
    keyword.build_index(docs, str(tmp_path / "index"))
    index = keyword.open_index(spark, str(tmp_path / "index"))
    hits = keyword.top(keyword.bm25(index, spark.createDataFrame([(1, "wort7")], "query_id int, query string")), 5)
    assert sorted(r.doc_id for r in hits.collect()) == [7, 57, 107, 157, 207]
    docs.write.parquet(str(tmp_path / "docs"))
    texts = spark.read.parquet(str(tmp_path / "docs")).select(F.col("doc_id").alias("id"), "text", "source")
    found = fusion.with_texts(hits.select(F.col("doc_id").alias("id")), texts)
    assert {r.text for r in found.collect()} == {"wort7 und mehr"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "docs" in plan


def test_attachments(spark, tmp_path):
    import zipfile

    from forumlake.sources import attachments

    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:t>Der erste Satz.</w:t></w:p><w:p><w:t>Das &amp; die.</w:t></w:p>")
    (tmp_path / "b.html").write_text("<style>x</style><p>Hallo")
    (tmp_path / "c.txt").write_bytes(b"plain \xff text")
    (tmp_path / "d.docx").write_bytes(b"broken")
    found = {r.name: r.text for r in attachments.texts(spark, str(tmp_path)).collect()}
    assert found == {"a.docx": "Der erste Satz.\nDas & die.", "b.html": "Hallo", "c.txt": "plain  text", "d.docx": ""}
    cut = attachments.chunks(attachments.texts(spark, str(tmp_path)).filter("name = 'a.docx'"), 3, 0).orderBy("chunk_index").collect()
    assert [(r.text, r.lang) for r in cut] == [("Der erste Satz.", "de"), ("Das & die.", "de")]


def test_history_stream(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(30)] + [(2, 0, "user", "x")], schema).write.parquet(str(tmp_path / "m"))
    stream = streams.history(spark.readStream.schema(schema).parquet(str(tmp_path / "m")), 5)
    stream.writeStream.format("memory").queryName("history").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.conv_id, r.turn) for r in spark.table("history").collect()) == [(1, i) for i in range(25, 30)] + [(2, 0)]


def test_history_state_after_restarts(spark, tmp_path):
    """Turns come in several runs, out of order and twice; the state holds the last of each conversation."""
    schema, state = "conv_id long, turn long, role string, text string", str(tmp_path / "c")
    for batch in ([(1, i, "user", f"t{i}") for i in range(9)], [(1, 3, "user", "t3"), (2, 0, "user", None), (1, 8, "user", "t8")], [(2, 1, "assistant", "b"), (1, 10, "user", "t10")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
        streams.keep_history(spark.readStream.schema(schema).parquet(str(tmp_path / "m")), state, 4).awaitTermination()
    found = sorted((r.conv_id, r.turn, r.role, r.text) for r in streams.kept_history(spark, state).collect())
    assert found == [(1, 6, "user", "t6"), (1, 7, "user", "t7"), (1, 8, "user", "t8"), (1, 10, "user", "t10"), (2, 0, "user", None), (2, 1, "assistant", "b")]


def test_idle_conversations_are_forgotten(spark, tmp_path):
    import time

    schema = "conv_id long, turn long, role string, text string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "m"))
    put((1, 0, "user", "old"), (2, 0, "user", "old"))
    query = streams.keep_history(spark.readStream.schema(schema).parquet(str(tmp_path / "m")), str(tmp_path / "c"), 5, 6.0)
    try:
        time.sleep(20)
        put((1, 1, "user", "new"))
        time.sleep(5)
    finally:
        query.stop()
    assert [(r.conv_id, r.turn) for r in streams.kept_history(spark, str(tmp_path / "c")).filter("turn > 0").collect()] == [(1, 1)]
    assert streams.kept_history(spark, str(tmp_path / "c")).filter("turn = 0").count() == 0


def test_token_stream(spark):
    lines = [(1, 0, 'data: {"choices":[{"delta":{"content":"Ja"}}]}'), (1, 1, "data: oops"), (1, 2, 'data: {"choices":[{"delta":{"content":"!"}}]}'), (1, 3, "data: [DONE]"), (1, 4, 'data: {"choices":[{"delta":{"content":"x"}}]}'), (1, 5, ": ping")]
    rows = spark.createDataFrame(lines, "stream int, ord int, line string")
    assert streams.stream_text(rows).first().text == "Ja!"


def test_pages_at_a_time(spark):
    """Plain and odd pages give the same elements, whichever parser reads them, and rows are handed on before a batch is through."""
    from forumlake.sources import pages

    for source in ("<p>a<p class='b c'>d &amp; e", "<table><tr><td>x<td data-label=y>z</table>", "<a href=\"q?a=1&amp;b=2\" title>t</a>", "<li>1<li>2<ul><li>3</ul>", "a<br>b</p>c"):
        plain, lenient = pages._plain(source), pages._Builder()
        lenient.feed(source)
        lenient.close()
        shape = lambda x: (x.tag, x.attributes, x.classes(), [c if isinstance(c, str) else shape(c) for c in x.children], [y.tag for y in x.walk()])
        assert shape(plain.open[0]) == shape(lenient.open[0])
    assert pages._plain("<a href='x>y'>") is None and pages._plain("1 < 2") is None and pages._plain("<script>a</script>") is None
    sizes = []

    class Batch:
        def __init__(self, frame):
            self.dtypes, self.sparkSession = frame.dtypes, frame.sparkSession

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"page_id": range(4), "url": ["u"] * 4, "html": ["<b>" + "x" * pages.AT_ONCE] * 3 + [None]})
            sizes.extend(x.num_rows for x in run(iter([batch])))

    pages.rows_of(Batch(spark.createDataFrame([], "page_id long, url string, html string")), lambda page: [(1, x.text()) for x in page.find("b")], "n int, t string")
    assert sizes == [1, 1, 1, 0]


class _Recorded:
    """Stands for a table: keeps the function that is handed to mapInArrow."""

    def __init__(self, frame):
        self.frame = frame

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self


def test_chunks_are_handed_on_in_portions():
    import pyarrow as pa
    from unittest import mock

    from forumlake.operators import chunking

    docs = _Recorded(None)
    with mock.patch.object(chunking, "F"), mock.patch.object(chunking, "collapse"):
        chunking.by_characters(docs)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": ["ab. " * 500_000, "", "x"]})
    parts = list(docs.run(iter([batch])))
    assert len(parts) > 2 and max(sum(map(len, p.column("text").to_pylist())) for p in parts) <= chunking.AT_ONCE + 1200
    rows = [r for p in parts for r in p.to_pylist()]
    assert rows[-1] == {"doc_id": 3, "chunk": 0, "char_start": 0, "char_end": 1, "text": "x"} and [r["chunk"] for r in rows[:-1]] == list(range(len(rows) - 1))


def test_graph_without_gathering(spark):
    """Items as rows give the graph of a roll-up, and no list of a proposal's items is made."""
    items = spark.createDataFrame([(f"p{i % 4}", f"t{i % 9}", "n", f"m{i % 3}", None, "v", "2024-01-02") for i in range(14)] + [("alone", "t99", "n", "m", None, "v", None)], "referenzvorlage string, top_id string, name string, meeting string, vorlage_url string, vorlage string, meeting_date string")
    some = proposals.referenced(items, 3)
    for graph in (proposals.graph_nodes, proposals.graph_edges):
        found = graph(some)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, graph(proposals.reference_rollup(items, 3)).collect()))
        assert "collect_list" not in found._jdf.queryExecution().toString()


def test_agenda_walks_a_row_a_few_times(monkeypatch):
    row = (
        '<tr><td class="tofnum"><span class="badge x">Ö 1</span><td><div class="smc-card-header-title-simple">a</div><td data-label="Vorlage"><a class="smc_datatype_vo" href="vo0050.asp?__kvonr=1">VO/1</a>'
        '<td><div class="smc-doc-content"><a href="getfile.asp?id=1" title="Datei"></a></div><div class="smc-doc-content"><span class="smc-text-block"><a href="getfile.asp?id=2">zwei</a></span></div><div class="smc-doc-content"><a href="x.asp">nein</a></div></td></tr>'
    )
    source = '<table id="smc_page_si0057_contenttable2">' + row * 50 + "</table>"
    seen, walk = [], pages.Element.walk
    monkeypatch.setattr(pages.Element, "walk", lambda x: seen.append(x) or walk(x))
    rows = pages._agenda(pages.parse(source))
    assert len(rows) == 50 and rows[49] == (49, "Ö 1", "a", None, None, None, "VO/1", "vo0050.asp?__kvonr=1", [{"href": "getfile.asp?id=1", "label": "Datei"}, {"href": "getfile.asp?id=2", "label": "zwei"}])
    assert len(seen) <= 9 * 50


def test_pages_leave_no_cycles():
    import gc

    gc.collect()
    gc.disable()
    try:
        for source in ("<table><tr><td>a<td><a href=b>c</a></table>", "1 < 2 <script>x</script><p>a<p>b"):
            pages.parse(source).page.clear()
        assert not any(isinstance(x, pages.Element) for x in gc.get_objects())
    finally:
        gc.enable()
