"""Queries on the council's records: pages made of whole tables go through the parsers, and tables through the writers and readers.

The SQL states what the tables held before they became pages.
"""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..api import Engine
from ..functions import registered
from ..functions import text as X
from ..operators import minutes, models, party_tables, proposals
from ..sources import fetching, html_tables, pages, readers, sinks
from ..sources.store import new_folder
from ..streaming import streams
from .relations import _items
from .search import table

_BASE = "https://rat.example/bi/si0057.asp"


def _fill(template: str, **columns):
    """A text with columns in its braces."""
    out, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        out += [F.lit(before), columns[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def _in_order(rows, key: str, order, html):
    """(key, html): the rows' pieces of a page, in their order."""
    listed = F.sort_array(F.collect_list(F.struct((F.col(order) if isinstance(order, str) else order).alias("o"), html.alias("h"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["h"]), "").alias("html"))


def agenda_items(spark, sf):
    """Orders as meetings, line items as agenda items; every third one comes under a new heading, every fourth isn't public."""
    lines = table(spark, sf, "lineitem")
    c = {x: F.col(x) for x in lines.columns}
    heading = _fill('<tr><td class="tofnum"></td><td><div class="smc-card-header-title-simple"> Teil <b>{f}</b></div></td></tr>', f=c["l_returnflag"])
    item = _fill(
        '<tr><td class="tofnum"><span class="badge x">{k} {n}</span><td><div class="a smc-card-header-title-simple">{m} &amp; {i}</div><p class="smc_field_smcdv0_box2_beschluss margin-bottom-0">{s} </p>{v}'
        "<td data-label=Vorlage><a class='smc_datatype_vo' href='vo0050.asp?__kvonr={p}'>VO/{p}</a><td><div class=\"smc-doc-content\"><a href=\"getfile.asp?id={u}&amp;type=do\" title=\"Datei {u}\"></a></div>"
        '<div class="smc-doc-content"><span class="smc-text-block-991"><a href="/bi/getfile.asp?id={u}">doppelt</a></span></div><div class="smc-doc-content"><a href="x.asp">nein</a></div></td></tr>',
        k=F.when(c["l_linenumber"] % 4 == 0, "N").otherwise("Ö"), n=c["l_linenumber"], m=F.date_format("l_shipdate", "yyyy-MM-dd"), i=c["l_returnflag"], s=c["l_linestatus"], p=c["l_partkey"], u=c["l_suppkey"],
        v=F.when(c["l_linenumber"] % 2 == 0, _fill('<p class="smc_field_smcdv0_box2_abstimmung">einig</p><p class="smc_field_smcdv0_box2_abstimmung">{q} Stimmen</p>', q=c["l_linenumber"])).otherwise(""),
    )
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = _in_order(lines, "l_orderkey", order, F.concat(F.when(c["l_linenumber"] % 3 == 1, heading).otherwise(""), item))
    made = rows.select(F.col("l_orderkey").alias("meeting_id"), F.lit(_BASE).alias("url"), F.concat(F.lit('<html><body><table id="smc_page_si0057_contenttable2">'), "html", F.lit("</table><table><tr><td>fremd</table>")).alias("html"))
    found = pages.agenda(made)
    file = F.get("files", F.lit(0))
    return found.select("top_id", "top_name", "type", "vorlage_id", "vorlage_url", F.col("beschluss.beratungsergebnis_1").alias("ergebnis"), F.col("beschluss.stimmenverteilung").alias("stimmen"), F.size("files").cast("long").alias("n_files"), file["url"].alias("file"), file["label"].alias("label"), file["id"].alias("file_id"))


def proposal_pages(spark, sf):
    """Parts as proposals; every fiftieth page names another id, every seventh has no subject but a headline."""
    parts = table(spark, sf, "part")
    c = {x: F.col(x) for x in parts.columns}
    html = _fill(
        '<h1 class="smc_h1">Kopf {k}</h1><div class="smc-table smc_page_vo0050_contenttable">{s}<div class="smc-table-cell voname"> {n} </div><div class="smc-table-cell vovaname">{t}</div>{a}</div>'
        '<div class="smc-el-h smc_datatype_do"><a href="../getfile.asp?id={k}" title="Dokument Download Dateityp: pdf">{m}</a></div><a aria-label="Beratungen" href="vo0053.asp?__kvonr={k}">mehr</a>',
        k=c["p_partkey"], n=F.when(c["p_partkey"] % 50 == 0, "anders").otherwise(c["p_partkey"].cast("string")), t=c["p_type"], m=c["p_brand"],
        s=F.when(c["p_partkey"] % 7 == 0, "").otherwise(_fill('<div class="smc-table-cell vobetr">{x}</div>', x=c["p_name"])), a=F.when(c["p_partkey"] % 3 == 0, _fill('<div class="smc-table-cell voakz">AZ {x}</div>', x=c["p_size"])).otherwise(""),
    )
    good, bad = pages.proposal_details(parts.select(c["p_partkey"].cast("string").alias("vorlage_id"), F.lit(_BASE).alias("url"), html.alias("html")))
    doc = F.get("docs", F.lit(0))
    columns = ["vorlage_id", "typ", "betreff", "aktenzeichen", "url", doc["title"].alias("doc"), doc["dtype"].alias("dtype"), doc["url"].alias("doc_url")]
    return good.select(*columns, F.lit(True).alias("ok")).unionByName(bad.select(*columns, F.lit(False).alias("ok")))


def consultation_pages(spark, sf):
    """Customers as proposals, their orders as consultations; some have no TOP, some no hyphen, some no result."""
    orders = table(spark, sf, "orders")
    c = {x: F.col(x) for x in orders.columns}
    card = _fill(
        '<div class="card card-light"><button class="btn btn-link btn-block text-left"> {d} Ausschuss {p} {t}{i}<span>x</span></button>{r}<p class="smc_field_totexta"><b>Stimmen:</b> {k} ja</p><div class="smc_datatype_do"><a href="getfile.asp?id={k}">Anlage {k}</a></div></div>',
        d=F.date_format("o_orderdate", "dd.MM.yyyy"), p=F.replace("o_orderpriority", F.lit("-"), F.lit(" ")), t=F.when(c["o_orderkey"] % 5 == 0, "").otherwise(_fill("TOP {k}", k=c["o_orderkey"] % 9)), i=F.when(c["o_orderkey"] % 3 == 0, "").otherwise(" - Entscheidung"),
        r=F.when(c["o_orderkey"] % 4 == 0, "").otherwise(_fill('<p class="smc_field_btname"><b>Ergebnis:</b> Status {s} </p>', s=c["o_orderstatus"])), k=c["o_orderkey"],
    )
    rows = _in_order(orders, "o_custkey", "o_orderkey", card)
    found = pages.consultations(rows.select(F.col("o_custkey").cast("string").alias("vorlage_id"), F.lit(_BASE).alias("url"), F.concat(F.lit('<div id="smcaccordion">'), "html", F.lit("</div>")).alias("html")))
    return found.select("vorlage_id", F.col("row").cast("long").alias("row"), F.date_format("datum", "yyyy-MM-dd").alias("datum"), "intent", "gremium", "ergebnis", "stimmen", F.get("dateien", F.lit(0))["href"].alias("datei"))


def committee_groups(spark, sf):
    """Nations' numbers as committees of the council's groups, and the orders of each."""
    names = party_tables.committees(spark)
    numbered = names.withColumn("n", F.row_number().over(W.orderBy("committee")) - 1)
    owned = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return owned.join(F.broadcast(numbered), F.col("c_nationkey") == F.col("n")).groupBy("grp", "committee").agg(F.count("*").alias("n_orders"))


def _people_pages(spark, sf):
    people = table(spark, sf, "customer")
    row = _fill("<tr><td><a href='pe0051.asp?__kpenr={k}&amp;x=1'>{n}</a></td><td> {s} </td><td>{r}</td></tr>", k=F.col("c_custkey"), s=F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_mktsegment")), r=F.lit("Mitglied"), n=F.when(F.col("c_custkey") % 10 == 0, "N.N.").otherwise(_fill("Frau Dr. {a}, {b}", a=F.col("c_name"), b=F.col("c_nationkey"))))
    return html_tables.table_rows(_in_order(people, "c_nationkey", "c_custkey", row).select(F.col("c_nationkey").alias("page_id"), F.concat(F.lit("<table>"), "html", F.lit("<tr><td>allein</table>")).alias("html")))


def attendance_rows(spark, sf):
    """Customers as those present, a page for each nation."""
    return html_tables.attendance(_people_pages(spark, sf)).select("page_id", "name", "id", "party", "role")


def person_rows(spark, sf):
    """Customers as members, without those that nobody is."""
    return html_tables.people(_people_pages(spark, sf)).select("page_id", "person_id", "anrede", "nachname", "vorname", "partei")


def multi_value_labels(spark, sf):
    """Regions with their nations as one label's values; the link of "Internet" in place of its text."""
    nations = table(spark, sf, "nation")
    row = _fill("<tr><td>Land:</td><td>{n}</td></tr><tr><td>Internet:</td><td><a href='https://{k}.example'>Seite</a></td></tr>", n=F.col("n_name"), k=F.col("n_nationkey"))
    rows = html_tables.table_rows(_in_order(nations, "n_regionkey", "n_nationkey", row).select(F.col("n_regionkey").alias("page_id"), F.concat(F.lit("<table>"), "html", F.lit("</table>")).alias("html")))
    return html_tables.multi_labels(rows).select("page_id", *[F.array_join(F.try_element_at("data", F.lit(x)), ",").alias(x.lower()) for x in ("Land", "Internet")])


def protocol_choice(spark, sf):
    """Orders as meetings with several links, of which one is the protocol."""
    key = F.col("o_orderkey")
    html = _fill("<a href='a{k}'>Einladung</a><a href=\"b{k}\">Niederschrift {p}</a><a href=c{k}>Ergebnisprotokoll zur Niederschrift</a>{x}<a href='d{k}.PDF' title=\"Plan\"><img></a><a href='e.pdf'>e</a>", k=key, p=F.col("o_orderpriority"), x=F.when(key % 3 == 0, _fill("<a href='z{k}'>NIEDERSCHRIFT neu</a>", k=key)).when(key % 3 == 1, "<a href='y'>Niederschrift (abgesagt)</a>").otherwise(""))
    found = html_tables.links(table(spark, sf, "orders").select(key.alias("page_id"), F.lit(_BASE).alias("url"), html.alias("html")))
    plan = found.filter("label = 'Plan'").select("page_id", "label")
    return html_tables.chosen_protocol(found).join(pages.first_pdf(found), "page_id").join(plan, "page_id")


def discovered_meetings(spark, sf):
    """Nations as committees, years of orders, and their orders as meetings that a page lists by its second link."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    address = lambda c, y: F.concat(F.lit("https://rat.example/bi/si0046.asp?gr="), c.cast("string"), F.lit("&jahr="), y.cast("string"))
    listed = orders.select(F.concat_ws("-", "c_nationkey", F.year("o_orderdate")).alias("page"), "o_orderkey", address(F.col("c_nationkey"), F.year("o_orderdate")).alias("url"))
    row = _fill("<tr><td><a href='i.ics'>Termin</a></td><td><a href=\"si0057.asp?__ksinr={k}\">Sitzung</a></td></tr>", k=F.col("o_orderkey"))
    made = _in_order(listed, "url", "o_orderkey", row).select("url", F.concat(F.lit("<table><tr><th>Kopf</th></tr>"), "html", F.lit("<tr><td><a href='a'>a</a><a href='b'>b</a></table>")).alias("html"))
    years = spark.createDataFrame([(y,) for y in range(1992, 1999)], "year int")
    found = pages.discover(table(spark, sf, "nation").select(F.col("n_nationkey").alias("committee")), years, made, address(F.col("committee"), F.col("year")))
    return found.select("committee", F.col("year").cast("long").alias("year"), X.query_parameter(F.col("url"), "__ksinr").alias("meeting"))


def protocol_items(spark, sf):
    """Conversations as minutes: turns are pages, the user's open an item under two rules, the others continue it; page 0 has the date."""
    turns = table(spark, sf, "conversations")
    opens = (F.col("role") == "user") & (F.col("turn") > 0)
    line = lambda texts, y: [F.struct(x.cast("string").alias("text"), F.lit(float(y)).alias("top"), F.lit(float(y + 2)).alias("bottom")) for x in texts]
    header = F.array(*line([F.lit("Tagesordnungspunkt"), F.col("turn"), F.lit("Nr."), F.concat_ws("-", "conv_id", "turn")], 10), *line([F.lit("Thema"), F.lit("zwei")], 30), *line([F.lit("Frau"), F.lit("Muster")], 40))
    body = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text"), F.lit(100.0).alias("top"), F.lit(102.0).alias("bottom")))
    first = F.array(*line([F.lit("Am"), F.lit("01.02.2024")], 10))
    every = F.when(F.col("turn") == 0, first).when(opens, F.concat(header, body)).otherwise(body)
    words = turns.select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page"), F.posexplode(every).alias("ord", "w")).select("doc", "page", "ord", "w.*")
    rules = turns.filter(opens).select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page"), F.explode(F.array(F.lit(60), F.lit(5), F.lit(300))).alias("y"))
    return minutes.protocol_items(words, rules).select("doc", "date", *[F.coalesce(F.col(c).cast("long"), F.lit(-1)).alias(c) for c in ("page_start", "end_page", "len_content1")], "top_nr", "drucksache_nr", "person_resp", "topic", "content1")


def item_payload(spark, sf):
    """Line items with their orders as meetings; orders of one status are missing."""
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    text = lambda c: F.col(c).cast("string")
    none = F.lit(None).cast("string")
    items = lines.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("name"), F.concat_ws("/", "l_orderkey", "l_linenumber").alias("top_id"), text("l_orderkey").alias("meeting_id"), text("l_partkey").alias("vorlage_id"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("A"), F.col("l_linestatus"))).otherwise(F.array().cast("array<string>")).alias("antrag_party"), F.struct(F.col("l_linestatus").alias("beratungsergebnis_1"), none.alias("stimmenverteilung")).alias("beschluss"))
    meetings = orders.select(text("o_orderkey").alias("Sitzung"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("Gremium"), F.lit("Alle").alias("Gremien"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("Datum"), F.lit("Saal").alias("location"), F.lit("u").alias("source_url"))
    return proposals.item_payload(items, meetings).select("name", "top_id", "meeting_id", "vorlage_id", "typ", "partei", "beratungsergebnis", "gremium", "datum", "ort")


def item_records(spark, sf):
    lines = table(spark, sf, "lineitem")
    none = F.lit(None)
    items = lines.select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("top_id"), F.col("l_orderkey").alias("meeting_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("top_name"), F.col("l_returnflag").alias("type"), F.when(F.col("l_linenumber") == 1, F.array("l_linestatus")).alias("antrag"), none.cast("string").alias("aktenzeichen"), none.cast("string").alias("vorlage_id"), none.cast("string").alias("vorlage_url"), none.cast("string").alias("beschluss"), none.cast("array<string>").alias("files"))
    return proposals.item_record(items).select("top_id", "meeting_id", "name", "public", "type", F.array_join("antrag_party", ",").alias("party"), F.size("files").cast("long").alias("n_files"))


def explored_items(spark, sf):
    """Orders of two years with three items or more of suppliers whose name holds a text."""
    items = _items(spark, sf).withColumn("meeting", F.concat(F.lit("Rat "), F.col("meeting")))
    return Engine.explore(items, 3, "1995-01-01", "1996-12-31", "RAT 1").select("referenzvorlage", "num_tops", "num_meetings")


def value_counts(spark, sf):
    return table(spark, sf, "customer").filter(F.col("c_mktsegment").isNotNull() & (F.col("c_mktsegment") != "")).groupBy("c_mktsegment").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_mktsegment").limit(20)


def iso_times(spark, sf):
    """Days, and times with and without an offset."""
    at = F.col("ts")
    day, plain, zone = F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    return table(spark, sf, "events").select("event_id", X.iso_epoch(day).alias("of_day"), X.iso_epoch(plain).alias("of_time"), X.iso_epoch(zone).alias("of_zone"), X.iso_epoch(F.lit("kein Datum")).isNull().alias("bad"))


_upserted: dict[tuple, str] = {}


def _batches(spark, sf):
    """Where events lie that were put over each other by user in three batches."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _upserted:
        path, rows = new_folder(spark, "upsert"), table(spark, sf, "events").select("user_id", "event_id", "event_type")
        sinks.create(path, rows)
        for part in range(3):
            sinks.upsert(rows.filter(F.col("event_id") % 3 == part), path, ["user_id"], "event_id")
        _upserted[key] = path
    return _upserted[key]


def upsert_in_batches(spark, sf):
    """The events after all batches."""
    return sinks.read(spark, _batches(spark, sf))


def upsert_past_version(spark, sf):
    """The events after the first two batches: an earlier version of the same table."""
    return sinks.read(spark, _batches(spark, sf), version=3)


def upsert_compacted(spark, sf):
    """The events after the deltas of another table have been merged, with a batch on top."""
    path, rows = new_folder(spark, "upsert"), table(spark, sf, "events").select("user_id", "event_id", "event_type")
    for part in range(2):
        sinks.upsert(rows.filter(F.col("event_id") % 3 == part), path, ["user_id"], "event_id")
    sinks.compact(spark, path)
    sinks.upsert(rows.filter("event_id % 3 = 2"), path, ["user_id"], "event_id")
    return sinks.read(spark, path)


def vectors_upserted(spark, sf):
    """Vectors with a payload written twice, the second time one label of them with another number."""
    path, rows = new_folder(spark, "points"), table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    sinks.upsert_vectors(rows.withColumn("written", F.lit(1)), path)
    sinks.upsert_vectors(rows.filter("label = 1").withColumns({"written": F.lit(2), "label": F.lit(-1)}), path)
    return sinks.read(spark, path).select("id", F.col("label").cast("long").alias("label"), F.size("embedding").cast("long").alias("n"))


def attachments_saved(spark, sf):
    """Files of parts, saved twice; places that are taken stay as they are."""
    key = F.col("p_partkey")
    at = F.lit(datetime.datetime(2024, 3, 5)).cast("timestamp")
    url = F.concat(F.lit("https://rat.example/bi/"), F.when(key % 2 == 0, F.concat(F.lit("getfile.asp?id="), key.cast("string"), F.lit("&type=do"))).otherwise(F.concat(F.lit("f"), key.cast("string"), F.lit(".docx"))))
    files = table(spark, sf, "part").select(url.alias("url"), F.concat(F.lit("Plan: "), "p_name").alias("label"), F.lit("application/pdf").alias("content_type"), at.alias("saved_at"), F.lit(1).alias("turn"))
    files = files.withColumn("content_type", F.when(F.col("url").contains("getfile"), F.col("content_type")))
    path = new_folder(spark, "attachments")
    first = sinks.save_attachments(files.filter("url LIKE '%5%'"), path)
    second = sinks.save_attachments(files.withColumn("turn", F.lit(2)), path)
    return first.unionByName(second).select("path", "id", "type", F.col("turn").cast("long").alias("turn"))


def llm_log(spark, sf):
    """Every turn of a user as a run of a stand-in model, logged by version and model and read back."""

    def complete(messages):
        said = messages[1]["content"]
        return {"output_text": '{"n": %d}' % len(said) if len(said) % 2 else "kein JSON", "input_tokens": len(said.split())}

    turns = table(spark, sf, "conversations").filter("role = 'user'")
    items = turns.select(F.lit("2024-01-01").alias("meeting_date"), F.concat_ws("-", "conv_id", "turn").alias("top_id"), F.col("text").alias("user_input"))
    path = new_folder(spark, "runs")
    sinks.llm_log(models.run_llm(items, complete, "Fasse zusammen.", "stub", "v1"), path)
    rows = spark.read.parquet(path)
    timed = (F.col("latency_ms") >= 0) & F.col("run_id").rlike("^[0-9a-f-]{36}$") & F.col("created_at").rlike("Z$")
    return rows.select("run_key", "input_hash", "output_json", "error", "input_tokens", "model", "prompt_version", timed.alias("logged"))


def _parts(spark, sf, body):
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").cast("long").alias("ord"), body.alias("line"))


def ndjson_stream(spark, sf):
    """Turns as parts of a chat or a completion, with lines between that aren't JSON, up to the part that says done."""
    part = F.when(F.col("conv_id") % 2 == 0, F.to_json(F.struct(F.struct(F.col("text").alias("content")).alias("message")))).otherwise(F.to_json(F.struct(F.col("text").alias("response"), (F.col("turn") == 2).alias("done"))))
    lines = _parts(spark, sf, part)
    return streams.ndjson_text(lines.unionByName(lines.select("stream", "ord", F.lit("{kaputt").alias("line"))))


def delta_events(spark, sf):
    found = streams.delta_events(_parts(spark, sf, F.to_json(F.struct(F.col("text").alias("response")))))
    return found.select("stream", "ord", "type", F.coalesce("delta", "response").alias("text"))


def json_lines(spark, sf):
    return streams.to_lines(table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"))


def pages_to_fetch(spark, sf):
    """Pages that a cache of 31 days doesn't have."""
    rows = table(spark, sf, "pages").select("page_id", "url")
    cached = rows.filter("page_id % 3 <> 0").select("page_id", F.expr("current_timestamp() - make_interval(0, 0, 0, CASE page_id % 3 WHEN 1 THEN 5 ELSE 40 END)").alias("fetched_at"))
    return streams.fresh(rows, cached, ["page_id"], 31).select("page_id")


def fetched_pages(spark, sf):
    """Pages fetched through a cache in two runs from a recording that has some missing and some with an error: the second run asks again for these only. Of an address's pages the first counts."""
    pages = table(spark, sf, "pages")
    status = F.when(F.col("page_id") % 5 == 0, 404).otherwise(200)
    said = pages.filter("page_id % 7 <> 0").select("page_id", "url", status.alias("status"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("body"))
    urls, cache = pages.select("url"), new_folder(spark, "cache")
    fetching.fetch_cached(urls.join(pages.filter("page_id % 2 = 0").select("url"), "url", "left_semi"), cache, 31, fetching.recorded(said, "page_id"))
    found = fetching.fetch_cached(urls, cache, 31, fetching.recorded(said, "page_id"))
    return found.select("url", F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("error", F.lit("")).alias("error"), "from_cache", F.coalesce(F.length("text"), F.lit(-1)).cast("long").alias("n_chars"))


def registered_functions(spark, sf):
    """The text functions from SQL."""
    registered.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("forum_documents")
    return spark.sql("SELECT doc_id, forum_snippet(text) snippet, forum_short_sha1(text) short, forum_collapse(text) clean FROM forum_documents")


def entity_files(spark, sf):
    """Nations as JSON files, one object in each, read with a schema."""
    path = new_folder(spark, "entities")
    table(spark, sf, "nation").select("n_nationkey", "n_name", F.struct("n_regionkey").alias("of")).write.option("maxRecordsPerFile", 1).json(path)
    return readers.entities(spark, path, "n_nationkey int, n_name string, of struct<n_regionkey int>, other string").select("n_nationkey", "n_name", F.col("of.n_regionkey").alias("region"), F.coalesce("other", F.lit("-")).alias("other"))


def manifest_lines(spark, sf):
    """Suppliers as lines with single quotes, read as a manifest."""
    path = new_folder(spark, "manifest")
    key = F.col("s_suppkey").cast("string")
    line = F.concat(F.lit("{'file': 's"), key, F.lit(".pdf', 'url': 'https://x/"), key, F.lit("', 'retrieval_date': '2024-01-01'}"))
    table(spark, sf, "supplier").select(line.alias("value")).write.text(path)
    return readers.manifest(spark, path).select("file", "url", "retrieval_date")


def hidden_emails(spark, sf):
    """Customers with addresses that style sheets take apart; every third is plain."""
    key = F.col("c_custkey")
    own = key.cast("string")
    html = F.concat(F.lit("<style>span.a"), own, F.lit('::before { content: "'), F.reverse(F.concat(F.lit("@"), F.lower("c_mktsegment"), F.lit(".de"))), F.lit('" } span.a'), own, F.lit('::AFTER{content:"post'), own, F.lit('"}</style><p>'))
    cell = F.when(key % 3 == 0, _fill("<b>post{k}</b> (at) haus", k=key)).otherwise(_fill("<span class='x a{k}'>.amt</span>", k=key))
    return table(spark, sf, "customer").select("c_custkey", X.hidden_email(html, cell).alias("email"))


def hashed_vectors(spark, sf):
    """Encoded documents are of unit length."""
    vector = models.hashed_encoder(F.col("text"))
    found = table(spark, sf, "documents").select("doc_id", vector.alias("v"))
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return found.select("doc_id", F.size("v").cast("long").alias("n"), F.round(length, 3).alias("length"))


_ROOT = "'https://rat.example/bi/'"
_PATH = "'2024/03/' || id || '_' || regexp_replace(regexp_replace('Plan: ' || p_name, '[\\\\/:*?\"<>|]+', '-', 'g'), '\\s+', ' ', 'g') || CASE WHEN p_partkey % 2 = 0 THEN '.pdf' ELSE '.docx' END"

_GROUPS = ", ".join(f"('{g}', '{c}')" for g, names in party_tables.COMMITTEES for c in names)

SQL = {
    "committee_groups": f"WITH g AS (SELECT *, row_number() OVER (ORDER BY committee) - 1 n FROM (VALUES {_GROUPS}) v(grp, committee)) SELECT grp, committee, count(*) n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN g ON c_nationkey = n GROUP BY ALL",
    "agenda_items": f"WITH i AS (SELECT *, last_value(CASE WHEN l_linenumber % 3 = 1 THEN 'Teil ' || l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) t FROM lineitem) SELECT l_orderkey || ':Ö:' || l_linenumber top_id, strftime(l_shipdate, '%Y-%m-%d') || ' & ' || l_returnflag top_name, t AS type, 'VO/' || l_partkey vorlage_id, {_ROOT} || 'vo0050.asp?__kvonr=' || l_partkey vorlage_url, l_linestatus ergebnis, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber || ' Stimmen' END stimmen, 1::BIGINT n_files, {_ROOT} || 'getfile.asp?id=' || l_suppkey || '&type=do' file, 'Datei ' || l_suppkey AS label, l_suppkey::VARCHAR file_id FROM i WHERE l_linenumber % 4 <> 0",
    "proposal_pages": f"SELECT p_partkey::VARCHAR vorlage_id, p_type typ, CASE WHEN p_partkey % 7 = 0 THEN 'Kopf ' || p_partkey ELSE p_name END betreff, CASE WHEN p_partkey % 3 = 0 THEN 'AZ ' || p_size END aktenzeichen, {_ROOT} || 'vo0053.asp?__kvonr=' || p_partkey url, p_brand doc, 'pdf' dtype, 'https://rat.example/getfile.asp?id=' || p_partkey doc_url, p_partkey % 50 <> 0 ok FROM part",
    "consultation_pages": f"SELECT o_custkey::VARCHAR vorlage_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row, strftime(o_orderdate, '%Y-%m-%d') datum, CASE WHEN o_orderkey % 3 = 0 THEN trim(strftime(o_orderdate, '%d.%m.%Y') || ' Ausschuss ' || replace(o_orderpriority, '-', ' ') || ' ' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'TOP ' || o_orderkey % 9 END) ELSE 'Entscheidung' END intent, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Ausschuss ' || replace(o_orderpriority, '-', ' ') END gremium, CASE WHEN o_orderkey % 4 <> 0 THEN 'Status ' || o_orderstatus END ergebnis, o_orderkey || 'ja' stimmen, {_ROOT} || 'getfile.asp?id=' || o_orderkey datei FROM orders",
    "attendance_rows": "SELECT c_nationkey page_id, CASE WHEN c_custkey % 10 = 0 THEN 'N.N.' ELSE 'Frau Dr. ' || c_name || ', ' || c_nationkey END AS name, c_custkey::VARCHAR id, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END party, 'Mitglied' AS role FROM customer",
    "person_rows": "SELECT c_nationkey page_id, c_custkey::VARCHAR person_id, 'Frau' anrede, 'Dr. ' || c_name nachname, c_nationkey::VARCHAR vorname, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END partei FROM customer WHERE c_custkey % 10 <> 0",
    "multi_value_labels": "SELECT n_regionkey page_id, string_agg(n_name, ',' ORDER BY n_nationkey) land, string_agg('https://' || n_nationkey || '.example', ',' ORDER BY n_nationkey) internet FROM nation GROUP BY 1",
    "protocol_choice": f"SELECT o_orderkey page_id, CASE WHEN o_orderkey % 3 = 0 THEN 'z' ELSE 'b' END || o_orderkey href, {_ROOT} || 'd' || o_orderkey || '.PDF' url, 'Plan' AS label FROM orders",
    "discovered_meetings": "SELECT c_nationkey committee, year(o_orderdate) AS year, o_orderkey::VARCHAR meeting FROM orders JOIN customer ON o_custkey = c_custkey WHERE year(o_orderdate) BETWEEN 1992 AND 1998",
    "protocol_items": "WITH t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) i, max(turn) OVER (PARTITION BY conv_id) z FROM conversations WHERE turn > 0), g AS (SELECT conv_id, min(turn) f, list(text ORDER BY turn) x, count(*) n, max(turn) e FROM t WHERE i > 0 GROUP BY conv_id, i), d AS (SELECT DISTINCT conv_id FROM conversations WHERE turn = 0) SELECT g.conv_id::VARCHAR doc, CASE WHEN d.conv_id IS NOT NULL THEN '01.02.2024' END date, f page_start, CASE WHEN array_to_string(x[2:], ' ') <> '' THEN e ELSE -1 END end_page, CASE WHEN array_to_string(x[2:], ' ') <> '' THEN length(x[1] || array_to_string(x[2:], ' ')) ELSE -1 END len_content1, f::VARCHAR top_nr, g.conv_id || '-' || f drucksache_nr, 'Frau Muster' person_resp, 'Thema zwei' topic, x[1] || array_to_string(x[2:], ' ') content1 FROM g LEFT JOIN d USING (conv_id)",
    "item_payload": "SELECT strftime(l_shipdate, '%Y-%m-%d') AS name, l_orderkey || '/' || l_linenumber top_id, l_orderkey::VARCHAR meeting_id, l_partkey::VARCHAR vorlage_id, l_returnflag typ, CASE WHEN l_linenumber % 2 = 0 THEN 'A, ' || l_linestatus END partei, l_linestatus beratungsergebnis, CASE WHEN l_orderkey % 2 = 0 THEN o_orderpriority ELSE 'Alle' END gremium, epoch(date_trunc('day', o_orderdate))::BIGINT datum, 'Saal' ort FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'",
    "item_records": "SELECT l_orderkey || '_' || l_linenumber top_id, l_orderkey meeting_id, strftime(l_shipdate, '%Y-%m-%d') AS name, true public, l_returnflag AS type, CASE WHEN l_linenumber = 1 THEN l_linestatus ELSE '' END party, 0::BIGINT n_files FROM lineitem",
    "explored_items": "SELECT l_orderkey::VARCHAR referenzvorlage, count(*) num_tops, count(DISTINCT l_suppkey) num_meetings FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1995-01-01' AND '1996-12-31' AND starts_with(l_suppkey::VARCHAR, '1') GROUP BY 1 HAVING count(*) >= 3",
    "value_counts": "SELECT c_mktsegment, count(*) n FROM customer WHERE c_mktsegment <> '' GROUP BY ALL ORDER BY n DESC, c_mktsegment LIMIT 20",
    "iso_times": "SELECT event_id, epoch(date_trunc('day', ts))::BIGINT of_day, epoch(date_trunc('second', ts))::BIGINT of_time, epoch(date_trunc('second', ts))::BIGINT - 7200 of_zone, true bad FROM events",
    "upsert_past_version": "SELECT user_id, event_id, event_type FROM events WHERE event_id % 3 < 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "upsert_compacted": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "upsert_in_batches": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "vectors_upserted": "SELECT vec_id id, CASE WHEN label = 1 THEN -1 ELSE label END::BIGINT AS label, len(embedding) n FROM embeddings",
    "attachments_saved": f"WITH u AS (SELECT *, {_ROOT} || CASE WHEN p_partkey % 2 = 0 THEN 'getfile.asp?id=' || p_partkey || '&type=do' ELSE 'f' || p_partkey || '.docx' END url FROM part), k AS (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN p_partkey::VARCHAR ELSE substr(sha1(url), 1, 12) END id FROM u) SELECT {_PATH} AS path, id, CASE WHEN p_partkey % 2 = 0 THEN 'do' END AS type, CASE WHEN contains(url, '5') THEN 1 ELSE 2 END::BIGINT turn FROM k",
    "llm_log": "SELECT '2024-01-01_' || conv_id || '-' || turn || '_v1_stub' run_key, sha256(text) input_hash, CASE WHEN length(said) % 2 = 1 THEN '{\"n\": ' || length(said) || '}' END output_json, CASE WHEN length(said) % 2 = 0 THEN 'not JSON' END error, len(list_filter(regexp_split_to_array(said, '\\s+'), lambda w: w <> '')) input_tokens, 'stub' model, 'v1' prompt_version, true logged FROM (SELECT *, 'INPUT (TOP-Text): ' || text said FROM conversations WHERE role = 'user')",
    "ndjson_stream": "SELECT conv_id AS stream, string_agg(text, '' ORDER BY turn) AS text FROM conversations WHERE conv_id % 2 = 0 OR turn <= 2 GROUP BY ALL",
    "delta_events": "SELECT conv_id AS stream, turn::BIGINT ord, 'response.delta' AS type, text FROM conversations UNION ALL SELECT conv_id, max(turn) + 1, 'response.completed', string_agg(text, '' ORDER BY turn) FROM conversations GROUP BY conv_id",
    "json_lines": "SELECT to_json(struct_pack(n_nationkey := n_nationkey, n_name := n_name, n_regionkey := n_regionkey))::VARCHAR AS value FROM nation",
    "pages_to_fetch": "SELECT page_id FROM pages WHERE page_id % 3 <> 1",
    "fetched_pages": "WITH u AS (SELECT url, bool_or(page_id % 2 = 0) early, bool_or(page_id % 7 <> 0) AS known FROM pages GROUP BY url), p AS (SELECT url, (CASE WHEN page_id % 5 = 0 THEN 404 ELSE 200 END)::INTEGER status, length(coalesce(html, '')) n FROM pages WHERE page_id % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id, coalesce(html, '')) = 1) SELECT url, coalesce(status, 0)::INTEGER status, CASE WHEN status IS NULL THEN 'not recorded' WHEN status = 404 THEN 'status 404' ELSE '' END error, early AND coalesce(status = 200, false) from_cache, CASE WHEN status = 200 THEN n ELSE -1 END n_chars FROM u LEFT JOIN p USING (url)",
    "registered_functions": r"SELECT doc_id, CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '…' ELSE text END snippet, substr(sha1(text), 1, 12) short, trim(regexp_replace(text, '[\s\x0B\x85\p{Z}]+', ' ', 'g')) clean FROM documents",
    "entity_files": "SELECT n_nationkey, n_name, n_regionkey region, '-' other FROM nation",
    "manifest_lines": "SELECT 's' || s_suppkey || '.pdf' file, 'https://x/' || s_suppkey url, '2024-01-01' retrieval_date FROM supplier",
    "hidden_emails": "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'post' || c_custkey || ' (at) haus' ELSE 'post' || c_custkey || '.amt@' || lower(c_mktsegment) || '.de' END email FROM customer",
    "hashed_vectors": r"SELECT doc_id, 384::BIGINT n, CASE WHEN len(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length FROM documents",
}

QUERIES = {f.__name__: f for f in (agenda_items, proposal_pages, consultation_pages, committee_groups, attendance_rows, person_rows, multi_value_labels, protocol_choice, discovered_meetings, protocol_items, item_payload, item_records, explored_items, value_counts, iso_times, upsert_in_batches, upsert_past_version, upsert_compacted, vectors_upserted, attachments_saved, llm_log, ndjson_stream, delta_events, json_lines, pages_to_fetch, fetched_pages, registered_functions, entity_files, manifest_lines, hidden_emails, hashed_vectors)}
