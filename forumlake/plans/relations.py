"""Relational queries: joins, roll-ups, graph tables, windows, incremental writes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import fusion, minutes, parties, proposals, sequences
from ..streaming import streams
from ..sources.store import new_folder
from .search import table


def party_dimension_lookup(spark, sf):
    people = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    aliases = table(spark, sf, "nation").select(F.col("n_nationkey").alias("alias"), F.col("n_regionkey").alias("canon"))
    regions = table(spark, sf, "region").select(F.col("r_regionkey").alias("canon"), "r_name")
    return parties.lookup(people, aliases, regions, "c_nationkey").select("c_custkey", "c_nationkey", "r_name")


def label_value_multimap(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.sort_array(F.collect_list("event_id")).alias("ids"))
    return rows.select("user_id", "event_type", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


def german_date_parse(spark, sf):
    written = F.date_format("o_orderdate", "dd.MM.yyyy")
    rows = table(spark, sf, "orders").select("o_orderkey", X.german_date(written).alias("day"))
    return rows.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), X.epoch_seconds(F.col("day")).alias("epoch"))


def json_payload_extract(spark, sf):
    parsed = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf, "events").select("event_id", parsed.alias("k"))


def terms_agg(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(5000)


def label_variants(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_type").alias("raw")).distinct()
    return names.withColumn("clean", F.regexp_replace("raw", r"^\S+\s+", "")).groupBy("clean").agg(F.count("*").alias("variants"))


def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


def distinct_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


def regex_filter(spark, sf):
    return table(spark, sf, "documents").filter(F.col("text").rlike(r"(?i)(^|[^a-z])(loser|idiot|trash)([^a-z]|$)")).select("doc_id", "lang")


def _items(spark, sf):
    """Orders as proposals, line items as agenda items, suppliers as meetings."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("top_id"), F.col("l_linestatus").alias("name"), F.col("l_suppkey").cast("string").alias("meeting"))
    orders = table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("meeting_date"), F.col("o_orderpriority").alias("vorlage"))
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(F.col("l_orderkey").cast("string").alias("referenzvorlage"), "top_id", "name", "meeting", F.lit(None).cast("string").alias("vorlage_url"), "vorlage", "meeting_date")


def ref_rollup_min_count(spark, sf):
    return proposals.reference_rollup(_items(spark, sf), 3).select("referenzvorlage", "num_tops", "num_meetings", F.array_join(F.transform("tops", lambda t: t["top_id"]), ",").alias("tops"))


def committee_rollup(spark, sf):
    orders, customers, nations = (table(spark, sf, x) for x in ("orders", "customer", "nation"))
    owned = orders.filter((F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1997-01-01")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    return owned.groupBy(F.col("n_name").alias("gremium")).agg(F.count("*").alias("num_tops"), F.count_distinct("c_custkey").alias("num_owners")).filter("num_tops >= 2")


def graph_nodes(spark, sf):
    return proposals.graph_nodes(proposals.referenced(_items(spark, sf), 3))


def graph_edges(spark, sf):
    return proposals.graph_edges(proposals.referenced(_items(spark, sf), 3))


def typed_graph_edges(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return proposals.typed_edges(rows, [("person_party", "c_custkey", "n_name"), ("party_committee", "n_name", "n_regionkey")])


def inner_join_match_rate(spark, sf):
    return proposals.match_rate(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def incremental_left_anti(spark, sf):
    return table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti").select("doc_id", "source")


def first_wins(spark, sf):
    return fusion.first_of(table(spark, sf, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


def section_forward_fill(spark, sf):
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return sequences.fill_forward(table(spark, sf, "events"), "user_id", "event_id", heading, "section").select("event_id", "user_id", F.coalesce("section", F.lit(-1)).alias("section"))


def page_sessionise(spark, sf):
    found = sequences.items_of_pages(table(spark, sf, "conversations"), "conv_id", "turn", F.col("role") == "user")
    return found.select("conv_id", "item", "first", "last", "body")


def history_window_20(spark, sf):
    return sequences.last_rows(table(spark, sf, "conversations"), "conv_id", "turn", 20).select("conv_id", "turn", "role")


def kept_conversations(spark, sf):
    """The last three turns of all conversations, as a stream over them keeps them in its state, which is read back."""
    folder, rows = new_folder(spark, "conversations"), table(spark, sf, "conversations")
    rows.write.parquet(f"{folder}/turns")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/turns")
    streams.keep_history(stream, f"{folder}/state", 3).awaitTermination()
    return streams.kept_history(spark, f"{folder}/state").select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


def next_word_lead(spark, sf):
    words = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("ord", "word"))
    found = sequences.next_value(words, "doc_id", "ord", "word", "next").filter("word = 'the'")
    return found.select("doc_id", F.col("ord").cast("long").alias("ord"), "next")


def latest_by_key_upsert(spark, sf):
    rows = sequences.latest(table(spark, sf, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return rows.select("user_id", "event_id", "event_type")


def stream_tokens(spark, sf):
    """Each conversation's texts as a stream of events with its end, a broken line before it and another event after it."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("stream"), F.col("turn").cast("long").alias("ord"), "text")
    event = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    ends = rows.select("stream").distinct()
    extra = [ends.select("stream", F.lit(at).cast("long").alias("ord"), F.lit(line).alias("line")) for at, line in ((-1, "data: {kaputt"), (1 << 40, "data: [DONE]"), (1 << 41, 'data: {"choices":[{"delta":{"content":"zu spät"}}]}'))]
    lines = rows.select("stream", "ord", event.alias("line"))
    for part in extra:
        lines = lines.unionByName(part)
    return streams.stream_text(lines)


def minutes_markers(spark, sf):
    """Words of documents as words of pages: the first marker on each."""
    words = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc"), F.lit(0).alias("page"), F.posexplode(F.split(F.regexp_replace("text", "the ", "Tagesordnungspunkt "), " ")).alias("ord", "text"))
    return minutes.markers(words).select("doc", F.col("ord").cast("long").alias("ord"), "text")


_IT = "i AS (SELECT l_orderkey::VARCHAR referenzvorlage, l_orderkey || ':' || l_linenumber top_id, l_suppkey meeting, o_orderpriority vorlage, strftime(o_orderdate, '%Y-%m-%d') meeting_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT referenzvorlage FROM i GROUP BY ALL HAVING count(*) >= 3)"

SQL = {
    "party_dimension_lookup": "SELECT c_custkey, c_nationkey, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
    "label_value_multimap": "SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) ids FROM events GROUP BY ALL",
    "german_date_parse": "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(date_trunc('day', o_orderdate))::BIGINT AS epoch FROM orders",
    "json_payload_extract": "SELECT event_id, (props::JSON->>'k')::BIGINT k FROM events",
    "terms_agg": "SELECT source, count(*) n FROM documents GROUP BY ALL ORDER BY n DESC, source LIMIT 5000",
    "label_variants": r"SELECT clean, count(*) variants FROM (SELECT DISTINCT p_type raw, regexp_replace(p_type, '^\S+\s+', '') clean FROM part) GROUP BY clean",
    "distinct_pairs": "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem",
    "distinct_count": "SELECT count(DISTINCT l_partkey) parts, count(DISTINCT l_suppkey) suppliers FROM lineitem",
    "regex_filter": "SELECT doc_id, lang FROM documents WHERE regexp_matches(text, '(?i)(^|[^a-z])(loser|idiot|trash)([^a-z]|$)')",
    "ref_rollup_min_count": f"WITH {_IT} SELECT referenzvorlage, count(*) num_tops, count(DISTINCT meeting) num_meetings, string_agg(top_id, ',' ORDER BY top_id) tops FROM i JOIN k USING (referenzvorlage) GROUP BY ALL",
    "committee_rollup": "SELECT n_name gremium, count(*) num_tops, count(DISTINCT c_custkey) num_owners FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= '1995-01-01' AND o_orderdate < '1997-01-01' GROUP BY ALL HAVING count(*) >= 2",
    "graph_nodes": f"WITH {_IT} SELECT 'r:' || referenzvorlage id, referenzvorlage AS label, 'reference' AS kind FROM k UNION ALL SELECT 't:' || top_id, min(meeting_date || ' · ' || vorlage), 'item' FROM i JOIN k USING (referenzvorlage) GROUP BY top_id",
    "graph_edges": f"WITH {_IT} SELECT 'r:' || referenzvorlage AS source, 't:' || top_id AS target FROM i JOIN k USING (referenzvorlage)",
    "typed_graph_edges": "SELECT 'person_party' kind, c_custkey::VARCHAR AS source, n_name AS target FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT 'party_committee', n_name, n_regionkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "inner_join_match_rate": "SELECT count(*) total, count(l.doc_id) matched, round(count(l.doc_id) / count(*), 6) rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
    "incremental_left_anti": "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "first_wins": "SELECT user_id, event_type, min(event_id) event_id FROM events GROUP BY ALL",
    "section_forward_fill": "SELECT event_id, user_id, coalesce(last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS section FROM events",
    "page_sessionise": "WITH n AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT item FROM conversations), g AS (SELECT conv_id, item, min(turn) AS first, max(turn) AS last, list(text ORDER BY turn) p FROM n WHERE item > 0 GROUP BY ALL) SELECT conv_id, item, first, last, p[1] || coalesce(array_to_string(p[2:], ' '), '') body FROM g",
    "history_window_20": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20",
    "kept_conversations": "SELECT conv_id, turn, role, length(text) n_chars FROM (SELECT DISTINCT * FROM conversations) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= 3",
    "next_word_lead": "WITH w AS (SELECT doc_id, unnest(range(0, len(w))) ord, unnest(w) word FROM (SELECT doc_id, string_split(text, ' ') w FROM documents)), l AS (SELECT *, lead(word) OVER (PARTITION BY doc_id ORDER BY ord) AS next FROM w) SELECT doc_id, ord, next FROM l WHERE word = 'the'",
    "latest_by_key_upsert": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "stream_tokens": "SELECT conv_id AS stream, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY ALL",
    "minutes_markers": "WITH w AS (SELECT doc_id::VARCHAR doc, unnest(range(0, len(w))) ord, unnest(w) AS text FROM (SELECT doc_id, string_split(replace(text, 'the ', 'Tagesordnungspunkt '), ' ') w FROM documents)) SELECT doc, ord, text FROM w WHERE starts_with(lower(text), 'tagesordnungspunkt') QUALIFY row_number() OVER (PARTITION BY doc ORDER BY ord) = 1",
}

QUERIES = {f.__name__: f for f in (party_dimension_lookup, label_value_multimap, german_date_parse, json_payload_extract, terms_agg, label_variants, distinct_pairs, distinct_count, regex_filter, ref_rollup_min_count, committee_rollup, graph_nodes, graph_edges, typed_graph_edges, inner_join_match_rate, incremental_left_anti, first_wins, section_forward_fill, page_sessionise, history_window_20, kept_conversations, next_word_lead, latest_by_key_upsert, stream_tokens, minutes_markers)}
