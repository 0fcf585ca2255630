"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(spark, vectors, vectors.filter("vec_id % 50 = 0"), k=5)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import token_files, with_crc32

    return with_crc32(token_files(spark, table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(spark, table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0, capacity=2048)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import drop_lines

    return drop_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped_lines")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "block", "slot", "place")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    found = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(spark, table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import verified

    return verified(table(spark, sf_dir, "documents"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import labelled, scan

    return labelled(scan(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit, counters, failures

    return audit(counters(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_main_text, op2_nearest_neighbours, op3_token_files, op4_near_dedup, op5_best_fit_packing, op6_line_dedup, op7_mix_sources, op8_quality_rules, op9_language_id, op10_toxicity, op11_merkle_manifest, op12_license_scan, op13_filter_audit)}


#: By prefixes of each set's rarest shingles, confirmed on whole sets.
NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) g FROM w),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
f AS (SELECT g, count(*) f FROM s GROUP BY g),
r AS (SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY f, g) k FROM s JOIN f USING (g) JOIN n USING (doc_id)),
p AS (SELECT doc_id, g, n FROM r WHERE k <= n - (80 * n + 99) // 100 + 1),
c AS (SELECT DISTINCT x.doc_id a, y.doc_id b, x.n na, y.n nb FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
l AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id id, doc_id root FROM documents UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id),
m AS (SELECT id, min(root) component_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT n_shingles, component_id, d.doc_id = component_id AS kept FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

#: Templates as strings in place of hashes: whole lines, lines token by token, and each choice of the cells that may vary.
LINES_SQL = r"""WITH l AS (SELECT doc_id, unnest(range(0, len(x))) line, unnest(x) v FROM (SELECT doc_id, string_split(text, chr(10)) x FROM documents)),
t AS (SELECT doc_id, line, list_filter(regexp_split_to_array(v, '[\x20\x09-\x0D]+'), lambda w: w <> '') w FROM l),
m AS (SELECT doc_id, doc_id * 1000000 + line place, w, len(w) n, list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) t, len(list_filter(w, lambda x: NOT regexp_matches(x, '[0-9]'))) f FROM t),
h AS (SELECT *, f >= 3 AND 2 * f >= n AS general, CASE WHEN n < 8 THEN 10 WHEN n < 20 THEN 3 ELSE 2 END least, least(n, 10) c FROM m WHERE n >= 3 OR f > 0),
c AS (SELECT *, list_transform(range(0, c), lambda i: array_to_string(t[i * n // c + 1:(i + 1) * n // c], ' ')) cells FROM h WHERE general AND n >= 8),
o AS (SELECT a.i, b.i j FROM range(0, 10) a(i), range(0, 10) b(i) WHERE a.i < b.i),
k AS (SELECT doc_id, place, least, CASE WHEN general THEN '=' || array_to_string(t, ' ') ELSE '!' || array_to_string(w, ' ') END k FROM h
  UNION ALL SELECT doc_id, place, 2, '"' || array_to_string(w, ' ') FROM h WHERE n >= 8
  UNION ALL SELECT doc_id, place, least, concat_ws('|', n, t[1], i, array_to_string(list_transform(cells, lambda x, p: CASE WHEN p = i + 1 THEN '' ELSE x END), '|')) FROM c JOIN range(0, 9) r(i) ON n < 10 AND i < c.c
  UNION ALL SELECT doc_id, place, least, concat_ws('|', n, t[1], i, j, array_to_string(list_transform(cells, lambda x, p: CASE WHEN p = i + 1 OR p = j + 1 THEN '' ELSE x END), '|')) FROM c JOIN o ON n >= 10),
g AS (SELECT k, min(place) first FROM k GROUP BY k, least HAVING count(DISTINCT doc_id) >= least),
d AS (SELECT DISTINCT place FROM k JOIN g USING (k) WHERE place > first),
s AS (SELECT l.doc_id, coalesce(string_agg(v, chr(10) ORDER BY l.line) FILTER (d.place IS NULL), '') AS text, count(d.place) n FROM l LEFT JOIN d ON d.place = l.doc_id * 1000000 + l.line GROUP BY l.doc_id)
SELECT d.doc_id, s.text, coalesce(s.n, 0) AS n_dropped_lines FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id"""

#: Nodes of a level make the next one's; a row's way goes up the tries of its source and of the sources. CRC-32 bit by bit.
MERKLE_SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') head, text,
  list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_prepend(ascii(c)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) crc FROM documents),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) leaf, CASE WHEN crc % 2 = 1 THEN replace(text, chr(10), '') ELSE text END t, head FROM d),
r AS (SELECT doc_id, source, leaf, sha256(head || coalesce(strlen(t) || ':' || t, '-')) other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t AS (SELECT 0 lv, source, i, leaf h, count(*) OVER (PARTITION BY source) n FROM r
  UNION ALL SELECT lv + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY lv, source, i // 3),
s AS (SELECT source, h subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () n FROM t WHERE n = 1),
u AS (SELECT 0 lv, i, subroot h, n FROM s UNION ALL SELECT lv + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM u WHERE n > 1 GROUP BY lv, i // 3),
a AS (SELECT x.lv, x.source, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') before, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS after FROM t x JOIN t y ON x.lv = y.lv AND x.source IS NOT DISTINCT FROM y.source AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY x.lv, x.source, x.i),
b AS (SELECT x.lv, x.i, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i < x.i), '') before, coalesce(string_agg(y.h, '' ORDER BY y.i) FILTER (y.i > x.i), '') AS after FROM u x JOIN u y ON x.lv = y.lv AND x.i // 3 = y.i // 3 WHERE x.n > 1 GROUP BY x.lv, x.i),
w AS (SELECT 0 lv, doc_id, source, i first, i, other h, '' proof FROM r
  UNION ALL SELECT w.lv + 1, doc_id, w.source, first, w.i // 3, sha256(before || w.h || after), proof || before || after FROM w JOIN a ON a.lv = w.lv AND a.source IS NOT DISTINCT FROM w.source AND a.i = w.i),
v AS (SELECT 0 lv, doc_id, w.source, first, s.i, w.h, proof FROM w JOIN s ON s.source IS NOT DISTINCT FROM w.source JOIN t ON t.n = 1 AND t.source IS NOT DISTINCT FROM w.source AND t.lv = w.lv
  UNION ALL SELECT v.lv + 1, doc_id, source, first, v.i // 3, sha256(before || v.h || after), proof || before || after FROM v JOIN b ON b.lv = v.lv AND b.i = v.i)
SELECT r.doc_id, r.leaf, s.subroot, u.h root, sha256(v.proof) proof_sha256, v.h folded_root, v.h = u.h verified, r.source, r.i rank
FROM v JOIN u ON u.n = 1 AND u.lv = v.lv JOIN r ON r.source IS NOT DISTINCT FROM v.source AND r.i = v.first JOIN s ON s.source IS NOT DISTINCT FROM r.source"""


AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') part, coalesce(text, '') t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') w, coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) e FROM d),
f AS (SELECT doc_id, part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), e] f FROM w),
m AS (SELECT doc_id, coalesce(max(quality = 1), false) good, coalesce(max(toxic = 1), false) toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
c AS (SELECT part, f, count(*) n, count(*) FILTER (good) good, count(*) FILTER (toxic) toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY part, f),
l AS (SELECT unnest([1, 2, 3, 4, 5]) k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT list_reduce(list_transform(o, lambda k: 'ABCDE'[k]), lambda x, y: x || y) filter_order, o, unnest([1, 2, 3, 4, 5]) step FROM o),
r AS (SELECT part, filter_order, step, o[step] k, n, good, toxic, f[o[step]] own, list_bool_or(list_transform(o[1:step - 1], lambda k: f[k])) earlier, len(list_filter(f, lambda x: x)) fails FROM c CROSS JOIN s),
x AS (SELECT part, filter_order, step, k, sum(n) FILTER (NOT own AND NOT coalesce(earlier, false)) kept, sum(n) FILTER (own AND NOT coalesce(earlier, false)) removed, sum(n) FILTER (own AND earlier) redundant, sum(n) FILTER (own AND fails = 1) unique_fails, sum(good) FILTER (own AND NOT coalesce(earlier, false)) good_lost, sum(toxic) FILTER (own AND NOT coalesce(earlier, false)) toxic_lost FROM r GROUP BY part, filter_order, step, k)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT kept, coalesce(removed, 0)::BIGINT removed, coalesce(redundant, 0)::BIGINT redundant, coalesce(unique_fails, 0)::BIGINT unique_fails, coalesce(good_lost, 0)::BIGINT good_lost, coalesce(toxic_lost, 0)::BIGINT toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT shapley FROM x"""


def _license_sql() -> str:
    from . import license_scan as x

    templates = [(label, x.template_words(text)) for label, text in x.TEMPLATES]
    tokens = ", ".join(f"({k}, '{label}', '{w}', {len(set(ws))}, {(x.CONTAINED * len(set(ws)) + 99) // 100}, {x.WINDOW * len(ws)})" for k, (label, ws) in enumerate(templates) for w in sorted(set(ws)))
    phrases = " UNION ALL ".join(f"SELECT doc_id, place, '{label}' AS label FROM n WHERE " + " AND ".join(f"w{i} = '{w}'" for i, w in enumerate(x.template_words(text))) for text, label in x.PHRASES)
    return rf"""WITH l AS (SELECT doc_id, unnest(range(0, len(x))) line, unnest(x) v FROM (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) x FROM documents)),
k AS (SELECT doc_id, line, regexp_extract_all(v, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM l),
b AS (SELECT *, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) block, sum(len(w)) OVER (PARTITION BY doc_id ORDER BY line) - len(w) before FROM k WHERE len(w) > 0),
w AS (SELECT doc_id, block, (before + unnest(range(0, len(w))))::BIGINT place, unnest(w) word FROM b),
n AS (SELECT doc_id, place, word w0, lead(word, 1) OVER z w1, lead(word, 2) OVER z w2 FROM w WINDOW z AS (PARTITION BY doc_id ORDER BY place)),
p AS ({phrases}),
t AS (SELECT * FROM (VALUES {tokens}) t(template, label, word, size, need, width)),
h AS (SELECT doc_id, block, template, label, place, word, size, need, width FROM w JOIN t USING (word)),
c AS (SELECT doc_id, block, template FROM h GROUP BY ALL HAVING count(DISTINCT word) >= any_value(need)),
g AS (SELECT h.* FROM h JOIN c USING (doc_id, block, template)),
e AS (SELECT r.doc_id, r.block, r.template, any_value(r.label) AS label, any_value(r.size) size, any_value(r.need) need, r.place, count(DISTINCT q.word) held FROM g r JOIN g q ON q.doc_id = r.doc_id AND q.block = r.block AND q.template = r.template AND q.place > r.place - r.width AND q.place <= r.place GROUP BY r.doc_id, r.block, r.template, r.place),
m AS (SELECT doc_id, label, held / size share FROM e WHERE held >= need),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM p UNION SELECT doc_id, label FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, count(*) n_base, min(place) first_word, max(place) last_word, string_agg(DISTINCT label, ',' ORDER BY label) base_labels FROM p GROUP BY doc_id),
s AS (SELECT doc_id, max(share) share FROM m GROUP BY doc_id),
y AS (SELECT doc_id, count(*) n_words FROM w GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) n_words, coalesce(n_base, 0) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END score
FROM documents d LEFT JOIN y USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN s USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_near_dedup": NEAR_SQL, "op6_line_dedup": LINES_SQL, "op11_merkle_manifest": MERKLE_SQL, "op12_license_scan": _license_sql(), "op13_filter_audit": AUDIT_SQL}
