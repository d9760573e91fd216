"""The numbered queries: each operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorlake.llm import alignment, chat, decontaminate, html_labeller, licenses, minhash, mixing, quality, repair, sharding, suffix, toxicity, warc
from floorlake.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_labeller.extract_pages(table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs).drop("text")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        sharding.row_key(F.col("doc_id"), F.col("text")).alias("__key"),
    )
    return sharding.feistel_shards(docs, "__key").select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_chats(table(spark, sf_dir, "conversations"))


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_conversations(rows, F.col("copies"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_report(table(spark, sf_dir, "documents"))


WORDS_SQL = "list_filter(regexp_split_to_array({0}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def _op3_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, {WORDS_SQL.format("lower(text)")} AS w FROM documents),
b AS (SELECT item_id, {WORDS_SQL.format("lower(text)")} AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
hits AS (SELECT doc_id, item_id, count(*)::DOUBLE / any_value(n) AS c FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids, max(c) AS c FROM hits WHERE c >= 0.8 GROUP BY doc_id)
SELECT doc_id, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, '') AS item_ids, round(coalesce(c, 0.0::DOUBLE), 6) AS max_containment,
  n_items IS NOT NULL AS contaminated, n_items IS NULL AS kept
FROM documents LEFT JOIN held USING (doc_id)"""


def _op4_sql(final: str | None = None) -> str:
    stripped, left = [], "text"
    for name, pattern in quality.CLASSES:
        stripped.append((name, left, (left := f"regexp_replace({left}, '{pattern}', '', 'g')")))
    classes = ", ".join(f"length({a}) - length({b})" for _, a, b in stripped) + f", length({left})"
    every = ", ".join(f"'{x}'" for x in sorted({x for v in quality.COMMON.values() for x in v}))
    listed = " ".join(f"WHEN '{k}' THEN [{', '.join(repr(x) for x in v)}]" for k, v in quality.COMMON.items())
    blank = ", ".join(["''"] * (quality.N_COMMON - 1))

    def distance(kind: str) -> str:
        return f"""{kind}_d AS (SELECT doc_id, sqrt(greatest(0, sum(
    CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2))) AS d
  FROM (SELECT a.doc_id, a.v / sum(a.v) OVER (PARTITION BY a.doc_id) AS p, r.v / sum(r.v) OVER (PARTITION BY a.doc_id) AS q
    FROM {kind}_h a JOIN (SELECT lang, bin, sum(v) AS v FROM {kind}_h GROUP BY lang, bin) r USING (lang, bin)) GROUP BY doc_id)"""

    base = f"""
WITH w AS (SELECT doc_id, lang, text, {WORDS_SQL.format("text")} AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) o(k) WHERE n >= 2 GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS a FROM documents),
char_h AS (SELECT doc_id, lang, unnest(range({quality.N_CLASSES})) AS bin, unnest([{classes}])::DOUBLE AS v FROM documents),
hits AS (SELECT doc_id, lang, len(w) AS n, list_filter(list_transform(w, lambda x: lower(x)), lambda x: x IN ({every})) AS h, CASE lang {listed} ELSE [{blank}] END AS c FROM w),
own AS (SELECT doc_id, lang, n, list_transform(c, lambda x: len(list_filter(h, lambda y: y = x))) AS o FROM hits),
word_h AS (SELECT doc_id, lang, unnest(range({quality.N_COMMON})) AS bin, unnest(list_append(o, n - list_sum(o)::BIGINT))::DOUBLE AS v FROM own),
{distance("char")},
{distance("word")},
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(a) - len(list_distinct(a)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  length(text) >= {quality.MIN_CHARS} AND coalesce(char_d.d, 0) > {quality.MAX_CHAR_DISTANCE} OR len(w) >= {quality.MIN_WORDS} AND coalesce(word_d.d, 0) > {quality.MAX_WORD_DISTANCE} AS far
  FROM w JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN char_d USING (doc_id) LEFT JOIN word_d USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)"""
    return base + (final or "\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT far AS kept FROM f")


CRC_TABLE = "t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i)))"
#: CRC-32 of a list ``bytes``, beside the table ``t``.
CRC = "CASE WHEN len(bytes) = 0 THEN 0 ELSE xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) END"


def _op6_sql() -> str:
    net = "SELECT key, l0 AS l, r0 AS r, n, rows, cols FROM ({0})"
    hashed = lambda x, k: f"(('0x' || substr(md5('{sharding.SEED}:{k}:' || {x}), 1, 8))::BIGINT)"
    for k in range(sharding.ROUNDS):
        moved = f"l, (r + {hashed('l', k)} % cols) % cols AS r" if k % 2 == 0 else f"(l + {hashed('r', k)} % rows) % rows AS l, r"
        net = f"SELECT key, {moved}, n, rows, cols FROM ({net})"
    net = f"SELECT key, l * cols + r AS x, n, rows, cols FROM ({net})"
    step = lambda source, where: net.format(f"SELECT key, x // cols AS l0, x % cols AS r0, n, rows, cols FROM {source} {where}")
    return f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, text, octet_length(encode(text)) + 1 AS size, md5(doc_id::VARCHAR || '|1' || text) AS key,
  list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
e AS (SELECT *, row_number() OVER (ORDER BY key) - 1 AS x, count(*) OVER () AS n FROM d),
s AS (SELECT key, x, n, floor(sqrt(n - 1))::BIGINT + 1 AS rows FROM e),
u AS (SELECT key, x, n, rows, greatest(1, (n + rows - 1) // rows) AS cols FROM s),
walk AS (SELECT * FROM ({step("u", "")}) UNION ALL SELECT * FROM ({step("walk", "WHERE x >= n")}))
SELECT doc_id, size::BIGINT AS size, {CRC}::BIGINT AS text_crc32,
  'rows' AS law, (walk.x % 16)::INTEGER AS shard, (walk.x // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM e JOIN walk USING (key), t WHERE walk.x < walk.n"""


OP7_SQL = """
WITH c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY turn) AS l FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS j, l FROM c),
h AS (SELECT conv_id, n, j, md5(l[1:j]::VARCHAR) AS h FROM p),
ends AS (SELECT h, j, min(conv_id) AS conv_id, count(*) AS n_same FROM h WHERE n = j GROUP BY h, j),
keep AS (SELECT conv_id, n_same FROM ends WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.h = ends.h AND h.j = ends.j AND h.n > h.j))
SELECT conv_id, len(l)::BIGINT AS n_turns, n_same::BIGINT AS n_same,
  array_to_string(list_transform(l, lambda x: '<|' || x.r || '|>' || chr(10) || x.t || '<|end|>'), chr(10)) AS chat
FROM c JOIN keep USING (conv_id)"""

OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f"""

OP8_SQL = """
WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n, hex(encode(text)) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, (2 * p + 1)::INT, 400)) AS k FROM (SELECT doc_id, h, unnest(range(n - 199)) AS p FROM d WHERE n >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM g),
s AS (SELECT doc_id, s, min(p) AS a, max(p) + 200 AS b FROM i GROUP BY doc_id, s),
k AS (SELECT doc_id, s, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM s),
t AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, (2 * z + 1)::INT, (2 * (a - z))::INT), '' ORDER BY a) || substr(any_value(h), (2 * max(b) + 1)::INT) AS h
  FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t.h, d.h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)"""

OP9_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') AS s FROM d WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
j AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b USING (s) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM j JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 80 * (a.n + b.n - k)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.v FROM r JOIN e ON e.u = r.y)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, c = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM r GROUP BY x) USING (doc_id)"""


def _op11_sql() -> str:
    """One pass over a conversation's rows with the cheapest 'cost:audit' of each state; at most one insert before a row and what the end needs after it."""
    least = lambda *x: f"least({', '.join(x)})"
    added = lambda state, cost, edit: f"(lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || '{edit}')"
    none = "'999999999:'"
    # states after an insert, where there is one: a user's from start, system and assistant, an assistant's from user
    user, assistant = least("p.u", added("p.z", 5, "I"), added("p.s", 5, "I"), added("p.a", 5, "I")), least("p.a", added("p.u", 5, "I"))
    keep = lambda state, wanted: f"CASE WHEN movable AND initial = '{wanted}' THEN {added(state, 'late', 'K')} ELSE {none} END"
    reroled = lambda state: f"CASE WHEN movable THEN {added(state, '1 + late', 'R')} ELSE {none} END"
    deleted = lambda state: added(state, 2, "D")
    to_user = [f(x, *w) for x in ("p.z", "p.s", assistant) for f, w in ((keep, ["u"]), (reroled, []))]
    done = least("z", "a", added("u", 5, "I"), added("s", 10, "II"))
    return f"""
WITH RECURSIVE {CRC_TABLE},
c AS (SELECT conv_id, turn, role, text, list_transform(regexp_extract_all(hex(encode(conv_id || ':' || turn)), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM conversations),
k AS (SELECT *, {CRC} % 20 AS kind FROM c, t),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE kind <> 0),
e AS (SELECT *, substr(role, 1, 1) AS initial, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS stop, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn, copy) AS same,
  lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS two FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn, copy)),
f AS (SELECT *, CASE WHEN stop = '' THEN 'blank' WHEN same > 1 THEN 'duplicate' WHEN stop NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM e),
g AS (SELECT *, fault NOT IN ('blank', 'duplicate') AS movable, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS late FROM f),
n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
  count_if(two NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
w AS (SELECT conv_id, 0::BIGINT AS i, '000000000:' AS z, {none} AS s, {none} AS u, {none} AS a FROM n
  UNION ALL SELECT p.conv_id, g.i, {deleted("p.z")}, {least(deleted("p.s"), keep("p.z", "s"))}, {least(deleted(user), *to_user)}, {least(deleted(assistant), keep(user, "a"), reroled(user))}
  FROM w p JOIN g ON g.conv_id = p.conv_id AND g.i = p.i + 1),
r AS (SELECT conv_id, substr(b, 1, 9)::BIGINT AS cost, substr(b, 11) AS audit FROM (SELECT conv_id, {done} AS b FROM w JOIN n USING (conv_id) WHERE w.i = n.n)),
x AS (SELECT conv_id, p, substr(audit, p::INT, 1) AS edit, length(replace(substr(audit, 1, p::INT), 'I', '')) AS i FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM r)),
y AS (SELECT x.conv_id, p, edit, role, CASE WHEN edit = 'I' THEN '' ELSE text END AS text, count(*) OVER o - count_if(edit = 'K' AND initial = 's') OVER o AS j
  FROM x LEFT JOIN g ON g.conv_id = x.conv_id AND g.i = x.i WHERE edit <> 'D' WINDOW o AS (PARTITION BY x.conv_id ORDER BY p)),
m AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN j % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS said FROM y GROUP BY conv_id)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN n USING (conv_id) LEFT JOIN r USING (conv_id) LEFT JOIN m USING (conv_id)"""


def _op12_sql() -> str:
    rows = [(label, text, "true") for label, text in licenses.PHRASES] + [(label, text, "false") for label, text in licenses.NOTICES]
    listed = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}', {phrase})" for i, (label, text, phrase) in enumerate(rows))
    said = lambda x: f"list_filter(regexp_split_to_array(translate({x}, '{licenses.UPPER}', '{licenses.LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
WITH m AS (SELECT template_id, label, phrase, {said("text")} AS w FROM (VALUES {listed}) v(template_id, label, text, phrase)),
mg AS (SELECT template_id, label, phrase, n, k, i - 1 AS t, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT *, len(w) AS n, least(len(w), {licenses.K}) AS k, unnest(range(1, len(w) - least(len(w), {licenses.K}) + 2)) AS i FROM m)),
d AS (SELECT doc_id, {said("text")} AS w FROM documents),
dg AS (SELECT doc_id, i - 1 AS i, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM mg))),
h AS (SELECT doc_id, template_id, label, phrase, n, k, t, i - t AS d FROM dg JOIN mg USING (k, gram)),
p AS (SELECT doc_id, label, d AS first FROM h WHERE phrase GROUP BY doc_id, template_id, label, n, k, d HAVING count(*) = n - k + 1),
o AS (SELECT *, coalesce(d - lag(d) OVER (PARTITION BY doc_id, template_id ORDER BY d) > least({licenses.SLACK}, n - 1), true)::INT AS new FROM (SELECT DISTINCT doc_id, template_id, label, n, d FROM h WHERE NOT phrase)),
s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template_id ORDER BY d) AS span FROM o),
c AS (SELECT doc_id, template_id, label, n, span, min(d + t) AS first, max(d + t + k - 1) AS last, count(DISTINCT x) AS words
  FROM (SELECT s.*, h.t, h.k, unnest(range(h.t, h.t + h.k)) AS x FROM s JOIN h USING (doc_id, template_id, d)) GROUP BY doc_id, template_id, label, n, span),
f AS (SELECT doc_id, label, words / n AS share FROM c WHERE words / n >= CASE WHEN n < {licenses.SHORT} THEN 1 ELSE {licenses.MIN_SHARE} END AND last - first + 1 <= n * {licenses.MAX_STRETCH}),
a AS (SELECT doc_id, label, first, true AS base, 1.0::DOUBLE AS share FROM p UNION ALL SELECT doc_id, label, NULL, false, share FROM f),
b AS (SELECT doc_id, count_if(base) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM a GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id)"""


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_html, op2_mixing, op3_decontamination, op4_quality, op5_warc, op6_sharding, op7_chat, op8_suffix, op9_minhash, op10_toxicity, op11_repair, op12_licenses, op13_alignment)}

ORACLE_SQL: dict[str, str] = {"op3_decontamination": _op3_sql(), "op4_quality": _op4_sql(), "op5_warc": OP5_SQL, "op6_sharding": _op6_sql(), "op7_chat": OP7_SQL, "op8_suffix": OP8_SQL, "op9_minhash": OP9_SQL, "op11_repair": _op11_sql(), "op12_licenses": _op12_sql()}
