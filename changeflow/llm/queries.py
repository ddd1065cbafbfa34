"""Registered queries of the operators, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeflow.llm import (
    chat, collocations, decontaminate, language, licenses, packing, quality_lines, repair, secret_scan, sharding, simhash,
    warc, wavelet,
)

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS position
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations)
), lines AS (
  SELECT conv_id, position, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS line FROM t
), prefixes AS (
  SELECT conv_id, position + 1 AS n,
         string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY position) AS body FROM lines
), whole AS (
  SELECT conv_id, max(n) AS n, max_by(body, n) AS body FROM prefixes GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, n, body FROM whole GROUP BY n, body
), kept AS (
  SELECT conv_id, n FROM one WHERE NOT EXISTS (
    SELECT 1 FROM prefixes p JOIN whole w ON p.conv_id = w.conv_id AND p.n < w.n WHERE p.n = one.n AND p.body = one.body)
)
SELECT l.conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(l.position // 512 AS BIGINT) AS part,
       CAST(min(l.position) AS BIGINT) AS first_turn, CAST(count(*) AS BIGINT) AS part_turns,
       string_agg(l.line, '' ORDER BY l.position) AS text
FROM lines l JOIN kept k ON l.conv_id = k.conv_id GROUP BY l.conv_id, k.n, l.position // 512
"""


@query("op1_chat_snapshots", CHAT_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render_conversations(load(spark, sf_dir, "conversations"))


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(load(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"))
    samples = language.learn(docs.filter(~out))
    found = language.predict(docs.select("doc_id", "text"), samples).drop("text")
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "n_letters", "entropy")


BENCHMARK_SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), places AS (
  SELECT item_id, w, least(10, len(w)) AS size, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS words FROM places
), starts AS (
  SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows)
), hits AS (
  SELECT doc_id, i, s.size, item_id FROM starts s JOIN windows x ON x.size = s.size AND x.words = array_to_string(w[i:i + s.size - 1], ' ')
), words AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS listed FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op4_benchmark_decontamination", BENCHMARK_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, load(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op6_vector_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(load(spark, sf_dir, "documents"))


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


@query("op8_shuffle_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_records(load(spark, sf_dir, "documents"))


BASE_QUALITY = [
    "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    "n_punctuation_lines", "n_navigation_lines", "n_boilerplate_lines", "n_lost_words",
]


@query("op9_line_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.clean_lines(load(spark, sf_dir, "documents").select("doc_id", "text")).select(*BASE_QUALITY)


@query("op10_wavelet_tokens")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.token_table(load(spark, sf_dir, "documents"))


COLLOCATION_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces
), placed AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split
), grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM placed, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, k, phrase, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30
), n AS (
  SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM split GROUP BY lang
), parts AS (
  SELECT lang, f, k, unnest(range(1, k)) AS size, phrase FROM f WHERE k > 2
), inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + size - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM parts) GROUP BY ALL
), kept AS (
  SELECT c.* FROM f c LEFT JOIN inside USING (lang, phrase)
  WHERE c.k > 1 AND (longer IS NULL OR 100 * longer::HUGEINT < 80 * c.f::HUGEINT)
), cuts AS (
  SELECT lang, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM kept
), sides AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
         CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')
), least AS (
  SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(load(spark, sf_dir, "documents").select("text", "lang"))


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS INT), 1)), '')
         AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


@query("op12_warc_revisits", WARC_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.archive_pages(load(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _edit(way: str, cost: str, letter: str) -> str:
    return f"CASE WHEN {way} IS NOT NULL THEN {{'c': {way}.c + {cost}, 'a': {way}.a || '{letter}'}} END"


def _kept(way: str, *initials: str) -> str:
    """A row is kept if its role's initial fits after the state, and rerolled to the only role that does otherwise."""
    keep = _edit(way, "late", "K")
    reroll = _edit(way, "2 + late", "R") if initials != ("s",) else "NULL"
    fits = ", ".join(f"'{i}'" for i in initials)
    return f"CASE WHEN must_go THEN NULL WHEN initial IN ({fits}) THEN {keep} ELSE {reroll} END"


# The state machine of the grammar, written out: w0 nothing yet, w1 after s, w2 after u, w3 after a; a way is its cost and letters.
REPAIR_SQL = f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT CAST(i AS UINTEGER), CAST(i AS UINTEGER), 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UINTEGER) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295::UINTEGER, list_reduce(
    list_concat([4294967295::UINTEGER], list_transform(string_split(
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::UINTEGER)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) % 20 AS kind
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         left(role, 1) AS initial, regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g') AS seen FROM damaged
), faults AS (
  SELECT *, seen = '' AS blank, seen <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         seen <> '' AND right(seen, 1) NOT IN ('.', '!', '?') AS open_ended, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), rows AS (
  SELECT *, blank OR duplicate AS must_go, CASE WHEN open_ended AND NOT duplicate THEN 1 ELSE 0 END AS late FROM faults
), sizes AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, sum(late) AS truncated,
         count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id
), ways AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': ''}} AS w0, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS w1,
         CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS v2, CAST(NULL AS STRUCT(c INTEGER, a VARCHAR)) AS v3 FROM sizes
  UNION ALL
  SELECT conv_id, i, {_edit("w0", "3", "D")}, list_min([{_edit("w1", "3", "D")}, {_kept("w0", "s")}]),
         list_min([{_edit("w2", "3", "D")}, {_kept("w0", "u")}, {_kept("w1", "u")}, {_kept("w3", "u")}]),
         list_min([{_edit("w3", "3", "D")}, {_kept("w2", "a")}])
  FROM (SELECT *, list_min([v3, {_edit("w2", "2", "I")}]) AS w3 FROM (
    SELECT r.conv_id, r.i, r.initial, r.must_go, r.late, w0, w1, v3,
           list_min([v2, {_edit("w0", "2", "I")}, {_edit("w1", "2", "I")}, {_edit("v3", "2", "I")}]) AS w2
    FROM ways w JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1))
), ends AS (
  SELECT conv_id, list_min([w0, v3, {_edit("w2", "2", "I")}]) AS way FROM (
    SELECT w.conv_id, w0, v3, list_min([v2, {_edit("w0", "2", "I")}, {_edit("w1", "2", "I")}, {_edit("v3", "2", "I")}]) AS w2
    FROM ways w JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i)
), written AS (
  SELECT conv_id, way.a AS audit, 0 AS k, CAST(0 AS BIGINT) AS i, 0 AS state, CAST([] AS VARCHAR[]) AS lines FROM ends
  UNION ALL
  SELECT w.conv_id, audit, k + 1, CASE WHEN letter = 'I' THEN w.i ELSE w.i + 1 END,
         CASE WHEN letter = 'D' THEN state WHEN letter = 'K' AND r.initial = 's' THEN 1 WHEN state = 2 THEN 3 ELSE 2 END,
         CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, r.role || ':' || r.text)
           ELSE list_append(lines, CASE WHEN state = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN letter = 'R' THEN r.text ELSE '' END) END
  FROM (SELECT *, substr(audit, k + 1, 1) AS letter FROM written WHERE k < length(audit)) w
  LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank,
       CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
       CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(way.c, 0) AS BIGINT) AS cost, coalesce(e.way.a, '') AS audit,
       sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN written w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND k = length(w.audit)
"""


@query("op11_conversation_repair", REPAIR_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damaged(load(spark, sf_dir, "conversations")))
