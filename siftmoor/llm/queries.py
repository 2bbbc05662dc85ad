"""The registered queries of the training-data operators, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftmoor.llm import (
    chat, decontamination, divergence, language, lines, mixing, nearest, resampling, shingles, substrings, suffix_tree, toxicity, url_rules,
)
from siftmoor.llm.common import fold

QUERIES, ORACLE = {}, {}

# The rules of op8, (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# The conversation that op6 adds, (conv_id, turn, role, text).
ADDED_TURNS = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = language.fit(docs.where(~held_out))
    return language.identify(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source"))


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingles.near_duplicates(table(spark, sf_dir, "documents"))


ORACLE["op3_ngram_jaccard"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words
  FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, words, unnest(generate_series(1, greatest(len(words) - 4, least(len(words), 1)))) AS i FROM split)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS hits FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY x, y),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * hits >= 80 * (p.n + q.n - hits)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.x = d.doc_id"""


@query
def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op4_substrings"] = r"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - 12)) AS i FROM split)),
seen AS (SELECT passage, min(doc_id) AS least FROM windows GROUP BY passage),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS i
  FROM windows JOIN seen USING (passage) WHERE least < doc_id),
kept AS (
  SELECT s.doc_id, s.word, s.i, c.i IS NULL AS stays
  FROM (SELECT doc_id, unnest(words) AS word, unnest(generate_series(1, len(words))) AS i FROM split) s
  LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.i = c.i),
told AS (SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (stays) AS text FROM kept GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN told USING (doc_id)"""


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    added = spark.createDataFrame(ADDED_TURNS, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(added)
    return chat.digests(chat.examples(rows))


ORACLE["op6_chat_formatting"] = r"""
WITH added(conv_id, turn, role, text) AS (VALUES
  (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
turns AS (
  SELECT conv_id, role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i,
    length(regexp_replace(coalesce(text, ''), '([<\[])(\\*)(/?s>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')) + length(role) + 8 AS written,
    count(*) OVER (PARTITION BY conv_id) AS n
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM added)),
upto AS (SELECT *, sum(written) OVER (PARTITION BY conv_id ORDER BY i) AS length_so_far FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length_so_far) FILTER (role = 'assistant' OR i = n) AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM upto GROUP BY conv_id"""


@query
def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


@query
def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), rules)


ORACLE["op8_url_rules"] = """
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (
  SELECT *, CASE
    WHEN '.' || host LIKE '%.www.example.com' AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN '.' || host LIKE '%.example.com' AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN '.' || host LIKE '%.com' AND path LIKE '/%' THEN 'com/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/es/%' THEN 'net/es/'
    WHEN '.' || host LIKE '%.net' AND path LIKE '/fr/%' THEN 'net/fr/' END AS rule FROM parsed)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged"""


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4) == 2
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query
def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    model = suffix_tree.fit(docs.where(~held_out))
    return suffix_tree.score(docs, model, {"doc_id": F.col("doc_id"), "held_out": held_out})


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# The CRC of a feature goes byte by byte over the digits of its hexadecimal form.
ORACLE["op11_resampling"] = r"""
WITH RECURSIVE steps(k, v, value) AS (
  SELECT 0, range::BIGINT, range::BIGINT FROM range(256) UNION ALL
  SELECT k + 1, v, CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END FROM steps WHERE k < 8),
crc_table AS (SELECT list(value ORDER BY v) AS t FROM steps WHERE k = 8),
texts AS (SELECT true AS own, doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT false, NULL, -row_number() OVER (), coalesce(text, '') FROM benchmark),
split AS (SELECT own, doc_id, r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
runs AS (SELECT own, r, unnest(list_concat(words,
    list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]),
    list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))) AS feature FROM split),
features AS (SELECT own, r, feature, count(*) AS n FROM runs GROUP BY own, r, feature),
hexes AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM features)),
buckets AS (SELECT feature, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(0, length(h) // 2),
    lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1)),
    lambda crc, byte: xor(crc >> 8, t[1 + (xor(crc, byte) & 255)])), 4294967295) % 10000 AS bucket FROM hexes, crc_table),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::BIGINT AS s, coalesce(sum(n) FILTER (NOT own), 0)::BIGINT AS t
  FROM features JOIN buckets USING (feature) GROUP BY bucket),
whole AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM counts, whole),
weights AS (SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM features JOIN buckets USING (feature) JOIN gains USING (bucket) WHERE own GROUP BY r),
scores AS (SELECT doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weights USING (r) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
  count(*) FILTER (n_words >= 20) OVER () AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END AS rank FROM ranked"""


@query
def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


ORACLE["op12_divergence"] = r"""
WITH docs AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
terms AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT r) AS held FROM terms GROUP BY lang, source, term),
kept AS (SELECT lang, term, sum(n)::BIGINT AS n FROM counts GROUP BY lang, term HAVING sum(held) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
cells AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS n_lang
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n)::BIGINT AS total FROM cells GROUP BY lang, source),
shares AS (SELECT c.lang, c.source, c.term, c.n, 1 + 1000000000::HUGEINT * (c.n + 1) // (t.total + l.v) AS p,
    1 + 1000000000::HUGEINT * (c.n_lang + 1) // (l.n + l.v) AS q
  FROM cells c JOIN totals t ON t.lang = c.lang AND t.source = c.source JOIN langs l ON l.lang = c.lang),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
told AS (
  SELECT g.lang, g.source, 'pair' AS part, o.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups g JOIN groups o ON g.lang = o.lang AND g.source <> o.source LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = o.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM told
QUALIFY part = 'pair' OR rank <= 200"""


@query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.without_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op13_line_dedup"] = r"""
WITH split AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
keyed AS (SELECT doc_id, r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, r, unnest(lines) AS line, unnest(generate_series(1, len(lines))) AS i FROM split)),
held AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
told AS (SELECT k.*, coalesce(k.doc_id < h.top, false) AS gone FROM keyed k LEFT JOIN held h ON h.key = k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY r"""
