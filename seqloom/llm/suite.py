"""Registered queries of the text operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import bond, compression, context_tree, decontam, language, licenses, packing, quality_rules, repair, secrets, simhash, url_rules, warc
from seqloom.llm.common import crc_bucket, read_table

TOKENIZER = "byte_bpe_50k.json"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).drop("rule_failed")


def op2_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(read_table(spark, sf_dir, "documents"))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = compression.fit(docs, read_table(spark, sf_dir, "labels"), compression.learn_ids(docs))
    return compression.score(docs, model).select(
        "doc_id", F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score",
        (F.col("score") >= compression.THRESHOLD).cast("int").alias("predicted"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write(read_table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(True))
    found = language.predict(docs, language.fit(docs, ~held))
    return found.withColumn("held_out", held).select("doc_id", "held_out", "lang_pred", "score", "n_positions", "agreeing")


#: Listed rules of the contract: verdict, host and path.
URL_RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The number of the document that a page shows stands after the language in its path.
PAGE_DOCUMENT = r"^[^:/?#]*://[^/?#]*/[a-z]{2}/([0-9]{1,18})(?:[./?#]|$)"


def op11_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    number = F.regexp_extract("url", PAGE_DOCUMENT, 1)
    rules = url_rules.mine(url_rules.labelled(pages, read_table(spark, sf_dir, "labels"), F.when(number != "", number.cast("long"))))
    return url_rules.judge(pages, rules, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "mined_rule", "mined_confidence")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.reconstruct(repair.damage(read_table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bond.mine(bond.prepared(read_table(spark, sf_dir, "embeddings")), F.col("vec_id") % 50 == 0)


#: Records by payload digest: base32 from five-bit groups of the SHA-1, the first page of a digest is the response.
OP4_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(CAST('0x' || h[i] AS INTEGER)), 4, '0')), '') AS b FROM p),
coded AS (SELECT page_id, n, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
  CAST(list_sum(list_transform(range(0, 5), lambda k: CAST(b[5 * i + k + 1] AS INTEGER) * (1 << (4 - k)))) AS INTEGER) + 1]), '') AS digest FROM bits),
first AS (SELECT digest, min(page_id) AS f FROM coded GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = f THEN NULL ELSE f END AS refers_to FROM coded JOIN first USING (digest)
"""

#: Measures by exploded windows; the binomial tail summed term by term.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(lang, '') AS s, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
wins AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS k FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
twice AS (SELECT r, k FROM wins GROUP BY r, k HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM wins JOIN twice USING (r, k), unnest(range(i, i + 8)) AS v(p) GROUP BY r),
f AS (SELECT doc_id, r, s, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, len(ls) AS n_lines,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f),
v AS (SELECT r, s, base_failed, doc_id, unnest(['symbols', 'repeats', 'lines', 'long_words']) AS rule, unnest([n_symbols / greatest(word_chars, 1),
  n_repeat_words / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1), least(word_chars / greatest(n_words, 1) / 50, 1)]) AS x FROM b),
st AS (SELECT r, s, base_failed, doc_id, rule, least(CAST(ceil(x * 200.0) AS INTEGER), 200) AS step FROM v),
lab AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
cnt AS (SELECT s, rule, step, sum(q) AS good FROM st JOIN lab USING (doc_id) WHERE NOT base_failed GROUP BY ALL),
grid AS (SELECT s, rule, g AS step FROM (SELECT DISTINCT s, rule FROM cnt), unnest(range(0, 201)) AS u(g)),
cum AS (SELECT s, rule, step, coalesce(sum(good) OVER (PARTITION BY s, rule ORDER BY step DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k,
  coalesce(sum(good) OVER (PARTITION BY s, rule), 0) AS n FROM grid LEFT JOIN cnt USING (s, rule, step)),
pv AS (SELECT *, CASE WHEN k >= n * 0.005 THEN 1.0 ELSE list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j:   exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.005) + (n - j) * ln(0.995)))) END AS p FROM cum),
bad AS (SELECT s, rule, max(CASE WHEN p > 0.05 / (4 * (SELECT count(DISTINCT s) FROM cnt)) THEN step ELSE -1 END) AS failed FROM pv GROUP BY s, rule),
rej AS (SELECT DISTINCT r FROM st JOIN bad USING (s, rule) WHERE failed < 200 AND step > failed + 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rej.r IS NULL AS kept FROM b LEFT JOIN rej USING (r)
"""

#: Every window of an item joined to every place of a document that holds its words.
OP5_SQL = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win
  FROM item, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
spots AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM doc, (SELECT DISTINCT k FROM windows), unnest(range(1, len(w) - k + 2)) AS t(i)),
hits AS (SELECT DISTINCT spots.r, spots.i, spots.k, item_id FROM spots JOIN windows USING (k, win)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + k)) AS t(p) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""



def _add(value: str, cost: int, letter: str) -> str:
    """Cost in nine digits, then the audit; so the least string is the cheapest, least audit."""
    return f"lpad(CAST(CAST(left({value}, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || '{letter}' || substr({value}, 10)"


def _raw(q: int, after: int) -> str:
    """Ways to use up a row in state q, of which `after` follows for a user or assistant row."""
    late = f"CAST(CAST(left(s{after}, 9) AS INTEGER) + 3 AS VARCHAR)"
    kept = [f"CASE WHEN lower(ch) = '{'u' if after == 2 else 'a'}' THEN CASE WHEN ch = lower(ch) THEN s{after} ELSE lpad({late}, 9, '0') || substr(s{after}, 10) END END"]
    if q == 0:
        kept.append("CASE WHEN ch = 's' THEN s1 WHEN ch = 'S' THEN lpad(CAST(CAST(left(s1, 9) AS INTEGER) + 3 AS VARCHAR), 9, '0') || substr(s1, 10) END")
    ways = [_add(f"s{q}", 4, "D"), f"CASE WHEN ch = lower(ch) THEN {_add(f's{after}', 3, 'R')} ELSE {_add(f's{after}', 6, 'R')} END"]
    ways += [f"left({k}, 9) || 'K' || substr({k}, 10)" for k in kept]
    return f"CASE WHEN ch = 'x' THEN {_add(f's{q}', 4, 'D')} ELSE least({', '.join(ways)}) END"


#: CRC-32 bit by bit; suffix costs and audits of four states from the last row to the first; the audit replayed over the rows.
OP12_SQL = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hit AS (SELECT *, xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length(k))), lambda c, j:
  xor(xor(c, CASE WHEN j % 8 = 0 THEN ascii(k[j // 8 + 1]) ELSE 0 END::BIGINT) >> 1, (xor(c, CASE WHEN j % 8 = 0 THEN ascii(k[j // 8 + 1]) ELSE 0 END::BIGINT) & 1) * 3988292384::BIGINT))) % 20 AS d FROM src),
dam AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS t,
  unnest(range(0, CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM hit WHERE d <> 0),
ord AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(t), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, t ORDER BY turn NULLS FIRST, copy) AS seen, rtrim(t, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM dam),
f AS (SELECT conv_id, turn, role, t, i, left(role, 1) AS c, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
  lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS nxt FROM ord),
conv AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (nxt IS NOT NULL AND c || nxt NOT IN ('su', 'ua', 'au')) AS illegal,
  string_agg(CASE WHEN fault IN ('b', 'd') THEN 'x' WHEN fault = 't' THEN CASE WHEN c IN ('s', 'u', 'a') THEN upper(c) ELSE 'O' END ELSE CASE WHEN c IN ('s', 'u', 'a') THEN c ELSE 'o' END END, '' ORDER BY i) AS codes
  FROM f GROUP BY conv_id),
dp AS (SELECT conv_id, codes, length(codes) AS pos, '000000000' AS s0, '000000006II' AS s1, '000000003I' AS s2, '000000000' AS s3 FROM conv
  UNION ALL SELECT conv_id, codes, pos, least(r0, {_add('r2', 3, 'I')}, {_add('r3', 6, 'II')}), least(r1, {_add('r2', 3, 'I')}, {_add('r3', 6, 'II')}),
    least(r2, {_add('r3', 3, 'I')}, {_add('r2', 6, 'II')}), least(r3, {_add('r2', 3, 'I')}, {_add('r3', 6, 'II')})
  FROM (SELECT conv_id, codes, pos - 1 AS pos, {_raw(0, 2)} AS r0, {_raw(1, 2)} AS r1, {_raw(2, 3)} AS r2, {_raw(3, 2)} AS r3 FROM (SELECT *, codes[pos] AS ch FROM dp WHERE pos > 0))),
best AS (SELECT conv_id, CAST(left(s0, 9) AS BIGINT) AS cost, substr(s0, 10) AS audit FROM dp WHERE pos = 0),
letters AS (SELECT conv_id, p, audit[p] AS e FROM best, unnest(range(1, length(audit) + 1)) AS u(p)),
placed AS (SELECT *, count(*) FILTER (e <> 'I') OVER w AS i, count(*) FILTER (e <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT l.conv_id, l.o, l.e, f.role, f.t, max(CASE WHEN l.o = 1 AND l.e = 'K' AND f.c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id) AS s
  FROM placed l LEFT JOIN f ON l.conv_id IS NOT DISTINCT FROM f.conv_id AND l.i = f.i AND l.e <> 'I' WHERE l.e <> 'D'),
text AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE t END, chr(10) ORDER BY o) AS x FROM lines GROUP BY conv_id)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(x, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN conv ON a.conv_id IS NOT DISTINCT FROM conv.conv_id
LEFT JOIN best ON a.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN text ON a.conv_id IS NOT DISTINCT FROM text.conv_id
"""

#: All scores of the anchors, then windows over them.
OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT * FROM (SELECT pos.anchor_id, pos.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY pos.anchor_id, pos.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank,
  n.vec_id AS negative_id, pos.score AS positive_score, n.score AS negative_score
  FROM pos JOIN pairs n ON n.anchor_id = pos.anchor_id AND NOT n.same AND 50 * pos.score <= 100 * n.score AND 100 * n.score <= 95 * pos.score) WHERE rank <= 3
"""

QUERIES = {
    "op1_quality_rules": (op1_quality_rules, OP1_SQL),
    "op2_context_tree": (op2_context_tree, None),
    "op3_compression_quality": (op3_compression_quality, None),
    "op4_warc": (op4_warc, OP4_SQL),
    "op5_decontamination": (op5_decontamination, OP5_SQL),
    "op6_licenses": (op6_licenses, None),
    "op7_packing": (op7_packing, None),
    "op8_simhash": (op8_simhash, None),
    "op9_secrets": (op9_secrets, None),
    "op10_language": (op10_language, None),
    "op11_url_rules": (op11_url_rules, None),
    "op12_conversation_repair": (op12_conversation_repair, OP12_SQL),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}
