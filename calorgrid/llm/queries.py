"""Queries of the text operators, opN_<name>, and the SQL that some of them must equal."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from calorgrid.llm import fim, importance, langid, licences, linededup, lineclean, mixing, ngramjoin, ordminhash, rans, spsample, store, tokcount, warc

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"

QUERIES: dict = {}
ORACLES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    records = store.cut(warc.read(spark, path, payload=False), "warc-records")  # three times read
    return warc.digests(warc.assemble(records))


ORACLES["op1_warc_transactions"] = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(CAST(encode(body) AS BLOB)) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= {warc.LEAST_BYTES} GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
  CASE WHEN k.keeper <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN k.keeper <> d.page_id THEN k.keeper END AS refers_to, CAST(1 AS BIGINT) AS n_metadata
FROM d LEFT JOIN k USING (payload_digest)
"""


@query
def op3_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineclean.clean(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "cleaned", "loss")


ORACLES["op3_line_cleaning"] = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
w0 AS (SELECT rid, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
w5 AS (SELECT rid, i, word, lead(word, 1) OVER v AS a, lead(word, 2) OVER v AS b, lead(word, 3) OVER v AS c, lead(word, 4) OVER v AS e FROM w0 WINDOW v AS (PARTITION BY rid ORDER BY i)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, word, a, b, c, e) AS n FROM w5 WHERE e IS NOT NULL) WHERE n >= 2),
gap AS (SELECT rid, sum(CASE WHEN nx IS NULL OR nx - i > 5 THEN 5 ELSE nx - i END) AS n FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rep) GROUP BY rid),
ws AS (SELECT rid, count(*) AS n, sum(length(word)) AS chars FROM w0 GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
l1 AS (SELECT rid, line, lower(line) AS low, len(regexp_extract_all(line, '[#*$%&|<>{{}}\\\[\]~^_=+]')) AS sym, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(line, '[#*$%&|<>]{{3,}}')) AS noise FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
l2 AS (SELECT *, 10 * sym > 3 * length(line) OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}]') OR regexp_matches(line, '[!?#*$%&|]{{4,}}')
  OR (NOT regexp_matches(line, '[.!?:;,…"''”’»)\]][\x20\x09-\x0D]*$') AND len(w) >= {lineclean.LONG_LINE})
  OR (len(w) >= 2 AND 2 * noise >= len(w)) OR (len(w) >= {lineclean.STUTTER} AND 3 * len(list_distinct(w)) <= len(w))
  OR regexp_matches(low, '^[\x20\x09-\x0D]*(?:{lineclean.NAVIGATION})(?:[\x20\x09-\x0D]*[|>»·/-][\x20\x09-\x0D]*[^|>»·/]{{1,30}})*[\x20\x09-\x0D]*$')
  OR regexp_matches(line, '^[^|»>]{{0,30}}(?:[\x20\x09-\x0D]*[|»>][^|»>]{{0,30}}){{2,}}$')
  OR (length(line) <= 200 AND regexp_matches(low, '{lineclean.BOILERPLATE}')) AS bad FROM l1),
ls AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup, sum(length(line)) AS chars, sum(CASE WHEN bad THEN length(line) ELSE 0 END) AS lost, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS removed FROM l2 GROUP BY rid),
f AS (SELECT d.doc_id, coalesce(ws.n, 0) AS n_words, coalesce(ws.chars, 0) AS word_chars, len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, coalesce(ls.dup, 0) AS n_dup_lines, coalesce(gap.n, 0) AS n_repeat_words, coalesce(ls.chars, 0) AS chars, coalesce(ls.lost, 0) AS lost, coalesce(ls.removed, 0) AS removed FROM d LEFT JOIN ws USING (rid) LEFT JOIN gap USING (rid) LEFT JOIN ls USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {lineclean.MIN_WORDS} OR 100 * n_repeat_words > {lineclean.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {lineclean.MIN_WORDS} OR 100 * n_repeat_words > {lineclean.MAX_REPEAT_PERCENT} * n_words) AND 100 * lost <= {lineclean.MAX_LOSS_PERCENT} * chars AS kept,
  CAST(removed AS BIGINT) AS n_lines_removed FROM f
"""


@query
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


ORACLES["op9_source_mixing"] = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1 AS INTEGER)] AS BIGINT) AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
  3 * coalesce(sum(source_size) OVER v, 0) AS done, coalesce(sum(weight) OVER v, 0) AS gone
  FROM w WINDOW v AS (ORDER BY CAST(source_size * 3 AS DOUBLE) / CAST(weight AS DOUBLE), source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT *, CAST(total - done AS DOUBLE) / CAST(weights - gone AS DOUBLE) AS share FROM o),
c AS (SELECT *, share * CAST(weight AS DOUBLE) >= CAST(3 * source_size AS DOUBLE) AS capped FROM h),
e AS (SELECT share AS level FROM c WHERE NOT capped ORDER BY gone LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE (SELECT level FROM e) * CAST(weight AS DOUBLE) END AS target FROM c),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0.0::DOUBLE ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
  CAST(CAST(concat('0x', substr(md5(concat('{mixing.SEED}:', coalesce(CAST(d.doc_id AS VARCHAR), 'null'))), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM r
"""


@query
def op2_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokcount.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


@query
def op10_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spsample.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE))


@query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digest(table(spark, sf_dir, "documents"))


@query
def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordminhash.digest(table(spark, sf_dir, "documents"))


@query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(table(spark, sf_dir, "documents"))


ORACLES["op12_fill_in_middle"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{fim.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digits FROM documents),
h AS (SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n, CAST('0x' || substr(digits, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(digits, 9, 8) AS BIGINT) AS h2,
  CAST('0x' || substr(digits, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(digits, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {100 - fim.PLAIN_PERCENT} THEN 'plain'
    WHEN h4 % 100 < {fim.SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1, n - b) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CAPITALS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES["op13_importance_resampling"] = rf"""
WITH RECURSIVE step(i, k, c) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS v FROM step WHERE k = 8),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '{_LETTERS}') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), {_CAPITALS}), '{_LETTERS}') AS w FROM benchmark),
dw AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(w) AS word FROM d) GROUP BY ALL),
bw AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY ALL),
word AS (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)),
hashed AS (SELECT word, xor(list_reduce(list_transform(range(1, octet_length(encode(word)) + 1), lambda i: CAST('0x' || substr(hex(encode(word)), 2 * i - 1, 2) AS BIGINT)),
  lambda c, x: xor(c >> 8, v[CAST(xor(c, x) & 255 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), CAST(4294967295 AS BIGINT)) % {importance.BUCKETS} AS bucket FROM word, crc),
s AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS s FROM dw JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, CAST(sum(n) AS DOUBLE) AS t FROM bw JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM s) + {importance.BUCKETS})) / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM t) + {importance.BUCKETS})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT rid, CAST(sum(n * gain) AS BIGINT) AS weight FROM dw JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY rid),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{importance.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN w USING (rid)),
r AS (SELECT *, CASE WHEN n_features >= {importance.MIN_WORDS} THEN row_number() OVER (PARTITION BY n_features >= {importance.MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) END AS place,
  {importance.DRAW_PERCENT} * (count(*) FILTER (n_features >= {importance.MIN_WORDS}) OVER ()) // 100 AS draw FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= draw THEN place END AS rank FROM r
"""


@query
def op11_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(table(spark, sf_dir, "documents"))
