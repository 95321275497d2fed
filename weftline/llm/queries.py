"""The corpus operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, language, line_templates, near_dup, packing, phrase_index, pii, quality, toxicity, warc_zip
from .common import crc_mod, need, table

MAX_TOKENS = 2048


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_private(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 4) != 2)
    return out.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = language.identify(table(spark, sf_dir, "documents"), crc_mod("doc_id", 3) != 1)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), MAX_TOKENS)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(need(table(spark, sf_dir, "documents"), {"doc_id": "long", "text": "string"}))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc_zip.read_records(warc_zip.write_archives(table(spark, sf_dir, "pages")))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = phrase_index.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    near = F.size("near_items").cast("long").alias("n_near_items")
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated", near)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2:3].isdigit()}


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_DUPLICATES = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END, ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
  l AS (SELECT c.a, c.b FROM c JOIN n p ON p.doc_id = c.a JOIN n q ON q.doc_id = c.b WHERE 100 * shared >= 75 * (p.n + q.n - shared)),
  r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other),
  m AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id)
  SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(m.least, d.doc_id)) AS BIGINT) AS component_id, d.doc_id <= coalesce(m.least, d.doc_id) AS kept
  FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""

ARCHIVES = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages), f AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
  SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (digest)"""

CONTAMINATION = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
  s AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 13 THEN w ELSE w[i : i + 12] END AS ws FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
  g AS (SELECT item_id, len(ws) AS k, array_to_string(ws, ' ') AS x FROM s),
  k AS (SELECT DISTINCT k FROM g), o AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS x FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
  h AS (SELECT doc_id, i, o.k, item_id FROM o JOIN g ON g.x = o.x AND g.k = o.k),
  n AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM h) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY doc_id),
  p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS place FROM d), f AS (SELECT word, count(*) AS n FROM p GROUP BY word),
  u AS (SELECT ws, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS off FROM (SELECT DISTINCT ws FROM s)),
  r AS (SELECT ws, arg_min(u.word, coalesce(f.n, 0) * 100 + off) AS word FROM u LEFT JOIN f USING (word) GROUP BY ws),
  e AS (SELECT doc_id, count(DISTINCT item_id) AS n FROM (SELECT DISTINCT p.doc_id, r.ws FROM r JOIN p USING (word) JOIN d USING (doc_id) WHERE list_has_all(d.w[greatest(1, place - 20) : place + 20], r.ws)) JOIN s USING (ws) GROUP BY doc_id)
  SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(n.n, 0) > 0 AND 20 * coalesce(n.n, 0) >= len(d.w) AS contaminated, CAST(coalesce(e.n, 0) AS BIGINT) AS n_near_items FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN e USING (doc_id)"""


QUALITY = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, row_number() OVER () AS r FROM documents),
  l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
  n AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
  g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
  c AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS k FROM g) WHERE k > 1),
  p AS (SELECT r, count(DISTINCT at_) AS k FROM (SELECT r, unnest(range(i, i + 8)) AS at_ FROM c) GROUP BY r),
  s AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.k, 0) AS BIGINT) AS n_repeat_words, coalesce(lines, 0) AS n_lines FROM d LEFT JOIN n USING (r) LEFT JOIN p USING (r)),
  f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN n_words < 64 THEN 0 WHEN n_words < 256 THEN 1 WHEN n_words < 1024 THEN 2 ELSE 3 END AS stratum, word_chars / greatest(n_words, 1) AS mean FROM s),
  v AS (SELECT *, unnest(['symbols', 'lines', 'repeats', 'long', 'short']) AS rule, unnest([least(n_symbols / greatest(n_words, 1), 1.0), n_dup_lines / greatest(n_lines, 1), n_repeat_words / greatest(n_words, 1), least(mean / 32, 1.0), greatest(0.0, 1 - mean / 8)]) AS figure FROM f),
  m AS (SELECT doc_id, max(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
  b AS (SELECT stratum, rule, least(CAST(floor(figure * 64) AS INTEGER), 63) AS bin, good FROM v JOIN m USING (doc_id) WHERE NOT base_failed),
  q AS (SELECT stratum, rule, cut, count(*) FILTER (WHERE good AND bin >= cut) AS k, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good AND bin >= cut) - 10 * count(*) FILTER (WHERE good AND bin >= cut) AS gain
    FROM b, (SELECT unnest(range(1, 64)) AS cut) GROUP BY ALL),
  o AS (SELECT *, list_sum([exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)) FOR i IN range(0, k + 1)]) AS below FROM q WHERE gain > 0 AND k < n),
  e AS (SELECT stratum, rule, arg_max(cut, gain * 100 + cut) AS cut FROM o WHERE below <= 0.05 / 1280 GROUP BY ALL),
  x AS (SELECT v.r, bool_or(coalesce(v.figure * 64 >= e.cut, false)) AS rejected FROM v LEFT JOIN e USING (stratum, rule) GROUP BY v.r)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM f JOIN x USING (r)"""

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
WORD = r"[\p{L}\p{M}]{3,}"


def _places(kind: str, pattern: str, rows: str) -> str:
    """Matches of a pattern with their places, from their lengths and those of the pieces between them."""
    found = f"SELECT r, unnest(regexp_extract_all(t, '{pattern}')) AS v, unnest(string_split_regex(t, '{pattern}')) AS piece, unnest(range(0, len(string_split_regex(t, '{pattern}')))) AS k FROM {rows}"
    ends = "sum(length(piece) + length(v)) OVER (PARTITION BY r ORDER BY k)"
    return f"SELECT r, '{kind}' AS kind, v, {ends} - length(v) AS a, {ends} AS b FROM ({found}) WHERE v IS NOT NULL"


PRIVATE = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents), u AS (SELECT count(*) AS total FROM d),
  i AS ({_places('email', EMAIL, 'd')} UNION ALL SELECT * FROM ({_places('ip', '[0-9]+(?:[.][0-9]+)(?:[.][0-9]+)(?:[.][0-9]+)', 'd')}) WHERE regexp_full_match(v, '(?:{OCTET}[.]){{3}}{OCTET}')
    UNION ALL SELECT r, kind, v, a, b FROM (SELECT *, reverse(regexp_replace(v, '[^0-9]', '', 'g')) AS x FROM ({_places('card', '[0-9](?:[ -]?[0-9])+', 'd')}))
      WHERE length(x) BETWEEN 13 AND 19 AND list_sum([CASE WHEN k % 2 = 1 THEN x[k]::INT WHEN x[k]::INT > 4 THEN 2 * x[k]::INT - 9 ELSE 2 * x[k]::INT END FOR k IN range(1, length(x) + 1)]) % 10 = 0
    UNION ALL SELECT * FROM ({_places('phone', '[+][0-9][ ().0-9-]+[0-9]', 'd')}) WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 9 AND 15),
  h AS (SELECT DISTINCT r, concat(kind, CASE WHEN kind IN ('card', 'phone') THEN regexp_replace(v, '[^0-9]', '', 'g') ELSE lower(v) END) AS c FROM i), n_c AS (SELECT c, count(*) AS nc FROM h GROUP BY c),
  o AS (SELECT lower(w) AS w, count(DISTINCT r) AS nt FROM (SELECT r, unnest(regexp_extract_all(t, '{WORD}')) AS w FROM d) GROUP BY 1),
  q AS (SELECT w[:3] AS q, max(nt) AS top FROM o GROUP BY 1),
  p AS (SELECT r, lower(v) AS w, a, b FROM ({_places('term', EMAIL + '|' + WORD, '(SELECT * FROM d WHERE r IN (SELECT r FROM h))')}) WHERE NOT contains(v, '@')),
  j AS (SELECT w, c, count(*) AS nj FROM (SELECT DISTINCT r, w FROM p) JOIN h USING (r) GROUP BY ALL),
  z AS (SELECT w, c, nc FROM j JOIN n_c USING (c) JOIN o USING (w), u WHERE nc > 1 AND nj > 1 AND nc < total AND 1 - ln((nj - 1) / (nt - 0.5)) / ln((nc - 1) / (total - 1)) >= 0.9),
  y AS (SELECT DISTINCT p.r, p.a, p.b FROM p JOIN h USING (r) JOIN z USING (w, c)),
  s AS (SELECT r, kind, a, b, list_position(['email', 'ip', 'card', 'phone', 'term'], kind) AS k FROM i UNION ALL SELECT r, 'term', a, b, 5 FROM y),
  g AS (SELECT r, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
    string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY k, a) FILTER (WHERE k < 5) AS base, string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY k, a) AS spans FROM s GROUP BY r)
  SELECT doc_id, CAST(coalesce(n_email, 0) AS BIGINT) AS n_email, CAST(coalesce(n_ip, 0) AS BIGINT) AS n_ip, CAST(coalesce(n_card, 0) AS BIGINT) AS n_card, CAST(coalesce(n_phone, 0) AS BIGINT) AS n_phone,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": PRIVATE, "op6_quality_rules": QUALITY, "op8_near_duplicates": NEAR_DUPLICATES, "op9_warc": ARCHIVES, "op10_decontamination": CONTAMINATION}
