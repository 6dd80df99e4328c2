"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from querywright.llm import bpe, langid, matroska, packing, pii, quality, rollup, simhash, suffix, warc
from querywright.llm.common import fresh_dir, table


def op1_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    found = langid.identify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "mixture")


def op2_matroska_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_digests(table(spark, sf_dir, "documents"))


def op3_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), bpe.default_path()
    return bpe.encode_decode(docs, path, bpe.lexicon_of(spark, docs, path))


def op5_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op6_warc_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.corpus_rollup(table(spark, sf_dir, "documents"), bpe.default_path(), fresh_dir(spark, "rollup"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_digests(table(spark, sf_dir, "documents"))


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_two_fit(table(spark, sf_dir, "documents"), bpe.default_path())


def op10_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_language_mixture, op2_matroska_media, op3_simhash_gray, op4_bpe_lexicon, op5_pii_deobfuscation,
        op6_warc_shards, op7_token_rollups, op8_suffix_dedup, op9_best_two_fit, op10_line_quality,
    )
    return {f.__name__: f for f in found}


BLANKS = "[\\x20\\x09-\\x0D]+"
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
d AS (SELECT p.page_id, f.first_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes,
        list_transform(range(0, 8), lambda i: CAST('0x' || substr(sha1(p.h), CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT)) AS v
      FROM p JOIN f ON p.h = f.h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(v, lambda x: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 10) % 32 + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x % 32 + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
QUALITY_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{blanks}'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM d),
x AS (SELECT doc_id, unnest(w) AS a, unnest(range(1, len(w) + 1)) AS i FROM s),
g AS (SELECT doc_id, i, a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY i) AS b, lead(a, 2) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM x),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g WHERE c IS NOT NULL),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS j FROM c, (VALUES (0), (1), (2)) AS o(k) WHERE n > 1) GROUP BY doc_id),
e AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM s),
q AS (SELECT doc_id, line, i,
    len(line) - len(replace(line, '|', '')) >= 4 OR len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 10 > len(regexp_replace(line, '{blanks}', '', 'g'))
    OR len(line) - len(regexp_replace(line, '[{arrows}]', '', 'g')) >= 3
    OR ((len(line) - len(replace(line, '!!', ''))) / 2 >= 3 AND len(regexp_replace(line, '\\p{{Lu}}+', '', 'g')) * 2 < len(line))
    OR regexp_matches(lower(line), '{boiler}')
    OR (NOT regexp_matches(line, '[.,;:!?…。！？]') AND len(list_filter(regexp_split_to_array(line, '{blanks}'), lambda v: v <> '')) >= 25) AS bad,
    regexp_matches(line, '[^\\x20\\x09-\\x0D]') AS solid FROM e),
m AS (SELECT doc_id, count(*) FILTER (WHERE bad) AS removed, coalesce(sum(len(regexp_replace(line, '{blanks}', '', 'g'))) FILTER (WHERE NOT bad), 0) AS rest,
    count(line) FILTER (WHERE solid) - count(DISTINCT line) FILTER (WHERE solid) AS dup FROM q GROUP BY doc_id),
z AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '{blanks}', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(m.dup AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(m.removed AS BIGINT) AS n_lines_removed, m.rest FROM s JOIN m ON m.doc_id = s.doc_id LEFT JOIN r ON r.doc_id = s.doc_id),
y AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (n_lines_removed = 0 OR rest >= 0.5 * word_chars) AS kept, n_lines_removed FROM y
""".format(blanks=BLANKS, arrows=quality.ARROWS, boiler="|".join(x.replace("(", "\\(").replace(")", "\\)") for x in quality.BOILERPLATE))


def oracle_sql() -> dict[str, str]:
    """Mixtures, media, fingerprints, vocabularies, deobfuscation, suffix orders and packings are not for SQL; tests hold
    them against brute force, the libraries, or exact round trips."""
    return {"op6_warc_shards": WARC_SQL, "op10_line_quality": QUALITY_SQL}
