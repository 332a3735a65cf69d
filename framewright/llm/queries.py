"""The corpus operators as queries over whole tables, each with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import digest_texts
from .common import LOWER, UPPER, table
from .exact_dedup import exact_dedup
from .html_text import extract_main_text
from .licenses import license_scan
from .packing import harmonic_pack
from .quality_rules import KEEP_SHARE, LINE_DOCS, LINE_SHARE, MIN_WORDS, quality_rules
from .sharding import shard_query
from .simhash import near_duplicates
from .substring_dedup import WINDOW, digest
from .toxicity import toxicity


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by models fitted to its labels."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate group."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of packed sequences."""
    return harmonic_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, language, thousands of doc_id; each fiftieth document is its folder's file LICENSE."""
    folder = F.floor(F.col("doc_id") / 1000).cast("string")
    name = F.when(F.col("doc_id") % 50 == 0, "LICENSE").otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", "source", "lang", folder, name)
    return license_scan(table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and the verdict of the line rules."""
    return quality_rules(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equal texts that stays."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words, and how many repeats take."""
    return digest(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal bytes."""
    return shard_query(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded, as digests."""
    return digest_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


OP6_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT id, unnest(range(len(w) - 2)) AS i,
         unnest(list_transform(range(len(w) - 2), lambda i: w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) AS g
  FROM d WHERE len(w) >= 3),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM grams) WHERE c > 1),
repeats AS (SELECT id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) AS v(k) GROUP BY id),
lines AS (SELECT id, host, l FROM (SELECT id, host, unnest(string_split(t, chr(10))) AS l FROM d)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
dups AS (SELECT id, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY id),
norm AS (SELECT id, host, lower(array_to_string(regexp_extract_all(l, '[^\x20\x09-\x0D]+'), ' ')) AS l,
                len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS n FROM lines),
hosts AS (SELECT host, count(*) AS n FROM d GROUP BY host),
often AS (SELECT host, l FROM (SELECT host, l, count(DISTINCT id) AS n FROM norm GROUP BY host, l) AS c JOIN hosts USING (host)
          WHERE c.n > {LINE_DOCS} AND c.n > {LINE_SHARE} * hosts.n),
gone AS (SELECT id, sum(n) AS n FROM norm JOIN often USING (host, l) GROUP BY id),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dups.n, 0)::BIGINT AS n_dup_lines, coalesce(repeats.n, 0)::BIGINT AS n_repeat_words,
         coalesce(gone.n, 0)::BIGINT AS n_line_words
  FROM d LEFT JOIN dups USING (id) LEFT JOIN repeats USING (id) LEFT JOIN gone USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_line_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
       AND NOT (n_line_words > 0 AND (n_words - n_line_words < {MIN_WORDS} OR n_words - n_line_words < {KEEP_SHARE} * n_words)) AS kept
FROM m
"""

OP7_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


OP8_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT id, unnest(range(len(w) - {WINDOW - 1})) AS i,
         unnest(list_transform(range(len(w) - {WINDOW - 1}), lambda i: sha256(array_to_string(w[i + 1 : i + {WINDOW}], ' ')))) AS k
  FROM d WHERE len(w) >= {WINDOW}),
again AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY k) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT id, i + j AS i FROM again, range({WINDOW}) AS r(j)),
words AS (SELECT id, unnest(range(len(w))) AS i, unnest(w) AS word FROM d),
kept AS (SELECT id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (id, i) GROUP BY id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All corpus queries by name."""
    return {f.__name__: f for f in (op1_toxicity, op2_simhash, op3_packing, op4_licenses, op5_html_text, op6_quality_rules, op7_exact_dedup, op8_substring_dedup, op9_sharding, op10_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    """The SQL of those that SQL can say; tests hold the others against plain versions."""
    return {"op6_quality_rules": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op8_substring_dedup": OP8_SQL}
