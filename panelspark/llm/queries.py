"""Registered queries of the text operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from panelspark.llm import bpe, decontaminate, hard_negatives, langid, main_text, packing, piece_count, prefix_trie, quality_lm, quality_rules, simhash, token_files, tool_links
from panelspark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: The id that ends a document in token files.
END_ID = 2
#: The id that ends a document in packed sequences.
PACKED_END_ID = 0


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs)
    marked = docs.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "text")
    return langid.predict(marked, model, passed=("doc_id", "held_out"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text.extract(table(spark, sf_dir, "pages"))
    return out.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op3_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_links.conversation_links(table(spark, sf_dir, "conversations"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    strings = decontaminate.Strings(table(spark, sf_dir, "benchmark"))
    found = decontaminate.find(table(spark, sf_dir, "documents"), strings).withColumn("n_hit", decontaminate.n_hit())
    listed = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (decontaminate.ONE_IN * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    back = token_files.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    n = F.octet_length("ids") / 4
    return back.select("doc_id", "start", n.cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    out = piece_count.count_tokens(sized, public_tokenizers.path("piece_bpe_32k.model"), passed=("doc_id", "n_bytes"))
    return out.withColumn("over_limit", F.col("n_tokens") > piece_count.LIMIT)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names = quality_rules.order(quality_rules.measure(docs))
    # which rule failed first depends on measured times, so it is no part of the result
    return quality_rules.judge(docs, names).drop("failed_rule")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), PACKED_END_ID)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "queue")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))
    return nodes.withColumn("depth", F.col("depth").cast("bigint"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_main_text": op2_main_text,
    "op3_quality_lm": op3_quality_lm,
    "op4_tool_links": op4_tool_links,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_files": op6_token_files,
    "op7_simhash": op7_simhash,
    "op8_token_counts": op8_token_counts,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_packing": op11_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
    "pipeline": corpus_pipeline.run,
}

_WORDS_OF = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS_OF.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
strings AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS size, array_to_string(w[p + 1 : p + 13], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 12, 1))) AS p FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_OF.format("coalesce(text, '')")} AS w FROM documents),
places AS (
  SELECT r, p, z.size, array_to_string(w[p + 1 : p + z.size], ' ') AS s
  FROM (SELECT r, w, unnest(range(len(w))) AS p FROM doc_words) t, (SELECT DISTINCT size FROM strings) z
  WHERE p + z.size <= len(w)),
hits AS (SELECT r, p, places.size, item_id FROM places JOIN strings ON places.s = strings.s AND places.size = strings.size),
marked AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc_words LEFT JOIN marked USING (r) LEFT JOIN found USING (r)
"""

_SPACE = r"\x20\x09-\x0D"
_TRIM = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP9_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^{_SPACE}]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{_SPACE}]')) AS lines
  FROM documents),
windows AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, w[p + 1], w[p + 2], w[p + 3]) AS times
  FROM (SELECT r, w, unnest(range(len(w) - 2)) AS p FROM d WHERE len(w) > 2)),
repeated AS (
  SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM windows WHERE times > 1) GROUP BY r),
base AS (
  SELECT d.*, len(w) AS n_words, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(repeated.n, 0) AS n_repeat_words,
    list_sum(list_transform(lines, lambda x: length(x))) AS line_chars,
    list_sum(list_transform(list_distinct(lines), lambda x: length(x))) AS own_chars
  FROM d LEFT JOIN repeated USING (r)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  coalesce(NOT base_failed
    AND chars >= {quality_rules.MEAN_WORD_CHARS[0]} * n_words AND chars <= {quality_rules.MEAN_WORD_CHARS[1]} * n_words
    AND n_symbols <= {quality_rules.MAX_SYMBOLS_PER_WORD} * CAST(n_words AS DOUBLE)
    AND line_chars - own_chars <= {quality_rules.MAX_DUP_LINE_CHARS} * CAST(line_chars AS DOUBLE)
    AND len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) >= {quality_rules.MIN_WORDS_WITH_LETTER} * CAST(n_words AS DOUBLE)
    AND len(list_filter(lines, lambda x: regexp_matches(x, '^[{_SPACE}]*[-*•‣●]'))) <= {quality_rules.MAX_BULLET_LINES} * CAST(len(lines) AS DOUBLE)
    AND len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[{_SPACE}]*$'))) <= {quality_rules.MAX_ELLIPSIS_LINES} * CAST(len(lines) AS DOUBLE)
    AND len(list_filter(w, lambda x: length(x) > 1 AND regexp_matches(x, '\p{{Lu}}') AND NOT regexp_matches(x, '\p{{Ll}}')))
      <= {quality_rules.MAX_UPPER_WORDS} * CAST(n_words AS DOUBLE), false) AS kept
FROM judged
"""

ORACLES: dict[str, str] = {"op4_tool_links": tool_links.SQL, "op5_decontaminate": OP5_SQL, "op9_quality_rules": OP9_SQL, "op12_prefix_trie": prefix_trie.SQL, "op13_hard_negatives": hard_negatives.SQL}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
