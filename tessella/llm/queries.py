"""One query per operator, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, decontaminate, html_text, pii, quality, shard, simhash, suffix_dedup, token_files, toxicity
from tessella.llm._common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(table(spark, sf_dir, "documents"))


def op4_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.placed(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit_from_tables(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


# --- parts of the above that SQL expresses ---------------------------------------------------------------------------


def pii_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_quality(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") | ~F.col("kept")).alias("base_holds"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bytes and slots of all shards together, and whether counts differ by one at most and slots have no gap."""
    each = op7_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("size"), (F.count_distinct("slot") == F.count("*")).alias("own"), (F.max("slot") + 1 == F.count("*")).alias("gapless"))
    return each.agg(F.sum("n").alias("n_rows"), F.sum("size").alias("n_bytes"), (F.max("n") - F.min("n") <= 1).alias("even"), F.min(F.col("own") & F.col("gapless")).alias("gapless"), F.count("*").alias("n_shards"))


_DIGITS_OF = "regexp_replace(m, '[^0-9]', '', 'g')"
_PII_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
luhn AS (SELECT doc_id, {_DIGITS_OF} AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]([\x20-]?[0-9])+')) AS m FROM t)),
cards AS (SELECT doc_id, count(*) AS n FROM luhn WHERE length(d) BETWEEN 14 AND 19 AND list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(d, CAST(length(d) - i AS BIGINT), 1) AS INTEGER) ELSE (2 * CAST(substr(d, CAST(length(d) - i AS BIGINT), 1) AS INTEGER)) % 10 + (2 * CAST(substr(d, CAST(length(d) - i AS BIGINT), 1) AS INTEGER)) // 10 END)) % 10 = 0 GROUP BY 1)
SELECT t.doc_id,
 CAST(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
 CAST(len(list_filter(regexp_extract_all(text, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: len(list_filter(string_split(m, '.'), lambda p: CAST(p AS HUGEINT) > 255)) = 0)) AS BIGINT) AS n_ip,
 CAST(coalesce(cards.n, 0) AS BIGINT) AS n_card,
 CAST(len(list_filter(regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), lambda m: length({_DIGITS_OF}) BETWEEN 10 AND 15)) AS BIGINT) AS n_phone
FROM t LEFT JOIN cards USING (doc_id)"""
_QUALITY_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
one AS (SELECT doc_id, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM one) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(3) r(k) GROUP BY 1),
m AS (SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
 CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
 FROM t JOIN w USING (doc_id) LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, true AS base_holds FROM m"""
_SHARD_SQL = "SELECT count(*) AS n_rows, CAST(sum(octet_length(encode(coalesce(text, ''))) + 1) AS BIGINT) AS n_bytes, true AS even, true AS gapless, CAST(16 AS BIGINT) AS n_shards FROM documents"

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_pii, op3_byte_bpe, op4_arrow_tokens, op5_quality, op6_simhash, op7_sharding, op8_suffix_dedup, op9_toxicity, op10_html, pii_base_counts, quality_base, shard_law)}
#: DuckDB SQL of those that SQL expresses; the others are tested against brute force in tests/llm.
ORACLE: dict[str, str] = {"pii_base_counts": _PII_SQL, "quality_base": _QUALITY_SQL, "shard_law": _SHARD_SQL}
