"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from grouptrace.llm import byte_bpe, decontamination, jaccard_join, license_scan, oracles, periodic_runs, quality_rules, spelling_variants, substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, warc, words
from grouptrace.session import apply_runtime_conf


VOCABULARY = "byte_bpe_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
LONGEST = 1024


def _table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    words.small_batches(spark)
    return apply_runtime_conf(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents", "doc_id", "text")
    coded = byte_bpe.coded(documents, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select(
        "row.doc_id", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"),
        F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents", "doc_id", "text")
    return decontamination.leaks(documents, _table(spark, sf_dir, "benchmark", "item_id", "text"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.without_repeats(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select(
        "row.doc_id", "n_words", "n_removed", "spans", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256")
    )


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines",
        "n_stop_words",
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = substring_dedup.parsed(_table(spark, sf_dir, "documents", "doc_id", "text"))
    return parsed.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.joined(_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judged(
        _table(spark, sf_dir, "pages", "page_id", "url"), url_filter.BLOCK_RULES, url_filter.ALLOW_RULES,
        url_filter.LISTED_NAMES,
    )
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents", "doc_id", "text")
    labels = _table(spark, sf_dir, "labels", "doc_id", "toxic")
    return toxicity.classified(documents, labels).select("row.doc_id", "held_out", "score", "predicted")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.counted(_table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path(TOKENIZER))
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LONGEST).alias("over_limit"))


def planted_runs(documents: DataFrame) -> DataFrame:
    """Documents of whose ids' checksums ten is a divisor repeat a stretch of their own words up to the end of the text."""
    checksum, words_of = F.crc32(F.col("doc_id").cast("string")), r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)"
    g, n = F.floor(checksum / 10), F.size("_words")
    chosen = documents.withColumn("_words", F.when(checksum % 10 == 0, F.expr(words_of)))
    chosen = chosen.withColumn("_n", n).withColumn("_a", F.when(n > 0, F.pmod(g, n)).cast("int"))
    chosen = chosen.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + g % 8))).cast("int"))
    planted = F.expr(
        "array_join(concat(slice(_words, 1, _a), slice(flatten(array_repeat(slice(_words, _a + 1, _p), "
        "cast(ceil((_n - _a) / _p) as int))), 1, _n - _a)), ' ')"
    )
    return chosen.withColumn("text", F.when(F.col("_n") > 0, planted).otherwise(F.col("text"))).select(*documents.columns)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.found(planted_runs(_table(spark, sf_dir, "documents", "doc_id", "text")))
    by_length = F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("a"), (-r.period).alias("b")))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n")))
    found = found.withColumn("best", F.array_max(by_length))
    return found.select(
        "row.doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.a")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.b")).alias("period"), F.expr("1000 * best.length div -best.b").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.grouped(_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_decontamination": op2_decontamination,
    "op3_license_scan": op3_license_scan,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_toxicity": op10_toxicity,
    "op11_token_counts": op11_token_counts,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE = {
    "op3_license_scan": license_scan.oracle_sql(),
    "op5_warc": warc.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op7_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op8_jaccard_join": oracles.JACCARD_JOIN,
    "op9_url_filter": url_filter.ORACLE_SQL,
}
