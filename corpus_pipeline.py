"""The corpus pipeline: from raw documents to token ids.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and works on all documents that its predecessor kept;
each result is written as Parquet and read again as the next one's docs. All but the last return the columns of documents.
Rows without a doc_id pass the filtering stages; a null text counts as empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grouptrace.llm import byte_bpe, decontamination, jaccard_join, suffix_dedup, toxicity, words
from grouptrace.session import apply_runtime_conf, materialize

VOCABULARY = "byte_bpe_50k.tiktoken"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    words.small_batches(apply_runtime_conf(spark))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from the labels of the documents at hand."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return toxicity.classified(docs, labels).where("predicted = 0").select("row.*")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id; of rows alike in doc_id and text, one."""
    words.small_batches(apply_runtime_conf(spark))
    joined = materialize(jaccard_join.joined(docs), "components")
    first = joined.where("component_id = doc_id").select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(docs.columns)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words and more that a smaller doc_id has too. A text that loses all its words goes."""
    words.small_batches(apply_runtime_conf(spark))
    cut = suffix_dedup.without_repeats(docs).where("n_words = 0 OR n_removed < n_words")
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long"))}
    columns = []
    for name in docs.columns:
        old = F.col(f"row.`{name}`") if name != "text" else None
        columns.append((new["text"] if name == "text" else F.coalesce(new[name], old) if name == "n_chars" else old).alias(name))
    return cut.select(*columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no passage of a benchmark item."""
    benchmark = _read(spark, sf_dir, "benchmark").select("item_id", "text")
    leaked = decontamination.leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(leaked, "doc_id", "left_anti").select(docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, with the digests of the ids and of the bytes that they decode to."""
    words.small_batches(apply_runtime_conf(spark))
    coded = byte_bpe.coded(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select(
        "row.doc_id", "row.lang", "row.source", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), "tokens",
        F.sha2("tokens", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("suffix_array_dedup", without_repeated_passages),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", encoded),
]

#: The classifier and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
