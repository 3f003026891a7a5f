"""The document pipeline: language ID, near-duplicates, decontamination, secret redaction, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns the documents that stay, with the columns of documents; the last
returns their token ids.  Rows that a stage drops are named by id, so a row with a null doc_id always stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from feedweave.llm import bpe, decontaminate, language_id, minhash, secret_scan
from feedweave.llm.common import table, without

#: Word encodings that a worker remembers here: beside what the executor keeps from the stages before, fewer than alone.
ROOM = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified."""
    return language_id.keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return without(docs, minhash.near_duplicates(docs).where("not kept").select("doc_id"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select("doc_id"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark; n_chars follows the text."""
    return secret_scan.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of each document."""
    return bpe.encode_documents(docs, bpe.word_bpe_path(), room=ROOM, decode=False).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", deduplicate),
    ("decontaminate", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("bpe", encode),
]

#: Minima, randomness tests and merge lists are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
