"""Corpus pipeline: quality rules, near-duplicate removal, benchmark
decontamination, redaction of personal data, BPE encoding.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns the documents that the next stage gets, with the columns of
``documents``; the last returns their encoding. Each stage works on all rows its
predecessor kept. ``n_chars`` follows the text.

Defined cases: a stage's decisions on null, empty, repeated and tied rows are
those of its operator. Documents without a text are rejected by the quality
rules (they have no words); a row whose id is null is never a copy; rows that
repeat an id and a text are one document to the near-duplicate stage and all
stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.llm import bpe_codec, decontam, near_dedup, pii, quality
from eventide.llm.queries import vocab_file
from eventide.session import scratch_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# Near duplicates: a shingle of five words, similarity of at least 0.8.
SIMILARITY_PERCENT = 80


def _documents(rows: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``documents`` with the given column as text."""
    return rows.select("doc_id", F.col(text).alias("text"), "lang", "source",
                       F.length(text).cast("long").alias("n_chars"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Accepted documents without the lines that failed."""
    return _documents(quality.clean(docs).where("kept"), "clean_text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the smallest id."""
    return near_dedup.keep_one(docs, percent=SIMILARITY_PERCENT).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; mostly benchmark text goes whole."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _documents(decontam.remove_spans(docs, items))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return _documents(pii.find(docs, pii.fit(docs)), "redacted")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of ids and decoded text."""
    return bpe_codec.encode(docs, vocab_file(), decoded=False).select(
        "doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("BPE encoding", encoding),
]

# BPE encoding and boosted trees are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written as Parquet
    and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark, "pipeline")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
