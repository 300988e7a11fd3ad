"""From raw documents to tokens: the stages of the training-data pipeline.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept;
`run` writes each result as Parquet and reads it again. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspan.llm import bpe, decontam, line_dedup, ngram_join, quality
from linkspan.llm.common import read
from linkspan.sources.scratch import settle

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or that the forest rejects go."""
    stats = settle(quality.measure(docs.select("doc_id", "text")).drop("text"), "quality")
    return quality.passing(docs, stats, read(spark, sf_dir, "labels"))


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of two or more lines go; so do documents that had words and have none left."""
    cleaned = line_dedup.dedup(docs)
    word = r"[^\x20\x09-\x0D]"
    left = F.coalesce(F.col("text").rlike(word), F.lit(False)) | (F.col("removed_chunks") == 0)
    return cleaned.where(left).withColumn(
        "n_chars", F.when(F.col("removed_chunks") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by 80 % common five-word shingles the first stays, and once."""
    near = settle(ngram_join.near_duplicates(docs, share=80, words=5), "near")
    return ngram_join.once(ngram_join.kept(docs, near), near)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontam.clean(docs, read(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document, with a digest of what they decode to."""
    vocabulary = bpe.Vocabulary(spark, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    made = bpe.encode(docs, vocabulary, decoded=True, keep=["doc_id", "lang", "source"], forget=True)
    return made.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_chunks),
    ("jaccard_join", one_of_each),
    ("decontamination", without_benchmark),
    ("byte_bpe", tokens),
]

#: The forest of the first stage is no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
