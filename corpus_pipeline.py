"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermaweave.llm import decontam, packing, secrets, similar, toxicity
from thermaweave.llm.common import read, staged

#: Near duplicates here: shingles of five words whose sets have a Jaccard similarity of 0.8 or more.
WORDS, SIMILARITY = 5, 0.8
#: Radius of the earlier rule (fingerprints only), which no stage uses.
BITS = 6


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return similar.keep_one(docs, WORDS, SIMILARITY)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets' values in texts give way to a mark; ``n_chars`` follows."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    parts = packing.pieces(docs).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(parts)


STAGES = [
    ("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scans", hide_secrets), ("best_fit_packing", pack_sequences),
]

#: SQL expresses neither the trained machine nor the tokenizer: tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
