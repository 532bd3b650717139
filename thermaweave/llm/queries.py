"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, chat, decontam, exact, lm, packing, quality, repair, secrets, sharding, simhash, toxicity
from .common import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where does each piece of each document stand in sequences of 2048 tokens?"""
    parts = packing.pieces(read(spark, sf_dir, "documents")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(parts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are linked by fingerprints that differ in at most three bits?"""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents share a passage with which benchmark item?"""
    return decontam.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which secrets stand where in each document?"""
    return secrets.digest(secrets.scan(read(spark, sf_dir, "documents")))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely is each document toxic?"""
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


@query
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely is each document of good quality?"""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, read(spark, sf_dir, "labels")))


@query
def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which 20 vectors have the largest inner product with each vector whose id is divisible by 20?"""
    return ann.search(read(spark, sf_dir, "embeddings"))


@query
def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shard of at most a mebibyte of text holds each document?"""
    placed, _ = sharding.assign(read(spark, sf_dir, "documents"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return placed.select("doc_id", size.alias("bytes"), "shard_depth", "shard_prefix")


ORACLES["op6_sharding"] = sharding.ORACLE


@query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from each formatted conversation?"""
    talks = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return chat.digests(chat.turns(talks.unionByName(extra)))


@query
def op9_language_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How probable is each document for a unigram and for a context-mixing model?"""
    return lm.score(read(spark, sf_dir, "documents"))


@query
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How do two tokenizers align on each document, and how common are its links?"""
    return align.alignments(read(spark, sf_dir, "documents"))


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays for each text?"""
    return exact.assign(read(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = exact.ORACLE


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with each damaged conversation, and what is its cheapest repair?"""
    return repair.repair(repair.damage(read(spark, sf_dir, "conversations")))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
