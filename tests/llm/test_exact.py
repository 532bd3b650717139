import hashlib
import re

from pyspark.sql import functions as F

from thermaweave.llm import exact
from thermaweave.llm.queries import QUERIES


def brute(rows):
    """(id, text) rows to id, keep_id, size, sha; ids are not NULL."""
    groups: dict = {}
    for key, text in rows:
        sha = hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", text or "").encode()).hexdigest()
        groups.setdefault(sha, []).append(key)
    return sorted((k, min(g), len(g), k == min(g), sha) for sha, g in groups.items() for k in g)


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op12_exact_dedup"](spark, sf_dir).collect()) == brute(rows)


def test_hot_texts_need_no_shuffle(spark):
    docs = spark.range(20_000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot\t one").when(F.col("id") % 7 == 0, "hot two").otherwise(F.concat(F.lit("x "), (F.col("id") % 9000).cast("string"))).alias("text"),
    ).repartition(12)
    assert sorted(tuple(r) for r in exact.assign(docs).collect()) == brute([tuple(r) for r in docs.collect()])
    rows = docs.select(F.col("doc_id").alias("_id"), F.monotonically_increasing_id().alias("_row"), exact.digest("text").alias("_sha"))
    heavy = exact.frequent(rows, 20_000).collect()
    assert sorted(r["_size"] for r in heavy) == [1905, 6667]
    assert exact.frequent(rows, 20_000, winners=4).count() == 1


def test_few_counters_change_nothing(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 50).cast("string").alias("text"))
    want = brute([tuple(r) for r in docs.collect()])
    for counters, winners in ((8, 4), (64, 1000), (8192, 1)):
        assert sorted(tuple(r) for r in exact.assign(docs, counters=counters, winners=winners).collect()) == want


def test_edge_rows(spark):
    long = "ab \n" * 300_000
    rows = [(5, "a  b", 1), (3, "a\tb", 2), (3, "a\r\n b", 3), (None, "a b", 4), (None, None, 5), (None, "", 6), (9, " ", 7), (8, long, 8), (7, long.replace(" \n", "\x0b"), 9), (2, "a b", 10), (1, " a b", 11)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _row int").repartition(3)
    got = sorted((tuple(r)[:4] for r in exact.assign(docs).collect()), key=str)
    assert got == sorted([
        (5, 3, 4, False), (3, 3, 4, True), (3, 3, 4, False), (None, 3, 4, False), (None, None, 2, True), (None, None, 2, False), (9, 9, 1, True),
        (8, 7, 2, False), (7, 7, 2, True), (2, 2, 1, True), (1, 1, 1, True),
    ], key=str)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 7, 9]
    assert exact.assign(docs.limit(0)).count() == 0 and exact.keep_one(docs.limit(0)).count() == 0


def test_no_python_worker(spark, sf_dir):
    plan = QUERIES["op12_exact_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
