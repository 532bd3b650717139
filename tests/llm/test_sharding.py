import hashlib

from pyspark.sql import functions as F

from compare import difference
from thermaweave.llm import sharding
from thermaweave.llm.queries import ORACLES, QUERIES


def test_query_against_sql(spark, con, sf_dir):
    assert difference(spark, con, sf_dir, "op6_sharding", QUERIES, ORACLES) is None


def plain(rows, limit):
    """Split one bit at a time; rows are (hash, bytes)."""
    out, todo = {}, [(0, 0, rows)]
    while todo:
        depth, prefix, own = todo.pop()
        if not own:
            continue
        if sum(b for _, b in own) <= limit or len({h for h, _ in own}) == 1:
            out[depth, prefix] = (sum(b for _, b in own), len(own))
            continue
        for bit in (0, 1):
            todo.append((depth + 1, 2 * prefix + bit, [r for r in own if r[0] >> (59 - depth) & 1 == bit]))
    return out


def test_directory_against_splitting(spark):
    rows = [(int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), 1 + k * 37 % 100) for k in range(3000)]
    rows += [(rows[5][0] ^ 1, 90), (rows[5][0] ^ 3, 70), (rows[7][0], 10_000)]  # nearly equal hashes; one over the limit
    df = spark.createDataFrame(rows, "_h bigint, _bytes bigint")
    for limit in (150, 5000, 10**9):
        got = {(r.depth, r.prefix): (r.bytes, r.rows) for r in sharding.directory(df, limit).collect()}
        assert got == plain(rows, limit)


def test_edge_rows(spark):
    rows = [(1, None, 9), (None, "abc", 9), (2, "x" * 500, 9)] + [(3, "y" * 60, 9)] * 40 + [(4, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard_depth int")
    placed, shards = sharding.assign(docs, 200)
    assert sorted(placed.columns) == sorted(["doc_id", "text", "shard_depth", "shard_prefix"])
    sums = placed.groupBy("shard_depth", "shard_prefix").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == len(rows) and all(r.n == 1 for r in sums if (r.b or 0) > 200) and len(sums) > 12
    assert {(r.depth, r.prefix) for r in shards.collect()} == {(r.shard_depth, r.shard_prefix) for r in sums}
    empty, none = sharding.assign(docs.limit(0), 200)
    assert empty.count() == 0 and none.count() == 0


def test_written_shards(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    shards = sharding.write(docs, str(tmp_path / "out"), 50_000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and shards.where("bytes > 50000 AND rows > 1").count() == 0
