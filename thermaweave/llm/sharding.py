"""Sharding by extendible hashing, with DataFrame functions only.

Every row has a hash of its id; a shard is a prefix of hash bits. All rows start in one bucket, and
only a bucket over its byte limit splits on one more bit, until each fits. The directory is found from sums
per prefix: rows are reduced to a histogram of leading bits before they are shuffled, all prefixes of it
are summed, and of the prefixes of a row the shortest that fits is its shard. Buckets that still do not fit at the histogram's depth
are looked at again, deeper; nothing else is read again.

A bucket whose rows all have one hash cannot split. If it is over the limit, its rows (copies of one id) are written once with
a number each and are hashed with it; one row that is over the limit alone is a shard of its own.

Defined cases: a NULL text has no bytes; a NULL id is hashed as such; repeated rows are sharded each; an empty
table gives an empty result; :func:`assign` keeps all columns and adds ``shard_depth`` and ``shard_prefix``, replacing
columns of these names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaweave.functions.lineage import staged

LIMIT = 1 << 20
BITS = 60
#: Prefix bits looked at beyond those that an even spread would need.
EXTRA = 3
#: A directory of at most so many shards (about 40 bytes each) is sent to every task.
BROADCAST_SHARDS = 200_000


def hash_bits(key):
    """60 bits of the MD5 of a key, as a number."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def _prefix(depth):
    return F.expr(f"shiftright(_h, {BITS} - ({depth}))")


def directory(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Shards of rows with ``_h`` (hash) and ``_bytes``: depth, prefix, bytes, rows, single (one hash only)."""
    total = rows.agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n")).first()
    low, left, shards = 0, rows, None
    deep = min(BITS, EXTRA + max(0, math.ceil(math.log2(max(total.b or 0, 1) / limit))))
    while True:
        leaf = left.groupBy(_prefix(deep).alias("_leaf")).agg(F.sum("_bytes").alias("b"), F.count(F.lit(1)).alias("n"), F.min("_h").alias("lo"), F.max("_h").alias("hi"))
        leaf = staged(leaf, "histogram")
        levels = F.explode(F.sequence(F.lit(low), F.lit(deep)))
        sums = (
            leaf.select("*", levels.alias("depth")).withColumn("prefix", F.expr(f"shiftright(_leaf, {deep} - depth)"))
            .groupBy("depth", "prefix").agg(F.sum("b").alias("bytes"), F.sum("n").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        )
        fits = sums.where((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
        # The shortest fitting prefix: its parent does not fit. At the top, nothing stands above.
        parent = sums.where((F.col("bytes") > limit) & (F.col("lo") != F.col("hi"))).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("_up"))
        first = fits.where(F.col("depth") == low) if low == 0 else fits.limit(0)
        found = fits.withColumn("_up", F.shiftright("prefix", 1)).join(parent, ["depth", "_up"], "left_semi").drop("_up").unionByName(first)
        found = found.select("depth", "prefix", "bytes", "rows", (F.col("lo") == F.col("hi")).alias("single"))
        shards = found if shards is None else shards.unionByName(found)
        over = sums.where((F.col("depth") == deep) & (F.col("bytes") > limit) & (F.col("lo") != F.col("hi"))).select(F.col("prefix").alias("_leaf"))
        over = staged(over, "oversized")
        if deep == BITS or over.isEmpty():
            return staged(shards, "directory")
        left = left.withColumn("_leaf", _prefix(deep)).join(over, "_leaf", "left_semi").drop("_leaf")
        low, deep = deep, min(BITS, deep + 8)


def assign(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``docs`` with its shard (``shard_depth``, ``shard_prefix``), and the directory."""
    kept = [c for c in docs.columns if c not in ("shard_depth", "shard_prefix")]
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("NULL"))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint")
    wide = docs.select(*kept, hash_bits(key).alias("_h"), size.alias("_bytes"))
    shards = directory(wide.select("_h", "_bytes"), limit)
    copies = shards.where((F.col("bytes") > limit) & (F.col("rows") > 1)).select("depth", "prefix")
    if not copies.isEmpty():
        # Copies of one id that exceed a shard together: numbered once, in a table, and hashed with the number.
        # Their one hash is found again by the prefix; there are at most total bytes / limit such hashes.
        depths = [r.depth for r in copies.select("depth").distinct().collect()]
        at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths]))
        hashes = wide.select("_h", at.alias("_p")).select("_h", "_p.depth", "_p.prefix").join(copies, ["depth", "prefix"], "left_semi").select("_h").distinct()
        hot = wide.join(hashes, "_h", "left_semi")
        numbered = staged(hot.withColumn("_copy", F.monotonically_increasing_id()), "copies")
        again = numbered.withColumn("_h", hash_bits(F.concat_ws("|", key, "_copy"))).drop("_copy")
        cold = wide.join(numbered.select("_h").distinct(), "_h", "left_anti")
        wide = cold.unionByName(again)
        shards = directory(wide.select("_h", "_bytes"), limit)
    facts = shards.agg(F.min("depth").alias("least"), F.count(F.lit(1)).alias("n")).first()
    least = facts.least or 0
    # One entry for each prefix of the smallest depth: the few shards below it.
    entries = shards.groupBy(F.expr(f"shiftright(prefix, depth - {least})").alias("_entry")).agg(F.collect_list(F.struct("depth", "prefix")).alias("_below"))
    if facts.n <= BROADCAST_SHARDS:
        entries = F.broadcast(entries)
    placed = wide.withColumn("_entry", _prefix(least)).join(entries, "_entry")
    own = F.expr(f"filter(_below, s -> shiftright(_h, {BITS} - s.depth) = s.prefix)[0]")
    return placed.select(*kept, own.alias("_shard")).select(*kept, F.col("_shard.depth").alias("shard_depth"), F.col("_shard.prefix").alias("shard_prefix")), shards


def write(docs: DataFrame, path: str, limit: int = LIMIT, **options) -> DataFrame:
    """Write each shard as parquet below ``path``, a folder each, and return the directory."""
    placed, shards = assign(docs, limit, **options)
    parts = max(1, shards.count())
    placed.repartition(parts, "shard_depth", "shard_prefix").write.partitionBy("shard_depth", "shard_prefix").parquet(path)
    return shards


#: The directory by its definition: a row's shard is its shortest prefix whose rows fit or share one hash.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS b, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'NULL')), 1, 15) AS BIGINT) AS h FROM documents
), p AS (
  SELECT depth, h >> ({BITS} - depth) AS prefix, sum(b) AS bytes, min(h) = max(h) AS single
  FROM d, (SELECT unnest(range(0, {BITS} + 1)) AS depth) GROUP BY 1, 2
), o AS (
  SELECT d.doc_id, d.b, min(p.depth) AS depth, any_value(d.h) AS h FROM d, p
  WHERE p.prefix = d.h >> ({BITS} - p.depth) AND (p.bytes <= {LIMIT} OR p.single) GROUP BY 1, 2
)
SELECT doc_id, CAST(b AS BIGINT) AS bytes, CAST(depth AS INTEGER) AS shard_depth, h >> ({BITS} - depth) AS shard_prefix FROM o
"""
