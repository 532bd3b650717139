"""Cutting lineage and deciding broadcasts.

Intermediate results are written to the shared folder named by
``spark.checkpoint.dir``, so a lost executor never loses them.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 200_000
#: And, where a table may hold long text or arrays, at most so many bytes (estimated as it is written).
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a session that runs in one process may do without: it gets a private one.

    On a cluster a folder of its own would be local to each executor, so a missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not configured:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors share (master is {master})")
        configured = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a small table reliably and forget how it was computed."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """:func:`cut`, with the number of rows observed while writing (no extra job).

    A retried task can only make the number larger, which is the safe side for its one use: deciding
    whether a table may be broadcast.
    """
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return table, int(seen.get.get("n") or 0)


def staged(df: DataFrame, label: str = "stage", partition_by: list[str] = ()) -> DataFrame:
    """Materialise a large table as parquet in the shared folder and read it back."""
    path = scratch_path(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _row_bytes(df: DataFrame):
    """A row's size, roughly: 16 bytes a column, and the contents of texts and arrays."""
    out = F.lit(16 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(f"`{f.name}`"), F.lit(0))
        elif kind in ("array", "map"):
            out = out + 16 * F.greatest(F.size(f"`{f.name}`"), F.lit(0))
    return out


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Materialise a join side and mark it for broadcast only when it was found to be small, in rows and in bytes.

    A larger side comes back unmarked and joins by shuffle, where adaptive execution splits
    skewed keys.
    """
    seen = Observation()
    table = cut(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(_row_bytes(df)).alias("bytes")))
    found = seen.get
    small = int(found.get("n") or 0) <= max_rows and int(found.get("bytes") or 0) <= max_bytes
    return F.broadcast(table) if small else table


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other (still a hashable equality)."""
    renamed = right.select(
        *[F.col(k).alias(f"__{k}") for k in keys],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    on = None
    for k in keys:
        term = left[k].eqNullSafe(renamed[f"__{k}"])
        on = term if on is None else on & term
    joined = left.join(renamed, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])
