"""Row numbers and top-N within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import null_safe_join, small_side, staged


def number_rows(df: DataFrame, keys: list[str], order: list, name: str = "row_no") -> DataFrame:
    """1-based position of each row in its group.

    Rows are range-partitioned by (keys, order), which spreads one group over many tasks; each
    task numbers its own slice and a small table of slice sizes supplies the offset.
    """
    cols = [F.col(k) for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    spread = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    spread = staged(spread.withColumn("_id", F.monotonically_increasing_id()), "ranked")
    slice_no = F.shiftright("_id", 33)
    slices = spread.groupBy(*keys, slice_no.alias("_slice")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = null_safe_join(spread.withColumn("_slice", slice_no), small_side(slices), keys + ["_slice"], "inner")
    return out.select(*df.columns, (F.col("_before") + F.col("_id") - F.col("_first") + 1).cast("bigint").alias(name))


def top_per_group(df: DataFrame, keys: list[str], order: list, limit: int, salts: int = 64) -> DataFrame:
    """First ``limit`` rows per group. A salted pre-selection keeps a hot group off one task."""
    salt = F.pmod(F.xxhash64(*df.columns), F.lit(salts))
    first = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit)
        .withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= limit)
        .drop("_salt", "_r")
    )
