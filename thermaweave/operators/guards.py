"""Data-quality checks that report, or stop, before silent damage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, null_safe_join
from .screening import wind_keys


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate keys: {[r.asDict() for r in bad]}")
    return df


def absent_variables(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Wanted variables with their row and value counts in the data; zero rows means a misspelt name."""
    counts = df.where(F.col("variable").isin(wanted)).groupBy("variable").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"))
    names = df.sparkSession.createDataFrame([(w,) for w in wanted], "variable string")
    return names.join(counts, "variable", "left").select("variable", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_rows", "n_values")])


def alignment_metrics(df: DataFrame, target: str, wind: str, hour: str, **kwargs) -> DataFrame:
    """Whether covariates line up with the target: key counts, hour range, top wind, and the verdicts."""
    keys = wind_keys(df, target, wind, hour, **kwargs)
    usable = F.col("hour").isNotNull() & F.col("wind_speed").isNotNull()
    out = keys.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count_if("has_any").alias("n_any"), F.count_if(usable).alias("n_usable"),
        F.min("hour").alias("hour_min"), F.max("hour").alias("hour_max"), F.max("wind_speed").alias("wind_max"),
    )
    return out.select(
        "*", (F.col("n_usable") < F.lit(0.5) * F.col("n_any")).alias("poorly_aligned"),
        ((F.col("hour_min") < 0) | (F.col("hour_max") > 24)).alias("hour_out_of_range"), (F.col("wind_max") > 60).alias("wind_suspicious"),
    )


#: Buckets of the coarse and of the fine digests.
COARSE, FINE = 256, 65_536


def _digests(df: DataFrame, keys: list[str], value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their two buckets, order-free digests by coarse bucket)."""
    spread = F.xxhash64(*keys)
    rows = df.select(*keys, F.col(value), F.pmod(spread, F.lit(COARSE)).cast("int").alias("_c"), F.pmod(spread, F.lit(FINE)).cast("int").alias("_f"))
    return rows, _digest(rows, ["_c"], keys, value)


def _digest(rows: DataFrame, by: list[str], keys: list[str], value: str) -> DataFrame:
    whole = F.xxhash64(*keys, F.col(value), F.isnull(value))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.sum(F.xxhash64(whole, F.lit(1)).cast("decimal(38,0)")).alias("h1"),
        F.sum(F.xxhash64(whole, F.lit(2)).cast("decimal(38,0)")).alias("h2"), F.max(F.isnan(F.col(value).cast("double"))).alias("nan"))


def _differing(a: DataFrame, b: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(buckets that differ, totals of the equal ones)."""
    other = b.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(c).alias(f"_{c}2") for c in ("n", "n_values", "h1", "h2", "nan")])
    both = cut(a.join(other, [F.col(c) == F.col(f"_{c}") for c in by], "full").withColumns({c: F.coalesce(c, f"_{c}") for c in by}))
    same = (F.col("n") == F.col("_n2")) & (F.col("n_values") == F.col("_n_values2")) & (F.col("h1") == F.col("_h12")) & (F.col("h2") == F.col("_h22")) & ~F.coalesce("nan", F.lit(False))
    same = F.coalesce(same, F.lit(False))
    return both.where(~same).select(*by), both.where(same).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("n_values"), F.lit(0)).alias("n_values"))


def differing_rows(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> tuple[DataFrame, DataFrame, int, int]:
    """Rows of both tables in the buckets whose digests differ, and the rows and values of all others, which are equal.

    Digests are sums of hashes, so order does not matter and tasks combine them: first over ``COARSE`` buckets of the keys, then,
    inside those that differ, over ``FINE`` ones.
    """
    (a, da), (b, db) = _digests(old, keys, value), _digests(new, keys, value)
    coarse, equal = _differing(da, db, ["_c"])
    total = equal.first()
    if coarse.isEmpty():
        return a.where("false"), b.where("false"), total["n"], total["n_values"]
    a, b = (t.join(F.broadcast(coarse), "_c", "left_semi") for t in (a, b))  # COARSE rows at most
    fine, equal = _differing(_digest(a, ["_f"], keys, value), _digest(b, ["_f"], keys, value), ["_f"])
    more = equal.first()
    a, b = (t.join(F.broadcast(fine), "_f", "left_semi") for t in (a, b))  # FINE rows at most
    return a, b, total["n"] + more["n"], total["n_values"] + more["n_values"]


def compare_tables(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Whether two tables with unique keys hold the same data: keys on one side only, NULL mismatches, largest difference.

    Only rows of buckets whose digests differ are joined (:func:`differing_rows`); equal tables are compared without a join of rows.
    """
    a, b, n_equal, n_values = differing_rows(old, new, keys, value)
    b = b.select(*keys, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    both = null_safe_join(a.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_in_old")), b, keys, "full")
    paired = F.col("_in_old").isNotNull() & F.col("_in_new").isNotNull()
    return both.agg(
        (F.count_if(paired) + F.lit(n_equal)).alias("n_paired"), F.count_if(F.col("_in_new").isNull()).alias("n_only_old"), F.count_if(F.col("_in_old").isNull()).alias("n_only_new"),
        F.count_if(paired & (F.col("_old").isNull() != F.col("_new").isNull())).alias("n_null_mismatch"),
        F.greatest(F.max(F.abs(F.col("_old") - F.col("_new"))), F.lit(0.0 if n_values else None).cast("double")).alias("max_abs_diff"),
    )


def same_data(old: DataFrame, new: DataFrame, keys: list[str], value: str = "value", tolerance: float = 1e-8) -> bool:
    r = compare_tables(old, new, keys, value).first()
    return r["n_only_old"] == r["n_only_new"] == r["n_null_mismatch"] == 0 and (r["max_abs_diff"] or 0.0) <= tolerance


def missing_keys(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that are absent."""
    return null_safe_join(wanted.select(*keys).distinct(), have.select(*keys).distinct(), keys, "left_anti")
