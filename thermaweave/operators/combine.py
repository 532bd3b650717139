"""Stacking runs, labelling them, and benchmark subsets."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import null_safe_join, small_side

# The combined table's columns, in order.
COMBINED_COLUMNS = ["model", "run", "site", "site_name", "site_type", "region", "lat", "lon", "date", "variable", "value", "se", "notes"]


def latest_runs(registry: DataFrame, wanted: str) -> DataFrame:
    """Per model the last run in name order among those holding the wanted file.

    ``registry`` has (model, run, file); run names end in an ISO date, so name order is age.
    """
    return registry.where(F.col("file") == wanted).groupBy("model").agg(F.max("run").alias("run"))


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns a frame lacks become NULL."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_runs(frames: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Stack run tables, each with its literal labels."""
    return stack([df.select("*", *[F.lit(v).alias(k) for k, v in labels.items()]) for df, labels in frames])


def attach_sites(states: DataFrame, locations: DataFrame) -> DataFrame:
    """Site names and positions; rows without a known site keep NULLs."""
    cols = ["id", "site_name", "site_type", "lat", "lon", "region", "notes"]
    out = states.join(small_side(locations.select(*cols).withColumnRenamed("id", "site")), "site", "left")
    return out.select(*COMBINED_COLUMNS)


def unknown_sites(states: DataFrame, locations: DataFrame) -> DataFrame:
    """Sites without a location, for the warning."""
    return states.select("site").distinct().join(small_side(locations.select(F.col("id").alias("site"))), "site", "left_anti")


def model_order(models: list[str], column: str = "model") -> Column:
    return F.array_position(F.array(*map(F.lit, models)), F.col(column))


def in_model_order(df: DataFrame, models: list[str]) -> DataFrame:
    """Rows by model in the given order, then site, then date (a distributed range sort)."""
    return df.orderBy(model_order(models), "site", "date")


def benchmark_subset(
    df: DataFrame, variables: list[str], stat: str, flags: dict[str, list[str]], after: str | None = None, days_of_month: list[str] | None = None,
    included_after: str | None = None, site: str = "point_id", time: str = "time",
) -> DataFrame:
    """Values of some variables with membership flags per site, optionally on fixed days of the month."""
    out = df.where(F.col("variable").isin(variables) & (F.col("stat") == stat) & F.col("value").isNotNull())
    if after is not None:
        out = out.where(F.to_date(time) > F.lit(after).cast("date"))
    if days_of_month is not None:
        out = out.where(F.substring(F.col(time).cast("string"), 9, 2).isin(days_of_month))
    marks = [F.col(site).isin(sites).alias(name) for name, sites in flags.items()]
    if included_after is not None:
        marks.append((F.to_date(time) > F.lit(included_after).cast("date")).alias("included_time"))
    return out.select(*[c for c in df.columns if c != "radius_m"], *marks)


def compare_views(frames: list[DataFrame], variables: list[str], keys: list[str] = ("date", "site")) -> DataFrame:
    """One row per key with a column per view, for 1:1 comparison. A repeated cell is an error."""
    from .screening import pivot_keys

    return pivot_keys(stack([f.select(*keys, "variable", "value") for f in frames]), list(keys), variables)


def key_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys present in exactly one of two tables, with the side they are on."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    only_a = null_safe_join(a, b, keys, "left_anti").withColumn("side", F.lit("left"))
    return only_a.unionByName(null_safe_join(b, a, keys, "left_anti").withColumn("side", F.lit("right")))


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))
