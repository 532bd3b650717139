"""Distribution, removal and coverage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import METRES_PER_DEGREE, finite, percent
from ..functions.lineage import small_side
from ..functions.quantiles import narrow, summarise, summarise_with_mad
from .matchup import POOLED, with_levels

KEPT_PROBS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def kept_removed_frame(df: DataFrame, group: str | None = None) -> DataFrame:
    """(variable, group, value, retained) of every row of a screened table; both halves in one pass."""
    label = F.lit(POOLED) if group is None else F.col(group).cast("string")
    return df.select("variable", label.alias("group"), F.col("value").cast("double").alias("value"), F.col("stage").isNull().alias("retained"))


def variable_summary(frame: DataFrame, by_group: bool = True) -> DataFrame:
    """Counts under both denominators and the kept / removed distributions, pooled and by group."""
    frame = narrow(frame, ["variable", "group", "value", "retained"], "frame")  # what several passes read
    rows = with_levels(frame.withColumnRenamed("group", "_g"), F.col("_g"), pooled_only=not by_group)
    keys = ["variable", "pooled", "group"]
    rows = rows.select(*keys, "value", "retained", F.when(F.col("retained"), F.col("value")).alias("_k"), F.when(~F.col("retained"), F.col("value")).alias("_m"))
    k, m = F.col("_k"), F.col("_m")
    out, _ = summarise_with_mad(rows, keys, {"_k": KEPT_PROBS, "_m": {"rm_median": 0.5}}, "_k", "median", "mad", [
        F.count(F.lit(1)).alias("n_input"), F.count("value").alias("n_present"),
        F.count_if("retained").alias("n_kept"), F.count_if(~F.col("retained")).alias("n_removed"),
        F.count_if(F.col("retained") & k.isNull()).alias("n_missing"),
        F.avg(k).alias("mean"), F.stddev_samp(k).alias("sd"), F.min(k).alias("min"), F.max(k).alias("max"),
        F.count(m).alias("rm_n"), F.avg(m).alias("rm_mean"), F.stddev_samp(m).alias("rm_sd"), F.min(m).alias("rm_min"), F.max(m).alias("rm_max"),
    ])
    return out.select(
        "variable", "pooled", "group", "n_input", "n_present", "n_kept", "n_removed",
        percent("rm_n", "n_present", 3).alias("pct_removed"), percent("n_removed", "n_input", 3).alias("pct_of_rows"), "n_missing",
        "mean", "sd", "median", "mad", "min", "p01", "p05", "p25", "p75", "p95", "p99", "max",
        "rm_n", "rm_mean", "rm_sd", "rm_median", "rm_min", "rm_max",
    )


def pooled_first(table: DataFrame, *lead: str) -> DataFrame:
    """Report order: variable (and any further lead), pooled row first, then groups."""
    return table.orderBy(*lead, F.desc("pooled"), "group")


def removal_summary(df: DataFrame, group: str | None = None) -> DataFrame:
    """Removed rows per stage and variable, as a share of all values that entered.

    One aggregate at (stage, variable, group) grain; pooled rows and denominators are sums of it.
    """
    label = F.lit(POOLED) if group is None else F.col(group).cast("string")
    fine = df.groupBy("stage", "variable", label.alias("_g")).agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_present"))
    rows = with_levels(fine, F.col("_g"), pooled_only=group is None)
    total = rows.groupBy("variable", "pooled", "group").agg(F.sum("n_present").alias("_den"))
    cells = rows.where(F.col("stage").isNotNull()).groupBy("stage", "variable", "pooled", "group").agg(
        F.sum("n_rows").alias("n_removed"), F.sum("n_present").alias("n_present"))
    t = total.select(F.col("variable").alias("_v"), F.col("pooled").alias("_p"), F.col("group").alias("_gg"), "_den")
    out = cells.join(t, F.col("variable").eqNullSafe(F.col("_v")) & (F.col("pooled") == F.col("_p")) & F.col("group").eqNullSafe(F.col("_gg")))
    pct = F.round(F.lit(100.0) * F.col("n_present") / F.nullif(F.col("_den"), F.lit(0)), 3)
    return out.select("stage", "variable", "pooled", "group", "n_removed", "n_present", pct.alias("pct_of_present"))


def removal_cascade(summary: DataFrame) -> DataFrame:
    """Pooled removals of present values per variable and stage."""
    return summary.where(F.col("pooled") & (F.col("n_present") > 0)).select("variable", "stage", "n_present")


def histogram(frame: DataFrame, bins: int = 100) -> DataFrame:
    """Equal-width counts of value by variable and retention, over each variable's own range."""
    rows = frame.where(F.col("value").isNotNull())
    span = small_side(rows.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))
    slot = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col("value") - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    joined = rows.join(span, "variable").withColumn("bin", slot.cast("bigint"))
    out = joined.groupBy("variable", "retained", "bin").agg(F.count(F.lit(1)).alias("n"), F.min("_lo").alias("_lo"), F.min("_hi").alias("_hi"))
    return out.select("variable", "retained", "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "n")


def group_display(frame: DataFrame) -> DataFrame:
    """Per variable and group: counts, removal rate and the retained five-number summary."""
    keys = ["variable", "group"]
    rows = narrow(frame.where(F.col("value").isNotNull()), [*keys, "retained", F.when(F.col("retained"), F.col("value")).alias("_k")], "frame")
    out, _ = summarise(rows, keys, {"_k": {"q1": 0.25, "median": 0.5, "q3": 0.75}}, [
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("retained")).alias("n_removed"), F.min("_k").alias("min"), F.max("_k").alias("max"),
    ])
    return out.withColumn("pct_removed", F.lit(100.0) * F.col("n_removed") / F.col("n")).orderBy("variable", F.asc_nulls_last("median"))


def bounding_box(
    df: DataFrame, lat: str = "lat", lon: str = "lon", buffer: float = 0.1, equal_km: bool = True,
    min_buffer_km: float = 2.0, clamp: bool = True,
) -> DataFrame:
    """Padded extent of the finite points, from one aggregate.

    ``equal_km`` pads both axes by one distance, a fraction of the longer side; otherwise each
    axis is padded by its own fraction. The padding is never below ``min_buffer_km``.
    """
    km = F.lit(METRES_PER_DEGREE / 1000.0)
    for c in (lat, lon):
        df = df.where(finite(c).isNotNull())
    box = df.agg(F.min(lon).alias("x0"), F.max(lon).alias("x1"), F.min(lat).alias("y0"), F.max(lat).alias("y1"))
    km_east = km * F.cos(F.radians((F.col("y0") + F.col("y1")) / 2))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    share, least = F.lit(float(buffer)), F.lit(float(min_buffer_km))
    if equal_km:
        pad = F.greatest(F.greatest(dx * km_east, dy * km) * share, least)
        px, py = pad / km_east, pad / km
    else:
        px, py = F.greatest(dx * share, least / km_east), F.greatest(dy * share, least / km)
    sides = {"xmin": F.col("x0") - px, "ymin": F.col("y0") - py, "xmax": F.col("x1") + px, "ymax": F.col("y1") + py}
    if clamp:
        edge = {"x": 180.0, "y": 90.0}
        sides = {k: F.least(F.greatest(v, F.lit(-edge[k[0]])), F.lit(edge[k[0]])) for k, v in sides.items()}
    return box.select(*[v.alias(k) for k, v in sides.items()])


def value_counts(df: DataFrame, point: str = "point_id") -> DataFrame:
    """Rows and present values per point and variable."""
    return df.groupBy(point, "variable").agg(F.count(F.lit(1)).alias("n_rows"), F.count("value").alias("n_values"))


def sites_above(counts: DataFrame, thresholds: list[int]) -> DataFrame:
    """Per variable, how many points exceed each count."""
    return counts.groupBy("variable").agg(*[F.count_if(F.col("n_values") > t).alias(f"sites_over_{t}") for t in thresholds])


def fraction_below(df: DataFrame, target: str, reference: str, limit: float, site: str = "point_id") -> DataFrame:
    """Per site of a wide table: target values, smallest difference, and the share of rows under a limit.

    Rows without a difference stay in the denominator.
    """
    d = F.col(target) - F.col(reference)
    return df.groupBy(site).agg(
        F.count(target).alias("n"), (F.count_if(d < limit) / F.count(F.lit(1))).alias("fraction_below"), F.min(d).alias("min_diff"),
    )
