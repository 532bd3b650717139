"""Borrowing a variable from the nearest adequately covered site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, small_side, staged
from .spheretree import search


def site_positions(df: DataFrame, site: str = "point_id", order: str = "time") -> DataFrame:
    """One position per site: that of its earliest row, so the choice does not depend on partitioning."""
    first = F.min(F.struct(F.col(order), F.col("lat"), F.col("lon")))
    return df.groupBy(F.col(site).alias("site")).agg(first.alias("f")).select("site", "f.lat", "f.lon")


def mean_positions(df: DataFrame, site: str = "point_id") -> DataFrame:
    return df.groupBy(F.col(site).alias("site")).agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def donor_coverage(df: DataFrame, where: Column, site: str = "point_id", value: str = "value") -> DataFrame:
    """Per site: values of the chosen variable, and whether it can lend."""
    out = df.groupBy(F.col(site).alias("site")).agg(F.count(F.when(where, F.col(value))).alias("n_valid"), F.count_if(where).alias("n_rows"))
    return out.withColumn("has_values", F.col("n_valid") > 0)


def nearest_donors(recipients: DataFrame, donors: DataFrame, k: int = 1, limit_km: float | None = None) -> DataFrame:
    """The ``k`` nearest donors of every recipient, ties by donor id; columns site, rank, donor, km, ...."""
    return search(recipients, donors, k, limit_km)


def covered_donors(recipients: DataFrame, donors: DataFrame, limit_km: float | None, min_fraction: float) -> DataFrame:
    """Nearest donor within the limit, unless it holds less than ``min_fraction`` of the best
    covered one's values; then the best covered (ties to the nearer). ``donors`` carries ``n_valid``.
    """
    fields = F.struct("donor", "km", "n_valid")
    near = search(recipients, donors, 1, limit_km).select("site", fields.alias("near"))
    best = search(recipients, donors, 1, limit_km, "n_valid").select("site", fields.alias("best"))
    return _pick_covered(near.join(best, "site"), min_fraction)


def _pick_covered(both: DataFrame, min_fraction: float) -> DataFrame:
    switch = F.col("near.n_valid") < F.lit(float(min_fraction)) * F.col("best.n_valid")
    pick = F.when(switch, F.col("best")).otherwise(F.col("near"))
    return both.select("site", pick.alias("p"), switch.alias("switched")).select("site", "p.donor", "p.km", "p.n_valid", "switched")


def fill_from_donors(df: DataFrame, picks: DataFrame, where: Column, prefix: str, site: str = "point_id", time: str = "time", value: str = "value") -> DataFrame:
    """Recipient rows take the donor's value on the same date; NULL stays NULL.

    Provenance columns ``<prefix>_imputed, _donor, _donor_km (2 dp), _donor_n`` are added. Two
    donor rows on one date are an error raised inside the job.
    """
    cols = df.columns
    chosen = small_side(picks.select(F.col("site").alias(site), F.col("donor").alias("_donor"), F.col("km").alias("_km"),
                                     (F.col("n_valid") if "n_valid" in picks.columns else F.lit(None).cast("bigint")).alias("_n")))
    lenders = small_side(picks.select(F.col("donor").alias(site)).distinct())
    donor_rows = df.where(where).join(lenders, site, "left_semi").groupBy(F.col(site).alias("_donor"), F.col(time).alias("_time")).agg(
        F.max(value).alias("_v"), F.count(F.lit(1)).alias("_c"))
    problem = F.raise_error("duplicate donor rows on one date").cast("double")
    donor_rows = donor_rows.select("_donor", "_time", F.when(F.col("_c") > 1, problem).otherwise(F.col("_v")).alias("_v"))
    tagged = df.join(chosen, site, "left").withColumn("_donor", F.when(F.coalesce(where, F.lit(False)), F.col("_donor")))
    # Only recipient rows meet the donors' rows; everything else passes by without a shuffle.
    needy = tagged.where(F.col("_donor").isNotNull())
    filled = needy.join(donor_rows.withColumnRenamed("_time", time), ["_donor", time], "left")
    untouched = tagged.where(F.col("_donor").isNull())

    def shape(rows: DataFrame, new: Column, hit: bool) -> DataFrame:
        def only(c: Column, kind: str) -> Column:
            return c if hit else F.lit(None).cast(kind)

        return rows.select(
            *[new.alias(value) if c == value else F.col(c) for c in cols], F.lit(hit).alias(f"{prefix}_imputed"),
            only(F.col("_donor"), "string").alias(f"{prefix}_donor"), only(F.round("_km", 2), "double").alias(f"{prefix}_donor_km"),
            only(F.col("_n"), "bigint").alias(f"{prefix}_donor_n"),
        )

    return shape(untouched, F.col(value), False).unionByName(shape(filled, F.col("_v"), True))


def impute_nearest(df: DataFrame, where: Column, prefix: str, limit_km: float | None = 25.0, min_fraction: float | None = None,
                   site: str = "point_id", time: str = "time", value: str = "value") -> DataFrame:
    """Coverage, donor choice and fill in one call."""
    df = staged(df, "extract")  # what the choice and the fill both read
    first = F.min(F.struct(F.col(time), F.col("lat"), F.col("lon"))).alias("f")
    sites = df.groupBy(F.col(site).alias("site")).agg(first, F.count(F.when(where, F.col(value))).alias("n_valid"))
    sites = cut(sites.select("site", "f.lat", "f.lon", "n_valid", (F.col("n_valid") > 0).alias("has_values")))
    donors = sites.where("has_values").select("site", "lat", "lon", "n_valid")
    lacking = sites.where("not has_values").select("site", "lat", "lon")
    if min_fraction is None:
        picks = nearest_donors(lacking, donors, 1, limit_km).select("site", "donor", "km", "n_valid")
    else:
        picks = covered_donors(lacking, donors, limit_km, min_fraction)
    return fill_from_donors(df, picks, where, prefix, site, time, value)
