"""Nearest-donor queries: a fifth of the sites lack the reference variable."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import donors as d
from .base import R, query, raw_long, with_ctes

LACKING = ["P0", "P5", "P10", "P15", "P20"]
LACK_SQL = ", ".join(f"'{s}'" for s in LACKING)

def is_ref():
    return (F.col("variable") == "ref_sst") & (F.col("stat") == "nanmean")

KM = "2 * 6371 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"


def holed(spark, sf):
    """The raw extract with the reference's values, but not its rows, missing at five sites. Even
    sites keep only late dates, so that coverage differs between donors."""
    gone = F.col("point_id").isin(LACKING) | (F.col("point_id").isin("P1", "P11", "P21") & (F.col("time") < F.lit("1997-01-01").cast("date")))
    return raw_long(spark, sf).withColumn("value", F.when(~(is_ref() & gone), F.col("value")))


HOLED = ("holed", f"SELECT * REPLACE (CASE WHEN variable = 'ref_sst' AND stat = 'nanmean' AND (point_id IN ({LACK_SQL}) OR (point_id IN ('P1', 'P11', 'P21') AND time < DATE '1997-01-01')) THEN NULL ELSE value END AS value) FROM raw")
CTES = [
    HOLED, ("pos", "SELECT point_id AS site, min(lat) AS lat, min(lon) AS lon FROM holed GROUP BY 1"),
    ("cov", "SELECT point_id AS site, count(value) FILTER (WHERE variable = 'ref_sst' AND stat = 'nanmean') AS n_valid, count(*) FILTER (WHERE variable = 'ref_sst' AND stat = 'nanmean') AS n_rows FROM holed GROUP BY 1"),
    ("pairs", f"SELECT a.site, b.site AS donor, {KM} AS km, c.n_valid FROM pos a JOIN cov ca ON ca.site = a.site AND ca.n_valid = 0 JOIN pos b ON b.site <> a.site JOIN cov c ON c.site = b.site AND c.n_valid > 0"),
    ("near", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, donor) AS rn FROM pairs WHERE km <= 25) WHERE rn = 1"),
    ("best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY n_valid DESC, km, donor) AS rn FROM pairs WHERE km <= 40) WHERE rn = 1"),
    ("near40", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, donor) AS rn FROM pairs WHERE km <= 40) WHERE rn = 1"),
    ("covered", "SELECT n.site, CASE WHEN n.n_valid < 0.9 * b.n_valid THEN b.donor ELSE n.donor END AS donor, CASE WHEN n.n_valid < 0.9 * b.n_valid THEN b.km ELSE n.km END AS km, CASE WHEN n.n_valid < 0.9 * b.n_valid THEN b.n_valid ELSE n.n_valid END AS n_valid, n.n_valid < 0.9 * b.n_valid AS switched FROM near40 n JOIN best b USING (site)"),
]


def sites(spark, sf):
    df = holed(spark, sf)
    return d.cut(d.site_positions(df).join(d.donor_coverage(df, is_ref()), "site"))


def split(spark, sf):
    s = sites(spark, sf)
    return s.where("not has_values").select("site", "lat", "lon"), s.where("has_values").select("site", "lat", "lon", "n_valid")


@query("A15_donor_coverage", with_ctes("SELECT site, n_valid, n_rows, n_valid > 0 AS has_values FROM cov", "raw", CTES))
def a15(spark, sf):
    return d.donor_coverage(holed(spark, sf), is_ref())


@query("A16_site_positions", with_ctes(f"SELECT point_id AS site, {R('avg(lat)')} AS lat, {R('avg(lon)')} AS lon, {R('min(lat)')} AS first_lat, {R('min(lon)')} AS first_lon FROM raw GROUP BY 1", "raw"))
def a16(spark, sf):
    df = raw_long(spark, sf)
    return d.mean_positions(df).join(d.site_positions(df).withColumnsRenamed({"lat": "first_lat", "lon": "first_lon"}), "site")


@query("J6_nearest_donor", with_ctes(f"SELECT site, donor, {R('km')} AS km, n_valid FROM near", "raw", CTES))
def j6(spark, sf):
    lacking, lenders = split(spark, sf)
    return d.nearest_donors(lacking, lenders, 1, 25.0).select("site", "donor", "km", "n_valid")


@query("J7_covered_donor", with_ctes(f"SELECT site, donor, {R('km')} AS km, n_valid, switched FROM covered", "raw", CTES))
def j7(spark, sf):
    lacking, lenders = split(spark, sf)
    return d.covered_donors(lacking, lenders, 40.0, 0.9)


@query("J7_best_covered_without_limit", with_ctes(f"""SELECT site, donor, {R('km')} AS km, n_valid, near_n < 1.0 * n_valid AS switched FROM (SELECT p.*, row_number() OVER (PARTITION BY site ORDER BY n_valid DESC, km, donor) AS rn,
first_value(n_valid) OVER (PARTITION BY site ORDER BY km, donor) AS near_n FROM pairs p) WHERE rn = 1""", "raw", CTES))
def j7_open(spark, sf):
    lacking, lenders = split(spark, sf)
    return d.covered_donors(lacking, lenders, None, 1.0)


@query("J8_N6_three_nearest", with_ctes(f"SELECT site, CAST(rn AS INTEGER) AS rank, donor, {R('km')} AS km, n_valid, km > 25 AS beyond_limit FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, donor) AS rn FROM pairs) WHERE rn <= 3", "raw", CTES))
def j8(spark, sf):
    lacking, lenders = split(spark, sf)
    return d.nearest_donors(lacking, lenders, 3).select("site", "rank", "donor", "km", "n_valid", (F.col("km") > 25).alias("beyond_limit"))


def fill_sql(picks: str) -> str:
    return f"""SELECT h.point_id, h.time, h.variable, h.stat, {R('CASE WHEN p.donor IS NOT NULL THEN v.value ELSE h.value END')} AS value, p.donor IS NOT NULL AS ref_imputed, p.donor AS ref_donor,
round(p.km, 2) AS ref_donor_km, p.n_valid AS ref_donor_n FROM holed h LEFT JOIN {picks} p ON p.site = h.point_id AND h.variable = 'ref_sst' AND h.stat = 'nanmean'
LEFT JOIN holed v ON v.point_id = p.donor AND v.time = h.time AND v.variable = 'ref_sst' AND v.stat = 'nanmean'"""


FILL_COLUMNS = ["point_id", "time", "variable", "stat", "value", "ref_imputed", "ref_donor", "ref_donor_km", "ref_donor_n"]


@query("J9_fill_from_nearest", with_ctes(fill_sql("near"), "raw", CTES))
def j9(spark, sf):
    return d.impute_nearest(holed(spark, sf), is_ref(), "ref", 25.0).select(*FILL_COLUMNS)


@query("J9_fill_from_covered", with_ctes(fill_sql("covered"), "raw", CTES))
def j9_covered(spark, sf):
    return d.impute_nearest(holed(spark, sf), is_ref(), "ref", 40.0, 0.9).select(*FILL_COLUMNS)
