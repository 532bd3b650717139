"""Grid, calendar, scaling and series queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid as g
from ..operators.screening import pivot_keys
from .base import TEMPERATURES, R, extract, query, raw_extended, raw_long, table, with_ctes

VARS = ["lst_sst", "eco_sst", "ref_sst"]
POSITION = "CASE variable WHEN 'lst_sst' THEN 1 WHEN 'eco_sst' THEN 2 ELSE 3 END"


def grid_ctes(step: int = 1, agg: str = "avg", where: str = "variable IN ('lst_sst', 'eco_sst', 'ref_sst')", source: str = "conv") -> list[tuple[str, str]]:
    return [
        ("sel", f"SELECT variable, point_id AS site, time AS date, value FROM {source} WHERE {where}"),
        ("span", f"SELECT min(date) AS t0, CAST(floor(date_diff('day', min(date), max(date)) / {step}.0) AS INTEGER) AS last_bin FROM sel"),
        ("cells", f"SELECT variable, site, CAST(floor(date_diff('day', t0, date) / {step}.0) AS INTEGER) AS bin, {agg}(value) AS value FROM sel CROSS JOIN span WHERE value IS NOT NULL GROUP BY 1, 2, 3"),
        ("sites", "SELECT site, row_number() OVER (ORDER BY site) AS site_index FROM (SELECT DISTINCT site FROM cells)"),
        ("series", f"SELECT row_number() OVER (ORDER BY {POSITION}, site) AS row, variable || '_' || site AS row_key, variable, site, site_index FROM (SELECT DISTINCT variable, site FROM cells) JOIN sites USING (site)"),
        ("grid", f"SELECT row, row_key, variable, site, site_index, bin, CAST(t0 + bin * {step} AS DATE) AS date, value FROM cells JOIN series USING (variable, site) CROSS JOIN span"),
    ]


def the_grid(spark, sf, step=1, agg="mean"):
    return g.build_grid(extract(spark, sf), VARS, step, agg, strict=False)


GRID_COLS = f"row, row_key, variable, site, site_index, bin, date, {R('value')} AS value"


@query("T4_long_grid", with_ctes(f"SELECT {GRID_COLS} FROM grid", "conv", grid_ctes()))
def t4(spark, sf):
    return the_grid(spark, sf).long()


@query("T4_dense_grid", with_ctes(f"""SELECT s.row, s.variable, s.site, b.bin, CAST(t0 + b.bin AS DATE) AS date, {R('c.value')} AS value FROM series s CROSS JOIN span CROSS JOIN (SELECT unnest(range(last_bin + 1))::INTEGER AS bin FROM span) b
LEFT JOIN cells c ON c.variable = s.variable AND c.site = s.site AND c.bin = b.bin""", "conv", grid_ctes()))
def t4_dense(spark, sf):
    return the_grid(spark, sf).dense().select("row", "variable", "site", "bin", "date", "value")


@query("T5_series_arrays", with_ctes(f"""SELECT s.row, s.row_key, len(v) AS n_bins, len(list_filter(v, lambda x: x IS NOT NULL)) AS n_observed, {R('list_sum(v)')} AS total, {R('v[1]')} AS first_value FROM series s JOIN (
SELECT s.row, list(c.value ORDER BY b.bin) AS v FROM series s CROSS JOIN (SELECT unnest(range(last_bin + 1))::INTEGER AS bin FROM span) b LEFT JOIN cells c ON c.variable = s.variable AND c.site = s.site AND c.bin = b.bin GROUP BY 1) a USING (row)""", "conv", grid_ctes()))
def t5(spark, sf):
    a = the_grid(spark, sf).arrays()
    v = F.col("values")
    seen = F.filter(v, lambda x: x.isNotNull())
    return a.select("row", "row_key", F.size(v).cast("bigint").alias("n_bins"), F.size(seen).cast("bigint").alias("n_observed"),
                    F.aggregate(seen, F.lit(0.0), lambda acc, x: acc + x).alias("total"), v[0].alias("first_value"))


@query("T6_O2_row_metadata", with_ctes("SELECT * FROM series", "conv", grid_ctes()))
def t6(spark, sf):
    return the_grid(spark, sf).series


@query("T10_multi_day_grid", with_ctes(f"SELECT {GRID_COLS} FROM grid", "conv", grid_ctes(5)))
def t10(spark, sf):
    return the_grid(spark, sf, 5).long()


for _agg, _sql in (("sum", "sum"), ("min", "min"), ("max", "max"), ("median", "median")):
    @query(f"A26_grid_{_agg}", with_ctes(f"SELECT variable, site, bin, {R('value')} AS value FROM cells", "conv", grid_ctes(30, _sql)))
    def a26(spark, sf, _agg=_agg):
        return the_grid(spark, sf, 30, _agg).cells


# Half of the series lose every value, so they must be reported.
GAPPY = [("gappy", "SELECT * REPLACE (CASE WHEN variable = 'ref_sst' AND aoi IN ('A0', 'A3') THEN NULL ELSE value END AS value) FROM conv")]


def gappy(spark, sf):
    lost = (F.col("variable") == "ref_sst") & F.col("aoi").isin("A0", "A3")
    return extract(spark, sf).withColumn("value", F.when(~lost, F.col("value")))


@query("J10_dropped_series", with_ctes("SELECT v.variable, s.site FROM (SELECT DISTINCT site FROM sel) s CROSS JOIN (VALUES ('lst_sst'), ('eco_sst'), ('ref_sst')) v(variable) WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.variable = v.variable AND c.site = s.site)", "conv", [*GAPPY, *grid_ctes(source="gappy")]))
def j10(spark, sf):
    return g.build_grid(gappy(spark, sf), VARS, strict=False).dropped


@query("G15_seasonal_basis", with_ctes(f"SELECT date, {R('sin(2 * pi() * dayofyear(date) / 365.25)')} AS sin1, {R('cos(2 * pi() * dayofyear(date) / 365.25)')} AS cos1, {R('sin(4 * pi() * dayofyear(date) / 365.25)')} AS sin2, {R('cos(4 * pi() * dayofyear(date) / 365.25)')} AS cos2 FROM (SELECT CAST(t0 + unnest(range(last_bin + 1))::INTEGER AS DATE) AS date FROM span)", "conv", grid_ctes()))
def g15(spark, sf):
    return g.seasonal_basis(the_grid(spark, sf).axis(spark), 2)


@query("G15_seasonal_basis_long", with_ctes(f"SELECT date, CAST(v.k AS INTEGER) AS k, {R('v.d')} AS d FROM (SELECT CAST(t0 + unnest(range(last_bin + 1))::INTEGER AS DATE) AS date FROM span) CROSS JOIN LATERAL (VALUES (1, sin(2 * pi() * dayofyear(date) / 365.25)), (2, cos(2 * pi() * dayofyear(date) / 365.25))) v(k, d)", "conv", grid_ctes()))
def g15_long(spark, sf):
    return g.seasonal_basis_long(the_grid(spark, sf).axis(spark), 1)


@query("N1_site_ranks", with_ctes("SELECT site, row_number() OVER (ORDER BY site) AS site_index FROM (SELECT DISTINCT site FROM grid WHERE variable = 'ref_sst')", "conv", [*GAPPY, *grid_ctes(source="gappy")]))
def n1(spark, sf):
    return g.site_ranks(g.build_grid(gappy(spark, sf), VARS, strict=False).long().where("variable = 'ref_sst'"))


SITES = ["P1", "P3", "P10", "P12", "P20"]
SITES_SQL = ", ".join(f"'{s}'" for s in SITES)


@query("P9_site_and_period", with_ctes(f"SELECT row, site, date, {R('value')} AS value FROM grid WHERE site IN ({SITES_SQL}) AND date > DATE '1993-01-15' AND date <= DATE '1996-06-30'", "conv", grid_ctes()))
def p9(spark, sf):
    return g.select_period(the_grid(spark, sf).long(), SITES, "1993-01-15", "1996-06-30").select("row", "site", "date", "value")


@query("T9_holdout_fit_rows", with_ctes(f"SELECT variable, site, count(*) AS n, {R('avg(value)')} AS mean FROM grid WHERE NOT (site IN ({SITES_SQL}) AND variable = 'eco_sst') GROUP BY 1, 2", "conv", grid_ctes()))
def t9_fit(spark, sf):
    fit, _ = g.split_holdout(the_grid(spark, sf).long(), SITES, ["eco_sst"])
    return fit.groupBy("variable", "site").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


@query("T9_holdout_withheld", with_ctes(f"SELECT date, site, variable, {R('value')} AS value FROM grid WHERE site IN ({SITES_SQL}) AND variable = 'eco_sst'", "conv", grid_ctes()))
def t9(spark, sf):
    return g.split_holdout(the_grid(spark, sf).long(), SITES, ["eco_sst"])[1]


SCALES = [("scales", "SELECT site, avg(value) FILTER (WHERE variable = 'ref_sst') AS mu, stddev_samp(value) FILTER (WHERE variable = 'ref_sst') AS sigma FROM grid GROUP BY site")]


@query("A9_scale_constants", with_ctes(f"SELECT site, {R('mu')} AS mu, {R('sigma')} AS sigma FROM scales", "conv", [*grid_ctes(), *SCALES]))
def a9(spark, sf):
    return g.scale_constants(the_grid(spark, sf).long(), "ref_sst", strict=False).drop("usable")


@query("A9_unusable_scales", with_ctes(f"SELECT site, {R('mu')} AS mu, {R('sigma')} AS sigma, coalesce(sigma > 0, false) AS usable FROM scales", "conv", [*GAPPY, *grid_ctes(source="gappy"), *SCALES]))
def a9_bad(spark, sf):
    return g.scale_constants(g.build_grid(gappy(spark, sf), VARS, strict=False).long(), "ref_sst", strict=False)


@query("T8_scaled_observations", with_ctes(f"SELECT row, date, {R('(value - mu) / sigma')} AS y FROM grid JOIN scales USING (site)", "conv", [*grid_ctes(), *SCALES]))
def t8(spark, sf):
    long = the_grid(spark, sf).long()
    return g.scale_values(long, g.scale_constants(long, "ref_sst", strict=False)).select("row", "date", "y")


@query("T12_scaled_by_own_series", with_ctes(f"SELECT row, date, {R('(value - avg(value) OVER w) / stddev_samp(value) OVER w')} AS y FROM grid WINDOW w AS (PARTITION BY row)", "conv", grid_ctes()))
def t12(spark, sf):
    return g.scale_each_series(the_grid(spark, sf).long()).select("row", "date", "y")


@query("T12_scaled_by_one_series", with_ctes(f"SELECT row, date, {R('(value - m) / s')} AS y FROM grid CROSS JOIN (SELECT avg(value) AS m, stddev_samp(value) AS s FROM grid WHERE variable = 'ref_sst' AND site = 'P7')", "conv", grid_ctes()))
def t12_one(spark, sf):
    return g.scale_by_one_series(the_grid(spark, sf).long(), "ref_sst", "P7").select("row", "date", "y")


@query("T13_covariate_grid", with_ctes(f"""SELECT variable, site, bin, {R('value')} AS value FROM (SELECT variable, site, CAST(date_diff('day', (SELECT min(date) FROM axed), date) AS INTEGER) AS bin, avg(value) AS value FROM axed WHERE value IS NOT NULL GROUP BY 1, 2, 3)""", "ext", [
    ("dates", "SELECT DISTINCT time AS date FROM raw WHERE variable = 'eco_sst' AND stat = 'nanmean' AND value IS NOT NULL"),
    ("axed", "SELECT variable, point_id AS site, stat, time AS date, avg(value) AS value FROM ext WHERE variable IN ('eco_sst_wind', 'eco_sst_hour') AND stat IN ('nearest', 'nanmean') AND time IN (SELECT date FROM dates) GROUP BY 1, 2, 3, 4")]))
def t13(spark, sf):
    dates = raw_long(spark, sf).where("variable = 'eco_sst' and stat = 'nanmean' and value is not null").select(F.col("time").alias("date")).distinct()
    return g.covariate_grid(raw_extended(spark, sf), ["eco_sst_wind", "eco_sst_hour"], ["nearest", "nanmean"], dates).cells


@query("T13_covariates_zero_filled", with_ctes(f"""SELECT v.variable, n.n_dates * n_sites AS n_cells, {R('total')} AS total FROM (SELECT variable, sum(value) AS total, count(DISTINCT site) AS n_sites FROM (SELECT variable, site, date, avg(value) AS value FROM axed WHERE value IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1) v
CROSS JOIN (SELECT date_diff('day', min(date), max(date)) + 1 AS n_dates FROM axed) n""", "ext", [
    ("axed", "SELECT variable, point_id AS site, stat, time AS date, avg(value) AS value FROM ext WHERE variable IN ('lst_sst_wind') AND stat IN ('nearest', 'nanmean') GROUP BY 1, 2, 3, 4")]))
def t13_zero(spark, sf):
    dates = raw_long(spark, sf).where("variable = 'lst_sst'").select(F.col("time").alias("date")).distinct()
    dense = g.covariate_grid(raw_extended(spark, sf), ["lst_sst_wind"], ["nearest", "nanmean"], dates).dense().na.fill(0.0, ["value"])
    return dense.groupBy("variable").agg(F.count(F.lit(1)).alias("n_cells"), F.sum("value").alias("total"))


@query("A23_grid_coverage", with_ctes(f"""SELECT coalesce(variable, '(all)') AS block, sum(ns)::BIGINT AS n_series, min(r0)::BIGINT AS first_row, max(r1)::BIGINT AS last_row, sum(no)::BIGINT AS n_observed, sum(nc)::BIGINT AS n_cells, {R('100.0 * sum(no) / sum(nc)')} AS pct_observed FROM (
SELECT variable, count(*) AS ns, min(row) AS r0, max(row) AS r1, (SELECT count(*) FROM cells c WHERE c.variable = s.variable) AS no, count(*) * (SELECT last_bin + 1 FROM span) AS nc FROM series s GROUP BY variable) GROUP BY ROLLUP (variable)""", "conv", grid_ctes()))
def a23(spark, sf):
    return g.coverage(the_grid(spark, sf))


@query("A23_thinned_columns", with_ctes("""SELECT variable, bin, count(*) AS n FROM cells WHERE bin IN (SELECT CAST(round_even(1 + j * (last_bin / 299.0::DOUBLE), 0) AS INTEGER) - 1 FROM span CROSS JOIN (SELECT unnest(range(300)) AS j)) GROUP BY 1, 2""", "conv", grid_ctes()))
def a23_thin(spark, sf):
    return g.thin_columns(the_grid(spark, sf), 300).groupBy("variable", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("N5_autocorrelation", with_ctes(f"""SELECT p.variable, p.site, p.lag, p.n AS n_pairs, {R('p.c / z.c')} AS acf FROM (SELECT a.variable, a.site, l.lag, count(*) AS n, sum(a.x * b.x) / (count(*) + l.lag) AS c FROM dev a CROSS JOIN (SELECT unnest(range(11))::INTEGER AS lag) l
JOIN dev b ON b.variable = a.variable AND b.site = a.site AND b.bin = a.bin + l.lag GROUP BY 1, 2, 3) p JOIN (SELECT variable, site, sum(x * x) / count(*) AS c FROM dev GROUP BY 1, 2) z USING (variable, site)""", "conv", [*grid_ctes(), ("dev", "SELECT variable, site, bin, value - avg(value) OVER (PARTITION BY variable, site) AS x FROM cells")]))
def n5(spark, sf):
    return g.autocorrelation(the_grid(spark, sf).cells, ["variable", "site"], 10)


@query("N2_rolling_mean", f"""SELECT user_id, date, {R('sum(s) OVER w / sum(n) OVER w')} AS value_mean FROM (SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS s, count(value) AS n FROM events GROUP BY 1, 2)
WINDOW w AS (PARTITION BY user_id ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY FOLLOWING)""")
def n2(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date"), "value")
    return g.rolling_mean(e, ["user_id"])


@query("N3_date_gaps", """SELECT user_id, date, CAST(gap AS INTEGER) AS gap FROM (SELECT user_id, date, date_diff('day', lag(date) OVER (PARTITION BY user_id ORDER BY date), date) AS gap FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS date FROM events)) WHERE gap IS NOT NULL""")
def n3(spark, sf):
    return g.date_gaps(table(spark, sf, "events").select("user_id", F.to_date("ts").alias("date")), ["user_id"])


@query("A17_modal_gap", with_ctes("""SELECT point_id, variable, CAST(gap AS INTEGER) AS step_days FROM (SELECT *, row_number() OVER (PARTITION BY point_id, variable ORDER BY n DESC, gap) AS r FROM (
SELECT point_id, variable, gap, count(*) AS n FROM (SELECT point_id, variable, date_diff('day', lag(time) OVER (PARTITION BY point_id, variable ORDER BY time), time) AS gap FROM (SELECT DISTINCT point_id, variable, time FROM conv)) WHERE gap IS NOT NULL GROUP BY 1, 2, 3)) WHERE r = 1"""))
def a17(spark, sf):
    from .base import celsius

    return g.modal_gap(celsius(spark, sf), ["point_id", "variable"], "time")


PROFILE = [("prof", "SELECT -43.0::DOUBLE + (l_suppkey % 97) * 0.003::DOUBLE AS lat, 147.0::DOUBLE + (l_partkey % 89) * 0.004::DOUBLE AS lon, CAST(l_shipdate AS DATE) AS date, CAST(l_linenumber AS DOUBLE) AS depth_m, l_quantity * 0.8512345677::DOUBLE AS sst FROM lineitem"),
           ("o", "SELECT avg(lat) AS lat0, avg(lon) AS lon0 FROM prof"),
           ("binned", """SELECT *, bin_x || '_' || bin_y AS bin_id, lon0 + (bin_x + 0.5) * 2000 / (111320 * cos(radians(lat0))) AS bin_lon, lat0 + (bin_y + 0.5) * 2000 / 111320 AS bin_lat FROM (
SELECT *, CAST(floor((lon - lon0) * 111320 * cos(radians(lat0)) / 2000) AS BIGINT) AS bin_x, CAST(floor((lat - lat0) * 111320 / 2000) AS BIGINT) AS bin_y FROM prof CROSS JOIN o)""")]


def profiles(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select((F.lit(-43.0) + (F.col("l_suppkey") % 97) * F.lit(0.003)).alias("lat"), (F.lit(147.0) + (F.col("l_partkey") % 89) * F.lit(0.004)).alias("lon"),
                     F.to_date("l_shipdate").alias("date"), F.col("l_linenumber").cast("double").alias("depth_m"), (F.col("l_quantity") * F.lit(0.8512345677)).alias("sst"))


@query("T11_spatial_bins", with_ctes(f"SELECT bin_id, {R('min(bin_lon)')} AS bin_lon, {R('min(bin_lat)')} AS bin_lat, count(*) AS n FROM binned GROUP BY bin_id", "raw", PROFILE))
def t11(spark, sf):
    return g.spatial_bins(profiles(spark, sf)).groupBy("bin_id").agg(F.min("bin_lon").alias("bin_lon"), F.min("bin_lat").alias("bin_lat"), F.count(F.lit(1)).alias("n"))


@query("A18_N4_distinct_dates_per_bin", with_ctes("SELECT bin_id, n_dates, count(*) AS n FROM binned JOIN (SELECT bin_x, bin_y, count(DISTINCT date) AS n_dates FROM binned GROUP BY 1, 2) USING (bin_x, bin_y) GROUP BY 1, 2", "raw", PROFILE))
def a18(spark, sf):
    return g.with_distinct_dates(g.spatial_bins(profiles(spark, sf)), ["bin_x", "bin_y"]).groupBy("bin_id", "n_dates").agg(F.count(F.lit(1)).alias("n"))


@query("P14_shallow_profiles", with_ctes(f"SELECT bin_id, date, {R('avg(sst)')} AS sst FROM binned JOIN (SELECT bin_x, bin_y, count(DISTINCT date) AS n_dates FROM binned GROUP BY 1, 2) USING (bin_x, bin_y) WHERE n_dates > 5 AND depth_m < 5 GROUP BY 1, 2", "raw", PROFILE))
def p14(spark, sf):
    return g.profile_series(profiles(spark, sf), min_dates=5, value="sst").select("bin_id", "date", "sst")


@query("P14_year_and_depth", with_ctes(f"SELECT date, count(*) FILTER (WHERE depth_m > 3) AS n_deep, {R('avg(sst) FILTER (WHERE depth_m > 3)')} AS deep, {R('avg(sst) FILTER (WHERE depth_m < 3)')} AS surface FROM prof WHERE year(date) > 1995 GROUP BY date", "raw", PROFILE))
def p14_year(spark, sf):
    p = profiles(spark, sf).where(F.year("date") > 1995)
    deep, top = F.col("depth_m") > 3, F.col("depth_m") < 3
    return p.groupBy("date").agg(F.count_if(deep).alias("n_deep"), F.avg(F.when(deep, F.col("sst"))).alias("deep"), F.avg(F.when(top, F.col("sst"))).alias("surface"))


@query("A19_daily_mean", with_ctes(f"SELECT point_id, time, {R('avg(value)')} AS value, count(value) AS n FROM raw GROUP BY 1, 2", "raw"))
def a19(spark, sf):
    return raw_long(spark, sf).groupBy("point_id", "time").agg(F.avg("value").alias("value"), F.count("value").alias("n"))


DEEP = [*PROFILE, ("daily", "SELECT date, avg(sst) FILTER (WHERE depth_m < 4) AS s, count(sst) FILTER (WHERE depth_m < 4) AS ns, sum(sst) FILTER (WHERE depth_m < 4) AS ts, count(sst) FILTER (WHERE depth_m >= 4) AS nd, sum(sst) FILTER (WHERE depth_m >= 4) AS td FROM prof GROUP BY date"),
        ("m3", "SELECT date, sum(coalesce(ts, 0)) OVER w / nullif(sum(ns) OVER w, 0) AS surf, sum(coalesce(td, 0)) OVER w / nullif(sum(nd) OVER w, 0) AS deep FROM daily WINDOW w AS (ORDER BY date RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND INTERVAL 1 DAY FOLLOWING)"),
        ("co", "SELECT regr_intercept(surf, deep) AS a, regr_slope(surf, deep) AS b FROM m3")]


@query("G10_calibrated_series", with_ctes(f"SELECT date, {R('avg(a + b * sst)')} AS calibrated, count(*) AS n FROM prof CROSS JOIN co WHERE depth_m >= 4 GROUP BY date", "raw", DEEP))
def g10(spark, sf):
    p = profiles(spark, sf)
    top = F.col("depth_m") < 4
    p = p.withColumns({"station": F.lit("all"), "surf": F.when(top, F.col("sst")), "deep": F.when(~top, F.col("sst"))})
    a, b = g.calibrate(g.rolling_mean(p, ["station"], values=["surf", "deep"]), "surf_mean", "deep_mean")
    return p.where(~top).groupBy("date").agg(F.avg(F.lit(a) + F.lit(b) * F.col("sst")).alias("calibrated"), F.count(F.lit(1)).alias("n"))


@query("T7_wide_to_long", with_ctes(f"SELECT site, date, variable, {R('value')} AS value FROM grid WHERE value IS NOT NULL", "conv", grid_ctes()))
def t7(spark, sf):
    wide = pivot_keys(the_grid(spark, sf).long(), ["site", "date"], TEMPERATURES)
    return wide.unpivot(["site", "date"], TEMPERATURES, "variable", "value").where(F.col("value").isNotNull())
