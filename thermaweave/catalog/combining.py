"""Queries over several runs and benchmark tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ranking import number_rows
from ..operators import combine as c
from .base import R, query, raw_long, table, with_ctes

MODELS = ["A2", "A0", "A1", "A4", "A3"]
FLAGS = {"test_site": ["P1", "P2", "P8"], "calibration": ["P2"], "other_region_site": ["P20", "P21"]}
KEEP = "point_id, lat, lon, aoi, time, variable, stat"


def states(spark, sf):
    """Reconstruction-like rows: one model per region, one run per year."""
    rows = raw_long(spark, sf).where("stat = 'nanmean' and value is not null")
    return rows.select(F.col("aoi").alias("model"), F.concat(F.lit("cfg_"), F.year("time").cast("string"), F.lit("-06-30")).alias("run"), F.col("point_id").alias("site"),
                       F.col("time").alias("date"), "variable", "value", (F.lit(0.01) * F.dayofyear("time")).alias("se"))


STATES = ("states", "SELECT aoi AS model, 'cfg_' || year(time) || '-06-30' AS run, point_id AS site, time AS date, variable, value, 0.01::DOUBLE * dayofyear(time) AS se FROM raw WHERE stat = 'nanmean' AND value IS NOT NULL")


@query("R3_latest_run", with_ctes("SELECT model, max(run) AS run FROM (SELECT DISTINCT model, run, CASE WHEN run >= 'cfg_1998' THEN 'log.txt' ELSE 'states.csv' END AS file FROM states) WHERE file = 'states.csv' GROUP BY 1", "raw", [STATES]))
def r3(spark, sf):
    registry = states(spark, sf).select("model", "run").distinct().withColumn("file", F.when(F.col("run") >= "cfg_1998", "log.txt").otherwise("states.csv"))
    return c.latest_runs(registry, "states.csv")


def locations(spark, sf):
    """Sites from the supplier's nations; a fifth have no entry."""
    n = table(spark, sf, "nation").where("n_nationkey % 5 <> 4")
    return n.select(F.concat(F.lit("P"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("site_name"), F.lit("station").alias("site_type"),
                    (F.lit(-43.0) + F.col("n_nationkey") * 0.1).alias("lat"), (F.lit(147.0) + F.col("n_nationkey") * 0.12).alias("lon"),
                    F.col("n_regionkey").cast("string").alias("region"), F.lit(None).cast("string").alias("notes"))


LOCATIONS = ("loc", "SELECT 'P' || n_nationkey AS id, n_name AS site_name, 'station' AS site_type, -43.0::DOUBLE + n_nationkey * 0.1::DOUBLE AS lat, 147.0::DOUBLE + n_nationkey * 0.12::DOUBLE AS lon, CAST(n_regionkey AS VARCHAR) AS region, CAST(NULL AS VARCHAR) AS notes FROM nation WHERE n_nationkey % 5 <> 4")
COMBINED_SQL = f"SELECT s.model, s.run, s.site, l.site_name, l.site_type, l.region, {R('l.lat')} AS lat, {R('l.lon')} AS lon, s.date, s.variable, {R('s.value')} AS value, {R('s.se')} AS se, l.notes FROM states s LEFT JOIN loc l ON l.id = s.site"


@query("J5_combined_with_sites", with_ctes(COMBINED_SQL, "raw", [STATES, LOCATIONS]))
def j5(spark, sf):
    return c.attach_sites(states(spark, sf), locations(spark, sf))


@query("J5_sites_without_location", with_ctes("SELECT DISTINCT site FROM states WHERE site NOT IN (SELECT id FROM loc)", "raw", [STATES, LOCATIONS]))
def j5_unknown(spark, sf):
    return c.unknown_sites(states(spark, sf), locations(spark, sf))


@query("O3_model_site_date_order", with_ctes("SELECT model, site, count(*) AS n, CAST(row_number() OVER (ORDER BY CASE model WHEN 'A2' THEN 1 WHEN 'A0' THEN 2 WHEN 'A1' THEN 3 WHEN 'A4' THEN 4 ELSE 5 END, site) AS INTEGER) AS position FROM states GROUP BY 1, 2", "raw", [STATES]))
def o3(spark, sf):
    rows = states(spark, sf).groupBy("model", "site").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("date"))
    # Numbered to make the order visible to a comparison.
    numbered = number_rows(c.in_model_order(rows, MODELS), [], [c.model_order(MODELS), "site"], "position")
    return numbered.withColumn("position", F.col("position").cast("int")).drop("date")


FLAG_SQL = ", ".join(f"point_id IN ({', '.join(repr(s) for s in v)}) AS {k}" for k, v in FLAGS.items())


@query("P10_benchmark_subset", with_ctes(f"SELECT {KEEP}, {R('value')} AS value, {FLAG_SQL}, time > DATE '1995-10-01' AS included_time FROM raw WHERE variable IN ('eco_sst', 'ref_sst') AND stat = 'nanmean' AND value IS NOT NULL", "raw"))
def p10(spark, sf):
    return c.benchmark_subset(raw_long(spark, sf), ["eco_sst", "ref_sst"], "nanmean", FLAGS, included_after="1995-10-01")


@query("P10_benchmark_small", with_ctes(f"SELECT {KEEP}, {R('value')} AS value, {FLAG_SQL} FROM raw WHERE variable IN ('eco_sst', 'ref_sst') AND stat = 'nanmean' AND value IS NOT NULL AND time > DATE '1995-10-01' AND substr(CAST(time AS VARCHAR), 9, 2) IN ('01', '10', '20')", "raw"))
def p10_small(spark, sf):
    return c.benchmark_subset(raw_long(spark, sf), ["eco_sst", "ref_sst"], "nanmean", FLAGS, after="1995-10-01", days_of_month=["01", "10", "20"])


@query("U2_stacked_runs", with_ctes(f"SELECT site, date, variable, {R('value')} AS value, CASE model WHEN 'A0' THEN 'north' ELSE 'south' END AS sites, CASE model WHEN 'A0' THEN 'yes' ELSE 'no' END AS converged FROM states", "raw", [STATES]))
def u2(spark, sf):
    s = states(spark, sf)
    cols = ["site", "date", "variable", "value"]
    labels = {m: {"sites": "north", "converged": "yes"} if m == "A0" else {"sites": "south", "converged": "no"} for m in MODELS}
    return c.stack_runs([(s.where(F.col("model") == m).select(*cols), label) for m, label in labels.items()])


@query("U2_benchmark_in_runs", with_ctes(f"SELECT point_id AS site, lat, lon, time AS date, variable, {R('value')} AS value FROM raw WHERE stat = 'nearest' AND value IS NOT NULL AND point_id IN (SELECT site FROM states)", "raw", [STATES]))
def u2_bench(spark, sf):
    bench = raw_long(spark, sf).where("stat = 'nearest' and value is not null")
    names = {"point_id": "site", "time": "date"}
    bench = bench.select(*[F.col(x).alias(names.get(x, x)) for x in ("point_id", "lat", "lon", "time", "variable", "value")])
    run_sites = states(spark, sf).select("site").distinct()
    return bench.withColumns({x: F.round(x, 6) for x in ("lat", "lon")}).join(c.small_side(run_sites), "site", "left_semi")


@query("U3_observations_with_estimates", with_ctes(f"""SELECT 'data' AS model, CAST(NULL AS VARCHAR) AS run, point_id AS site, time AS date, variable, {R('value')} AS value, CAST(NULL AS DOUBLE) AS se, 'long-term monitoring' AS notes FROM raw WHERE variable = 'ref_sst' AND stat = 'nearest'
UNION ALL SELECT model, run, site, date, variable, {R('value')}, {R('se')}, NULL FROM states""", "raw", [STATES]))
def u3(spark, sf):
    obs = raw_long(spark, sf).where("variable = 'ref_sst' and stat = 'nearest'")
    obs = obs.select(F.lit("data").alias("model"), F.col("point_id").alias("site"), F.col("time").alias("date"), "variable", "value", F.lit("long-term monitoring").alias("notes"))
    return c.stack([obs, states(spark, sf)])


@query("T14_U3_wide_comparison", with_ctes(f"SELECT date, site, {R('max(value) FILTER (WHERE variable = $$eco_sst$$)')} AS eco_sst, {R('max(value) FILTER (WHERE variable = $$ref_sst$$)')} AS ref_sst FROM states WHERE variable IN ('eco_sst', 'ref_sst') GROUP BY 1, 2", "raw", [STATES]))
def t14(spark, sf):
    s = states(spark, sf)
    return c.compare_views([s.where("variable = 'eco_sst'"), s.where("variable = 'ref_sst'")], ["eco_sst", "ref_sst"])


@query("U4_key_difference", with_ctes("""(SELECT DISTINCT point_id, time, 'left' AS side FROM raw a WHERE variable = 'eco_sst' AND NOT EXISTS (SELECT 1 FROM raw b WHERE b.variable = 'lst_sst' AND b.point_id = a.point_id AND b.time = a.time))
UNION ALL (SELECT DISTINCT point_id, time, 'right' AS side FROM raw a WHERE variable = 'lst_sst' AND NOT EXISTS (SELECT 1 FROM raw b WHERE b.variable = 'eco_sst' AND b.point_id = a.point_id AND b.time = a.time))""", "raw"))
def u4(spark, sf):
    r = raw_long(spark, sf)
    return c.key_difference(r.where("variable = 'eco_sst'"), r.where("variable = 'lst_sst'"), ["point_id", "time"])


@query("U4_common_keys", with_ctes("SELECT point_id, time FROM raw WHERE variable = 'eco_sst' INTERSECT SELECT point_id, time FROM raw WHERE variable = 'lst_sst'", "raw"))
def u4_common(spark, sf):
    r = raw_long(spark, sf)
    return c.common_keys(r.where("variable = 'eco_sst'"), r.where("variable = 'lst_sst'"), ["point_id", "time"])
