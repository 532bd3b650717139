"""Reading and writing: each query writes derived rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lineage import scratch_path, staged
from ..operators import combine
from ..operators.grid import site_ranks, split_holdout
from ..operators.scoring import skill
from ..operators.screening import kept, removed
from ..operators.summaries import kept_removed_frame, variable_summary
from ..schemas import STATES as STATES_SCHEMA
from ..sources import readers as rd, writers as wr
from .base import IDS, R, celsius_temperatures, query, raw_long, with_ctes
from .combining import LOCATIONS, STATES, COMBINED_SQL, locations, states
from .gridding import GRID_COLS, SITES, SITES_SQL, grid_ctes, the_grid
from .quality import CHAIN, ID_SQL, ranged
from .scoring import GROUPED, LEVELS, labelled_preds, skill_cols

RAW_OUT = f"{ID_SQL}, variable, stat, radius_m, {R('value')} AS value"


@query("R1_read_csv_extract", with_ctes(f"SELECT {RAW_OUT} FROM raw", "raw"))
def r1(spark, sf):
    path = wr.write_table(raw_long(spark, sf), scratch_path(spark, "extract"), fmt="csv")
    return rd.read_long(spark, path)


@query("R1_read_parquet_extract", with_ctes(f"SELECT variable, count(*) AS n, count(value) AS n_values, {R('avg(value)')} AS mean FROM raw GROUP BY 1", "raw"))
def r1_parquet(spark, sf):
    path = wr.write_table(raw_long(spark, sf), scratch_path(spark, "extract"), partition_by=["variable"])
    rows = rd.read_long(spark, path, "parquet")
    return rows.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.avg("value").alias("mean"))


@query("R2_parse_dates", with_ctes("SELECT time, count(*) AS n FROM (SELECT CASE WHEN variable = 'ref_sst' AND stat = 'nearest' THEN NULL ELSE time END AS time FROM raw) GROUP BY 1", "raw"))
def r2(spark, sf):
    bad = (F.col("variable") == "ref_sst") & (F.col("stat") == "nearest")
    text = raw_long(spark, sf).withColumn("time", F.when(bad, F.lit("not a date")).otherwise(F.col("time").cast("string")))
    path = wr.write_table(text, scratch_path(spark, "extract"), fmt="csv")
    return rd.read_long_parse_time(spark, path).groupBy("time").agg(F.count(F.lit(1)).alias("n"))


def write_runs(spark, sf):
    """Every model's and year's reconstruction, written at once; the folder."""
    root = scratch_path(spark, "runs")
    wr.write_runs(staged(states(spark, sf).select("model", "run", "date", "site", "variable", "value", "se"), "states"), root)
    return root


@query("R4_read_runs_with_labels", with_ctes(f"SELECT model, run, date, site, variable, {R('value')} AS value, {R('se')} AS se FROM states", "raw", [STATES]))
def r4(spark, sf):
    return rd.read_listed_runs(spark, write_runs(spark, sf))


@query("R3_run_listing", with_ctes("SELECT model, max(run) AS run FROM states GROUP BY 1", "raw", [STATES]))
def r3_listing(spark, sf):
    return combine.latest_runs(rd.list_runs(spark, write_runs(spark, sf)), "states")


@query("W2_run_manifest", with_ctes("SELECT model, run, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_dates FROM states GROUP BY 1, 2", "raw", [STATES]))
def w2_manifest(spark, sf):
    return rd.list_runs(spark, write_runs(spark, sf)).select("model", "run", "n_rows", "first_date", "last_date", "n_dates")


@query("W2_written_axis", with_ctes("SELECT t0 AS start, 5 AS time_step, last_bin FROM span", "conv", grid_ctes(5)))
def w2_axis(spark, sf):
    root = scratch_path(spark, "grid")
    wr.write_grid(the_grid(spark, sf, 5), root)
    return spark.read.parquet(f"{root}/axis")


@query("W1_write_clean_and_removed", with_ctes(f"SELECT {ID_SQL}, variable, {R('value')} AS value, reason, stage IS NULL AS retained FROM f2", "conv", CHAIN[:3]))
def w1(spark, sf):
    df = ranged(spark, sf)
    root = scratch_path(spark, "preprocessing")
    wr.write_preprocessing(root, kept(df), removed(df), {"variable_summary": variable_summary(kept_removed_frame(df), by_group=False)})
    clean = spark.read.parquet(f"{root}/clean").select(*IDS, "variable", "value", F.lit(None).cast("string").alias("reason"), F.lit(True).alias("retained"))
    return clean.unionByName(spark.read.parquet(f"{root}/removed").select(*IDS, "variable", "value", "reason", F.lit(False).alias("retained")))


@query("W2_write_grid", with_ctes(f"SELECT {GRID_COLS} FROM grid", "conv", grid_ctes()))
def w2(spark, sf):
    root = scratch_path(spark, "grid")
    wr.write_grid(the_grid(spark, sf), root)
    return spark.read.parquet(f"{root}/grid")


@query("W3_write_views", with_ctes(f"SELECT f AS format, date, site, variable, {R('value')} AS value, {R('se')} AS se FROM states, (VALUES ('parquet'), ('csv')) v(f)", "raw", [STATES]))
def w3(spark, sf):
    s = states(spark, sf).select("date", "site", "variable", "value", "se")
    root = scratch_path(spark, "views")
    wr.write_views({"": s.where("variable <> 'ref_sst'"), "ref": s.where("variable = 'ref_sst'")}, root, ["parquet", "csv"])
    names = ("states", "states_ref_only")
    csv = spark.read.schema(STATES_SCHEMA).option("header", True).csv([f"{root}/{n}.csv" for n in names])
    parquet = spark.read.schema(STATES_SCHEMA).parquet(*[f"{root}/{n}.parquet" for n in names])
    return parquet.select(F.lit("parquet").alias("format"), "*").unionByName(csv.select(F.lit("csv").alias("format"), "*"))


@query("W4_write_model_inputs", with_ctes(f"""SELECT CASE WHEN site IN ({SITES_SQL}) AND variable = 'eco_sst' THEN 'validation' ELSE 'observations' END AS part, date, site, variable, {R('value')} AS value, CAST(NULL AS BIGINT) AS number FROM grid
UNION ALL SELECT 'design', NULL, site, variable, NULL, row FROM series UNION ALL SELECT 'scales', NULL, site, NULL, NULL, site_index FROM sites""", "conv", grid_ctes()))
def w4(spark, sf):
    grid = the_grid(spark, sf)
    fit, held = split_holdout(grid.long(), SITES, ["eco_sst"])
    root = scratch_path(spark, "model")
    sites = site_ranks(grid.series)
    written = wr.write_model_inputs(root, sites, grid.series, fit, held)
    empty = wr.write_model_inputs(scratch_path(spark, "model"), sites, grid.series, fit, held.where("false"))
    assert written and not empty
    columns = {"date": "date", "site": "string", "variable": "string", "value": "double", "number": "bigint"}
    out = None
    for part, number in (("validation", None), ("observations", None), ("design", "row"), ("scales", "site_index")):
        read = spark.read.parquet(f"{root}/{part}")
        read = read.withColumn("number", F.col(number) if number else F.lit(None))
        read = read.select(F.lit(part).alias("part"), *[(F.col(c) if c in read.columns and not (number and c in ("date", "value")) else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
        out = read if out is None else out.unionByName(read)
    return out


@query("W5_write_scores", with_ctes(f"SELECT level, unit, model, n, {skill_cols()} FROM sk", "conv", GROUPED))
def w5(spark, sf):
    preds, _ = labelled_preds(spark, sf)
    scores = skill(preds, LEVELS)
    root = scratch_path(spark, "scores")
    wr.write_scores(root, {level: scores.where(F.col("level") == level) for level in LEVELS})
    return spark.read.schema(scores.schema).option("header", True).option("nullValue", "NA").csv([f"{root}/{level}" for level in LEVELS])


@query("W6_write_combined", with_ctes(COMBINED_SQL, "raw", [STATES, LOCATIONS]))
def w6(spark, sf):
    df = combine.attach_sites(states(spark, sf), locations(spark, sf))
    path = wr.write_combined(df, scratch_path(spark, "combined"))
    return spark.read.schema(df.schema).option("header", True).csv(path)
