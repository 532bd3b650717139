"""What the scripts in ``jobs/`` do: each reads tables from a folder and writes tables to another."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import combine, design, donors, reconstruct as rec
from ..sources import readers as rd, writers as wr
from .config import ModelConfig
from .fit import fit, prepare
from .validate import validate_model


def run_fit(spark: SparkSession, cfg: ModelConfig, grid: str, output: str, shared_from: str, reference: str, overwrite: bool = False) -> None:
    """Fit the grid of a folder, on the grid's own time axis, and write everything that a later job needs; the axis comes last."""
    axis = rd.read_axis(spark, grid)
    validate_model(cfg, spark.read.parquet(f"{grid}/rows"))
    data = prepare(spark.read.parquet(f"{grid}/grid"), cfg, axis)
    fitted = fit(data, cfg, shared_from, reference)
    wr.write_model_inputs(output, data.scales, fitted.design, data.observed, data.holdout, overwrite, data.axis.dates(spark))
    wr.write_table(data.sites, f"{output}/sites", overwrite)
    wr.write_table(data.series, f"{output}/rows", overwrite)
    wr.write_table(fitted.params, f"{output}/params", overwrite)
    wr.write_table(fitted.states, f"{output}/state_estimates", overwrite)
    wr.write_views(fitted.views(), output, ["parquet"], overwrite)
    wr.write_axis(data.axis, spark, output, overwrite)


def run_reconstruct(spark: SparkSession, cfg: ModelConfig, run: str, output: str, overwrite: bool = False) -> None:
    """Views from the tables of a run, which may have been fitted elsewhere, with shared factors if it has them.

    Read: ``sites`` (site, site_index, mu, sigma), ``rows`` (row, variable, site, site_index), ``params`` (name, value),
    ``state_estimates`` (site, date, x, se), and ``factors`` (factor, date, x, se) when the configuration has any. A site whose state no instrument
    observes, and a parameter that is missing, are errors.
    """
    sites, params, states = (spark.read.parquet(f"{run}/{name}") for name in ("sites", "params", "state_estimates"))
    spec = design.instrument_table(spark, cfg.instruments)
    series = spark.read.parquet(f"{run}/rows").where(F.col("variable").isin(list(cfg.instruments)))
    wr.write_table(design.observation_design(series, spec, cfg.factors, 2 * cfg.harmonics), f"{output}/design", overwrite)
    shared = None
    if cfg.factors:
        shared = rec.shared_part(states.select("site", "date"), rec.loadings(sites, params, cfg.factors), spark.read.parquet(f"{run}/factors").where(F.col("factor") <= cfg.factors))

    def view(variable: str | None) -> DataFrame:
        kind = {"intercept": "site", "seasonality": "shared", "tag": None} if variable is None else cfg.instruments[variable]
        coefs = rec.view_coefficients(sites, params, 2 * cfg.harmonics, 0, kind["intercept"], kind["seasonality"], kind["tag"], optional=variable is None)
        return rec.reconstruct_view(states, None, coefs, variable or "sst", cfg.harmonics, cfg.period, kind.get("site_state", True), shared)

    wr.write_views({"": view(None), **{cfg.instruments[v]["tag"]: view(v) for v in cfg.views}}, output, ["parquet"], overwrite)


def run_impute(spark: SparkSession, extract: str, output: str, variable: str, statistic: str, prefix: str, limit_km: float | None = 25.0, min_fraction: float | None = None, fmt: str = "csv", overwrite: bool = False) -> None:
    """The extract with a variable lent by near sites to those that lack it; with a fraction, by better covered ones."""
    rows = rd.read_long(spark, extract, fmt)
    where = (F.col("variable") == variable) & (F.col("stat") == statistic)
    wr.write_table(donors.impute_nearest(rows, where, prefix, limit_km, min_fraction), output, overwrite, fmt)


def run_combine(spark: SparkSession, root: str, locations: str, output: str, models: list[str], overwrite: bool = False) -> None:
    """The latest complete run of each model, stacked with site names and positions, in the order of models."""
    listed = rd.list_runs(spark, root).where(F.col("model").isin(models))
    latest = combine.latest_runs(listed, "states")
    rows = rd.read_listed_runs(spark, root).join(F.broadcast(latest), ["model", "run"], "left_semi")  # a row a model
    places = spark.read.option("header", True).schema("id string, site_name string, site_type string, lat double, lon double, region string, notes string").csv(locations)
    wr.write_combined(combine.in_model_order(combine.attach_sites(rows, places), models), output, overwrite)
