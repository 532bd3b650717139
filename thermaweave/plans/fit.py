"""Grid to smoothed states and reconstructed views, site by site.

Stands in for the joint fit: per-series seasonal regressions give intercepts and seasonal terms,
match-up spread gives the error variances, a likelihood grid gives the state's persistence and
variance, and a smoother per site gives the states. Day effects and shared factors are not fitted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import harmonic_terms
from ..functions.lineage import cut, small_side, staged
from ..operators import design, grid as g, matchup, reconstruct as rec, smoothing as sm
from .config import ModelConfig


@dataclass
class ModelData:
    """Observations put on the reference's scale, and what was withheld."""

    observed: DataFrame
    scaled: DataFrame
    scales: DataFrame
    sites: DataFrame
    holdout: DataFrame | None
    axis: g.TimeAxis
    series: DataFrame


def prepare(grid: DataFrame, cfg: ModelConfig, axis: g.TimeAxis | None = None, strict: bool = True) -> ModelData:
    """Choose sites and period, withhold, scale per site by the reference, and index the sites and series.

    ``axis`` is the grid's time axis; states exist on each of its bins in the period, whether observed or not. Without it
    the axis is daily, from the first to the last observation. Without ``strict`` a site whose scale is unusable has no scaled values instead of being an error.
    """
    rows = g.select_period(grid.where(F.col("value").isNotNull()), cfg.sites, cfg.start, cfg.end)
    rows = rows.where(F.col("variable").isin(list(cfg.instruments)) | F.col("variable").isin(cfg.holdout_variables))
    held = None
    if cfg.holdout_sites:
        rows, held = g.split_holdout(rows, cfg.holdout_sites, cfg.holdout_variables)
    rows = staged(rows.select("variable", "site", "date", "value"), "observed")
    if cfg.scale_reference is None:
        scales = rows.select("site").distinct().withColumns({"mu": F.lit(0.0), "sigma": F.lit(1.0)})
    else:
        scales = g.scale_constants(rows, cfg.scale_reference, strict).select("site", "mu", "sigma")
        if not strict:
            scales = scales.withColumn("sigma", F.when(F.col("sigma") > 0, F.col("sigma")))
    scales = cut(scales)
    sites = cut(g.site_ranks(rows).join(scales, "site"))
    if axis is None:
        span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        axis = g.TimeAxis(span["a"], 1, (span["b"] - span["a"]).days)
    else:
        axis = axis.within(cfg.start, cfg.end)
    series = g.index_series(cut(rows.select("variable", "site").distinct()), [*cfg.instruments, *[v for v in cfg.holdout_variables if v not in cfg.instruments]])
    return ModelData(rows, g.scale_values(rows, scales), scales, sites, held, axis, series)


@dataclass
class Fitted:
    params: DataFrame
    variances: DataFrame
    rho: float
    tau: float
    states: DataFrame
    data: ModelData
    config: ModelConfig
    design: DataFrame

    def view(self, variable: str | None = None) -> DataFrame:
        """The site view, or one instrument's own view, in physical units."""
        cfg = self.config
        if variable is None:
            kind = {"intercept": "site", "seasonality": "shared", "tag": None, "site_state": True}
        else:
            kind = cfg.instruments[variable]
        coefs = rec.view_coefficients(self.data.sites, self.params, 2 * cfg.harmonics, 0, kind["intercept"], kind["seasonality"], kind["tag"], optional=variable is None)
        return rec.reconstruct_view(self.states, None, coefs, variable or "sst", cfg.harmonics, cfg.period, kind.get("site_state", True))

    def views(self) -> dict[str, DataFrame]:
        return {"": self.view(), **{self.config.instruments[v]["tag"]: self.view(v) for v in self.config.views}}


def fit(data: ModelData, cfg: ModelConfig, shared_from: str, spread_reference: str, strict: bool = True) -> Fitted:
    """Estimate and smooth. Shared factors are not fitted: a configuration that asks for them is refused. ``shared_from`` names the instrument whose regressions give the shared terms.

    Without ``strict`` sites without shared terms, and instruments without an offset to them, observe nothing: such a site's states are predictions.
    """
    if cfg.factors:
        raise ValueError("factors are not fitted here; give loadings and factor states to the reconstruction")
    spark = data.observed.sparkSession
    spec = design.instrument_table(spark, cfg.instruments)
    # Written before anything is estimated: a site whose state no instrument observes is an error here.
    entries = staged(design.observation_design(data.series.where(F.col("variable").isin(list(cfg.instruments))), spec, 0, 2 * cfg.harmonics), "design")
    regressions = cut(design.seasonal_regressions(data.scaled, cfg.harmonics, cfg.period, cfg.min_obs))
    own = design.seed_table(regressions, data.sites.select("site", "site_index"), spec, shared_from, 2 * cfg.harmonics)
    params = cut(own.unionByName(_offsets(regressions, spec, shared_from)))

    unit_spread = matchup.match_up_variance(
        data.scaled.select("site", "date", "variable", F.col("y").alias("value")), [v for v in cfg.instruments if v != spread_reference], [spread_reference])
    variances = sm.error_variances(unit_spread, spread_reference)
    floor = variances.agg(F.min("r").alias("r"))
    variances = cut(variances.unionByName(floor.select(F.lit(spread_reference).alias("variable"), "r")))

    kinds, known = cfg.instruments, data.sites
    if not strict:
        known = known.join(small_side(regressions.where(F.col("variable") == shared_from).select("site")), "site", "left_semi")
        offsets = {f"mu_{s['tag']}" for s in kinds.values() if s["intercept"] == "site+instrument"}
        have = {r["name"] for r in params.where(F.col("name").isin(list(offsets))).select("name").collect()}
        kinds = {v: s for v, s in kinds.items() if s["intercept"] != "site+instrument" or f"mu_{s['tag']}" in have}
    resid = residuals(data, params, cfg, kinds, known)
    observing = [v for v, s in cfg.instruments.items() if s.get("site_state", True)]
    seen = staged(sm.collapse(resid.where(F.col("variable").isin(observing)), variances), "collapsed")
    axis = data.axis
    scores = sm.log_likelihoods(seen, axis.start, [tuple(c) for c in cfg.candidates], cfg.init_var, axis.time_step, axis.last_bin)
    scores = cut(scores)
    rho, tau = sm.best_candidate(scores) if strict or not scores.isEmpty() else cfg.candidates[0]
    states = sm.smooth(seen, axis.start, axis.last_bin, rho, tau, cfg.init_var, axis.time_step, sites=None if strict else data.sites)
    return Fitted(params, variances, rho, tau, staged(states, "states"), data, cfg, entries)


def _offsets(regressions: DataFrame, spec: DataFrame, shared_from: str) -> DataFrame:
    """One offset per ``site+instrument`` instrument: its mean departure from the shared intercepts."""
    base = regressions.where(F.col("variable") == shared_from).select("site", F.col("mu").alias("_base"))
    rows = regressions.join(small_side(spec.where("intercept = 'site+instrument'").select("variable", "tag")), "variable").join(small_side(base), "site")
    return rows.groupBy("tag").agg(F.avg(F.col("mu") - F.col("_base")).alias("value")).select(F.concat(F.lit("mu_"), "tag").alias("name"), "value")


def residuals(data: ModelData, params: DataFrame, cfg: ModelConfig, kinds: dict[str, dict], sites: DataFrame) -> DataFrame:
    """Scaled observations minus their instrument's intercept and season: (site, date, variable, resid)."""
    basis = list(harmonic_terms("date", cfg.harmonics, cfg.period).values())
    coefs = None
    for v, kind in kinds.items():
        c = rec.view_coefficients(sites, params, 2 * cfg.harmonics, 0, kind["intercept"], kind["seasonality"], kind["tag"], optional=True)
        c = c.select("site", F.lit(v).alias("variable"), "intercept", "season")
        coefs = c if coefs is None else coefs.unionByName(c)
    if coefs is None:
        return data.scaled.where("false").select("site", "date", "variable", F.col("y").alias("resid"))
    rows = data.scaled.join(small_side(coefs), ["site", "variable"])
    season = sum((F.col("season")[k] * b for k, b in enumerate(basis)), F.lit(0.0))
    return rows.select("site", "date", "variable", (F.col("y") - F.col("intercept") - season).alias("resid"))
