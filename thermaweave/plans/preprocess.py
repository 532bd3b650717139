"""Raw extract to clean table, removal log, summaries and grid.

Shuffles of the raw rows: one by key for the wind screens (all of them share it), one by key for
each match-up screen. Everything else is a narrow expression, a join to a small counted table, or a
partial aggregate.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.lineage import staged
from ..operators import guards, matchup, screening, summaries
from ..operators.grid import Grid, build_grid, seasonal_basis
from ..operators.labelling import convert_temperature, label_variables
from .config import PreprocessConfig
from .validate import validate_preprocessing


@dataclass
class Preprocessed:
    """Everything is lazy over ``flags``, the screened table written once."""

    flags: DataFrame
    steps: list[tuple[int, str, str]]
    config: PreprocessConfig
    fits: list[DataFrame] = field(default_factory=list)

    @property
    def clean(self) -> DataFrame:
        return screening.kept(self.flags)

    @property
    def removed(self) -> DataFrame:
        return screening.removed(self.flags)

    def stage_counts(self) -> DataFrame:
        return screening.stage_counts(self.flags, self.steps)

    def removal_summary(self) -> DataFrame:
        return summaries.removal_summary(self.flags, self.config.group_id)

    def variable_summary(self) -> DataFrame:
        frame = summaries.kept_removed_frame(self.flags, self.config.group_id)
        return summaries.variable_summary(frame, self.config.group_id is not None)

    def histogram(self, bins: int = 100) -> DataFrame:
        return summaries.histogram(summaries.kept_removed_frame(self.flags), bins)

    def group_display(self) -> DataFrame:
        return summaries.group_display(summaries.kept_removed_frame(self.flags, self.config.group_id))

    def match_up_variance(self) -> DataFrame | None:
        v = self.config.variance
        if not (v.enabled and v.targets and v.references):
            return None
        return matchup.match_up_variance(
            self.clean, v.targets, v.references, v.pairs, v.ids, v.by, tuple(v.valid_range) if v.valid_range else None, v.trim, v.min_n)

    def grid(self) -> Grid | None:
        g = self.config.grid
        if not (g.enabled and g.variables):
            return None
        return build_grid(self.clean, g.variables, g.time_step, "mean", g.site, g.time)

    def basis(self, grid: Grid) -> DataFrame:
        g = self.config.grid
        return seasonal_basis(grid.axis(self.flags.sparkSession), g.harmonics, g.period)

    def tables(self) -> dict[str, DataFrame]:
        """The summary tables to write."""
        out = {"stage_counts": self.stage_counts()}
        if self.config.diagnostics:
            out |= {"variable_summary": self.variable_summary(), "removal_summary": self.removal_summary(), "histogram": self.histogram()}
            if self.config.group_id is not None:
                out["group_display"] = self.group_display()
        spread = self.match_up_variance()
        if spread is not None:
            out["match_up_variance"] = spread
        for i, fit in enumerate(self.fits, start=1):
            out[f"match_up_fit_{i}"] = fit
        return out


def check_alignment(df: DataFrame, spec: dict, ids: list[str] | None = None) -> None:
    """Stop when no key has both wind and hour, and warn when few have or their values look odd."""
    m = guards.alignment_metrics(screening.kept(df), spec["target"], spec["wind"], spec["hour"], ids=ids).first()
    if m["n_any"] and not m["n_usable"]:
        raise ValueError(f"{spec['target']}: no observation has both {spec['wind']} and {spec['hour']}; the extracts are not aligned")
    for flag, text in (("poorly_aligned", "under half of the observations have wind and hour"), ("hour_out_of_range", "hours outside 0 to 24"), ("wind_suspicious", "winds over 60")):
        if m[flag]:
            warnings.warn(f"{spec['target']}: {text}", stacklevel=2)


def preprocess(raw: DataFrame, cfg: PreprocessConfig, validate: bool = True) -> Preprocessed:
    """Label, convert, screen in order: range, wind, season, match-up."""
    if validate:
        validate_preprocessing(cfg, raw)
    df = label_variables(raw, cfg.variables, cfg.value_col)
    u = cfg.units
    if u.variables:
        df = convert_temperature(df, u.variables, u.src, u.dst, "value", u.check_range, u.strict)
    steps: list[tuple[int, str, str]] = []

    def step(stage: str, variable: str) -> int:
        steps.append((len(steps) + 1, stage, variable))
        return len(steps)

    df = screening.begin(df)
    for v in cfg.range.variables:
        df = screening.screen_range(df, v, cfg.range.lower, cfg.range.upper, cfg.range.keep_na, step(screening.RANGE_STAGE, v))
    w = cfg.wind
    for s in w.variables:
        if validate:
            check_alignment(df, s, w.ids)
        df = screening.screen_wind(df, s["target"], s["wind"], s["hour"], w.early, w.late, w.threshold, w.local_time, w.lon, w.ids,
                                   w.drop_covariates, w.keep_na, step(screening.WIND_STAGE, s["target"]))
    df = staged(df, "screened", ["variable"])
    o = cfg.season
    if o.variables:
        first = [step(screening.SEASON_STAGE, v) for v in o.variables][0]
        df = screening.screen_seasonal(df, o.variables, o.thresholds, o.time, o.group, o.harmonics, robust=o.robust, keep_na=o.keep_na, step=first)
    m, fits = cfg.match_up, []
    for s in m.variables:
        df = matchup.screen_match_up(df, s["target"], s["reference"], m.lower, m.upper, m.slope, m.intercept, m.ids, m.by, m.passes, m.scale,
                                     m.center, m.keep_na, m.min_n, step(screening.MATCH_STAGE, s["target"]), fits)
    if o.variables or m.variables:
        df = staged(df, "flags", ["variable"])
    return Preprocessed(df, steps, cfg, fits)
