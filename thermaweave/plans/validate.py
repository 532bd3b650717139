"""Checking configurations against data. Every problem is collected before one error is raised."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import UNIT_BANDS
from ..operators.design import INTERCEPTS, SEASONALITIES
from .config import ModelConfig, PreprocessConfig


class ConfigError(ValueError):
    """All problems of a configuration, one per line."""

    def __init__(self, problems: list[str]):
        super().__init__("invalid configuration:\n  " + "\n  ".join(problems))
        self.problems = problems


def series_present(grid: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """For wanted (variable, site) pairs: how many values the grid holds."""
    names = grid.sparkSession.createDataFrame(wanted, "variable string, site string")
    have = grid.groupBy("variable", "site").agg(F.count("value").alias("n"))
    out = names.join(have, ["variable", "site"], "left")
    return out.select("variable", "site", F.coalesce("n", F.lit(0)).alias("n_values"), (F.coalesce("n", F.lit(0)) > 0).alias("present"))


def preprocessing_problems(cfg: PreprocessConfig, columns: list[str]) -> list[str]:
    """What is wrong with a preprocessing configuration for a table with these columns."""
    out = []
    labels = set(cfg.variables)
    if not labels:
        out.append("variables: at least one label is needed")
    for label, spec in cfg.variables.items():
        out += [f"variables[{label}]: no column {c}" for c in spec if c not in columns]
    if cfg.value_col not in columns:
        out.append(f"value_col: no column {cfg.value_col}")
    after = [c for c in columns if c not in {k for s in cfg.variables.values() for k in s}]
    if cfg.group_id is not None and cfg.group_id not in after:
        out.append(f"group_id: no column {cfg.group_id}")

    def known(where: str, names) -> None:
        out.extend(f"{where}: {n} is not a label" for n in names if n not in labels)

    known("units", cfg.units.variables)
    known("range", cfg.range.variables)
    if not cfg.range.lower < cfg.range.upper:
        out.append("range: lower must be less than upper")
    for spec in cfg.wind.variables:
        known("wind", [spec["target"], spec["wind"], spec["hour"]])
        if len({spec["target"], spec["wind"], spec["hour"]}) < 3:
            out.append("wind: target, wind and hour must differ")
    if not 0 <= cfg.wind.early < cfg.wind.late <= 24:
        out.append("wind: the window must satisfy 0 <= early < late <= 24")
    if cfg.wind.variables and not cfg.wind.local_time and cfg.wind.lon not in after:
        out.append(f"wind: no column {cfg.wind.lon}")
    known("season", cfg.season.variables)
    if not cfg.season.thresholds or any(t <= 0 for t in cfg.season.thresholds):
        out.append("season: thresholds must be positive")
    elif list(cfg.season.thresholds) != sorted(cfg.season.thresholds, reverse=True):
        out.append("season: thresholds must not increase")
    if cfg.season.variables:
        out += [f"season: no column {c}" for c in (cfg.season.time, cfg.season.group) if c not in after]
    if cfg.season.harmonics < 1:
        out.append("season: harmonics must be at least 1")
    for spec in cfg.match_up.variables:
        known("match_up", [spec["target"], spec["reference"]])
        if spec["target"] == spec["reference"]:
            out.append("match_up: target and reference must differ")
    if any(b is not None and b <= 0 for b in (cfg.match_up.lower, cfg.match_up.upper)):
        out.append("match_up: bounds must be positive")
    if cfg.match_up.passes < 1:
        out.append("match_up: passes must be at least 1")
    known("variance", [*cfg.variance.targets, *cfg.variance.references])
    if cfg.variance.pairs == "elementwise" and len(cfg.variance.targets) != len(cfg.variance.references):
        out.append("variance: elementwise pairs need lists of one length")
    known("grid", cfg.grid.variables)
    if cfg.grid.time_step < 1:
        out.append("grid: time_step must be at least one day")
    for name, unit in (("src", cfg.units.src), ("dst", cfg.units.dst)):
        if unit.upper() not in UNIT_BANDS:
            out.append(f"units: {name} must be one of {', '.join(UNIT_BANDS)}")
    if cfg.wind.threshold <= 0:
        out.append("wind: threshold must be positive")
    if cfg.match_up.scale not in ("mad", "sd"):
        out.append("match_up: scale must be mad or sd")
    if cfg.match_up.center not in ("median", "mean"):
        out.append("match_up: center must be median or mean")
    if cfg.variance.pairs not in ("cross", "elementwise"):
        out.append("variance: pairs must be cross or elementwise")
    bounds = cfg.variance.valid_range
    if bounds and not bounds[0] < bounds[1]:
        out.append("variance: valid_range must increase")
    if len(set(cfg.grid.variables)) < len(cfg.grid.variables):
        out.append("grid: a variable is named twice")
    if cfg.grid.harmonics < 1:
        out.append("grid: harmonics must be at least 1")
    if cfg.grid.variables:
        out += [f"grid: no column {c}" for c in (cfg.grid.site, cfg.grid.time) if c not in after]
    for where, by in (("match_up", cfg.match_up.by), ("variance", cfg.variance.by)):
        out += [f"{where}: no group column {c}" for c in by or [] if c not in after]
    for where, ids in (("wind", cfg.wind.ids), ("match_up", cfg.match_up.ids), ("variance", cfg.variance.ids)):
        out += [f"{where}: no id column {c}" for c in ids or [] if c not in after]
    return out


def label_matches(df: DataFrame, labels: dict[str, dict]) -> DataFrame:
    """(label, n_rows, fault) for each label of a configuration, from one aggregate: a fault is a label that matches no row."""
    from ..operators.labelling import spec_predicate

    counts = df.agg(*[F.count_if(spec_predicate(s)).alias(f"n{i}") for i, s in enumerate(labels.values())])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"n{i}").alias("n_rows")) for i, n in enumerate(labels)]))
    return counts.select(cells.alias("c")).select("c.label", "c.n_rows", (F.col("c.n_rows") == 0).alias("fault"))


def validate_preprocessing(cfg: PreprocessConfig, df: DataFrame) -> PreprocessConfig:
    """Configuration problems and labels that match no row, in one error."""
    problems = preprocessing_problems(cfg, df.columns)
    if not problems:
        problems = [f"variables[{r['label']}]: matches no row" for r in label_matches(df, cfg.variables).where("fault").collect()]
    if problems:
        raise ConfigError(problems)
    return cfg


def series_facts(cfg: ModelConfig, series: DataFrame, examples: int = 20) -> dict:
    """What the checks need to know about the (variable, site) series of a grid.

    Aggregated in Spark: one row per variable, one per site the configuration names, a count and a few
    examples reach the driver, never the series themselves.
    """
    pairs = series.select("variable", "site").distinct()
    chosen = F.lit(True) if cfg.sites is None else F.col("site").isin(list(cfg.sites))
    held = F.col("site").isin(list(cfg.holdout_sites)) & F.col("variable").isin(list(cfg.holdout_variables))
    live = chosen & ~held
    by_variable = pairs.groupBy("variable").agg(F.count_if(chosen).alias("chosen"), F.count_if(live).alias("live")).collect()
    named = sorted(set(cfg.sites or []) | set(cfg.holdout_sites))
    by_site = pairs.where(F.col("site").isin(named)).groupBy("site").agg(F.count_if(live).alias("live")).collect()
    per_site = pairs.where(chosen).groupBy("site").agg(F.count_if(live & (F.col("variable") == F.lit(cfg.scale_reference))).alias("ref"))
    unscaled = [] if cfg.scale_reference is None else [r["site"] for r in per_site.where("ref = 0").orderBy("site").limit(examples).collect()]
    return {
        "variables": {r["variable"]: (r["chosen"], r["live"]) for r in by_variable}, "sites": {r["site"]: r["live"] for r in by_site},
        "n_sites": per_site.count(), "unscaled": unscaled,
    }


def model_problems(cfg: ModelConfig, facts: dict) -> list[str]:
    """What is wrong with a model configuration, given :func:`series_facts`."""
    out = [f"sites: no data at {s}" for s in sorted(set(cfg.sites or []) - set(facts["sites"]))]
    for s in sorted(set(cfg.holdout_sites)):
        if (cfg.sites is not None and s not in cfg.sites) or s not in facts["sites"]:
            out.append(f"holdout_sites: {s} is not a selected site")
        elif facts["sites"][s] == 0:
            out.append(f"holdout: nothing is left at {s}")
    if cfg.holdout_sites and cfg.scale_reference in cfg.holdout_variables:
        out.append("holdout_variables: the scaling reference cannot be withheld")
    tags = [s["tag"] for s in cfg.instruments.values()]
    if len(set(tags)) < len(tags):
        out.append("instruments: tags must be unique")
    for v, s in cfg.instruments.items():
        if s["intercept"] not in INTERCEPTS:
            out.append(f"instruments[{v}]: unknown intercept kind {s['intercept']}")
        if s["seasonality"] not in SEASONALITIES:
            out.append(f"instruments[{v}]: unknown seasonality kind {s['seasonality']}")
    for v, (chosen, live) in sorted(facts["variables"].items()):
        if chosen and v not in cfg.instruments:
            out.append(f"instruments: no entry for {v}")
        elif chosen and not live:
            out.append(f"holdout: {v} is withheld everywhere")
    out += [f"scale_reference: no {cfg.scale_reference} at {s}" for s in facts["unscaled"]]
    if cfg.factors > facts["n_sites"]:
        out.append("factors: cannot exceed the number of sites")
    if cfg.start is not None and cfg.end is not None and not str(cfg.start) < str(cfg.end):
        out.append("start must be before end")
    return out


def validate_model(cfg: ModelConfig, series: DataFrame) -> ModelConfig:
    """All checks of a model configuration against a grid's series, in one error."""
    problems = model_problems(cfg, series_facts(cfg, series))
    if problems:
        raise ConfigError(problems)
    return cfg
