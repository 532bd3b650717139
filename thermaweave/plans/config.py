"""Configuration of the jobs, loadable from a dict or JSON."""

from __future__ import annotations

import dataclasses
import json
import typing
from dataclasses import dataclass, field


@dataclass
class Units:
    variables: list[str] = field(default_factory=list)
    src: str = "K"
    dst: str = "C"
    check_range: bool = True
    strict: bool = True


@dataclass
class Range:
    variables: list[str] = field(default_factory=list)
    lower: float = 0.0
    upper: float = 40.0
    keep_na: bool = True


@dataclass
class Wind:
    variables: list[dict] = field(default_factory=list)
    early: float = 9.0
    late: float = 18.0
    threshold: float = 2.0
    local_time: bool = False
    lon: str = "lon"
    ids: list[str] | None = None
    drop_covariates: bool = False
    keep_na: bool = True


@dataclass
class Season:
    variables: list[str] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=lambda: [3.3, 2.58])
    time: str = "time"
    group: str = "point_id"
    harmonics: int = 1
    robust: bool = True
    keep_na: bool = True


@dataclass
class MatchUp:
    variables: list[dict] = field(default_factory=list)
    lower: float | None = 100.0
    upper: float | None = 100.0
    slope: float | None = 1.0
    intercept: float | None = None
    ids: list[str] | None = None
    by: list[str] | None = None
    passes: int = 1
    scale: str = "mad"
    center: str = "median"
    keep_na: bool = True
    min_n: int = 10


@dataclass
class Variance:
    enabled: bool = True
    targets: list[str] = field(default_factory=list)
    references: list[str] = field(default_factory=list)
    pairs: str = "cross"
    ids: list[str] | None = None
    by: list[str] | None = None
    valid_range: list[float] | None = None
    trim: float | None = None
    min_n: int = 10


@dataclass
class GridFormat:
    enabled: bool = True
    variables: list[str] = field(default_factory=list)
    time_step: int = 1
    harmonics: int = 2
    period: float = 365.25
    site: str = "point_id"
    time: str = "time"


@dataclass
class PreprocessConfig:
    variables: dict[str, dict] = field(default_factory=dict)
    value_col: str = "value"
    group_id: str | None = None
    units: Units = field(default_factory=Units)
    range: Range = field(default_factory=Range)
    wind: Wind = field(default_factory=Wind)
    season: Season = field(default_factory=Season)
    match_up: MatchUp = field(default_factory=MatchUp)
    variance: Variance = field(default_factory=Variance)
    grid: GridFormat = field(default_factory=GridFormat)
    diagnostics: bool = True


@dataclass
class ModelConfig:
    instruments: dict[str, dict] = field(default_factory=dict)
    sites: list[str] | None = None
    start: str | None = None
    end: str | None = None
    holdout_sites: list[str] = field(default_factory=list)
    holdout_variables: list[str] = field(default_factory=lambda: ["insitu_sst"])
    scale_reference: str | None = None
    factors: int = 0
    harmonics: int = 1
    period: float = 365.25
    min_obs: int = 10
    candidates: list[list[float]] = field(default_factory=lambda: [[r, t] for r in (0.5, 0.8, 0.9, 0.95, 0.98) for t in (0.01, 0.05, 0.1, 0.3, 0.6)])
    init_var: float = 1.0
    views: list[str] = field(default_factory=list)


def from_dict(kind, values: dict):
    """Build a configuration; unknown keys are an error, because a misspelt one would be silent."""
    hints = typing.get_type_hints(kind)
    known = {f.name for f in dataclasses.fields(kind)}
    unknown = sorted(set(values) - known)
    if unknown:
        raise ValueError(f"unknown {kind.__name__} keys: {', '.join(unknown)}")
    return kind(**{k: from_dict(hints[k], v) if dataclasses.is_dataclass(hints[k]) and isinstance(v, dict) else v for k, v in values.items()})


def load_json(kind, path: str):
    with open(path, encoding="utf-8") as f:
        return from_dict(kind, json.load(f))
