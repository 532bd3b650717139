"""Quality screening.

One lazy table of rows carries a ``stage`` column that starts NULL. Each screen looks only at
rows still NULL and marks what it rejects, with its diagnostics, so nothing is split or
stacked again: ``kept`` and ``removed`` are filters.
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import MAD_FACTOR, SEASON_DAYS, harmonic_terms, percent, solar_hour, wrap_hours
from ..functions.lineage import BROADCAST_ROWS, cut_counted
from ..functions.quantiles import quantile_table
from .labelling import id_columns, require_columns

# Stage names and removal reasons.
RANGE_STAGE, WIND_STAGE, SEASON_STAGE, MATCH_STAGE = "physics_filter", "wind_filter", "outliers", "matchup_filter"
BELOW, ABOVE, MISSING = "below lower threshold", "above upper threshold", "missing value (untestable)"
CALM_DAY, DAY_NO_WIND, CALM_NO_TIME, NO_COVARIATES = (
    "calm within window",
    "within window, wind unknown",
    "calm, time unknown",
    "missing covariates",
)
DIAGNOSTICS = {
    "step": "int",
    "stage": "string",
    "stage_variable": "string",
    "reason": "string",
    "lower_threshold": "double",
    "upper_threshold": "double",
    "resid": "double",
    "removed_pass": "int",
    "solar_time": "double",
    "wind_speed": "double",
    "ref_value": "double",
}


def begin(df: DataFrame) -> DataFrame:
    """Add the provenance columns, all NULL."""
    if "stage" in df.columns:
        return df
    require_columns(df, ["variable", "value"])
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in DIAGNOSTICS.items()])


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in DIAGNOSTICS]


def kept(df: DataFrame) -> DataFrame:
    """Rows no screen rejected, without the provenance columns."""
    return df.where(F.col("stage").isNull()).select(*data_columns(df))


def removed(df: DataFrame) -> DataFrame:
    """The removal log: provenance first, then the row.

    Untestable rows dropped by ``keep_na=False`` leave the data but are not logged as removals.
    """
    lead = ["stage", "stage_variable", "variable", "value"]
    logged = F.col("stage").isNotNull() & ~F.col("reason").eqNullSafe(F.lit(MISSING))
    return df.where(logged).select(*lead, *[c for c in df.columns if c not in lead])


def mark(df: DataFrame, step: int | Column, stage: str, variable: str | Column, hit: Column, **diagnostics: Column) -> DataFrame:
    """Flag the rows in ``hit`` that are still alive."""
    hit = F.col("stage").isNull() & F.coalesce(hit, F.lit(False))
    values = {"step": F.lit(step), "stage": F.lit(stage), "stage_variable": F.lit(variable), **diagnostics}
    out = df.withColumn("_hit", hit)
    changed = {c: F.when(F.col("_hit"), v.cast(DIAGNOSTICS[c])).otherwise(F.col(c)) for c, v in values.items()}
    return out.withColumns(changed).drop("_hit")


def alive(variable: str | None = None) -> Column:
    test = F.col("stage").isNull()
    return test if variable is None else test & F.col("variable").eqNullSafe(F.lit(variable))


# ---- physical range -------------------------------------------------------------------------


def range_reason(value, lower: float, upper: float) -> Column:
    """NULL when strictly inside the bounds or missing; the bounds themselves are rejected."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v <= lower, F.lit(BELOW)).when(v >= upper, F.lit(ABOVE))


def screen_range(df: DataFrame, variable: str, lower: float = 0.0, upper: float = 40.0, keep_na: bool = True, step: int = 1) -> DataFrame:
    if not lower < upper:
        raise ValueError("lower must be less than upper")
    df = begin(df)
    why = range_reason("value", lower, upper)
    if not keep_na:
        why = F.coalesce(why, F.when(F.col("value").isNull(), F.lit(MISSING)))
    return mark(
        df, step, RANGE_STAGE, variable, alive(variable) & why.isNotNull(),
        reason=why, lower_threshold=F.lit(float(lower)), upper_threshold=F.lit(float(upper)),
    )


def range_summary(df: DataFrame, variables: list[str], lower: float = 0.0, upper: float = 40.0) -> DataFrame:
    """Outcome counts per variable: retained, missing, below, above."""
    outcome = F.coalesce(range_reason("value", lower, upper), F.when(F.col("value").isNull(), F.lit(MISSING)), F.lit("retained"))
    kinds = ["retained", MISSING, BELOW, ABOVE]
    counts = (
        df.where(F.col("variable").isin(variables)).groupBy("variable")
        .agg(F.count(F.lit(1)).alias("n_var"), *[F.count_if(outcome == k).alias(f"_{i}") for i, k in enumerate(kinds)])
    )
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(f"_{i}").alias("n")) for i, k in enumerate(kinds)]))
    return counts.select("variable", "n_var", cells.alias("c")).select("variable", "c.reason", "c.n", percent("c.n", "n_var", 2).alias("pct_of_var"))


# ---- reshaping by key -----------------------------------------------------------------------


def pivot_keys(df: DataFrame, ids: list[str], variables: list[str]) -> DataFrame:
    """One row per key with a column per variable; a repeated cell is an error.

    The filter comes first: keys holding only other variables must not appear.
    """
    cells = []
    for v in variables:
        here = F.col("variable") == v
        many = F.count_if(here) > 1
        cells.append(
            F.when(many, F.raise_error(f"duplicate observations per key for {v}").cast("double"))
            .otherwise(F.max(F.when(here, F.col("value")))).alias(v)
        )
    return df.where(F.col("variable").isin(variables)).groupBy(*ids).agg(*cells)


def per_key(variable: str, ids: list[str], guarded: list[str] = (), strict: bool = True) -> Column:
    """The live value of another variable at this row's key, by window.

    Windows over one set of ids share a shuffle and match NULL ids to each other, so this
    replaces a pivot followed by a join back. A repeat of this or a guarded variable is an error;
    without ``strict`` only one of a guarded variable is, and of this variable's repeats the largest value counts.
    """
    over = Window.partitionBy(*ids)
    single = [variable, *guarded] if strict else list(guarded)
    many = functools.reduce(operator.or_, [F.count_if(alive(v)).over(over) > 1 for v in single], F.lit(False))
    return F.when(many, F.raise_error(f"duplicate observations per key among {single}").cast("double")).otherwise(
        F.max(F.when(alive(variable), F.col("value"))).over(over)
    )


# ---- calm daytime ---------------------------------------------------------------------------


def wind_verdict(solar: Column, wind: Column, early: float, late: float, threshold: float) -> dict[str, Column]:
    """Three-valued ``in_window``, ``calm`` and ``risky`` tests."""
    in_window = (solar > early) & (solar < late)
    calm = wind <= threshold
    return {"in_window": in_window, "calm": calm, "risky": in_window & calm}


def wind_reason(verdict: dict[str, Column]) -> Column:
    risky, yes = verdict["risky"], F.lit(True)
    return (
        F.when(risky, F.lit(CALM_DAY))
        .when(risky.isNull() & verdict["in_window"].eqNullSafe(yes), F.lit(DAY_NO_WIND))
        .when(risky.isNull() & verdict["calm"].eqNullSafe(yes), F.lit(CALM_NO_TIME))
        .otherwise(F.lit(NO_COVARIATES))
    )


def _check_window(early: float, late: float) -> None:
    if not (0 <= early < late <= 24):
        raise ValueError("the window must satisfy 0 <= early < late <= 24")


def screen_wind(
    df: DataFrame,
    target: str,
    wind: str,
    hour: str,
    early: float = 10.0,
    late: float = 18.0,
    threshold: float = 2.0,
    local_time: bool = False,
    lon: str = "lon",
    ids: list[str] | None = None,
    drop_covariates: bool = False,
    keep_na: bool = True,
    step: int = 1,
) -> DataFrame:
    """Reject target rows (empty ones too) at keys that are calm inside the daytime window."""
    _check_window(early, late)
    if len({target, wind, hour}) < 3:
        raise ValueError("target, wind and hour must be different variables")
    df = begin(df)
    ids = [c for c in (ids or id_columns(df)) if c not in DIAGNOSTICS]
    cols = df.columns
    keyed = df.select("*", per_key(wind, ids, [target]).alias("_w"), per_key(hour, ids).alias("_h"))
    solar = wrap_hours("_h") if local_time else solar_hour("_h", lon)
    keyed = keyed.withColumn("_s", solar)
    verdict = wind_verdict(F.col("_s"), F.col("_w"), early, late, threshold)
    bad = F.coalesce(verdict["risky"], F.lit(not keep_na))
    subject = F.col("variable").isin([target, wind, hour] if drop_covariates else [target])
    out = mark(
        keyed, step, WIND_STAGE, target, subject & bad,
        reason=wind_reason(verdict), solar_time=F.col("_s"), wind_speed=F.col("_w"),
    )
    return out.select(*cols)


def wind_keys(
    df: DataFrame, target: str, wind: str, hour: str, early: float = 10.0, late: float = 18.0, threshold: float = 2.0,
    local_time: bool = False, lon: str = "lon", ids: list[str] | None = None, keep_na: bool = True,
) -> DataFrame:
    """One row per key with the screening decision, for summaries."""
    _check_window(early, late)
    ids = id_columns(df, ids)
    wide = pivot_keys(df, ids, [target, wind, hour])
    wide = wide.select(*ids, F.col(target).alias("target_value"), F.col(wind).alias("wind_speed"), F.col(hour).alias("_h"))
    wide = wide.withColumn("solar_time", wrap_hours("_h") if local_time else solar_hour("_h", lon))
    verdict = wind_verdict(F.col("solar_time"), F.col("wind_speed"), early, late, threshold)
    bad = F.coalesce(verdict["risky"], F.lit(not keep_na))
    some = F.col("target_value").isNotNull() | F.col("wind_speed").isNotNull() | F.col("_h").isNotNull()
    return wide.select(
        *ids, "target_value", "wind_speed", F.col("_h").alias("hour"), "solar_time",
        (~bad).alias("retained"), F.when(bad, wind_reason(verdict)).alias("reason"), some.alias("has_any"),
    )


def wind_summary(keys: DataFrame) -> DataFrame:
    """Outcome counts over keys that hold any of the three values."""
    kinds = ["retained", CALM_DAY, DAY_NO_WIND, CALM_NO_TIME, NO_COVARIATES]
    outcome = F.coalesce(F.col("reason"), F.lit("retained"))
    counts = keys.where("has_any").agg(F.count(F.lit(1)).alias("n_obs"), *[F.count_if(outcome == k).alias(f"_{i}") for i, k in enumerate(kinds)])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(f"_{i}").alias("n")) for i, k in enumerate(kinds)]))
    return counts.select("n_obs", cells.alias("c")).select("c.reason", "c.n", percent("c.n", "n_obs", 2).alias("pct_of_obs"))


def wind_counts(keys: DataFrame) -> DataFrame:
    """n_obs, n_keys, n_target_total and n_target_removed in one aggregate."""
    has_target = F.col("target_value").isNotNull()
    return keys.agg(
        F.count_if("has_any").alias("n_obs"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(has_target).alias("n_target_total"),
        F.count_if(has_target & ~F.col("retained")).alias("n_target_removed"),
    )


# ---- seasonal residual ----------------------------------------------------------------------


class SeasonalFit:
    """Per variable: pooled harmonic slopes and a residual centre and scale; per group: a level.

    ``groups`` is the (small, already written) table of (variable, group, means); the rest is a
    handful of numbers per configured variable.
    """

    def __init__(self, groups: DataFrame, group: str, terms: dict[str, Column], betas: dict[str, list[float]], counts: dict[str, int]):
        self.groups, self.group, self.terms, self.betas, self.counts = groups, group, terms, betas, counts
        self.center: dict[str, float] = {}
        self.scale: dict[str, float] = {}

    def _pick(self, numbers: dict[str, float]) -> Column:
        """A number by variable; NULL where there is none."""
        out = F.lit(None).cast("double")
        for v, x in numbers.items():
            out = F.when(F.col("variable") == v, F.lit(float(x))).otherwise(out)
        return out

    def residual(self, value: str = "value") -> Column:
        """Raw residual on a table that has its group's means joined, exactly zero for a group's only value; NULL where untestable."""
        slopes = [self._pick({v: b[k] for v, b in self.betas.items()}) for k in range(len(self.terms))]
        off = [b * (t - F.col(f"_m_{name}")) for b, (name, t) in zip(slopes, self.terms.items())]
        return functools.reduce(operator.sub, off, F.col(value) - F.col("_my"))

    def score(self, df: DataFrame, name: str = "_score", value: str = "value") -> DataFrame:
        """Standardised residual as a column; a broadcast join when the group table was found small."""
        if not self.scale:
            return df.withColumn(name, F.lit(None).cast("double"))
        joined = df.join(self.groups, ["variable", self.group], "left")
        off, scale = self.residual(value) - self._pick(self.center), self._pick(self.scale)
        beyond = F.when(off == 0, F.lit(math.nan)).otherwise(F.signum(off) * F.lit(math.inf))
        score = F.when(scale == 0, beyond).otherwise(off / F.nullif(scale, F.lit(0.0)))
        return joined.withColumn(name, score).select(*df.columns, name)


def fit_seasonal(
    df: DataFrame, variables: list[str], value: str = "value", time: str = "time", group: str = "point_id", harmonics: int = 1,
    period: float = SEASON_DAYS, robust: bool = False, strict: bool = True,
) -> SeasonalFit:
    """Least squares of value on harmonics with group intercepts, for several variables at once.

    No dummies are built: centred cross-products are additive over groups, so one partial aggregate
    per (variable, group) gives the normal equations, and only their sums (2H x 2H numbers per
    variable) reach the driver. With ``strict`` a variable with too few rows or no residual scale gets no scores.
    Otherwise its own fit is used, however few its rows: where they give no slopes, or a scale of zero, scores are NaN or infinite.
    """
    terms = harmonic_terms(time, harmonics, period)
    names = list(terms)
    usable = F.col("variable").isin(variables) & F.col(value).isNotNull() & F.col(time).isNotNull() & F.col(group).isNotNull()
    rows = df.where(usable).select("variable", group, time, F.col(value).cast("double").alias(value))
    terms_of = rows.withColumns({t: c for t, c in terms.items()})
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    groups, n_groups = cut_counted(
        terms_of.groupBy("variable", group).agg(
            F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_my"), *[F.avg(t).alias(f"_m_{t}") for t in names],
            *[F.covar_pop(a, b).alias(f"_x_{a}_{b}") for a, b in pairs], *[F.covar_pop(t, value).alias(f"_y_{t}") for t in names],
        )
    )
    sums = groups.groupBy("variable").agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("groups"),
        *[F.sum(F.col(f"_x_{a}_{b}") * F.col("_n")).alias(f"x_{a}_{b}") for a, b in pairs],
        *[F.sum(F.col(f"_y_{t}") * F.col("_n")).alias(f"y_{t}") for t in names],
    )
    betas, counts = {}, {}
    for total in sums.collect():
        if strict and total["n"] < len(names) + max(total["groups"], 1) + 2:
            continue
        gram = np.zeros((len(names), len(names)))
        for a, b in pairs:
            i, j = names.index(a), names.index(b)
            gram[i, j] = gram[j, i] = total[f"x_{a}_{b}"]
        # The pseudo-inverse stands in for dropping aliased terms.
        slopes = np.linalg.pinv(gram, rcond=1e-10) @ np.array([total[f"y_{t}"] for t in names])
        sizes = np.linalg.svd(gram, compute_uv=False)
        aliased = not strict and sizes[-1] <= 1e-10 * sizes[0]
        betas[total["variable"]] = [math.nan] * len(names) if aliased else list(slopes)
        counts[total["variable"]] = total["n"]
    fit = SeasonalFit(groups, group, terms, betas, counts)
    if not betas:
        return fit
    slim = groups.select("variable", group, "_my", *[f"_m_{t}" for t in names])
    fit.groups = F.broadcast(slim) if n_groups <= BROADCAST_ROWS else slim

    resid = rows.join(fit.groups, ["variable", group]).select("variable", fit.residual(value).alias("_r")).where(F.col("_r").isNotNull())
    if robust:
        def by_variable(table: DataFrame, column: str) -> dict[str, float]:
            return {r["variable"]: math.nan if r["q"] is None else r["q"] for r in quantile_table(table, ["variable"], column, {"q": 0.5}).collect()}

        fit.center = by_variable(resid, "_r")
        dev = resid.select("variable", F.abs(F.col("_r") - fit._pick(fit.center)).alias("_d"))
        fit.scale = {v: MAD_FACTOR * q for v, q in by_variable(dev, "_d").items()}
    if not robust or (strict and any(not s for s in fit.scale.values())):
        for r in resid.groupBy("variable").agg(F.avg("_r").alias("m"), F.stddev_samp("_r").alias("s")).collect():
            if not robust:
                fit.center[r["variable"]] = r["m"]
            if not fit.scale.get(r["variable"]):
                fit.scale[r["variable"]] = r["s"]
    fit.scale = {v: s for v, s in fit.scale.items() if s is not None and (not strict or (s and math.isfinite(s)))}
    return fit


def screen_seasonal(
    df: DataFrame, variables: str | list[str], thresholds=(5.0, 2.58), time: str = "time", group: str = "point_id", harmonics: int = 1,
    period: float = SEASON_DAYS, robust: bool = False, keep_na: bool = True, step: int = 1, log: list | None = None, strict: bool = True,
) -> DataFrame:
    """Fit, standardise, reject; then refit on the survivors for each further threshold.

    With ``strict`` a variable with too few rows for a fit keeps them all; see :func:`fit_seasonal` for what happens otherwise.

    Variables do not affect each other, so a list of them shares every job; they take consecutive
    step numbers. Between passes only the fitted group table is written out. Rows are never
    rewritten: each pass is a join to that table and an expression.
    """
    if not thresholds or any(not math.isfinite(t) or t <= 0 for t in thresholds):
        raise ValueError("thresholds must be positive")
    names = [variables] if isinstance(variables, str) else list(variables)
    df = begin(df)
    require_columns(df, [time, group])
    cols = df.columns
    usable = F.col("value").isNotNull() & F.col(time).isNotNull() & F.col(group).isNotNull()
    live = F.col("stage").isNull() & F.coalesce(F.col("variable").isin(names), F.lit(False))
    position = F.array_position(F.array(*map(F.lit, names)), F.col("variable")) + F.lit(step - 1)
    for number, threshold in enumerate(thresholds, start=1):
        fit = fit_seasonal(df.where(live), names, "value", time, group, harmonics, period, robust, strict)
        if log is not None:
            log.append({"pass": number, "threshold": float(threshold), "fit": fit})
        if not fit.scale:
            continue
        df = fit.score(df)
        hit = live & usable & (F.abs("_score") >= threshold)
        df = mark(df, position, SEASON_STAGE, F.col("variable"), hit, resid=F.col("_score"), removed_pass=F.lit(number)).select(*cols)
    if not keep_na:
        df = mark(df, position, SEASON_STAGE, F.col("variable"), live & ~usable, reason=F.lit(MISSING))
    return df


def seasonal_summary(df: DataFrame, variable: str, thresholds, time: str = "time", group: str = "point_id", step: int | None = None) -> DataFrame:
    """Rows in and removed per pass, from the flags of :func:`screen_seasonal` in one aggregate."""
    usable = F.col("value").isNotNull() & F.col(time).isNotNull() & F.col(group).isNotNull()
    mine = F.col("stage").eqNullSafe(F.lit(SEASON_STAGE)) & F.col("stage_variable").eqNullSafe(F.lit(variable))
    later = F.col("stage").isNull() | mine
    if step is not None:
        later = later | (F.col("step") > step)
    rows = df.where((F.col("variable") == variable) & usable & later)
    hit = F.when(mine, F.col("removed_pass"))
    passes = list(enumerate(thresholds, start=1))
    agg = rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(hit == p).alias(f"_r{p}") for p, _ in passes],
        *[F.count_if(hit < p).alias(f"_b{p}") for p, _ in passes],
    )
    cells = F.explode(F.array(*[
        F.struct(F.lit(p).alias("pass"), F.lit(float(t)).alias("threshold"), (F.col("n") - F.col(f"_b{p}")).alias("n_in"), F.col(f"_r{p}").alias("n_removed"))
        for p, t in passes
    ]))
    return agg.select(cells.alias("c")).select("c.*")


# ---- removal log and counts -----------------------------------------------------------------


def stage_counts(df: DataFrame, steps: list[tuple[int, str, str]]) -> DataFrame:
    """Rows in, out and removed for every step, from one aggregate over the ``step`` column."""
    agg = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(F.col("step") < k).alias(f"_b{k}") for k, _, _ in steps],
        *[F.count_if(F.col("step") == k).alias(f"_r{k}") for k, _, _ in steps],
    )
    cells = F.explode(F.array(*[
        F.struct(
            F.lit(k).alias("step"), F.lit(stage).alias("stage"), F.lit(variable).alias("variable"),
            (F.col("n") - F.col(f"_b{k}")).alias("n_in"), F.col(f"_r{k}").alias("n_removed"),
        ) for k, stage, variable in steps
    ]))
    out = agg.select(cells.alias("c")).select("c.*")
    return out.select("step", "stage", "variable", "n_in", (F.col("n_in") - F.col("n_removed")).alias("n_out"), "n_removed",
                      percent("n_removed", "n_in", 3).alias("pct_removed"))
