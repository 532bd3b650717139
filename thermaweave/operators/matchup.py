"""Comparing co-located variables: spread statistics and residual screening."""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import quantiles
from ..functions.exprs import correlation, percent
from ..functions.lineage import BROADCAST_ROWS, cut, cut_counted, null_safe_join, small_side, staged
from ..functions.quantiles import narrow, summarise, summarise_with_mad
from .labelling import id_columns, require_columns
from .screening import DIAGNOSTICS, MATCH_STAGE, alive, begin, mark, per_key, pivot_keys

# Pooled group label, label separator, removal reasons, Huber constant and
# convergence tolerance of the iteratively reweighted fit.
POOLED = "(all)"
SEPARATOR = " | "
TOO_COLD, TOO_WARM, OUTSIDE, UNMATCHED = (
    "below fit (cold / cloud)",
    "above fit (warm)",
    "outside bounds",
    "no reference match-up",
)
HUBER_K = 1.345
IRLS_TOLERANCE = 1e-4
IRLS_STEPS = 50
MAD_DIVISOR = 0.6745


def group_label(by: list[str] | None) -> Column:
    """The joined group label; NULL when any part is NULL."""
    if not by:
        return F.lit(POOLED)
    parts = [F.col(c).cast("string") for c in by]
    label = parts[0]
    for p in parts[1:]:
        label = F.concat(label, F.lit(SEPARATOR), p)
    return label


def with_levels(df: DataFrame, group: Column, pooled_only: bool = False) -> DataFrame:
    """Each row once for the pooled level and once for its group, as ``(pooled, group)``.

    The flag keeps a group that happens to be called '(all)', or NULL, apart from the total.
    """
    total = F.struct(F.lit(True).alias("pooled"), F.lit(POOLED).alias("group"))
    levels = [total] if pooled_only else [total, F.struct(F.lit(False).alias("pooled"), group.alias("group"))]
    return df.select("*", F.explode(F.array(*levels)).alias("_l")).select(*df.columns, "_l.pooled", "_l.group")


# ---- spread around 1:1 ----------------------------------------------------------------------


def pair_list(targets: list[str], references: list[str], pairs: str = "cross") -> list[tuple[str, str]]:
    """Target-reference pairs, all against all or in order; self-pairs are dropped."""
    if pairs == "elementwise":
        if len(targets) != len(references):
            raise ValueError("targets and references must have the same length")
        out = list(zip(targets, references))
    elif pairs == "cross":
        out = [(t, r) for r in references for t in targets]
    else:
        raise ValueError("pairs must be 'cross' or 'elementwise'")
    out = [(t, r) for t, r in out if t != r]
    if not out:
        raise ValueError("no comparable pairs")
    return out


def gate(value: Column, valid_range: tuple[float, float] | None) -> Column:
    """Values outside the closed range become NULL."""
    return value if valid_range is None else F.when(value.between(*map(float, valid_range)), value)


def match_up_differences(
    df: DataFrame, targets: list[str], references: list[str], pairs: str = "cross", ids: list[str] | None = None,
    by: list[str] | None = None, valid_range: tuple[float, float] | None = None,
) -> DataFrame:
    """One row per pair and key with both values: one pivot serves every pair."""
    ids = id_columns(df, ids)
    require_columns(df, by or [])
    if valid_range is not None and not valid_range[0] < valid_range[1]:
        raise ValueError("valid_range must increase")
    wanted = pair_list(targets, references, pairs)
    variables = list(dict.fromkeys([*targets, *references]))
    wide = pivot_keys(df, ids, variables)
    wide = wide.select(*ids, *[gate(F.col(v), valid_range).alias(v) for v in variables])
    cells = F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(r).alias("reference"), F.col(t).alias("target_value"), F.col(r).alias("ref_value"))
        for t, r in wanted
    ])
    out = wide.select(*ids, F.explode(cells).alias("p")).select(*ids, "p.*")
    return out.withColumn("diff", F.col("target_value") - F.col("ref_value")).where(F.col("diff").isNotNull())


def match_up_variance(
    df: DataFrame, targets: list[str], references: list[str], pairs: str = "cross", ids: list[str] | None = None,
    by: list[str] | None = None, valid_range: tuple[float, float] | None = None, trim: float | None = None,
    min_n: int = 10,
) -> DataFrame:
    """Bias, spread, quantiles, correlation and trimmed spread of target - reference, pooled and by group."""
    diffs = match_up_differences(df, targets, references, pairs, ids, by, valid_range)
    # The pivot is the one shuffle of the input: its narrow result is written, and every later pass reads that.
    diffs = staged(diffs.select("target", "reference", group_label(by).alias("_g"), "target_value", "ref_value", "diff"), "differences")
    rows = with_levels(diffs, F.col("_g"), pooled_only=not by)
    rows = rows.select("target", "reference", "pooled", "group", "target_value", "ref_value", "diff")
    return spread_statistics(rows, ["target", "reference", "pooled", "group"], trim, min_n)


def spread_statistics(rows: DataFrame, keys: list[str], trim: float | None = None, min_n: int = 10) -> DataFrame:
    """The statistic block of :func:`match_up_variance` for prepared ``diff`` rows."""
    d, y, x = F.col("diff"), F.col("target_value"), F.col("ref_value")
    base = [
        F.count(d).alias("n"), F.avg(d).alias("bias"), F.stddev_samp(d).alias("sd"), F.sqrt(F.avg(d * d)).alias("rmsd"),
        F.stddev_samp(y).alias("_sy"), F.stddev_samp(x).alias("_sx"), correlation(y, x).alias("_r"), F.regr_slope(y, x).alias("_b"),
    ]
    names = ["bias", "sd", "rmsd", "median_bias", "rsd", "p025", "p975"]
    out, n_keys = summarise_with_mad(rows, keys, {"diff": {"p025": 0.025, "median_bias": 0.5, "p975": 0.975}}, "diff", "median_bias", "rsd", base)
    enough = F.col("n") >= min_n
    varied = enough & (F.col("_sx") > 0) & (F.col("_sy") > 0)
    cols = [*keys, "n", *[F.when(enough, F.col(c)).alias(c) for c in names],
            F.when(varied, F.col("_r")).alias("r"), F.when(varied, F.col("_b")).alias("slope_ols")]
    if trim is None:
        return out.select(*cols)
    # A robust spread of zero falls back to the ordinary one.
    out = cut(out)
    width = F.when(F.col("rsd") == 0, F.col("sd")).otherwise(F.col("rsd"))
    bands = out.where(enough).select(*keys, F.col("median_bias").alias("_m"), (F.lit(float(trim)) * width).alias("_w"))
    near = null_safe_join(rows.select(*keys, "diff"), F.broadcast(bands) if n_keys <= BROADCAST_ROWS else bands, keys, "inner").where(F.abs(d - F.col("_m")) <= F.col("_w"))
    out = null_safe_join(out, near.groupBy(*keys).agg(F.count(d).alias("_nt"), F.stddev_samp(d).alias("_st")), keys)
    n_trim = F.when(enough, F.coalesce("_nt", F.lit(0)))
    return out.select(*cols, n_trim.alias("n_trim"), F.when(enough & (n_trim >= 2), F.col("_st")).alias("sd_trim"))


# ---- fits -----------------------------------------------------------------------------------


def _huber_lines(rows: DataFrame, keys: list[str], intercept: float | None) -> DataFrame:
    """Huber M-estimate of a line per key by reweighted sums: one written aggregate per iteration.

    Starts from least squares; the scale of each step is ``median(|r|) / 0.6745``. A key stops
    when its residuals change by less than 1e-4 (relative) or its scale is zero. Keys still
    moving after 50 steps have no fit.

    A step moves no residual by more than the new line is away from the old one at the ends of x, so the next median lies as close
    to the last: only values in that bracket, and in the one where weights begin to fall, are told apart; all others are sums. A group of at most
    ``RANKED`` rows has one bracket. Only a larger one whose line still moves far has its median searched first.
    """
    x, y = F.col("_x"), F.col("_y")
    fixed = intercept is not None
    turn = HUBER_K / MAD_DIVISOR  # weights fall from this multiple of the median on
    parts = {"s": F.lit(1.0), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}

    def solve(t: DataFrame) -> tuple[Column, Column]:
        if fixed:
            a = F.lit(float(intercept))
            return a, (F.col("sxy") - a * F.col("sx")) / F.nullif(F.col("sxx"), F.lit(0.0))
        det = F.nullif(F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
        b = (F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
        return (F.col("sy") - b * F.col("sx")) / F.col("s"), b

    def beside(table: DataFrame, n: int) -> DataFrame:
        out = rows.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, keys)
        return out.withColumn("_ar", F.abs(y - F.col("a") - F.col("b") * x))

    def written(table: DataFrame) -> tuple[DataFrame, int, int]:
        """The step's lines (written, not checkpointed: a checkpoint hands its constraints on, and they multiply), how many go on, and how many need a search."""
        seen = Observation()
        out = staged(table.observe(seen, F.count_if(~F.col("done")).alias("on"), F.count_if(~F.col("done") & F.col("search")).alias("search")), "huber-step")
        found = seen.get
        return out, int(found.get("on") or 0), int(found.get("search") or 0)

    rows = staged(rows, "huber")
    start = rows.groupBy(*keys).agg(*[F.sum(v).alias(k) for k, v in parts.items()], F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"))
    a, b = solve(start)
    big = F.col("n") > quantiles.RANKED
    none = F.lit(None).cast("double")
    fresh, n_active, n_search = written(start.where(F.col("lo") < F.col("hi")).select(*keys, "n", "lo", "hi", a.alias("a"), b.alias("b"), none.alias("m"), none.alias("far"), F.lit(False).alias("done"), big.alias("search")))
    finished = None
    for _ in range(IRLS_STEPS):
        if n_active == 0:
            break
        active = fresh.where(~F.col("done")).drop("done")
        known = none
        if n_search:
            seek = beside(active.where("search").select(*keys, "a", "b"), n_search).select(*keys, "_ar")
            found, _ = summarise(seek, keys, {"_ar": {"_m": 0.5}})
            active = active.join(F.broadcast(found) if n_search <= BROADCAST_ROWS else found, keys, "left")
            known = F.col("_m")
        low = F.when(~big, -math.inf).otherwise(F.coalesce(known, F.col("m") - F.col("far")))
        high = F.when(~big, math.inf).otherwise(F.coalesce(known, F.col("m") + F.col("far")))
        cur = beside(active.withColumns({"_lo": low, "_hi": high, "_known": known}), n_active)
        ar = F.col("_ar")
        zone = F.when(ar < F.col("_lo"), 0).when(ar <= F.col("_hi"), 1).when(ar < turn * F.col("_lo"), 2).when(ar <= turn * F.col("_hi"), 3).otherwise(4)
        cell = F.when(zone.isin(1, 3), ar)
        far_out = F.when(zone == 4, ar)
        lines = ["n", "lo", "hi", "a", "b", "_known"]
        cells = cur.groupBy(*keys, *lines, zone.alias("_zone"), cell.alias("_cell")).agg(
            F.count(F.lit(1)).alias("_c"), F.sum(x).alias("ux"), F.sum(x * x).alias("uxx"), F.sum(ar * ar).alias("rr"),
            *[F.sum(v).alias(f"i_{k}") for k, v in parts.items()], *[F.sum(v / far_out).alias(f"o_{k}") for k, v in parts.items()],
        )
        key = Window.partitionBy(*keys)
        to = F.sum("_c").over(key.orderBy("_zone", F.asc_nulls_first("_cell")).rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("_to", to)
        middle = (F.col("n") - 1) * F.lit(0.5)

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("_to") - F.col("_c") <= rank) & (rank < F.col("_to")) & (F.col("_zone") == 1), F.col("_cell"))).over(key)

        first, second = at(F.floor(middle)), at(F.ceil(middle))
        cells = cells.withColumn("m", F.coalesce("_known", (first + second) / 2))
        limit = F.lit(turn) * F.col("m")
        weight = F.when(F.col("_cell").isNull() | (F.col("_cell") <= limit), F.lit(1.0)).otherwise(limit / F.col("_cell"))
        sums = cells.groupBy(*keys, *lines[:-1], "m").agg(
            F.sum("ux").alias("ux"), F.sum("uxx").alias("uxx"), F.sum("rr").alias("rr"),
            *[F.sum(F.when(F.col("_zone") == 4, limit * F.col(f"o_{k}")).otherwise(weight * F.col(f"i_{k}"))).alias(k) for k in parts],
        )
        a1, b1 = solve(sums)
        step = sums.withColumn("a1", a1).withColumn("b1", b1)
        da, db = F.col("a1") - F.col("a"), F.col("b1") - F.col("b")
        # Sum of squared residual changes in closed form: both fits are lines.
        moved = F.col("n") * da * da + 2 * da * db * F.col("ux") + db * db * F.col("uxx")
        settled = F.sqrt(F.greatest(moved, F.lit(0.0)) / F.greatest(F.col("rr"), F.lit(1e-20))) <= IRLS_TOLERANCE
        flat = F.col("m") == 0
        lost = F.col("m").isNull()  # rounding moved the median out of its bracket: search it, from the same line
        far = F.greatest(F.abs(da + db * F.col("lo")), F.abs(da + db * F.col("hi"))) * (1 + 1e-6) + F.lit(1e-12)
        fresh, n_active, n_search = written(step.select(
            *keys, "n", "lo", "hi", F.when(flat | lost, F.col("a")).otherwise(F.col("a1")).alias("a"), F.when(flat | lost, F.col("b")).otherwise(F.col("b1")).alias("b"), "m", far.alias("far"),
            F.coalesce(flat | settled, F.lit(False)).alias("done"), (big & F.coalesce(far * F.col("n") > quantiles.RANKED * F.col("m"), F.lit(True))).alias("search"),
        ))
        done = fresh.where("done").select(*keys, "a", "b")
        finished = done if finished is None else finished.unionByName(done)
    return fresh.where("false").select(*keys, "a", "b") if finished is None else finished


def fit_match_up(
    df: DataFrame, min_n: int = 30, scale: str = "mad", center: str = "median", slope: float | None = 1.0, intercept: float | None = None,
    single: bool = False, strict: bool = True,
) -> DataFrame:
    """Line and scale per group from columns ``_grp``, ``_y``, ``_x``, ``_use``; one small table.

    Columns: group, n (the group's own match-ups), intercept, slope, scale, fixed. Groups with
    fewer than ``min_n`` match-ups, or no usable fit, carry the pooled triple. ``single`` says that
    there is one group only, which then is the pool. With ``strict`` a pool without a usable fit is an error; otherwise the
    pooled fit is whatever its match-ups give, however few (its scale may be NULL or zero), and without any there is no row.
    """
    if scale not in ("mad", "sd") or center not in ("median", "mean"):
        raise ValueError("scale must be 'mad' or 'sd'; center 'median' or 'mean'")
    keys = ["pooled", "group"]
    # Unused rows stay, with NULLs, so that every group appears; aggregates pass over them.
    use = F.col("_use") & F.col("_y").isNotNull() & F.col("_x").isNotNull()
    base = df.select("_grp", F.when(use, F.col("_y")).alias("_y"), F.when(use, F.col("_x")).alias("_x"))
    rows = with_levels(narrow(base, ["_grp", "_y", "_x"], "pairs"), F.col("_grp"), single).where("pooled or group is not null").select(*keys, "_y", "_x")
    x, y = F.col("_x"), F.col("_y")
    fix_b, fix_a = slope is not None, intercept is not None
    fixed = {(True, True): "slope + intercept", (True, False): "slope", (False, True): "intercept", (False, False): "none"}[fix_b, fix_a]
    if fix_b and fix_a:
        lined = rows.withColumns({"a": F.lit(float(intercept)), "b": F.lit(float(slope))})
    elif fix_b:
        off = rows.withColumn("b", F.lit(float(slope))).withColumn("_d", y - F.col("b") * x)
        if center == "median":
            lined = off.join(small_side(summarise(off.select(*keys, "_d"), keys, {"_d": {"a": 0.5}})[0]), keys)
        else:
            lined = off.join(small_side(off.groupBy(*keys).agg(F.avg("_d").alias("a"))), keys)
    elif center == "median":
        used = rows.where(F.col("_y").isNotNull())
        lined = rows.join(small_side(_huber_lines(used, keys, intercept)), keys, "left")
    elif fix_a:
        a = float(intercept)
        sums = rows.groupBy(*keys).agg((F.sum(x * (y - F.lit(a))) / F.nullif(F.sum(x * x), F.lit(0.0))).alias("b"), F.min(x).alias("lo"), F.max(x).alias("hi"))
        varied = F.col("lo") < F.col("hi") if strict else F.lit(True)
        lined = rows.join(small_side(sums.select(*keys, F.lit(a).alias("a"), F.when(varied, F.col("b")).alias("b"))), keys, "left")
    else:
        sums = rows.groupBy(*keys).agg(F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"))
        lined = rows.join(small_side(sums), keys, "left")
    lined = lined.withColumn("_r", y - F.col("a") - F.col("b") * x)
    about = [F.count(y).alias("n"), F.count("_r").alias("_n"), F.max("a").alias("a"), F.max("b").alias("b"), F.stddev_samp("_r").alias("_sd")]
    if scale == "mad":
        fits, _ = summarise_with_mad(lined.select(*keys, "_y", "a", "b", "_r"), keys, {"_r": {"_rm": 0.5}}, "_r", "_rm", "_mad", about)
    else:
        fits = lined.groupBy(*keys).agg(*about).withColumn("_mad", F.lit(None).cast("double"))
    robust = F.when(F.col("_mad") > 0, F.col("_mad"))
    spread = F.when(F.col("_n") >= 3, F.coalesce(robust, F.when(F.col("_sd") > 0, F.col("_sd")))) if strict else F.coalesce(robust, F.col("_sd"))
    fits, n_fits = cut_counted(fits.select(*keys, "n", "a", "b", spread.alias("s")))
    whole = fits.where("pooled").first()
    if strict and (whole is None or whole["s"] is None or whole["a"] is None):
        raise ValueError("pooled fit of target on reference failed")
    unsettled = not fix_b and center == "median" and whole is not None and whole["a"] is None
    if whole is None or whole["n"] == 0 or unsettled:
        fits, whole = fits.where("false"), {"a": None, "b": None, "s": None}
    ok = (F.col("n") >= min_n) & (F.col("s") > 0) & F.col("a").isNotNull()
    pick = {"intercept": "a", "slope": "b", "scale": "s"}
    own = F.broadcast(fits) if n_fits <= BROADCAST_ROWS else fits
    return (own if single else own.where("not pooled")).select(
        "group", "n", *[F.when(ok, F.col(c)).otherwise(F.lit(whole[c]).cast("double")).alias(n) for n, c in pick.items()], F.lit(fixed).alias("fixed"),
    )


def screen_match_up(
    df: DataFrame, target: str, reference: str, lower: float = 2.58, upper: float | None = 3.0, slope: float | None = 1.0,
    intercept: float | None = None, ids: list[str] | None = None, by: list[str] | None = None, passes: int = 1, scale: str = "mad",
    center: str = "median", keep_na: bool = True, min_n: int = 30, step: int = 1, log: list | None = None, strict: bool = True,
) -> DataFrame:
    """Reject target rows whose residual from the reference leaves ``(-lower * s, upper * s)``.

    With ``strict`` fewer than ``min_n`` match-ups are an error. Otherwise their own fit is used, and where they give no
    line or no scale nothing can be tested and nothing is rejected by it. A reference repeated at a key is an error with
    ``strict``, too; otherwise its largest value counts.

    The reference value arrives by a window over the ids and the keyed table is written once.
    Every pass then aggregates that table into a small fit table; residuals are expressions over
    a join to it. ``None`` for a bound leaves that side open.
    """
    if target == reference:
        raise ValueError("target and reference must be different variables")
    if any(b is not None and not (b > 0 and math.isfinite(b)) for b in (lower, upper)) or passes < 1:
        raise ValueError("bounds must be positive and passes at least 1")
    df = begin(df)
    require_columns(df, by or [])
    ids = [c for c in (ids or id_columns(df)) if c not in DIAGNOSTICS]
    if by and not set(by) <= set(ids):
        raise ValueError("by columns must be among the ids")
    cols = df.columns
    involved = F.coalesce(F.col("variable").isin(target, reference), F.lit(False))
    # Rows of other variables pass by: they are neither shuffled nor rewritten.
    keyed = staged(df.where(involved).withColumn("_ref", per_key(reference, ids, [target], strict)), "matchup", ["variable"])
    pairs = keyed.where(alive(target)).select(F.col("value").alias("_y"), F.col("_ref").alias("_x"), group_label(by).alias("_grp"))
    eligible = F.col("_y").isNotNull() & F.col("_x").isNotNull()
    counts = pairs.agg(F.count(F.lit(1)).alias("n_rows"), F.count("_y").alias("n_target"), F.count_if(eligible).alias("n_match")).first()
    if strict and (counts["n_target"] == 0 or counts["n_match"] < min_n):
        raise ValueError(f"only {counts['n_match']} match-ups between {target} and {reference} (min_n = {min_n})")
    if counts["n_match"] < 0.2 * counts["n_target"]:
        warnings.warn(f"only {counts['n_match']} of {counts['n_target']} {target} values have a match-up", stacklevel=2)

    def inside(p: int) -> Column:
        r, s = F.col(f"_r{p}"), F.col(f"_s{p}")
        test = r.isNull()
        bounds = F.lit(True)
        if lower is not None:
            bounds = bounds & (r > -F.lit(float(lower)) * s)
        if upper is not None:
            bounds = bounds & (r < F.lit(float(upper)) * s)
        return test | bounds  # NULL without a scale: neither fitted to nor rejected

    def joined(table: DataFrame, p: int, to: DataFrame) -> DataFrame:
        residual = F.col("_y") - (F.col(f"_a{p}") + F.col(f"_b{p}") * F.col("_x"))
        if not by:
            # One group: three numbers, no join.
            one = table.first() or {"intercept": None, "slope": None, "scale": None}
            numbers = {f"_a{p}": one["intercept"], f"_b{p}": one["slope"], f"_s{p}": one["scale"]}
            return to.withColumns({k: F.lit(v).cast("double") for k, v in numbers.items()}).withColumn(f"_r{p}", residual)
        slim = table.select(F.col("group").alias("_grp"), F.col("intercept").alias(f"_a{p}"), F.col("slope").alias(f"_b{p}"), F.col("scale").alias(f"_s{p}"))
        out = to.join(slim, "_grp", "left")
        return out.withColumn(f"_r{p}", residual)

    work, keep = pairs, F.lit(True)
    tables = []
    for p in range(1, passes + 1):
        table = fit_match_up(work.withColumn("_use", eligible & keep), min_n, scale, center, slope, intercept, not by, strict)
        tables.append(table)
        if log is not None:
            log.append(table.select(F.lit(p).alias("pass"), "*", F.lit(scale).alias("scale_est"), F.lit(center).alias("center_est")))
        work = joined(table, p, work)
        keep = keep & inside(p)
    final = fit_match_up(work.withColumn("_use", eligible & keep), min_n, scale, center, slope, intercept, not by, strict)

    out = keyed.withColumns({"_y": F.when(alive(target), F.col("value")), "_x": F.col("_ref"), "_grp": group_label(by)})
    for p, table in enumerate(tables, start=1):
        out = joined(table, p, out)
    out = joined(final, 0, out)
    last, s = F.col(f"_r{passes}"), F.col("_s0")

    tested = eligible & ~keep
    cold = last <= -F.lit(float(lower)) * s if lower is not None else F.lit(False)
    warm = last >= F.lit(float(upper)) * s if upper is not None else F.lit(False)
    why = F.when(warm, F.lit(TOO_WARM)).when(cold, F.lit(TOO_COLD)).otherwise(F.lit(OUTSIDE))
    unmatched = F.col("_y").isNotNull() & F.col("_x").isNull()
    hit = tested if keep_na else (tested | unmatched)
    out = mark(
        out, step, MATCH_STAGE, target, alive(target) & hit,
        reason=F.when(unmatched, F.lit(UNMATCHED)).otherwise(why), resid=last, ref_value=F.col("_x"),
    )
    return out.select(*cols).unionByName(df.where(~involved))


def match_up_summary(df: DataFrame, target: str, reference: str, ids: list[str] | None = None) -> DataFrame:
    """Outcome counts from flagged rows: tested and kept, kept without match-up, and each reason."""
    ids = [c for c in (ids or id_columns(df)) if c not in DIAGNOSTICS]
    mine = F.col("stage").eqNullSafe(F.lit(MATCH_STAGE)) & F.col("stage_variable").eqNullSafe(F.lit(target))
    keyed = df.withColumn("_ref", per_key(reference, ids))
    rows = keyed.where((F.col("variable") == target) & F.col("value").isNotNull() & (F.col("stage").isNull() | mine))
    kinds = ["retained (tested)", "retained (no match-up)", TOO_COLD, TOO_WARM, OUTSIDE, UNMATCHED]
    outcome = F.when(mine, F.col("reason")).when(F.col("_ref").isNull(), F.lit(kinds[1])).otherwise(F.lit(kinds[0]))
    counts = rows.agg(F.count(F.lit(1)).alias("n_target"), *[F.count_if(outcome == k).alias(f"_{i}") for i, k in enumerate(kinds)])
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("reason"), F.col(f"_{i}").alias("n")) for i, k in enumerate(kinds)]))
    return counts.select("n_target", cells.alias("c")).select("c.reason", "c.n", percent("c.n", "n_target", 2).alias("pct_of_target"))
