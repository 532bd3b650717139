"""Scoring predictions on withheld observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import STREAMS, correlation, draw, stir
from ..functions.lineage import cut, small_side, staged
from ..functions.quantiles import narrow, quantile_table, summarise
from ..functions.ranking import number_rows
from ..functions.resample import redraw
from .matchup import POOLED

# The three scored predictions, the normal coverage multiplier, interval names.
MODELS = {"full": "pred_full", "ref_model": "pred_ref_model", "ref_raw": "pred_ref_raw"}
Z95 = 1.96
#: Replicates of a unit that are redrawn together.
BLOCK = 500
SKILL_COLUMNS = [
    "n", "bias_lo", "bias_lo2", "bias", "bias_hi2", "bias_hi", "mse_lo", "mse_lo2", "MSE", "mse_hi2", "mse_hi",
    "rmse_lo", "rmse_lo2", "RMSE", "rmse_hi2", "rmse_hi", "MAE", "cor", "cover95", "dmse_lo", "dmse_lo2", "dMSE", "dmse_hi2", "dmse_hi",
]


def observed_long(grid: DataFrame, variable: str) -> DataFrame:
    """One variable's observed values out of a grid table."""
    return grid.where((F.col("variable") == variable) & F.col("value").isNotNull()).select("site", "date", "value")


def join_predictions(truth: DataFrame, fused: DataFrame, ref_model: DataFrame, ref_raw: DataFrame) -> DataFrame:
    """Truth with the three predictions on (site, date)."""
    keys = ["site", "date"]
    return (
        truth.select(*keys, F.col("value").alias("obs"))
        .join(fused.select(*keys, F.col("value").alias("pred_full"), F.col("se").alias("se_full")), keys)
        .join(ref_model.select(*keys, F.col("value").alias("pred_ref_model")), keys)
        .join(ref_raw.select(*keys, F.col("value").alias("pred_ref_raw")), keys)
    )


def prediction_losses(truth: DataFrame, preds: DataFrame, holdout_sites: list[str] | None = None) -> DataFrame:
    """What the join lost, per site: truth rows, joined rows, rows with a missing prediction, and
    whether the site was meant to be withheld. All zero-loss rows mean the join is sound."""
    t = truth.groupBy("site").agg(F.count(F.lit(1)).alias("n_truth"))
    gap = F.col("obs").isNull() | F.col("pred_full").isNull() | F.col("pred_ref_model").isNull() | F.col("pred_ref_raw").isNull()
    p = preds.groupBy("site").agg(F.count(F.lit(1)).alias("n_joined"), F.count_if(gap).alias("n_missing"))
    out = t.join(p, "site", "full").select(
        "site", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_truth", "n_joined", "n_missing")])
    known = F.lit(True) if holdout_sites is None else F.col("site").isin(list(holdout_sites))
    return out.withColumn("n_lost", F.col("n_truth") - F.col("n_joined")).withColumn("withheld", known)


def checked_predictions(truth: DataFrame, preds: DataFrame, holdout_sites: list[str] | None = None) -> DataFrame:
    """``preds``, or an error when the join lost or invented rows."""
    bad = prediction_losses(truth, preds, holdout_sites).where("n_lost <> 0 or n_missing > 0 or not withheld").limit(5).collect()
    if bad:
        raise ValueError(f"predictions do not cover the withheld observations: {[r.asDict() for r in bad]}")
    return preds


def site_coverage(grid: DataFrame, variables: list[str], min_obs: int = 1, sites: list[str] | None = None) -> DataFrame:
    """Per site ``n_<variable>`` and ``has_<variable>`` for every variable, zeros filled."""
    if min_obs < 1:
        raise ValueError("min_obs must be at least 1")
    rows = grid if sites is None else grid.where(F.col("site").isin(list(sites)))
    counts = rows.groupBy("site").agg(*[F.count(F.when(F.col("variable") == v, F.col("value"))).alias(f"n_{v}") for v in variables])
    return counts.select("*", *[(F.col(f"n_{v}") >= min_obs).alias(f"has_{v}") for v in variables])


def group_label(flag: str, min_obs: int = 1) -> Column:
    """Readable names for a ``has_<variable>`` split."""
    what = flag[4:] if flag.startswith("has_") else flag
    yes, no = (f"with {what}", f"without {what}") if min_obs <= 1 else (f"{what}, {min_obs}+ obs", f"{what}, under {min_obs} obs")
    return F.when(F.col(flag), F.lit(yes)).otherwise(F.lit(no))


def reference_labels(tag: str) -> dict[str, str]:
    up = tag.upper()
    return {"full": "Full model", "ref_model": f"{up} only (model)", "ref_raw": f"{up} only (raw)"}


# ---- point estimates ------------------------------------------------------------------------


def skill(preds: DataFrame, levels: dict[str, str | None]) -> DataFrame:
    """Skill of the three predictions at several levels in one aggregate.

    ``levels`` maps a level name to the column it groups by (None: all rows). Rows fan out to
    (model, level) inside the map stage and are combined there before the shuffle.
    """
    cells = [
        F.struct(F.lit(m).alias("model"), F.col(c).alias("pred"), (F.col("se_full") if m == "full" else F.lit(None).cast("double")).alias("se"))
        for m, c in MODELS.items()
    ]
    units = [
        F.struct(F.lit(name).alias("level"), (F.lit(POOLED) if col is None else F.col(col).cast("string")).alias("unit"))
        for name, col in levels.items()
    ]
    rows = preds.select("obs", "site", F.explode(F.array(*cells)).alias("m"), F.array(*units).alias("_u")).select("obs", "site", "m.*", F.explode("_u").alias("u"))
    e = F.col("pred") - F.col("obs")
    return rows.groupBy("u.level", "u.unit", "model").agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("bias"), F.avg(e * e).alias("MSE"), F.sqrt(F.avg(e * e)).alias("RMSE"),
        F.avg(F.abs(e)).alias("MAE"), correlation("obs", "pred").alias("cor"), F.avg((F.abs(e) <= F.lit(Z95) * F.col("se")).cast("double")).alias("cover95"),
    )


def with_gain(scores: DataFrame, keys: list[str]) -> DataFrame:
    """``dMSE``: each model's MSE minus that of the full model at the same key."""
    full = scores.where("model = 'full'").select(*keys, F.col("MSE").alias("_full"))
    return scores.join(full, keys).withColumn("dMSE", F.col("MSE") - F.col("_full")).drop("_full")


def group_contrast(scores: DataFrame, group_a: str, group_b: str) -> DataFrame:
    """Difference of dMSE between two groups, per reference prediction."""
    per = scores.where(F.col("unit").isin(group_a, group_b) & (F.col("model") != "full")).groupBy("model").agg(
        F.max(F.when(F.col("unit") == group_a, F.col("dMSE"))).alias("dMSE_a"), F.max(F.when(F.col("unit") == group_b, F.col("dMSE"))).alias("dMSE_b"))
    return per.select("model", F.lit(group_a).alias("group_a"), "dMSE_a", F.lit(group_b).alias("group_b"), "dMSE_b", (F.col("dMSE_b") - F.col("dMSE_a")).alias("contrast"))


# ---- bootstrap ------------------------------------------------------------------------------


def _units(preds: DataFrame, unit: str, time: str) -> DataFrame:
    """One row per unit: its number (from 1), its number of rows, and its errors as arrays in order of time.

    A unit has at most one row per date, so an array is bounded by the date axis.
    """
    errors = [(F.col(c) - F.col("obs")).alias(f"e_{m}") for m, c in MODELS.items()]
    rows = preds.select(F.col(unit).alias("unit"), F.col(time).alias("_t"), *errors)
    packed = rows.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("_t", *[f"e_{m}" for m in MODELS]))).alias("_e"))
    packed = staged(packed.select("unit", F.size("_e").cast("bigint").alias("n_rows"), *[F.col(f"_e.e_{m}").alias(f"e_{m}") for m in MODELS]), "units")
    return packed.join(number_rows(packed.select("unit"), [], ["unit"], "unit_no"), "unit")


def _statistics(sums: DataFrame, keys: list[str]) -> DataFrame:
    n = F.sum("n_rows")
    stats = [(F.sum(f"q_e_{m}") / n).alias(f"mse_{m}") for m in MODELS] + [(F.sum(f"s_e_{m}") / n).alias(f"bias_{m}") for m in MODELS]
    return sums.groupBy(*keys).agg(n.alias("n_draws"), *stats)


def _streams(seed: int, *parts) -> dict[str, Column]:
    out = {}
    for name, start in zip(("_x", "_y"), STREAMS):
        x = F.lit(start + seed).cast("bigint")
        for p in parts:
            x = stir(x, p)
        out[name] = x
    return out


def bootstrap_draws(preds: DataFrame, replicates: int, seed: int = 1, unit: str = "site", time: str = "date") -> DataFrame:
    """Per replicate: MSE and bias of the three models on a two-stage resample.

    Stage one draws as many units as there are, with replacement; stage two draws each drawn unit's rows with
    replacement. All draws are an integer hash of (seed, replicate, slot, draw), so any task can make them alone and a lost
    task redraws the same. One draw scores every model and both statistics. Thin (replicate, slot) rows are gathered in
    blocks of replicates and meet the units by unit number: replicates times units, never times rows.
    """
    units = staged(_units(preds, unit, time), "numbered")
    n_units = units.count()
    slots = units.sparkSession.range(replicates * n_units)
    slots = slots.select(F.floor(F.col("id") / F.lit(max(n_units, 1))).cast("bigint").alias("b"), (F.col("id") % F.lit(max(n_units, 1))).alias("slot"))
    slots = slots.withColumns(_streams(seed, "b", "slot"))
    # With one unit there is nothing to draw at the first stage: the pool has size one.
    slots = slots.withColumn("unit_no", draw("_x", "_y") % F.lit(max(n_units, 1)) + 1)
    blocks = slots.groupBy("unit_no", F.floor(F.col("b") / BLOCK).alias("_block")).agg(F.collect_list(F.struct("b", "slot")).alias("_s"))  # about BLOCK each
    blocks = blocks.select("unit_no", F.col("_s.b").alias("b"), F.col("_s.slot").alias("part"))
    return _statistics(redraw(blocks.join(units, "unit_no"), "unit", [f"e_{m}" for m in MODELS], seed), ["b"])


def bootstrap_intervals(draws: DataFrame, alpha: float = 0.05, alpha2: float = 0.10, keys: list[str] = ()) -> DataFrame:
    """Percentile bounds at two levels for bias, MSE, RMSE and the paired dMSE of each model.

    RMSE bounds are the roots of the MSE bounds. dMSE is differenced replicate by replicate and
    is NULL for the full model. A key has one row per replicate.
    """
    keys = list(keys)
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.col(f"bias_{m}").alias("bias"), F.col(f"mse_{m}").alias("mse"), (F.col(f"mse_{m}") - F.col("mse_full")).alias("dmse"))
        for m in MODELS
    ]))
    probs = {"lo": alpha / 2, "lo2": alpha2 / 2, "hi2": 1 - alpha2 / 2, "hi": 1 - alpha / 2}
    stats = ("bias", "mse", "dmse")
    rows = narrow(draws.select(*keys, cells.alias("c")), [*keys, "c.model", *[f"c.{s}" for s in stats]], "replicates")
    out, _ = summarise(rows, [*keys, "model"], {s: {f"{s}_{k}": p for k, p in probs.items()} for s in stats})
    ref = F.col("model") != "full"
    return out.select(
        *keys, "model", *[f"bias_{k}" for k in probs], *[f"mse_{k}" for k in probs], *[F.sqrt(f"mse_{k}").alias(f"rmse_{k}") for k in probs],
        *[F.when(ref, F.col(f"dmse_{k}")).alias(f"dmse_{k}") for k in probs],
    )


def score_table(preds: DataFrame, replicates: int, seed: int = 1, alpha: float = 0.05, alpha2: float = 0.10) -> tuple[DataFrame, DataFrame]:
    """(skill row per model with intervals, draws) for all rows of ``preds``."""
    draws = cut(bootstrap_draws(preds, replicates, seed))
    est = with_gain(skill(preds, {"overall": None}), ["level", "unit"])
    return est.join(bootstrap_intervals(draws, alpha, alpha2), "model").select("unit", "model", *SKILL_COLUMNS), draws


def bootstrap_by_unit(preds: DataFrame, replicates: int, seed: int = 1, alpha: float = 0.05, alpha2: float = 0.10, unit: str = "site", time: str = "date") -> DataFrame:
    """Intervals for every unit on its own, all units at once: rows are redrawn within the unit."""
    units = staged(_units(preds, unit, time), "numbered")
    first = F.explode(F.sequence(F.lit(0), F.lit(max(replicates - 1, 0)), F.lit(BLOCK)))
    blocks = units.withColumn("_first", first).withColumn("b", F.sequence(F.col("_first").cast("bigint"), F.least(F.col("_first") + BLOCK, F.lit(replicates)).cast("bigint") - 1))
    blocks = blocks.withColumn("part", F.transform("b", lambda _: F.col("unit_no"))).repartition("unit", "_first")
    draws = cut(_statistics(redraw(blocks, "unit", [f"e_{m}" for m in MODELS], seed), ["unit", "b"]))
    return bootstrap_intervals(draws, alpha, alpha2, ["unit"])


def contrast_intervals(draws_a: DataFrame, draws_b: DataFrame, alpha: float = 0.05, alpha2: float = 0.10) -> DataFrame:
    """Bounds on the between-group difference of dMSE, replicate by replicate."""
    both = draws_a.select("b", *[F.col(f"mse_{m}").alias(f"a_{m}") for m in MODELS]).join(draws_b, "b")
    cells = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), ((F.col(f"mse_{m}") - F.col("mse_full")) - (F.col(f"a_{m}") - F.col("a_full"))).alias("d"))
        for m in MODELS if m != "full"
    ]))
    rows = both.select(cells.alias("c")).select("c.*")
    return quantile_table(rows, ["model"], "d", {"lo": alpha / 2, "lo2": alpha2 / 2, "hi2": 1 - alpha2 / 2, "hi": 1 - alpha / 2})


def gain_against_coverage(scores: DataFrame, coverage: DataFrame) -> DataFrame:
    """Per site: MSE differences to the full model beside the observation counts."""
    diff = scores.where("level = 'site'").groupBy(F.col("unit").alias("site")).agg(*[
        (F.max(F.when(F.col("model") == m, F.col("MSE"))) - F.max(F.when(F.col("model") == "full", F.col("MSE")))).alias(f"{m}_diff")
        for m in MODELS if m != "full"
    ])
    return diff.join(small_side(coverage.select("site", *[c for c in coverage.columns if c.startswith("n_")])), "site")
