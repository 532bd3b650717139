"""Scoring a fitted run on what it never saw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut, small_side, staged
from ..operators import scoring as s


def score_holdout(
    truth: DataFrame, fused: DataFrame, ref_model: DataFrame, observed: DataFrame, reference: str, holdout_sites: list[str],
    variables: list[str], group_var: str | None = None, min_obs: int = 1, replicates: int = 10_000, seed: int = 1,
    alpha: float = 0.05, alpha2: float = 0.10,
) -> dict[str, DataFrame]:
    """Overall, per site and (optionally) per group skill with intervals, coverage and contrast."""
    raw = s.observed_long(observed, reference)
    preds = s.join_predictions(truth, fused, ref_model, raw)
    preds = staged(s.checked_predictions(truth, preds, holdout_sites), "preds")
    coverage = cut(s.site_coverage(observed, variables, min_obs, holdout_sites))
    overall, draws = s.score_table(preds, replicates, seed, alpha, alpha2)
    by_site = s.with_gain(s.skill(preds, {"site": "site"}), ["level", "unit"]).join(
        s.bootstrap_by_unit(preds, replicates, seed, alpha, alpha2), ["unit", "model"]).select("unit", "model", *s.SKILL_COLUMNS)
    out = {"overall": overall, "by_site": by_site, "coverage": coverage, "draws": draws}
    if group_var is None:
        return out
    if group_var not in coverage.columns:
        raise ValueError(f"{group_var} is not a site attribute; available: {', '.join(coverage.columns[1:])}")
    labels = coverage.select("site", s.group_label(group_var, min_obs).alias("grp"))
    names = sorted(r[0] for r in labels.select("grp").distinct().collect())
    if len(names) < 2:
        return out
    grouped = staged(preds.join(small_side(labels), "site"), "grouped")
    scores = cut(s.with_gain(s.skill(grouped, {"group": "grp"}), ["level", "unit"]))
    group_draws, rows = [], None
    for i, name in enumerate(names, start=1):
        d = cut(s.bootstrap_draws(grouped.where(F.col("grp") == name), replicates, seed + i))
        group_draws.append(d)
        part = s.bootstrap_intervals(d, alpha, alpha2).withColumn("unit", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    n_sites = grouped.groupBy(F.col("grp").alias("unit")).agg(F.count_distinct("site").alias("sites"))
    out["by_group"] = scores.join(rows, ["unit", "model"]).join(n_sites, "unit").select("unit", "sites", "model", *s.SKILL_COLUMNS)
    out["contrast"] = s.group_contrast(scores, names[0], names[1]).join(s.contrast_intervals(group_draws[0], group_draws[1], alpha, alpha2), "model")
    return out
