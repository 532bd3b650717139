"""Hold-out scoring: the reference variable against three simple predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import PRIME, STREAMS
from ..operators import scoring as s
from ..operators.guards import missing_keys
from .base import R, celsius_temperatures, extract, query, with_ctes
from .gridding import grid_ctes, the_grid

REPLICATES = 10_000
SEED = 1


def daily(spark, sf, source=celsius_temperatures):
    return source(spark, sf).select(F.col("point_id").alias("site"), F.col("time").alias("date"), "aoi", "variable", "value")


def parts(spark, sf):
    """(truth, fused, reference model, reference raw) as the tables a run would have written."""
    rows = daily(spark, sf, extract).where("variable = 'ref_sst' and value is not null").select("site", "date", "value")
    rows = rows.withColumn("mon", F.month("date"))
    mean = rows.groupBy("site").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("se"))
    month = rows.groupBy("site", "mon").agg(F.avg("value").alias("mm"))
    both = rows.join(month, ["site", "mon"]).join(mean, "site")
    fused = both.select("site", "date", F.col("mm").alias("value"), "se")
    model = both.select("site", "date", F.col("m").alias("value"))
    raw = rows.select("site", "date", (F.lit(0.5) * F.col("value") + F.lit(11.0)).alias("value"))
    return rows.drop("mon"), fused, model, raw


def predictions(spark, sf):
    return s.join_predictions(*parts(spark, sf))


PREDS = [
    ("truth", "SELECT point_id AS site, time AS date, value FROM conv WHERE variable = 'ref_sst' AND value IS NOT NULL"),
    ("preds", """SELECT t.site, t.date, t.value AS obs, f.m AS pred_full, a.se AS se_full, a.m AS pred_ref_model, 0.5 * t.value + 11.0 AS pred_ref_raw FROM truth t
JOIN (SELECT site, avg(value) AS m, stddev_samp(value) AS se FROM truth GROUP BY 1) a USING (site) JOIN (SELECT site, month(date) AS mon, avg(value) AS m FROM truth GROUP BY 1, 2) f ON f.site = t.site AND f.mon = month(t.date)"""),
]
COVER = [("cov", "SELECT site, count(value) FILTER (WHERE variable = 'lst_sst') AS n_lst_sst, count(value) FILTER (WHERE variable = 'eco_sst') AS n_eco_sst, count(value) FILTER (WHERE variable = 'ref_sst') AS n_ref_sst FROM grid GROUP BY 1"),
         ("lab", "SELECT site, n_eco_sst, n_eco_sst >= (SELECT quantile_disc(n_eco_sst, 0.5) FROM cov) AS has FROM cov")]


@query("J4_joined_predictions", with_ctes(f"SELECT site, date, {R('obs')} AS obs, {R('pred_full')} AS pred_full, {R('se_full')} AS se_full, {R('pred_ref_model')} AS pred_ref_model, {R('pred_ref_raw')} AS pred_ref_raw FROM preds", "conv", PREDS))
def j4(spark, sf):
    return predictions(spark, sf)


@query("J4_checked_predictions", with_ctes("SELECT site, count(*) AS n FROM preds GROUP BY 1", "conv", PREDS))
def j4_checked(spark, sf):
    truth, *rest = parts(spark, sf)
    return s.checked_predictions(truth, s.join_predictions(truth, *rest)).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query("V6_lost_rows", with_ctes("SELECT t.site, count(*) AS n_truth, count(*) FILTER (WHERE t.date >= DATE '1994-01-01') AS n_joined, CAST(0 AS BIGINT) AS n_missing, count(*) FILTER (WHERE t.date < DATE '1994-01-01') AS n_lost, t.site <> 'P3' AS withheld FROM truth t GROUP BY t.site", "conv", PREDS))
def v6(spark, sf):
    truth, fused, model, raw = parts(spark, sf)
    short = s.join_predictions(truth, fused.where("date >= date'1994-01-01'"), model, raw)
    sites = [f"P{i}" for i in range(25) if i != 3]
    return s.prediction_losses(truth, short, sites)


@query("J12_missing_keys", with_ctes("SELECT DISTINCT point_id AS site, time AS date FROM conv WHERE variable = 'eco_sst' EXCEPT SELECT point_id, time FROM conv WHERE variable = 'ref_sst'"))
def j12(spark, sf):
    rows = daily(spark, sf)
    return missing_keys(rows.where("variable = 'eco_sst'"), rows.where("variable = 'ref_sst'"), ["site", "date"])


@query("R5_observed_series", with_ctes(f"SELECT site, date, {R('value')} AS value FROM grid WHERE variable = 'eco_sst' AND value IS NOT NULL", "conv", grid_ctes()))
def r5(spark, sf):
    return s.observed_long(the_grid(spark, sf).long(), "eco_sst")


@query("A10_site_coverage", with_ctes("SELECT *, n_lst_sst >= 15 AS has_lst_sst, n_eco_sst >= 15 AS has_eco_sst, n_ref_sst >= 15 AS has_ref_sst FROM cov", "conv", [*grid_ctes(), *COVER]))
def a10(spark, sf):
    return s.site_coverage(the_grid(spark, sf).long(), ["lst_sst", "eco_sst", "ref_sst"], 15)


def skill_sql(level: str, unit: str, source: str = "preds") -> str:
    models = " UNION ALL ".join(f"SELECT {unit} AS unit, '{m}' AS model, obs, {c} AS pred, {'se_full' if m == 'full' else 'NULL::DOUBLE'} AS se FROM {source}" for m, c in s.MODELS.items())
    return f"""SELECT '{level}' AS level, unit, model, count(*) AS n, avg(pred - obs) AS bias, avg((pred - obs) ** 2) AS "MSE", sqrt(avg((pred - obs) ** 2)) AS "RMSE", avg(abs(pred - obs)) AS "MAE",
CASE WHEN stddev_pop(pred) > 1e-9 THEN corr(obs, pred) END AS cor, avg(CASE WHEN abs(pred - obs) <= 1.96 * se THEN 1.0 WHEN se IS NULL THEN NULL ELSE 0.0 END) AS cover95 FROM ({models}) GROUP BY unit, model"""


def skill_cols(alias: str = "") -> str:
    return ", ".join(f'{R(alias + chr(34) + c + chr(34))} AS "{c}"' for c in ("bias", "MSE", "RMSE", "MAE", "cor", "cover95"))


@query("A11_skill_metrics", with_ctes(f"SELECT level, unit, model, n, {skill_cols()} FROM ({skill_sql('overall', chr(39) + '(all)' + chr(39))})", "conv", PREDS))
def a11(spark, sf):
    return s.skill(predictions(spark, sf), {"overall": None})


def labelled_preds(spark, sf):
    cov = s.site_coverage(the_grid(spark, sf).long(), ["lst_sst", "eco_sst", "ref_sst"], 1)
    cov = s.cut(cov)
    mid = cov.agg(F.percentile_approx("n_eco_sst", 0.5, 100_000)).first()[0]
    cov = s.cut(cov.withColumn("has_eco_sst", F.col("n_eco_sst") >= mid))
    lab = cov.select("site", s.group_label("has_eco_sst").alias("grp"))
    return predictions(spark, sf).join(s.small_side(lab), "site"), cov


GROUPED = [*grid_ctes(), *COVER, *PREDS, ("gpreds", "SELECT p.*, CASE WHEN l.has THEN 'with eco_sst' ELSE 'without eco_sst' END AS grp FROM preds p JOIN lab l USING (site)"),
           ("sk", skill_sql("overall", "'(all)'", "gpreds") + " UNION ALL " + skill_sql("site", "site", "gpreds") + " UNION ALL " + skill_sql("group", "grp", "gpreds")),
           ("gain", """SELECT a.*, a."MSE" - f."MSE" AS "dMSE" FROM sk a JOIN sk f ON f.level = a.level AND f.unit = a.unit AND f.model = 'full'""")]
LEVELS = {"overall": None, "site": "site", "group": "grp"}


@query("A12_skill_by_level", with_ctes(f"""SELECT level, unit, model, n, {skill_cols()}, {R('"dMSE"')} AS "dMSE" FROM gain""", "conv", GROUPED))
def a12(spark, sf):
    p, _ = labelled_preds(spark, sf)
    return s.with_gain(s.skill(p, LEVELS), ["level", "unit"])


@query("A13_group_contrast", with_ctes("""SELECT model, 'with eco_sst' AS group_a, %s AS "dMSE_a", 'without eco_sst' AS group_b, %s AS "dMSE_b", %s AS contrast FROM (
SELECT model, max("dMSE") FILTER (WHERE unit = 'with eco_sst') AS a, max("dMSE") FILTER (WHERE unit = 'without eco_sst') AS b FROM gain WHERE level = 'group' AND model <> 'full' GROUP BY 1)""" % (R("a"), R("b"), R("b - a")), "conv", GROUPED))
def a13(spark, sf):
    p, _ = labelled_preds(spark, sf)
    scores = s.with_gain(s.skill(p, {"group": "grp"}), ["level", "unit"])
    return s.group_contrast(scores, "with eco_sst", "without eco_sst")


@query("A27_gain_against_coverage", with_ctes(f"""SELECT site, {R('rm')} AS ref_model_diff, {R('rr')} AS ref_raw_diff, n_lst_sst, n_eco_sst, n_ref_sst FROM (SELECT unit AS site, max("dMSE") FILTER (WHERE model = 'ref_model') AS rm, max("dMSE") FILTER (WHERE model = 'ref_raw') AS rr
FROM gain WHERE level = 'site' GROUP BY 1) JOIN cov USING (site)""", "conv", GROUPED))
def a27(spark, sf):
    p, cov = labelled_preds(spark, sf)
    return s.gain_against_coverage(s.skill(p, {"site": "site"}), cov)


@query("B5_group_labels", with_ctes("""SELECT site, CASE WHEN n_eco_sst >= 15 THEN 'eco_sst, 15+ obs' ELSE 'eco_sst, under 15 obs' END AS many, CASE WHEN n_eco_sst >= 1 THEN 'with eco_sst' ELSE 'without eco_sst' END AS any_obs FROM cov""", "conv", [*grid_ctes(), *COVER]))
def b5(spark, sf):
    long = the_grid(spark, sf).long()
    cov = s.site_coverage(long, ["eco_sst"], 15)
    return cov.select("site", s.group_label("has_eco_sst", 15).alias("many"), F.when(F.col("n_eco_sst") >= 1, "with eco_sst").otherwise("without eco_sst").alias("any_obs"))


# ---- bootstrap ------------------------------------------------------------------------------


def stir_sql(state: str, part: str) -> str:
    """The step of the library's integer hash."""
    x = f"(({state}) * 48271 + ({part}) % {PRIME} + 11) % {PRIME}"
    return f"list_transform([{x}], lambda h: (h * (h + 12345) % {PRIME} * 69621 + 7) % {PRIME})[1]"


def streams_sql(seed: int, *parts: str) -> list[str]:
    out = []
    for start in STREAMS:
        x = f"{start + seed}::BIGINT"
        for p in parts:
            x = stir_sql(x, p)
        out.append(x)
    return out


def draw_ctes(source: str = "preds", name: str = "draws", seed: int = SEED, reps: int = REPLICATES, where: str = "true") -> list[tuple[str, str]]:
    stats = ", ".join(f"avg(e_{m} ** 2) AS mse_{m}, avg(e_{m}) AS bias_{m}" for m in s.MODELS)
    errs = ", ".join(f"{c} - obs AS e_{m}" for m, c in s.MODELS.items())
    x, y = streams_sql(seed, "b", "slot")
    return [
        (f"{name}_e", f"SELECT site AS unit, row_number() OVER (PARTITION BY site ORDER BY date) AS row_no, {errs} FROM {source} WHERE {where}"),
        (f"{name}_u", f"SELECT unit, n_rows, row_number() OVER (ORDER BY unit) AS unit_no, count(*) OVER () AS n_units FROM (SELECT unit, count(*) AS n_rows FROM {name}_e GROUP BY 1)"),
        (f"{name}_s", f"SELECT b, x, y, (x * {PRIME} + y) % n_units + 1 AS unit_no FROM (SELECT b, n_units, {x} AS x, {y} AS y FROM (SELECT unnest(range({reps})) AS b), (SELECT unit_no - 1 AS slot, n_units FROM {name}_u))"),
        (f"{name}_d", f"SELECT b, x, y, unit, n_rows, unnest(range(1, n_rows + 1)) AS j FROM {name}_s JOIN {name}_u USING (unit_no)"),
        (f"{name}_h", f"SELECT b, unit, ({stir_sql('x', 'j')} * {PRIME} + {stir_sql('y', 'j')}) % n_rows + 1 AS row_no FROM {name}_d"),
        (name, f"SELECT b, count(*) AS n_draws, {stats} FROM {name}_h JOIN {name}_e USING (unit, row_no) GROUP BY b"),
    ]


def interval_ctes(source: str, name: str, keys: str = "") -> list[tuple[str, str]]:
    rows = " UNION ALL ".join(f"SELECT {keys}'{m}' AS model, bias_{m} AS bias, mse_{m} AS mse, mse_{m} - mse_full AS dmse FROM {source}" for m in s.MODELS)
    probs = {"lo": 0.025, "lo2": 0.05, "hi2": 0.95, "hi": 0.975}
    cols = [f"quantile_cont({st}, {p}) AS {st}_{k}" for st in ("bias", "mse") for k, p in probs.items()]
    cols += [f"sqrt(quantile_cont(mse, {p})) AS rmse_{k}" for k, p in probs.items()]
    cols += [f"CASE WHEN model <> 'full' THEN quantile_cont(dmse, {p}) END AS dmse_{k}" for k, p in probs.items()]
    return [(name, f"SELECT {keys}model, {', '.join(cols)} FROM ({rows}) GROUP BY {keys}model")]


INTERVALS = [f"{st}_{k}" for st in ("bias", "mse", "rmse", "dmse") for k in ("lo", "lo2", "hi2", "hi")]


@query("B1_bootstrap_draws", with_ctes("SELECT b, n_draws, " + ", ".join(f"{R(f'mse_{m}')} AS mse_{m}, {R(f'bias_{m}')} AS bias_{m}" for m in s.MODELS) + " FROM draws", "conv", [*PREDS, *draw_ctes()]))
def b1(spark, sf):
    return s.bootstrap_draws(predictions(spark, sf), REPLICATES, SEED)


@query("B2_bootstrap_intervals", with_ctes("SELECT model, " + ", ".join(f"{R(c)} AS {c}" for c in INTERVALS) + " FROM iv", "conv", [*PREDS, *draw_ctes(), *interval_ctes("draws", "iv")]))
def b2(spark, sf):
    return s.bootstrap_intervals(s.cut(s.bootstrap_draws(predictions(spark, sf), REPLICATES, SEED)))


def by_unit_ctes() -> list[tuple[str, str]]:
    stats = ", ".join(f"avg(e_{m} ** 2) AS mse_{m}, avg(e_{m}) AS bias_{m}" for m in s.MODELS)
    x, y = streams_sql(SEED, "b", "unit_no")
    return [
        ("bx", f"SELECT unit, b, n_rows, {x} AS x, {y} AS y FROM draws_u, (SELECT unnest(range({REPLICATES})) AS b)"),
        ("bd", "SELECT unit, b, n_rows, x, y, unnest(range(1, n_rows + 1)) AS j FROM bx"),
        ("bh", f"SELECT b, unit, ({stir_sql('x', 'j')} * {PRIME} + {stir_sql('y', 'j')}) % n_rows + 1 AS row_no FROM bd"),
        ("bs", f"SELECT unit, b, {stats} FROM bh JOIN draws_e USING (unit, row_no) GROUP BY 1, 2"), *interval_ctes("bs", "biv", "unit, "),
    ]


@query("B2_intervals_by_site", with_ctes("SELECT unit, model, " + ", ".join(f"{R(c)} AS {c}" for c in INTERVALS) + " FROM biv", "conv", [*PREDS, *draw_ctes(), *by_unit_ctes()]))
def b2_site(spark, sf):
    return s.bootstrap_by_unit(predictions(spark, sf), REPLICATES, SEED)


@query("B3_contrast_intervals", with_ctes("SELECT model, " + ", ".join(f"{R(f'quantile_cont(d, {p})')} AS {k}" for k, p in {"lo": 0.025, "lo2": 0.05, "hi2": 0.95, "hi": 0.975}.items()) + """ FROM (
SELECT 'ref_model' AS model, (y.mse_ref_model - y.mse_full) - (x.mse_ref_model - x.mse_full) AS d FROM dx x JOIN dy y USING (b) UNION ALL SELECT 'ref_raw', (y.mse_ref_raw - y.mse_full) - (x.mse_ref_raw - x.mse_full) FROM dx x JOIN dy y USING (b)) GROUP BY model""",
    "conv", [*GROUPED, *draw_ctes("gpreds", "dx", SEED, REPLICATES, "grp = 'with eco_sst'"), *draw_ctes("gpreds", "dy", SEED + 1, REPLICATES, "grp = 'without eco_sst'")]))
def b3(spark, sf):
    p, _ = labelled_preds(spark, sf)
    a = s.cut(s.bootstrap_draws(p.where("grp = 'with eco_sst'"), REPLICATES, SEED))
    b = s.cut(s.bootstrap_draws(p.where("grp = 'without eco_sst'"), REPLICATES, SEED + 1))
    return s.contrast_intervals(a, b)


@query("B4_skill_table", with_ctes("SELECT unit, model, n, " + skill_cols() + f""", {R('"dMSE"')} AS "dMSE", """ + ", ".join(f"{R(c)} AS {c}" for c in INTERVALS) + " FROM (" + skill_sql("overall", "'(all)'") + ") JOIN (SELECT model AS m2, \"MSE\" - first(\"MSE\") OVER (ORDER BY CASE WHEN model = 'full' THEN 0 ELSE 1 END) AS \"dMSE\" FROM (" + skill_sql("overall", "'(all)'") + ")) ON m2 = model JOIN iv USING (model)", "conv", [*PREDS, *draw_ctes(), *interval_ctes("draws", "iv")]))
def b4(spark, sf):
    return s.score_table(predictions(spark, sf), REPLICATES, SEED)[0]
