"""Labelling, units, screening, removal and distribution queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.exprs import convert_unit, harmonic_terms, slug, solar_hour, warming_covariate
from ..functions.lineage import staged
from ..operators import guards, matchup, screening, summaries
from ..operators.labelling import conversion_report, convert_temperature, label_matches, label_variables
from ..operators.screening import kept, removed
from .base import IDS, SPECS, TEMPERATURES, R, celsius, celsius_temperatures, extract, labelled, query, raw_extended, raw_long, raw_wide, table, with_ctes

ID_SQL = ", ".join(IDS)
EARLY, LATE, CALM = 9.0, 18.0, 2.0
LOW, HIGH = 0.0, 40.0
THRESHOLDS = (1.32, 1.28)
COLD, WARM = 1.2, 1.3

# ---- labelling and units --------------------------------------------------------------------


@query("P1_label_variables", with_ctes(f"SELECT {ID_SQL}, variable, {R('value')} AS value FROM fmt", "fmt"))
def p1(spark, sf):
    return labelled(spark, sf).withColumns({c: F.round(c, 6) for c in ("lat", "lon")})


OVERLAP = {"any_300": {"stat": ["nanmean", "nearest"], "radius_m": 300}, "mean_only": {"stat": "nanmean", "radius_m": 300}, "eco_near": {"stat": "nearest", "radius_m": 300, "variable": "eco_sst"}}


@query("P1_last_match_wins", with_ctes(f"""SELECT variable, count(*) AS n, count(value) AS n_values, {R('avg(value)')} AS mean FROM (
SELECT CASE WHEN stat = 'nearest' AND variable = 'eco_sst' THEN 'eco_near' WHEN stat = 'nanmean' THEN 'mean_only' ELSE 'any_300' END AS variable, value FROM raw) GROUP BY 1""", "raw"))
def p1_last(spark, sf):
    out = label_variables(raw_long(spark, sf), OVERLAP)
    return out.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.avg("value").alias("mean"))


@query("P1_match_counts", with_ctes("""SELECT CAST(1 + (CASE WHEN stat = 'nanmean' THEN 1 ELSE 0 END) + (CASE WHEN stat = 'nearest' AND variable = 'eco_sst' THEN 1 ELSE 0 END) AS BIGINT) AS n_specs,
count(*) AS n_rows FROM raw GROUP BY 1""", "raw"))
def p1_matches(spark, sf):
    return label_matches(raw_long(spark, sf), OVERLAP)


@query("P2_convert_temperature", with_ctes(f"SELECT {ID_SQL}, variable, {R('value')} AS value FROM conv"))
def p2(spark, sf):
    return convert_temperature(labelled(spark, sf), TEMPERATURES, "K", "C")


@query("P2_convert_to_fahrenheit", with_ctes(f"""SELECT variable, count(*) AS n, {R('min(f)')} AS lo, {R('max(f)')} AS hi, {R('avg(f)')} AS mean FROM (
SELECT variable, CASE WHEN variable = 'ref_sst' THEN (value - 273.15::DOUBLE) * 9 / 5 + 32 ELSE value END AS f FROM fmt) GROUP BY 1""", "fmt"))
def p2_f(spark, sf):
    out = convert_temperature(labelled(spark, sf), ["ref_sst"], "K", "F")
    return out.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.avg("value").alias("mean"))


@query("P3_conversion_report", with_ctes("""SELECT variable, count(value) AS n, round(min(value), 2) AS from_min, round(max(value), 2) AS from_max,
round(min(value) - 273.15::DOUBLE, 2) AS to_min, round(max(value) - 273.15::DOUBLE, 2) AS to_max
FROM fmt WHERE variable IN ('eco_sst', 'lst_sst', 'ref_sst') AND value IS NOT NULL GROUP BY variable""", "fmt"))
def p3(spark, sf):
    return conversion_report(labelled(spark, sf), TEMPERATURES)


# ---- the screening chain in SQL -------------------------------------------------------------

FLAGS = ["step", "stage", "stage_variable", "reason", "resid", "removed_pass", "solar_time", "wind_speed", "ref_value"]
START = f"""SELECT {ID_SQL}, variable, value, CAST(NULL AS INTEGER) AS step, CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS VARCHAR) AS stage_variable, CAST(NULL AS VARCHAR) AS reason,
CAST(NULL AS DOUBLE) AS resid, CAST(NULL AS INTEGER) AS removed_pass, CAST(NULL AS DOUBLE) AS solar_time, CAST(NULL AS DOUBLE) AS wind_speed, CAST(NULL AS DOUBLE) AS ref_value FROM conv"""


def flag_sql(src: str, hit: str, **new: str) -> str:
    """Re-select ``src`` with the flag columns replaced where ``hit`` holds."""
    cols = ", ".join(f"CASE WHEN {hit} THEN {new[c]} ELSE {c} END AS {c}" if c in new else c for c in FLAGS)
    return f"SELECT {ID_SQL}, variable, value, {cols} FROM {src}"


def range_sql(src: str, dst: str, variable: str, step: int) -> list[tuple[str, str]]:
    hit = f"(stage IS NULL AND variable = '{variable}' AND (value <= {LOW} OR value >= {HIGH}))"
    return [(dst, flag_sql(src, hit, step=str(step), stage="'physics_filter'", stage_variable=f"'{variable}'",
                           reason=f"CASE WHEN value <= {LOW} THEN 'below lower threshold' ELSE 'above upper threshold' END"))]


def wind_key_sql(src: str, target: str, wind: str, hour: str, alive: str = "stage IS NULL", early=EARLY, late=LATE, calm=CALM) -> str:
    return f"""SELECT *, s > {early} AND s < {late} AS inw, w <= {calm} AS calm FROM (
SELECT *, (h + lon / 15) - 24 * floor((h + lon / 15) / 24) AS s FROM (
SELECT {ID_SQL}, max(value) FILTER (WHERE variable = '{target}') AS t, max(value) FILTER (WHERE variable = '{wind}') AS w,
max(value) FILTER (WHERE variable = '{hour}') AS h FROM {src} WHERE {alive} AND variable IN ('{target}', '{wind}', '{hour}') GROUP BY {ID_SQL}))"""


def wind_sql(src: str, dst: str, target: str, wind: str, hour: str, step: int) -> list[tuple[str, str]]:
    keys = f"{dst}_k"
    on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM k.{c}" for c in IDS)
    joined = f"(SELECT a.*, k.s, k.w, k.inw AND k.calm AS risky FROM {src} a LEFT JOIN {keys} k ON {on})"
    hit = f"(stage IS NULL AND variable = '{target}' AND coalesce(risky, false))"
    return [(keys, wind_key_sql(src, target, wind, hour)),
            (dst, flag_sql(joined, hit, step=str(step), stage="'wind_filter'", stage_variable=f"'{target}'", reason="'calm within window'", solar_time="s", wind_speed="w"))]


def residual_sql(src: str, dst: str, where: str, robust: bool = True, group: str = "point_id", time: str = "time", value: str = "value") -> list[tuple[str, str]]:
    """Standardised residual of one harmonic with group intercepts, in closed form: column z."""
    center, spread = ("median(r)", "1.4826 * mad(r)") if robust else ("avg(r)", "stddev_samp(r)")
    return [
        (f"{dst}_b", f"SELECT *, sin(2 * pi() * dayofyear({time}) / 365.25) AS sn, cos(2 * pi() * dayofyear({time}) / 365.25) AS cs FROM {src} WHERE {where} AND {value} IS NOT NULL AND {time} IS NOT NULL AND {group} IS NOT NULL"),
        (f"{dst}_d", f"SELECT *, {value} - avg({value}) OVER g AS y, sn - avg(sn) OVER g AS xs, cs - avg(cs) OVER g AS xc FROM {dst}_b WINDOW g AS (PARTITION BY {group})"),
        (f"{dst}_x", f"SELECT sum(xs * xs) AS ss, sum(xc * xc) AS cc, sum(xs * xc) AS sc, sum(xs * y) AS sy, sum(xc * y) AS cy FROM {dst}_d"),
        (f"{dst}_r", f"SELECT d.*, y - xs * (sy * cc - cy * sc) / (ss * cc - sc * sc) - xc * (cy * ss - sy * sc) / (ss * cc - sc * sc) AS r FROM {dst}_d d CROSS JOIN {dst}_x"),
        (f"{dst}_s", f"SELECT {center} AS c, {spread} AS s FROM {dst}_r"),
        (dst, f"SELECT r.* EXCLUDE (sn, cs, y, xs, xc), (r - c) / s AS z FROM {dst}_r r CROSS JOIN {dst}_s"),
    ]


def season_sql(src: str, dst: str, variable: str, thresholds, step: int, robust: bool = True) -> list[tuple[str, str]]:
    out, cur = [], src
    for p, thr in enumerate(thresholds, start=1):
        fit, new = f"{dst}_f{p}", dst if p == len(thresholds) else f"{dst}_p{p}"
        out += residual_sql(cur, fit, f"stage IS NULL AND variable = '{variable}'", robust)
        on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM k.{c}" for c in IDS)
        joined = f"(SELECT a.*, k.z FROM {cur} a LEFT JOIN {fit} k ON {on} AND a.variable = k.variable)"
        hit = f"(stage IS NULL AND variable = '{variable}' AND value IS NOT NULL AND abs(z) >= {thr})"
        out.append((new, flag_sql(joined, hit, step=str(step), stage="'outliers'", stage_variable=f"'{variable}'", resid="z", removed_pass=str(p))))
        cur = new
    return out


def match_sql(src: str, dst: str, target: str, reference: str, step: int, passes: int = 1, by: str | None = None, min_n: int = 10, lower: float | None = COLD,
              upper: float | None = WARM, scale: str = "mad", kind: str = "offset_median", keep_na: bool = True) -> list[tuple[str, str]]:
    """Match-up screening; ``kind`` names the fit: offset_median, offset_mean, fixed, origin or free."""
    grp = f"'(all)'" if by is None else by
    ids_on = " AND ".join(f"a.{c} IS NOT DISTINCT FROM k.{c}" for c in IDS)
    spread = "1.4826 * mad(r)" if scale == "mad" else "stddev_samp(r)"
    line = {
        "offset_median": "median(y - x) AS a, 1.0::DOUBLE AS b", "offset_mean": "avg(y - x) AS a, 1.0::DOUBLE AS b", "fixed": "0.0::DOUBLE AS a, 1.0::DOUBLE AS b",
        "origin": "0.0::DOUBLE AS a, sum(x * y) / sum(x * x) AS b", "free": "regr_intercept(y, x) AS a, regr_slope(y, x) AS b",
    }[kind]
    out = [(f"{dst}_w0", f"""SELECT *, {grp} AS grp, true AS keep, CAST(NULL AS DOUBLE) AS lr FROM (SELECT {ID_SQL}, max(value) FILTER (WHERE variable = '{target}') AS y,
max(value) FILTER (WHERE variable = '{reference}') AS x FROM {src} WHERE stage IS NULL AND variable IN ('{target}', '{reference}') GROUP BY {ID_SQL})""")]

    def fit(work: str, name: str) -> list[tuple[str, str]]:
        use = f"SELECT * FROM {work} WHERE keep AND y IS NOT NULL AND x IS NOT NULL"
        one = lambda key, body: f"SELECT {key} AS grp, count(*) AS n, max(l.a) AS a, max(l.b) AS b, {spread} AS s0, stddev_samp(r) AS sd FROM {body} GROUP BY {key}"
        return [
            (f"{name}_u", f"SELECT grp, y, x FROM ({use}) UNION ALL SELECT '{{pooled}}', y, x FROM ({use})"),
            (f"{name}_l", f"SELECT grp, {line} FROM {name}_u GROUP BY grp"),
            (f"{name}_r", f"SELECT u.grp, l.a, l.b, y - l.a - l.b * x AS r FROM {name}_u u JOIN {name}_l l ON u.grp = l.grp"),
            (f"{name}_g", f"SELECT grp, count(*) AS n, max(a) AS a, max(b) AS b, CASE WHEN {spread} > 0 THEN {spread} ELSE stddev_samp(r) END AS s FROM {name}_r GROUP BY grp"),
            (name, f"""SELECT w.grp, coalesce(g.n, 0) AS n, CASE WHEN g.n >= {min_n} AND g.s > 0 THEN g.a ELSE p.a END AS a, CASE WHEN g.n >= {min_n} AND g.s > 0 THEN g.b ELSE p.b END AS b,
CASE WHEN g.n >= {min_n} AND g.s > 0 THEN g.s ELSE p.s END AS s FROM (SELECT DISTINCT grp FROM {work} WHERE grp IS NOT NULL) w LEFT JOIN {name}_g g ON w.grp = g.grp
CROSS JOIN (SELECT * FROM {name}_g WHERE grp = '{{pooled}}') p"""),
        ]

    bounds = " AND ".join(([f"r > -{lower} * s"] if lower is not None else []) + ([f"r < {upper} * s"] if upper is not None else []))
    for p in range(1, passes + 1):
        out += fit(f"{dst}_w{p - 1}", f"{dst}_t{p}")
        out.append((f"{dst}_w{p}", f"""SELECT {ID_SQL}, y, x, grp, keep AND (r IS NULL OR ({bounds})) AS keep, r AS lr FROM (
SELECT w.*, t.s, w.y - (t.a + t.b * w.x) AS r FROM {dst}_w{p - 1} w LEFT JOIN {dst}_t{p} t ON w.grp = t.grp)"""))
    out += fit(f"{dst}_w{passes}", f"{dst}_tf")
    cold = f"k.lr <= -{lower} * k.s" if lower is not None else "false"
    warm = f"k.lr >= {upper} * k.s" if upper is not None else "false"
    keyed = f"(SELECT w.*, t.s FROM {dst}_w{passes} w LEFT JOIN {dst}_tf t ON w.grp = t.grp)"
    missing = "" if keep_na else " OR (k.y IS NOT NULL AND k.x IS NULL)"
    joined = f"""(SELECT a.*, k.lr, k.x, ((k.y IS NOT NULL AND k.x IS NOT NULL AND NOT k.keep){missing}) AS bad,
CASE WHEN k.x IS NULL THEN 'no reference match-up' WHEN {warm} THEN 'above fit (warm)' WHEN {cold} THEN 'below fit (cold / cloud)' ELSE 'outside bounds' END AS why FROM {src} a LEFT JOIN {keyed} k ON {ids_on})"""
    hit = f"(stage IS NULL AND variable = '{target}' AND coalesce(bad, false))"
    out.append((dst, flag_sql(joined, hit, step=str(step), stage="'matchup_filter'", stage_variable=f"'{target}'", reason="why", resid="lr", ref_value="x")))
    return out


CHAIN = [
    ("f0", START), *range_sql("f0", "f1", "eco_sst", 1), *range_sql("f1", "f2", "lst_sst", 2),
    *wind_sql("f2", "f3", "eco_sst", "eco_wind", "eco_hour", 3), *wind_sql("f3", "f4", "lst_sst", "lst_wind", "lst_hour", 4),
    *season_sql("f4", "f5", "eco_sst", THRESHOLDS, 5), *season_sql("f5", "f6", "lst_sst", THRESHOLDS, 6),
    *match_sql("f6", "f7", "eco_sst", "ref_sst", 7),
]
STEPS = [
    (1, "physics_filter", "eco_sst"), (2, "physics_filter", "lst_sst"), (3, "wind_filter", "eco_sst"), (4, "wind_filter", "lst_sst"),
    (5, "outliers", "eco_sst"), (6, "outliers", "lst_sst"), (7, "matchup_filter", "eco_sst"),
]


def chain_sql(final: str, extra=()) -> str:
    return with_ctes(final, "conv", [*CHAIN, *extra])


def ranged(spark, sf):
    df = celsius(spark, sf)
    for step, v in ((1, "eco_sst"), (2, "lst_sst")):
        df = screening.screen_range(df, v, LOW, HIGH, step=step)
    return df


def winded(spark, sf):
    df = ranged(spark, sf)
    for step, v in ((3, "eco"), (4, "lst")):
        df = screening.screen_wind(df, f"{v}_sst", f"{v}_wind", f"{v}_hour", EARLY, LATE, CALM, step=step)
    return df


def screened(spark, sf):
    """All seven screens. The keyed table is written once; later fits read it."""
    df = staged(winded(spark, sf), "screened", ["variable"])
    df = screening.screen_seasonal(df, ["eco_sst", "lst_sst"], THRESHOLDS, robust=True, step=5, strict=False)
    return matchup.screen_match_up(df, "eco_sst", "ref_sst", COLD, WARM, min_n=10, step=7, strict=False)


# ---- range and wind -------------------------------------------------------------------------

FLAG_OUT = f"{ID_SQL}, variable, {R('value')} AS value, step, stage, stage_variable, reason"


@query("P4_range_screen", with_ctes(f"SELECT {FLAG_OUT}, CASE WHEN stage IS NULL THEN NULL ELSE 0.0::DOUBLE END AS lower_threshold, CASE WHEN stage IS NULL THEN NULL ELSE 40.0::DOUBLE END AS upper_threshold FROM f2", "conv", CHAIN[:3]))
def p4(spark, sf):
    return ranged(spark, sf).select(*IDS, "variable", "value", "step", "stage", "stage_variable", "reason", "lower_threshold", "upper_threshold")


@query("P5_range_summary", with_ctes("""SELECT variable, reason, n, CAST(round(CAST(100.0 * n / n_var AS DECIMAL(28, 12)), 2) AS DOUBLE) AS pct_of_var FROM (
SELECT variable, count(*) AS n_var, count(*) FILTER (WHERE value > 0 AND value < 40) AS r, count(*) FILTER (WHERE value IS NULL) AS m, count(*) FILTER (WHERE value <= 0) AS b, count(*) FILTER (WHERE value >= 40) AS a
FROM conv WHERE variable IN ('eco_sst', 'lst_sst', 'ref_sst') GROUP BY variable) t
CROSS JOIN LATERAL (VALUES ('retained', r), ('missing value (untestable)', m), ('below lower threshold', b), ('above upper threshold', a)) v(reason, n)"""))
def p5(spark, sf):
    return screening.range_summary(celsius(spark, sf), TEMPERATURES, LOW, HIGH)


W_KEYS = [("k", wind_key_sql("conv", "eco_sst", "eco_wind", "eco_hour", "true"))]
W_REASON = "CASE WHEN inw AND calm THEN 'calm within window' WHEN (inw AND calm) IS NULL AND inw THEN 'within window, wind unknown' WHEN (inw AND calm) IS NULL AND calm THEN 'calm, time unknown' ELSE 'missing covariates' END"


@query("P6_wind_screen", with_ctes(f"SELECT {FLAG_OUT}, {R('solar_time')} AS solar_time, {R('wind_speed')} AS wind_speed FROM f4", "conv", CHAIN[:7]))
def p6(spark, sf):
    return winded(spark, sf).select(*IDS, "variable", "value", "step", "stage", "stage_variable", "reason", "solar_time", "wind_speed")


def sparse_covariates(spark, sf):
    """Covariates with holes: wind unknown for weak discounts, hour unknown for early ids."""
    df = celsius(spark, sf)
    hole = ((F.col("variable") == "eco_wind") & (F.col("value") > 8)) | ((F.col("variable") == "eco_hour") & (F.col("value") < 2))
    return df.withColumn("value", F.when(~hole, F.col("value")))


SPARSE = [("sparse", f"SELECT {ID_SQL}, variable, CASE WHEN (variable = 'eco_wind' AND value > 8) OR (variable = 'eco_hour' AND value < 2) THEN NULL ELSE value END AS value FROM conv"),
          ("k", wind_key_sql("sparse", "eco_sst", "eco_wind", "eco_hour", "true"))]


@query("P7_wind_reasons_strict", with_ctes(f"SELECT {ID_SQL}, {R('t')} AS target_value, {R('s')} AS solar_time, {R('w')} AS wind_speed, {W_REASON} AS reason FROM k WHERE NOT coalesce(NOT (inw AND calm), false)", "conv", SPARSE))
def p7(spark, sf):
    keys = screening.wind_keys(sparse_covariates(spark, sf), "eco_sst", "eco_wind", "eco_hour", EARLY, LATE, CALM, keep_na=False)
    return keys.where("not retained").select(*IDS, "target_value", "solar_time", "wind_speed", "reason")


@query("P8_wind_summary", with_ctes(f"""SELECT v.reason, v.n, CAST(round(CAST(100.0 * v.n / n_obs AS DECIMAL(28, 12)), 2) AS DOUBLE) AS pct_of_obs FROM (
SELECT count(*) AS n_obs, count(*) FILTER (WHERE reason IS NULL) AS a, count(*) FILTER (WHERE reason = 'calm within window') AS b, count(*) FILTER (WHERE reason = 'within window, wind unknown') AS c,
count(*) FILTER (WHERE reason = 'calm, time unknown') AS d, count(*) FILTER (WHERE reason = 'missing covariates') AS e
FROM (SELECT CASE WHEN coalesce(NOT (inw AND calm), false) THEN NULL ELSE {W_REASON} END AS reason FROM k WHERE t IS NOT NULL OR w IS NOT NULL OR h IS NOT NULL)) q
CROSS JOIN LATERAL (VALUES ('retained', a), ('calm within window', b), ('within window, wind unknown', c), ('calm, time unknown', d), ('missing covariates', e)) v(reason, n)""", "conv", SPARSE))
def p8(spark, sf):
    return screening.wind_summary(screening.wind_keys(sparse_covariates(spark, sf), "eco_sst", "eco_wind", "eco_hour", EARLY, LATE, CALM, keep_na=False))


@query("P8_wind_counts", with_ctes("""SELECT count(*) FILTER (WHERE t IS NOT NULL OR w IS NOT NULL OR h IS NOT NULL) AS n_obs, count(*) AS n_keys, count(t) AS n_target_total,
count(*) FILTER (WHERE t IS NOT NULL AND coalesce(inw AND calm, false)) AS n_target_removed FROM k""", "conv", SPARSE))
def p8_counts(spark, sf):
    return screening.wind_counts(screening.wind_keys(sparse_covariates(spark, sf), "eco_sst", "eco_wind", "eco_hour", EARLY, LATE, CALM))


@query("P11_valid_range_gate", with_ctes(f"""SELECT variable, count(*) AS n_rows, count(g) AS n_valid, {R('min(g)')} AS lo, {R('max(g)')} AS hi FROM (
SELECT variable, CASE WHEN value BETWEEN 5 AND 35 THEN value END AS g FROM conv) GROUP BY variable"""))
def p11(spark, sf):
    g = matchup.gate(F.col("value"), (5.0, 35.0))
    return celsius(spark, sf).groupBy("variable").agg(F.count(F.lit(1)).alias("n_rows"), F.count(g).alias("n_valid"), F.min(g).alias("lo"), F.max(g).alias("hi"))


WIDE_SQL = f"""SELECT {ID_SQL}, max(value) FILTER (WHERE variable = 'eco_sst') AS eco_sst, max(value) FILTER (WHERE variable = 'eco_hour') AS eco_hour,
max(value) FILTER (WHERE variable = 'eco_wind') AS eco_wind FROM conv WHERE variable IN ('eco_sst', 'eco_hour', 'eco_wind') GROUP BY {ID_SQL}"""


@query("P12_null_when_calm", with_ctes(f"SELECT point_id, time, {R('CASE WHEN eco_wind > 2 THEN eco_sst END')} AS eco_sst_valid FROM w", "conv", [("w", WIDE_SQL)]))
def p12(spark, sf):
    w = screening.pivot_keys(celsius(spark, sf), IDS, ["eco_sst", "eco_hour", "eco_wind"])
    return w.select("point_id", "time", F.when(F.col("eco_wind") > 2, F.col("eco_sst")).alias("eco_sst_valid"))


@query("P13_legacy_kelvin_and_scaled_residual", with_ctes(f"""SELECT point_id, time, {R('value')} AS value, {R('z')} AS resid FROM rr WHERE abs(z) < 1.5""", "raw", [
    ("b", "SELECT *, sin(CAST(6.28 AS DOUBLE) * dayofyear(time) / 365) AS sn, cos(CAST(6.28 AS DOUBLE) * dayofyear(time) / 365) AS cs, value - 273 AS v FROM raw WHERE stat = 'nearest' AND variable = 'eco_sst' AND value IS NOT NULL"),
    ("d", "SELECT *, v - avg(v) OVER g AS y, sn - avg(sn) OVER g AS xs, cs - avg(cs) OVER g AS xc FROM b WINDOW g AS (PARTITION BY point_id)"),
    ("x", "SELECT sum(xs * xs) AS ss, sum(xc * xc) AS cc, sum(xs * xc) AS sc, sum(xs * y) AS sy, sum(xc * y) AS cy FROM d"),
    ("r", "SELECT d.*, y - xs * (sy * cc - cy * sc) / (ss * cc - sc * sc) - xc * (cy * ss - sy * sc) / (ss * cc - sc * sc) AS r FROM d CROSS JOIN x"),
    ("rr", "SELECT point_id, time, v AS value, (r - m) / s AS z FROM r CROSS JOIN (SELECT avg(r) AS m, stddev_samp(r) AS s FROM r)")]))
def p13(spark, sf):
    import math

    rows = raw_long(spark, sf).where((F.col("stat") == "nearest") & (F.col("variable") == "eco_sst") & F.col("value").isNotNull())
    rows = rows.select("point_id", "time", "variable", (F.col("value") - F.lit(273.0)).alias("value"))
    # A period of 2 pi / 6.28 * 365 days gives the older angle 6.28 * doy / 365.
    fit = screening.fit_seasonal(rows, ["eco_sst"], period=2.0 * math.pi / 6.28 * 365.0)
    return fit.score(rows, "resid").where(F.abs("resid") < 1.5).drop("variable")


@query("P15_high_exposure_flag", with_ctes(f"SELECT point_id, time, {R('s')} AS local_time, s < 18 AND s > 10 AS high_exposure FROM (SELECT *, (eco_hour + lon / 15) - 24 * floor((eco_hour + lon / 15) / 24) AS s FROM w)", "conv", [("w", WIDE_SQL)]))
def p15(spark, sf):
    w = screening.pivot_keys(celsius(spark, sf), IDS, ["eco_sst", "eco_hour", "eco_wind"])
    s = solar_hour("eco_hour", "lon")
    return w.select("point_id", "time", s.alias("local_time"), ((s < 18) & (s > 10)).alias("high_exposure"))


@query("J1_rejected_key_rows", with_ctes(f"SELECT {ID_SQL}, variable, {R('value')} AS value FROM f4 WHERE stage = 'wind_filter'", "conv", CHAIN[:7]))
def j1(spark, sf):
    return winded(spark, sf).where("stage = 'wind_filter'").select(*IDS, "variable", "value")


@query("J2_removed_with_diagnostics", chain_sql(f"SELECT {ID_SQL}, variable, {R('value')} AS value, stage, reason, {R('resid')} AS resid, removed_pass, {R('solar_time')} AS solar_time, {R('wind_speed')} AS wind_speed, {R('ref_value')} AS ref_value FROM f7 WHERE stage IS NOT NULL"))
def j2(spark, sf):
    return removed(screened(spark, sf)).select(*IDS, "variable", "value", "stage", "reason", "resid", "removed_pass", "solar_time", "wind_speed", "ref_value")


# ---- seasonal -------------------------------------------------------------------------------


@query("G1_seasonal_residual", with_ctes(f"SELECT point_id, time, {R('value')} AS value, {R('z')} AS score FROM g", "conv", residual_sql("conv", "g", "variable = 'eco_sst'", robust=False)))
def g1(spark, sf):
    rows = extract(spark, sf).where((F.col("variable") == "eco_sst") & F.col("value").isNotNull()).select("point_id", "time", "variable", "value")
    return screening.fit_seasonal(rows, ["eco_sst"]).score(rows, "score").drop("variable")


@query("G1_seasonal_residual_robust", with_ctes(f"SELECT point_id, time, {R('value')} AS value, {R('z')} AS score FROM g", "conv", residual_sql("conv", "g", "variable = 'lst_sst'", robust=True)))
def g1_robust(spark, sf):
    rows = extract(spark, sf).where((F.col("variable") == "lst_sst") & F.col("value").isNotNull()).select("point_id", "time", "variable", "value")
    return screening.fit_seasonal(rows, ["lst_sst"], robust=True).score(rows, "score").drop("variable")


SEASON = [("f0", START), *season_sql("f0", "o", "eco_sst", THRESHOLDS, 1)]


@query("G2_seasonal_screen", with_ctes(f"SELECT {ID_SQL}, variable, {R('value')} AS value, stage, {R('resid')} AS resid, removed_pass FROM o WHERE variable = 'eco_sst'", "conv", SEASON))
def g2(spark, sf):
    out = screening.screen_seasonal(extract(spark, sf), "eco_sst", THRESHOLDS, robust=True, strict=False)
    return out.where("variable = 'eco_sst'").select(*IDS, "variable", "value", "stage", "resid", "removed_pass")


@query("G2_seasonal_summary", with_ctes(f"""SELECT CAST(1 AS INTEGER) AS pass, {THRESHOLDS[0]}::DOUBLE AS threshold, count(*) AS n_in, count(*) FILTER (WHERE removed_pass = 1) AS n_removed FROM o WHERE variable = 'eco_sst' AND value IS NOT NULL
UNION ALL SELECT 2, {THRESHOLDS[1]}::DOUBLE, count(*) FILTER (WHERE coalesce(removed_pass, 9) > 1), count(*) FILTER (WHERE removed_pass = 2) FROM o WHERE variable = 'eco_sst' AND value IS NOT NULL""", "conv", SEASON))
def g2_summary(spark, sf):
    out = screening.screen_seasonal(extract(spark, sf), "eco_sst", THRESHOLDS, robust=True, strict=False)
    return screening.seasonal_summary(out, "eco_sst", THRESHOLDS)


# ---- match-up screening ---------------------------------------------------------------------


def match_query(name: str, passes=1, by=None, min_n=10, lower=COLD, upper=WARM, scale="mad", kind="offset_median", keep_na=True):
    args = {
        "offset_median": dict(slope=1.0, intercept=None, center="median"), "offset_mean": dict(slope=1.0, intercept=None, center="mean"),
        "fixed": dict(slope=1.0, intercept=0.0, center="mean"), "origin": dict(slope=None, intercept=0.0, center="mean"), "free": dict(slope=None, intercept=None, center="mean"),
    }[kind]
    ctes = [("f0", START), *match_sql("f0", "m", "eco_sst", "ref_sst", 1, passes, by, min_n, lower, upper, scale, kind, keep_na)]
    sql = with_ctes(f"SELECT {ID_SQL}, {R('value')} AS value, stage, reason, {R('resid')} AS resid, {R('ref_value')} AS ref_value FROM m WHERE variable = 'eco_sst'", "conv", ctes)

    @query(name, sql)
    def run(spark, sf):
        # Written once: the rows that pass by the screen would be drawn from the tables a second time.
        out = matchup.screen_match_up(extract(spark, sf), "eco_sst", "ref_sst", lower, upper, by=None if by is None else [by], passes=passes, scale=scale, min_n=min_n, keep_na=keep_na, strict=False, **args)
        return out.where("variable = 'eco_sst'").select(*IDS, "value", "stage", "reason", "resid", "ref_value")

    return ctes, args


MATCH, _ = match_query("G3_match_up_screen")
match_query("G3_match_up_two_passes_by_region", passes=2, by="aoi", min_n=30)
match_query("G3_match_up_two_passes_by_point", passes=2, by="point_id", min_n=35)
match_query("G3_match_up_drop_unmatched", keep_na=False)
match_query("G4_fit_both_fixed", kind="fixed", scale="sd")
match_query("G4_fit_mean_offset", kind="offset_mean", scale="sd", by="aoi")
match_query("G4_fit_through_origin", kind="origin", scale="sd", lower=0.9, upper=0.9)
match_query("G4_fit_free_line", kind="free", scale="mad", by="aoi")
match_query("G21_cold_tail_sd_screen", kind="fixed", scale="sd", passes=2, lower=1.2, upper=None)
match_query("G21_free_line_sd_screen", kind="free", scale="sd", passes=2, lower=1.3, upper=1.5)
BY_POINT = [("f0", START), *match_sql("f0", "m", "eco_sst", "ref_sst", 1, 2, "point_id", 35)]


def huber_ctes(steps: int = 50) -> list[tuple[str, str]]:
    """Reweighted least squares, one group of tables per step; a settled group is carried along."""
    out = [
        ("hp", "SELECT a.aoi AS g, a.value AS y, b.value AS x FROM conv a JOIN conv b ON a.point_id = b.point_id AND a.time = b.time AND a.variable = 'eco_sst' AND b.variable = 'ref_sst' WHERE a.value - b.value IS NOT NULL"),
        ("hr", "SELECT g, y, x FROM hp UNION ALL SELECT '{pooled}', y, x FROM hp"),
        ("h0", "SELECT g, regr_intercept(y, x) AS a, regr_slope(y, x) AS b, false AS done FROM hr GROUP BY g"),
    ]
    for i in range(steps):
        out += [
            (f"h{i}s", f"SELECT r.g, h.done, h.a, h.b, median(abs(y - h.a - h.b * x)) / 0.6745 AS s FROM hr r JOIN h{i} h ON r.g = h.g GROUP BY ALL"),
            (f"h{i}w", f"SELECT r.g, x, y, y - a - b * x AS e, CASE WHEN abs(y - a - b * x) <= 1.345 * s THEN 1.0 ELSE 1.345 * s / abs(y - a - b * x) END AS w FROM hr r JOIN h{i}s h ON r.g = h.g WHERE NOT done"),
            (f"h{i}l", f"SELECT g, (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) AS b, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy FROM h{i}w GROUP BY g"),
            (f"h{i}n", f"SELECT g, (sy - b * sx) / sw AS a, b FROM h{i}l"),
            (f"h{i}d", f"SELECT w.g, sqrt(sum((w.e - (w.y - n.a - n.b * w.x)) ** 2) / sum(w.e ** 2)) <= 1e-4 AS done FROM h{i}w w JOIN h{i}n n ON w.g = n.g GROUP BY w.g"),
            (f"h{i + 1}", f"SELECT * FROM h{i} WHERE done UNION ALL SELECT n.g, n.a, n.b, d.done FROM h{i}n n JOIN h{i}d d ON n.g = d.g"),
        ]
    last = f"h{steps}"
    out += [("he", f"SELECT r.g, l.a, l.b, y - l.a - l.b * x AS e FROM hr r JOIN {last} l ON r.g = l.g WHERE l.done"),
            ("hs", "SELECT g, count(*) AS n, max(a) AS a, max(b) AS b, CASE WHEN mad(e) > 0 THEN 1.4826 * mad(e) ELSE stddev_samp(e) END AS s FROM he GROUP BY g")]
    return [(n, "MATERIALIZED:" + b) if n.startswith("h") else (n, b) for n, b in out]


HUBER_SQL = with_ctes(f"""SELECT g.g AS "group", g.n, {R('CASE WHEN f.n >= 10 AND f.s > 0 THEN f.a ELSE p.a END')} AS intercept, {R('CASE WHEN f.n >= 10 AND f.s > 0 THEN f.b ELSE p.b END')} AS slope, {R('CASE WHEN f.n >= 10 AND f.s > 0 THEN f.s ELSE p.s END')} AS scale, 'none' AS fixed
FROM (SELECT g, count(*) AS n FROM hp GROUP BY g) g LEFT JOIN hs f ON f.g = g.g CROSS JOIN (SELECT * FROM hs WHERE g = '{{pooled}}') p""", "conv", huber_ctes()).replace("AS (MATERIALIZED:", "AS MATERIALIZED (")


@query("G5_huber_line", HUBER_SQL)
def g5(spark, sf):
    pairs = matchup.match_up_differences(extract(spark, sf), ["eco_sst"], ["ref_sst"], by=["aoi"])
    rows = pairs.select(F.col("aoi").alias("_grp"), F.col("target_value").alias("_y"), F.col("ref_value").alias("_x"), F.lit(True).alias("_use"))
    return matchup.fit_match_up(rows, 10, "mad", "median", slope=None, intercept=None, strict=False)


@query("G6_fit_log", with_ctes(f"""SELECT CAST(1 AS INTEGER) AS pass, grp AS "group", n, {R('a')} AS intercept, {R('b')} AS slope, {R('s')} AS scale, 'slope' AS fixed, 'mad' AS scale_est, 'median' AS center_est FROM m_t1
UNION ALL SELECT 2, grp, n, {R('a')}, {R('b')}, {R('s')}, 'slope', 'mad', 'median' FROM m_t2""", "conv", BY_POINT))
def g6(spark, sf):
    log = []
    matchup.screen_match_up(celsius_temperatures(spark, sf), "eco_sst", "ref_sst", COLD, WARM, by=["point_id"], passes=2, min_n=35, log=log, strict=False)
    return log[0].unionByName(log[1])


@query("G7_removal_reasons", with_ctes("""SELECT v.reason, v.n, CAST(round(CAST(100.0 * v.n / nt AS DECIMAL(28, 12)), 2) AS DOUBLE) AS pct_of_target FROM (SELECT count(*) AS nt, count(*) FILTER (WHERE stage IS NULL AND x IS NOT NULL) AS a, count(*) FILTER (WHERE stage IS NULL AND x IS NULL) AS b,
count(*) FILTER (WHERE reason = 'below fit (cold / cloud)') AS c, count(*) FILTER (WHERE reason = 'above fit (warm)') AS d, count(*) FILTER (WHERE reason = 'outside bounds') AS e, count(*) FILTER (WHERE reason = 'no reference match-up') AS f
FROM (SELECT m.*, w.x FROM m LEFT JOIN m_w0 w USING (point_id, lat, lon, aoi, time) WHERE variable = 'eco_sst' AND value IS NOT NULL)) q
CROSS JOIN LATERAL (VALUES ('retained (tested)', a), ('retained (no match-up)', b), ('below fit (cold / cloud)', c), ('above fit (warm)', d), ('outside bounds', e), ('no reference match-up', f)) v(reason, n)""", "conv", MATCH))
def g7(spark, sf):
    out = matchup.screen_match_up(celsius_temperatures(spark, sf), "eco_sst", "ref_sst", COLD, WARM, min_n=10, strict=False)
    return matchup.match_up_summary(out, "eco_sst", "ref_sst")


# ---- spread ---------------------------------------------------------------------------------


def spread_sql(pairs: list[tuple[str, str]], by: str | None, lo: float | None, hi: float | None, trim: float, min_n: int) -> str:
    ok = f"AND value BETWEEN {lo} AND {hi}" if lo is not None else ""
    cols = ", ".join(f"max(value) FILTER (WHERE variable = '{v}' {ok}) AS {v}" for v in TEMPERATURES)
    some = " UNION ALL ".join(f"SELECT '{t}' AS target, '{r}' AS reference, {by or 'NULL'} AS g, {t} AS y, {r} AS x, {t} - {r} AS d FROM w WHERE {t} - {r} IS NOT NULL" for t, r in pairs)
    levels = "SELECT target, reference, true AS pooled, '(all)' AS grp, y, x, d FROM p" + (" UNION ALL SELECT target, reference, false, g, y, x, d FROM p" if by else "")
    key = "target, reference, pooled, grp"
    return with_ctes(f"""SELECT target, reference, pooled, grp AS "group", n, {', '.join(f'CASE WHEN n >= {min_n} THEN {R(c)} END AS {c}' for c in ('bias', 'sd', 'rmsd', 'median_bias', 'rsd', 'p025', 'p975'))},
CASE WHEN n >= {min_n} AND sx > 0 AND sy > 0 THEN {R('r')} END AS r, CASE WHEN n >= {min_n} AND sx > 0 AND sy > 0 THEN {R('b')} END AS slope_ols,
CASE WHEN n >= {min_n} THEN n_trim END AS n_trim, CASE WHEN n >= {min_n} AND n_trim >= 2 THEN {R('sd_trim')} END AS sd_trim FROM z""", "conv", [
        ("w", f"SELECT {ID_SQL}, {cols} FROM conv WHERE variable IN ('eco_sst', 'lst_sst', 'ref_sst') GROUP BY {ID_SQL}"), ("p", some), ("l", levels),
        ("s", f"SELECT {key}, count(*) AS n, avg(d) AS bias, stddev_samp(d) AS sd, sqrt(avg(d * d)) AS rmsd, median(d) AS median_bias, 1.4826 * mad(d) AS rsd, quantile_cont(d, 0.025) AS p025, quantile_cont(d, 0.975) AS p975, stddev_samp(x) AS sx, stddev_samp(y) AS sy, corr(y, x) AS r, regr_slope(y, x) AS b FROM l GROUP BY {key}"),
        ("z", f"SELECT s.*, t.n_trim, t.sd_trim FROM s JOIN (SELECT l.target, l.reference, l.pooled, l.grp, count(*) FILTER (WHERE abs(d - median_bias) <= {trim} * CASE WHEN rsd > 0 THEN rsd ELSE sd END) AS n_trim, stddev_samp(d) FILTER (WHERE abs(d - median_bias) <= {trim} * CASE WHEN rsd > 0 THEN rsd ELSE sd END) AS sd_trim FROM l JOIN s USING (target, reference, pooled, grp) GROUP BY 1, 2, 3, 4) t USING (target, reference, pooled, grp)"),
    ])


@query("A7_match_up_variance", spread_sql([("eco_sst", "ref_sst"), ("lst_sst", "ref_sst")], "aoi", None, None, 1.5, 10))
def a7(spark, sf):
    return matchup.match_up_variance(extract(spark, sf), ["eco_sst", "lst_sst"], ["ref_sst"], by=["aoi"], trim=1.5)


@query("A8_trimmed_spread_in_valid_range", spread_sql([("eco_sst", "lst_sst"), ("ref_sst", "lst_sst"), ("lst_sst", "ref_sst"), ("eco_sst", "ref_sst")], None, 2.0, 38.0, 1.0, 10))
def a8(spark, sf):
    return matchup.match_up_variance(extract(spark, sf), ["eco_sst", "ref_sst", "lst_sst"], ["lst_sst", "ref_sst"], valid_range=(2.0, 38.0), trim=1.0)


@query("J3_match_up_pairs", with_ctes(f"""SELECT a.point_id, a.time, {R('a.value')} AS target_value, {R('b.value')} AS ref_value, {R('a.value - b.value')} AS diff
FROM conv a JOIN conv b ON a.point_id = b.point_id AND a.time = b.time AND a.variable = 'eco_sst' AND b.variable = 'ref_sst' WHERE a.value - b.value IS NOT NULL"""))
def j3(spark, sf):
    return matchup.match_up_differences(celsius_temperatures(spark, sf), ["eco_sst"], ["ref_sst"]).select("point_id", "time", "target_value", "ref_value", "diff")


@query("J11_pairs_cross_without_self", with_ctes("""SELECT target, reference, count(*) AS n FROM (
SELECT a.variable AS target, b.variable AS reference FROM conv a JOIN conv b ON a.point_id = b.point_id AND a.time = b.time AND a.variable <> b.variable
WHERE a.variable IN ('eco_sst', 'lst_sst', 'ref_sst') AND b.variable IN ('lst_sst', 'ref_sst') AND a.value IS NOT NULL AND b.value IS NOT NULL) GROUP BY 1, 2"""))
def j11(spark, sf):
    d = matchup.match_up_differences(celsius_temperatures(spark, sf), TEMPERATURES, ["lst_sst", "ref_sst"], "cross")
    return d.groupBy("target", "reference").agg(F.count(F.lit(1)).alias("n"))


@query("J11_pairs_elementwise", with_ctes("""SELECT a.variable AS target, b.variable AS reference, count(*) AS n FROM conv a JOIN conv b ON a.point_id = b.point_id AND a.time = b.time
AND ((a.variable = 'eco_sst' AND b.variable = 'ref_sst') OR (a.variable = 'lst_sst' AND b.variable = 'eco_sst')) WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2"""))
def j11_zip(spark, sf):
    d = matchup.match_up_differences(celsius_temperatures(spark, sf), ["eco_sst", "lst_sst"], ["ref_sst", "eco_sst"], "elementwise")
    return d.groupBy("target", "reference").agg(F.count(F.lit(1)).alias("n"))


# ---- distributions and removals -------------------------------------------------------------

FRAME = [("kr", "SELECT variable, aoi AS grp, value, stage IS NULL AS retained FROM f7")]
SUMMARY_LEVELS = ("lv", "SELECT variable, true AS pooled, '(all)' AS grp, value, retained FROM kr UNION ALL SELECT variable, false, grp, value, retained FROM kr")


def summary_sql(source: str) -> str:
    k, m = "FILTER (WHERE retained)", "FILTER (WHERE NOT retained)"
    q = lambda p: R(f"quantile_cont(value, {p}) {k}")
    return f"""SELECT variable, pooled, grp AS "group", count(*) AS n_input, count(value) AS n_present, count(*) {k} AS n_kept, count(*) {m} AS n_removed,
CAST(round(CAST(100.0 * count(value) {m} / greatest(count(value), 1) AS DECIMAL(28, 12)), 3) AS DOUBLE) AS pct_removed, CAST(round(CAST(100.0 * count(*) {m} / greatest(count(*), 1) AS DECIMAL(28, 12)), 3) AS DOUBLE) AS pct_of_rows, count(*) FILTER (WHERE retained AND value IS NULL) AS n_missing,
{R(f'avg(value) {k}')} AS mean, {R(f'stddev_samp(value) {k}')} AS sd, {R(f'median(value) {k}')} AS median, {R(f'1.4826 * mad(value) {k}')} AS mad, {R(f'min(value) {k}')} AS min,
{q(0.01)} AS p01, {q(0.05)} AS p05, {q(0.25)} AS p25, {q(0.75)} AS p75, {q(0.95)} AS p95, {q(0.99)} AS p99, {R(f'max(value) {k}')} AS max,
count(value) {m} AS rm_n, {R(f'avg(value) {m}')} AS rm_mean, {R(f'stddev_samp(value) {m}')} AS rm_sd, {R(f'median(value) {m}')} AS rm_median, {R(f'min(value) {m}')} AS rm_min, {R(f'max(value) {m}')} AS rm_max
FROM {source} GROUP BY variable, pooled, grp"""


@query("A1_value_statistics", with_ctes(summary_sql("lv"), "conv", [*CHAIN[:3], ("lv", "SELECT variable, true AS pooled, '(all)' AS grp, value, stage IS NULL AS retained FROM f2")]))
def a1(spark, sf):
    return summaries.variable_summary(summaries.kept_removed_frame(ranged(spark, sf)), by_group=False)


@query("A2_variable_summary", chain_sql(summary_sql("lv"), [*FRAME, SUMMARY_LEVELS]))
def a2(spark, sf):
    return summaries.variable_summary(summaries.kept_removed_frame(screened(spark, sf), "aoi"))


@query("A3_median_absolute_deviation", with_ctes(f"SELECT point_id, variable, {R('median(value)')} AS median, {R('1.4826 * mad(value)')} AS mad FROM conv WHERE variable IN ('eco_sst', 'lst_sst', 'ref_sst') GROUP BY 1, 2"))
def a3(spark, sf):
    from ..functions.quantiles import attach_median_mad

    keys = ["point_id", "variable"]
    rows = attach_median_mad(celsius_temperatures(spark, sf).select(*keys, "value"), keys, "value")
    return rows.groupBy(*keys).agg(F.max("median").alias("median"), F.max("mad").alias("mad"))


REMOVALS = [("fine", "SELECT stage, variable, aoi AS grp, count(*) AS nr, count(value) AS np FROM f7 GROUP BY 1, 2, 3"),
            ("lvl", "SELECT stage, variable, true AS pooled, '(all)' AS grp, nr, np FROM fine UNION ALL SELECT stage, variable, false, grp, nr, np FROM fine"),
            ("rs", """SELECT c.stage, c.variable, c.pooled, c.grp AS "group", CAST(c.nr AS BIGINT) AS n_removed, CAST(c.np AS BIGINT) AS n_present, CAST(round(CAST(100.0 * c.np / nullif(t.den, 0) AS DECIMAL(28, 12)), 3) AS DOUBLE) AS pct_of_present FROM
(SELECT stage, variable, pooled, grp, sum(nr) AS nr, sum(np) AS np FROM lvl WHERE stage IS NOT NULL GROUP BY 1, 2, 3, 4) c JOIN (SELECT variable, pooled, grp, sum(np) AS den FROM lvl GROUP BY 1, 2, 3) t USING (variable, pooled, grp)""")]


@query("A4_removal_summary", chain_sql("SELECT * FROM rs", REMOVALS))
def a4(spark, sf):
    return summaries.removal_summary(screened(spark, sf), "aoi")


@query("A5_stage_counts", chain_sql("SELECT step, stage, variable, n_in, n_in - n_removed AS n_out, n_removed, CAST(round(CAST(100.0 * n_removed / greatest(n_in, 1) AS DECIMAL(28, 12)), 3) AS DOUBLE) AS pct_removed FROM (" + " UNION ALL ".join(
    f"SELECT CAST({k} AS INTEGER) AS step, '{s}' AS stage, '{v}' AS variable, count(*) - count(*) FILTER (WHERE step < {k}) AS n_in, count(*) FILTER (WHERE step = {k}) AS n_removed FROM f7" for k, s, v in STEPS) + ")"))
def a5(spark, sf):
    return screening.stage_counts(screened(spark, sf), STEPS)


@query("A6_kept_removed_frame", with_ctes(f"""SELECT variable, aoi AS "group", {R('value')} AS value, stage IS NULL AS retained FROM f4""", "conv", CHAIN[:7]))
def a6(spark, sf):
    return summaries.kept_removed_frame(winded(spark, sf), "aoi")


def histogram_sql(bins: int) -> str:
    return f"""SELECT variable, retained, bin, {R(f'lo + bin * (hi - lo) / {bins}')} AS bin_start, count(*) AS n FROM (SELECT k.variable, retained, lo, hi, CAST(CASE WHEN hi > lo THEN least(floor((value - lo) / ((hi - lo) / {bins})), {bins - 1}) ELSE 0 END AS BIGINT) AS bin
FROM (SELECT variable, value, stage IS NULL AS retained FROM f2 WHERE value IS NOT NULL) k JOIN (SELECT variable, min(value) AS lo, max(value) AS hi FROM f2 WHERE value IS NOT NULL GROUP BY 1) s ON k.variable = s.variable) GROUP BY variable, retained, bin, lo, hi"""


for _bins in (100, 60, 80):
    @query(f"A20_histogram_{_bins}_bins", with_ctes(histogram_sql(_bins), "conv", CHAIN[:3]))
    def a20(spark, sf, _bins=_bins):
        return summaries.histogram(summaries.kept_removed_frame(ranged(spark, sf)), _bins)


@query("A21_group_display", with_ctes(f"""SELECT variable, aoi AS "group", count(*) AS n, count(*) FILTER (WHERE NOT retained) AS n_removed, {R('100.0 * count(*) FILTER (WHERE NOT retained) / count(*)')} AS pct_removed,
{R('min(value) FILTER (WHERE retained)')} AS min, {R('quantile_cont(value, 0.25) FILTER (WHERE retained)')} AS q1, {R('median(value) FILTER (WHERE retained)')} AS median, {R('quantile_cont(value, 0.75) FILTER (WHERE retained)')} AS q3, {R('max(value) FILTER (WHERE retained)')} AS max
FROM (SELECT *, stage IS NULL AS retained FROM f4 WHERE value IS NOT NULL) GROUP BY 1, 2""", "conv", CHAIN[:7]))
def a21(spark, sf):
    return summaries.group_display(summaries.kept_removed_frame(winded(spark, sf), "aoi"))


@query("A22_removal_cascade", chain_sql("SELECT variable, stage, n_present FROM rs WHERE pooled AND n_present > 0", REMOVALS))
def a22(spark, sf):
    return summaries.removal_cascade(summaries.removal_summary(screened(spark, sf), "aoi"))


@query("A14_observation_counts", with_ctes("""SELECT variable, count(*) FILTER (WHERE n > 100) AS sites_over_100, count(*) FILTER (WHERE n > 50) AS sites_over_50 FROM (SELECT point_id, variable, count(value) AS n FROM conv GROUP BY 1, 2) GROUP BY 1"""))
def a14(spark, sf):
    return summaries.sites_above(summaries.value_counts(celsius(spark, sf)), [100, 50])


@query("A14_values_per_point", with_ctes("SELECT point_id, variable, count(*) AS n_rows, count(value) AS n_values FROM conv GROUP BY 1, 2"))
def a14_points(spark, sf):
    return summaries.value_counts(celsius(spark, sf))


@query("A24_bounding_box", with_ctes(f"""SELECT {R('greatest(x0 - pad / ke, -180)')} AS xmin, {R('greatest(y0 - pad / 111.32, -90)')} AS ymin, {R('least(x1 + pad / ke, 180)')} AS xmax, {R('least(y1 + pad / 111.32, 90)')} AS ymax FROM (
SELECT *, greatest(0.1 * greatest((x1 - x0) * ke, (y1 - y0) * 111.32), 2) AS pad FROM (SELECT *, 111.32 * cos(radians((y0 + y1) / 2)) AS ke FROM (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM raw)))""", "raw"))
def a24(spark, sf):
    return summaries.bounding_box(raw_long(spark, sf))


@query("A24_bounding_box_per_axis", with_ctes(f"""SELECT {R('x0 - greatest(0.2 * (x1 - x0), 30 / ke)')} AS xmin, {R('y0 - greatest(0.2 * (y1 - y0), 30 / 111.32)')} AS ymin, {R('x1 + greatest(0.2 * (x1 - x0), 30 / ke)')} AS xmax, {R('y1 + greatest(0.2 * (y1 - y0), 30 / 111.32)')} AS ymax FROM (
SELECT *, 111.32 * cos(radians((y0 + y1) / 2)) AS ke FROM (SELECT min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM raw))""", "raw"))
def a24_axis(spark, sf):
    return summaries.bounding_box(raw_long(spark, sf), buffer=0.2, equal_km=False, min_buffer_km=30.0)


DAILY_PAIR = [("dw", f"""SELECT point_id, time, avg(value) FILTER (WHERE variable = 'lst_sst') AS lst_sst, avg(value) FILTER (WHERE variable = 'ref_sst') AS ref_sst, avg(value) FILTER (WHERE variable = 'eco_sst') AS eco_sst
FROM raw WHERE stat = 'nanmean' GROUP BY 1, 2""")]


def daily_means(spark, sf, stat="nanmean"):
    """Mean per site, date and variable as columns: duplicates average, in one aggregate."""
    rows = raw_long(spark, sf).where(F.col("stat") == stat)
    return rows.groupBy("point_id", "time").agg(*[F.avg(F.when(F.col("variable") == v, F.col("value"))).alias(v) for v in TEMPERATURES])


@query("A25_fraction_below_threshold", with_ctes(f"SELECT point_id, count(lst_sst) AS n, {R('count(*) FILTER (WHERE lst_sst - ref_sst < -4) / count(*)')} AS fraction_below, {R('min(lst_sst - ref_sst)')} AS min_diff FROM dw GROUP BY 1", "raw", DAILY_PAIR))
def a25(spark, sf):
    return summaries.fraction_below(daily_means(spark, sf), "lst_sst", "ref_sst", -4.0)


@query("A28_daily_mean_difference_mse", with_ctes(f"SELECT point_id, {R('avg((eco_sst - 273.15::DOUBLE - (ref_sst - 273.15::DOUBLE)) ** 2)')} AS mse FROM dw GROUP BY 1", "raw", DAILY_PAIR))
def a28(spark, sf):
    d = convert_unit("eco_sst", "K", "C") - convert_unit("ref_sst", "K", "C")
    return daily_means(spark, sf).groupBy("point_id").agg(F.avg(d * d).alias("mse"))


@query("T2_pivot_mean", with_ctes(f"SELECT point_id, time, {R('avg(value) FILTER (WHERE variable = $$eco_sst$$)')} AS eco_sst, {R('avg(value) FILTER (WHERE variable = $$lst_sst$$)')} AS lst_sst, {R('avg(value) FILTER (WHERE variable = $$ref_sst$$)')} AS ref_sst FROM raw GROUP BY 1, 2", "raw"))
def t2(spark, sf):
    return raw_long(spark, sf).groupBy("point_id", "time").pivot("variable", TEMPERATURES).agg(F.avg("value"))


@query("T1_pivot_unique", with_ctes(f"SELECT {ID_SQL}, {R('eco_sst')} AS eco_sst, {R('eco_hour')} AS eco_hour, {R('eco_wind')} AS eco_wind FROM w", "conv", [("w", WIDE_SQL)]))
def t1(spark, sf):
    return screening.pivot_keys(celsius(spark, sf), IDS, ["eco_sst", "eco_hour", "eco_wind"])


@query("T3_unpivot", with_ctes(f"SELECT {ID_SQL}, variable, {R('value')} AS value FROM ext WHERE stat = 'nanmean' AND variable IN ('eco_sst', 'eco_sst_hour', 'eco_sst_wind')", "ext"))
def t3(spark, sf):
    w = raw_wide(spark, sf).where((F.col("stat") == "nanmean") & (F.col("variable") == "eco_sst"))
    w = w.select(*IDS, F.col("value").alias("eco_sst"), F.col("hour").alias("eco_sst_hour"), F.col("wind").alias("eco_sst_wind"))
    return w.unpivot(IDS, ["eco_sst", "eco_sst_hour", "eco_sst_wind"], "variable", "value")


@query("U1_stacked_removals", chain_sql(f"SELECT stage, stage_variable, variable, {R('value')} AS value, point_id, time, reason, {R('resid')} AS resid, removed_pass FROM f7 WHERE stage IS NOT NULL"))
def u1(spark, sf):
    return removed(screened(spark, sf)).select("stage", "stage_variable", "variable", "value", "point_id", "time", "reason", "resid", "removed_pass")


@query("U1_clean_rows", chain_sql(f"SELECT {ID_SQL}, variable, {R('value')} AS value FROM f7 WHERE stage IS NULL"))
def u1_clean(spark, sf):
    return kept(screened(spark, sf))


@query("O1_report_order", with_ctes("""SELECT variable, pooled, grp AS "group", count(*) AS n, CAST(row_number() OVER (ORDER BY variable, NOT pooled, grp) AS INTEGER) AS position FROM (
SELECT variable, true AS pooled, '(all)' AS grp FROM conv UNION ALL SELECT variable, false, aoi FROM conv) GROUP BY 1, 2, 3"""))
def o1(spark, sf):
    from ..functions.ranking import number_rows

    rows = matchup.with_levels(celsius(spark, sf).select("variable", "aoi"), F.col("aoi"))
    out = rows.groupBy("variable", "pooled", "group").agg(F.count(F.lit(1)).alias("n"))
    placed = number_rows(out, [], ["variable", F.desc("pooled"), "group"], "position")
    return summaries.pooled_first(placed.withColumn("position", F.col("position").cast("int")), "variable")


@query("O4_thin_per_group", with_ctes(f"""SELECT aoi, point_id, time, {R('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY md5('7|' || point_id || '|' || CAST(time AS VARCHAR))) AS rn
FROM conv WHERE variable = 'ref_sst' AND value IS NOT NULL) WHERE rn <= 50"""))
def o4(spark, sf):
    from ..functions.ranking import top_per_group

    rows = celsius_temperatures(spark, sf).where("variable = 'ref_sst' and value is not null").select("aoi", "point_id", "time", "value")
    order = F.md5(F.concat_ws("|", F.lit("7"), "point_id", F.col("time").cast("string")))
    return top_per_group(rows, ["aoi"], [order], 50)


# ---- guards ---------------------------------------------------------------------------------


@query("V1_variables_present", with_ctes("""SELECT w.variable, count(c.variable) AS n_rows, count(c.value) AS n_values FROM (VALUES ('eco_sst'), ('lst_sst'), ('insitu_sst')) w(variable) LEFT JOIN conv c ON w.variable = c.variable GROUP BY 1"""))
def v1(spark, sf):
    return guards.absent_variables(celsius(spark, sf), ["eco_sst", "lst_sst", "insitu_sst"])


@query("V1_labels_that_match", with_ctes("""SELECT l.label, count(e.variable) AS n_rows, count(e.variable) = 0 AS fault FROM (VALUES ('eco', 'eco_sst', 'nanmean'), ('near', 'eco_sst', 'nearest'), ('ghost', 'eco_ss', NULL), ('none', 'lst_sst', 'median'))
l(label, variable, stat) LEFT JOIN raw e ON e.variable = l.variable AND (l.stat IS NULL OR e.stat = l.stat) GROUP BY 1""", "raw"))
def v1_labels(spark, sf):
    from ..plans.validate import label_matches

    labels = {"eco": {"variable": "eco_sst", "stat": "nanmean"}, "near": {"variable": "eco_sst", "stat": "nearest"}, "ghost": {"variable": "eco_ss"}, "none": {"variable": "lst_sst", "stat": "median"}}
    return label_matches(raw_long(spark, sf), labels)


@query("V3_alignment_metrics", with_ctes(f"""SELECT *, n_usable < 0.5 * n_any AS poorly_aligned, hour_min < 0 OR hour_max > 24 AS hour_out_of_range, wind_max > 60 AS wind_suspicious FROM (
SELECT count(*) AS n_keys, count(*) FILTER (WHERE t IS NOT NULL OR w IS NOT NULL OR h IS NOT NULL) AS n_any, count(*) FILTER (WHERE w IS NOT NULL AND h IS NOT NULL) AS n_usable, min(h) AS hour_min, max(h) AS hour_max, max(w) AS wind_max FROM k)""", "conv", SPARSE))
def v3(spark, sf):
    return guards.alignment_metrics(sparse_covariates(spark, sf), "eco_sst", "eco_wind", "eco_hour", early=EARLY, late=LATE)


@query("V4_duplicate_keys", with_ctes("SELECT point_id, time, variable, count(*) AS n_rows FROM raw GROUP BY 1, 2, 3 HAVING count(*) > 1", "raw"))
def v4(spark, sf):
    return guards.duplicate_keys(raw_long(spark, sf), ["point_id", "time", "variable"])


@query("V5_same_data_check", with_ctes(f"""SELECT count(*) FILTER (WHERE ia AND ib) AS n_paired, count(*) FILTER (WHERE ib IS NULL) AS n_only_old, count(*) FILTER (WHERE ia IS NULL) AS n_only_new,
count(*) FILTER (WHERE ia AND ib AND (v IS NULL) <> (u IS NULL)) AS n_null_mismatch, {R('max(abs(v - u))')} AS max_abs_diff FROM (SELECT point_id, time, value AS v, true AS ia FROM conv WHERE variable = 'eco_sst') a
FULL JOIN (SELECT point_id, time, value * 1.001 AS u, true AS ib FROM conv WHERE variable = 'eco_sst' AND (value < 40 OR value IS NULL)) b USING (point_id, time)"""))
def v5(spark, sf):
    a = celsius_temperatures(spark, sf).where("variable = 'eco_sst'").select("point_id", "time", "value")
    b = a.where("value < 40 or value is null").withColumn("value", F.col("value") * 1.001)
    return guards.compare_tables(a, b, ["point_id", "time"])


# ---- scalar functions -----------------------------------------------------------------------


@query("F1_unit_conversions", with_ctes(f"SELECT variable, {R('avg(value - 273.15::DOUBLE)')} AS c, {R('avg((value - 273.15::DOUBLE) * 9 / 5 + 32)')} AS f, {R('avg(value)')} AS k FROM raw GROUP BY 1", "raw"))
def f1(spark, sf):
    k = F.col("value")
    f = convert_unit(k, "K", "F")
    return raw_long(spark, sf).groupBy("variable").agg(F.avg(convert_unit(k, "K", "C")).alias("c"), F.avg(f).alias("f"), F.avg(convert_unit(f, "F", "K")).alias("k"))


@query("F2_local_solar_time", with_ctes(f"SELECT point_id, time, variable, stat, {R('(hour + lon / 15) - 24 * floor((hour + lon / 15) / 24)')} AS solar, {R('(hour - 30) - 24 * floor((hour - 30) / 24)')} AS wrapped FROM raw", "raw"))
def f2(spark, sf):
    from ..functions.exprs import wrap_hours

    return raw_wide(spark, sf).select("point_id", "time", "variable", "stat", solar_hour("hour", "lon").alias("solar"), wrap_hours(F.col("hour") - 30.0).alias("wrapped"))


@query("F3_F4_calendar_and_harmonics", with_ctes(f"SELECT time, CAST(dayofyear(time) AS INTEGER) AS doy, CAST(year(time) AS INTEGER) AS yr, {R('sin(2 * pi() * dayofyear(time) / 365.25)')} AS sin1, {R('cos(2 * pi() * dayofyear(time) / 365.25)')} AS cos1, {R('sin(4 * pi() * dayofyear(time) / 365.25)')} AS sin2, {R('cos(4 * pi() * dayofyear(time) / 365.25)')} AS cos2, count(*) AS n FROM raw GROUP BY time", "raw"))
def f4(spark, sf):
    days = raw_long(spark, sf).groupBy("time").agg(F.count(F.lit(1)).alias("n"))
    return days.select("time", F.dayofyear("time").alias("doy"), F.year("time").alias("yr"), *[c.alias(n) for n, c in harmonic_terms("time", 2).items()], "n")


@query("F5_F6_distances", with_ctes(f"""SELECT point_id, {R('2 * 6371 * asin(least(1, sqrt(power(sin(radians(-42 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(-42)) * power(sin(radians(148 - lon) / 2), 2))))')} AS km,
{R('(lon - 147) * 111320 * cos(radians(-43))')} AS east_m, {R('(lat + 43) * 111320')} AS north_m FROM (SELECT DISTINCT point_id, lat, lon FROM raw)""", "raw"))
def f5(spark, sf):
    from ..functions.exprs import haversine_km, metres_east, metres_north

    p = raw_long(spark, sf).select("point_id", "lat", "lon").distinct()
    return p.select("point_id", haversine_km("lat", "lon", F.lit(-42.0), F.lit(148.0)).alias("km"), metres_east("lon", F.lit(147.0), F.lit(-43.0)).alias("east_m"), metres_north("lat", F.lit(-43.0)).alias("north_m"))


@query("F7_F8_text", """SELECT source, lang, regexp_replace(source || ' / ' || lang, '[^A-Za-z0-9._-]+', '_', 'g') AS slug, upper(lang) AS up, substr(source, 2, 3) AS part, regexp_replace('has_' || source, '^has_', '') AS bare, count(*) AS n FROM documents GROUP BY source, lang""")
def f7(spark, sf):
    d = table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return d.select("source", "lang", slug(F.concat("source", F.lit(" / "), "lang")).alias("slug"), F.upper("lang").alias("up"), F.substring("source", 2, 3).alias("part"),
                    F.regexp_replace(F.concat(F.lit("has_"), "source"), "^has_", "").alias("bare"), "n")


@query("F9_F10_rounding_and_defaults", with_ctes(f"SELECT variable, {R('sum(round(hour + 0.5::DOUBLE, 0))')} AS half_up, {R('sum(round_even(hour + 0.5::DOUBLE, 0))')} AS half_even, {R('avg(round(value / 3, 2))')} AS two_places, {R('avg(coalesce(value, 0))')} AS zero_filled, {R('100.0 * count(value) / greatest(count(*), 1)')} AS pct FROM raw GROUP BY variable", "raw"))
def f9(spark, sf):
    from ..functions.exprs import percent

    v, h = F.col("value"), F.col("hour") + 0.5
    out = raw_wide(spark, sf).groupBy("variable").agg(
        F.sum(F.round(h, 0)).alias("half_up"), F.sum(F.bround(h, 0)).alias("half_even"), F.avg(F.round(v / 3, 2)).alias("two_places"),
        F.avg(F.coalesce(v, F.lit(0.0))).alias("zero_filled"), F.count(v).alias("n"), F.count(F.lit(1)).alias("t"))
    return out.select("variable", "half_up", "half_even", "two_places", "zero_filled", percent("n", "t").alias("pct"))


@query("F11_warming_covariate", with_ctes(f"SELECT point_id, time, variable, stat, {R('greatest(0, cos(2 * pi() * (hour - 14) / 24)) * exp(-wind / 2)')} AS warming FROM raw", "raw"))
def f11(spark, sf):
    return raw_wide(spark, sf).select("point_id", "time", "variable", "stat", warming_covariate("hour", "wind").alias("warming"))
