"""Seasonal regressions, designs, reconstruction and smoothing queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.exprs import SEASON_DAYS
from ..functions.lineage import cut
from ..operators import design, grid as g, matchup, reconstruct as rec, smoothing as sm
from .base import ORACLES, R, celsius_temperatures, query, with_ctes
from .gridding import SCALES, VARS, grid_ctes, the_grid

M = 2
INSTRUMENTS = {
    "lst_sst": {"tag": "lst", "intercept": "site+instrument", "seasonality": "shared", "error": "r_lst", "site_state": True},
    "eco_sst": {"tag": "eco", "intercept": "independent", "seasonality": "independent", "error": "r_eco", "site_state": True},
    "ref_sst": {"tag": "ref", "intercept": "zero", "seasonality": "shared", "error": "r_ref", "site_state": False},
}
SPEC = ("spec", """SELECT * FROM (VALUES ('lst_sst', 'lst', 'site+instrument', 'shared', 'r_lst', true), ('eco_sst', 'eco', 'independent', 'independent', 'r_eco', true), ('ref_sst', 'ref', 'zero', 'shared', 'r_ref', false))
v(variable, tag, intercept, seasonality, error, site_state)""")


def scaled(spark, sf, grid=None):
    long = (grid or the_grid(spark, sf)).long()
    return g.scale_values(long, g.scale_constants(long, "ref_sst", strict=False))


SCALED = ("scaled", "SELECT g.*, (value - mu) / sigma AS y FROM grid g JOIN scales USING (site)")
REG = [
    ("rb", "SELECT variable, site, site_index, y, sin(2 * pi() * dayofyear(date) / 365.25) AS sn, cos(2 * pi() * dayofyear(date) / 365.25) AS cs FROM scaled WHERE y IS NOT NULL"),
    ("rs", "SELECT variable, site, count(*) AS n, avg(y) AS my, avg(sn) AS ms, avg(cs) AS mc, covar_pop(sn, sn) AS ss, covar_pop(cs, cs) AS cc, covar_pop(sn, cs) AS sc, covar_pop(sn, y) AS sy, covar_pop(cs, y) AS cy FROM rb GROUP BY 1, 2 HAVING count(*) >= 10"),
    ("rc", "SELECT variable, site, n, my, ms, mc, (sy * cc - cy * sc) / (ss * cc - sc * sc) AS c1, (cy * ss - sy * sc) / (ss * cc - sc * sc) AS c2 FROM rs"),
    ("reg", "SELECT variable, site, n, my - c1 * ms - c2 * mc AS mu, c1, c2 FROM rc"),
]


def elimination_ctes(size: int) -> list[tuple[str, str]]:
    """Normal equations of ``size`` terms solved in SQL: one step per pivot, then back substitution."""
    angles = [f"{fn}({2 * k} * pi() * dayofyear(date) / 365.25)" for k in range(1, size // 2 + 1) for fn in ("sin", "cos")]
    n = range(size)
    out = [
        ("e_b", "SELECT variable, site, y, " + ", ".join(f"{a} AS x{i}" for i, a in enumerate(angles)) + " FROM scaled WHERE y IS NOT NULL"),
        ("e_0", "SELECT variable, site, count(*) AS n, avg(y) AS my, " + ", ".join(f"avg(x{i}) AS m{i}" for i in n) + ", " + ", ".join(f"covar_pop(x{i}, x{j}) AS a{i}_{j}" for i in n for j in n)
         + ", " + ", ".join(f"covar_pop(x{i}, y) AS b{i}" for i in n) + " FROM e_b GROUP BY 1, 2 HAVING count(*) >= 10"),
    ]
    for p in range(size - 1):
        new = [f"a{i}_{j} - a{i}_{p} * a{p}_{j} / a{p}_{p} AS a{i}_{j}" for i in range(p + 1, size) for j in range(p + 1, size)] + [f"b{i} - a{i}_{p} * b{p} / a{p}_{p} AS b{i}" for i in range(p + 1, size)]
        out.append((f"e_{p + 1}", f"SELECT * REPLACE ({', '.join(new)}) FROM e_{p}"))
    cur = f"e_{size - 1}"
    for i in reversed(n):
        known = "".join(f" - a{i}_{j} * c{j}" for j in range(i + 1, size))
        out.append((f"e_s{i}", f"SELECT *, (b{i}{known}) / a{i}_{i} AS c{i} FROM {cur}"))
        cur = f"e_s{i}"
    return out


@query("G8_seasonal_regressions_two_harmonics", with_ctes("SELECT variable, site, n, " + R("my" + "".join(f" - c{i} * m{i}" for i in range(4))) + " AS mu, " + ", ".join(f"{R(f'c{i}')} AS c{i + 1}" for i in range(4)) + " FROM e_s0", "conv", [*grid_ctes(), *SCALES, SCALED, *elimination_ctes(4)]))
def g8(spark, sf):
    return design.seasonal_regressions(scaled(spark, sf), 2, SEASON_DAYS, 10)


@query("G8_seasonal_regressions", with_ctes(f"SELECT variable, site, n, {R('mu')} AS mu, {R('c1')} AS c1, {R('c2')} AS c2 FROM reg", "conv", [*grid_ctes(), *SCALES, SCALED, *REG]))
def g8_one(spark, sf):
    return design.seasonal_regressions(scaled(spark, sf), 1, SEASON_DAYS, 10)


@query("G9_seed_table", with_ctes(f"""SELECT name, {R('value')} AS value FROM (SELECT v.t || '_' || site_index AS name, v.value FROM reg JOIN sites USING (site) CROSS JOIN LATERAL (VALUES ('mu', mu), ('c1', c1), ('c2', c2)) v(t, value) WHERE variable = 'lst_sst'
UNION ALL SELECT v.t || '_eco_' || site_index, v.value FROM reg JOIN sites USING (site) CROSS JOIN LATERAL (VALUES ('mu', mu), ('c1', c1), ('c2', c2)) v(t, value) WHERE variable = 'eco_sst')""", "conv", [*grid_ctes(), *SCALES, SCALED, *REG]))
def g9(spark, sf):
    grid = the_grid(spark, sf)
    regs = design.seasonal_regressions(scaled(spark, sf, grid), 1, SEASON_DAYS, 10)
    return design.seed_table(regs, sites_of(grid), design.instrument_table(spark, INSTRUMENTS), "lst_sst", 2)


def sites_of(grid):
    return grid.series.select("site", "site_index").distinct()


@query("G11_loading_names", with_ctes("SELECT site_index, j AS factor, CASE WHEN site_index <> j THEN 'lambda_' || site_index || '_' || j END AS name, CASE WHEN site_index = j THEN 1.0::DOUBLE END AS fixed_value FROM sites CROSS JOIN (SELECT unnest(range(1, 4)) AS j) WHERE j <= site_index", "conv", grid_ctes()))
def g11(spark, sf):
    return design.loading_names(sites_of(the_grid(spark, sf)), 3, fixed_diag=True)


def parameters(grid):
    """Named parameters as functions of the site index, so that SQL can make the same ones."""
    i = F.col("site_index").cast("double")
    s = F.col("site_index").cast("string")
    cells = [F.struct(F.concat(F.lit("mu_"), s).alias("name"), F.sin(i).alias("value")), F.struct(F.concat(F.lit("mu_eco_"), s).alias("name"), F.cos(i).alias("value"))]
    for k in (1, 2):
        cells.append(F.struct(F.concat(F.lit(f"c{k}_"), s).alias("name"), F.sin(i * k + 1.0).alias("value")))
        cells.append(F.struct(F.concat(F.lit(f"c{k}_eco_"), s).alias("name"), F.cos(i * k + 1.0).alias("value")))
    loads = F.transform(F.filter(F.sequence(F.lit(1), F.lit(M)), lambda j: j <= F.col("site_index")), lambda j: F.struct(F.concat(F.lit("lambda_"), s, F.lit("_"), j.cast("string")).alias("name"), F.sin(i * j.cast("double")).alias("value")))
    tag = F.when(F.col("site_index") == 1, F.array(F.struct(F.lit("mu_lst").alias("name"), F.lit(0.25).alias("value")))).otherwise(F.array().cast("array<struct<name:string,value:double>>"))
    return sites_of(grid).select(F.explode(F.concat(F.array(*cells), loads, tag)).alias("p")).select("p.*")


PARAMS = ("params", f"""SELECT 'mu_' || site_index AS name, sin(site_index) AS value FROM sites UNION ALL SELECT 'mu_eco_' || site_index, cos(site_index) FROM sites
UNION ALL SELECT 'c' || k || '_' || site_index, sin(site_index * k + 1) FROM sites, (VALUES (1), (2)) v(k) UNION ALL SELECT 'c' || k || '_eco_' || site_index, cos(site_index * k + 1) FROM sites, (VALUES (1), (2)) v(k)
UNION ALL SELECT 'lambda_' || site_index || '_' || j, sin(site_index * j) FROM sites, (VALUES (1), (2)) v(j) WHERE j <= site_index UNION ALL SELECT 'mu_lst', 0.25""")


@query("G12_cells_from_names", with_ctes(f"""SELECT regexp_extract(name, '^(.+)_([0-9]+)_([0-9]+)$', 1) AS param, CAST(greatest(i, j) AS INTEGER) AS row, CAST(least(i, j) AS INTEGER) AS col, {R('value')} AS value FROM (
SELECT *, CAST(regexp_extract(name, '^(.+)_([0-9]+)_([0-9]+)$', 2) AS INTEGER) AS i, CAST(regexp_extract(name, '^(.+)_([0-9]+)_([0-9]+)$', 3) AS INTEGER) AS j FROM params WHERE regexp_matches(name, '^(.+)_([0-9]+)_([0-9]+)$'))""", "conv", [*grid_ctes(), PARAMS]))
def g12(spark, sf):
    return design.cells_from_names(parameters(the_grid(spark, sf)))


@query("G13_observation_design", with_ctes("""SELECT row, variable, site, 'intercept' AS block, CAST(NULL AS BIGINT) AS target, CASE intercept WHEN 'site' THEN 'mu_' || site_index WHEN 'site+instrument' THEN 'mu_' || tag || '+mu_' || site_index ELSE 'mu_' || tag || '_' || site_index END AS name FROM ss WHERE intercept <> 'zero'
UNION ALL SELECT row, variable, site, 'error', NULL, error FROM ss
UNION ALL SELECT row, variable, site, 'season', k, 'c' || k || '_' || CASE WHEN seasonality = 'independent' THEN tag || '_' ELSE '' END || site_index FROM ss CROSS JOIN (VALUES (1), (2)) v(k)
UNION ALL SELECT row, variable, site, 'loading', j, 'lambda_' || site_index || '_' || j FROM ss CROSS JOIN (VALUES (1), (2)) v(j) WHERE j <= site_index
UNION ALL SELECT row, variable, site, 'site_state', site_index, '1' FROM ss WHERE site_state""", "conv", [*grid_ctes(), SPEC, ("ss", "SELECT * FROM series JOIN spec USING (variable)")]))
def g13(spark, sf):
    return design.observation_design(the_grid(spark, sf).series, design.instrument_table(spark, INSTRUMENTS), M, 2)


@query("J13_named_coefficients", with_ctes(f"SELECT s.site, p.name, {R('p.value')} AS value FROM sites s JOIN params p ON p.name = 'mu_' || s.site_index", "conv", [*grid_ctes(), PARAMS]))
def j13(spark, sf):
    grid = the_grid(spark, sf)
    wanted = sites_of(grid).select("site", F.concat(F.lit("mu_"), F.col("site_index").cast("string")).alias("name"))
    return design.require_names(wanted, parameters(grid))


@query("J13_optional_coefficients", with_ctes("SELECT site, 'nu_' || site_index AS name, 0.0::DOUBLE AS value FROM sites", "conv", grid_ctes()))
def j13_optional(spark, sf):
    grid = the_grid(spark, sf)
    wanted = sites_of(grid).select("site", F.concat(F.lit("nu_"), F.col("site_index").cast("string")).alias("name"))
    return design.require_names(wanted, parameters(grid), optional=True)


# ---- reconstruction -------------------------------------------------------------------------

STEP = 1


def states(grid):
    """Site states over the axis and two factors, as functions of site index and bin."""
    rows = sites_of(grid).select("site", "site_index", F.explode(F.sequence(F.lit(0), F.lit(grid.last_bin))).alias("bin"))
    i, b = F.col("site_index").cast("double"), F.col("bin").cast("double")
    site = rows.select("site", grid.date_of("bin").alias("date"), F.sin(i + b / 10.0).alias("x"), (F.lit(0.1) + F.lit(0.05) * F.cos(i * b)).alias("se"))
    axis = grid.axis(grid.series.sparkSession)
    factor = axis.select("date", F.explode(F.sequence(F.lit(1), F.lit(M))).alias("factor"), F.col("bin").cast("double").alias("b"))
    f = F.col("factor").cast("double")
    return site, factor.select("factor", "date", F.cos(f * F.col("b") / 7.0).alias("x"), (F.lit(0.2) + F.lit(0.1) * F.sin(f + F.col("b"))).alias("se"))


def site_scales(grid):
    return sites_of(grid).join(g.scale_constants(grid.long(), "ref_sst", strict=False), "site")


def view(spark, sf, variable=None, state=True):
    grid = the_grid(spark, sf, STEP)
    site, factors = states(grid)
    kind = INSTRUMENTS.get(variable, {"intercept": "site", "seasonality": "shared", "tag": None})
    coefs = rec.view_coefficients(site_scales(grid), parameters(grid), 2, M, kind["intercept"], kind["seasonality"], kind["tag"], optional=variable is None)
    own = INSTRUMENTS[variable]["site_state"] if variable else True
    return rec.reconstruct_view(site, rec.factor_table(factors, M), coefs, variable or "sst", 1, SEASON_DAYS, own)


BASE = [
    *grid_ctes(STEP), *SCALES, PARAMS,
    ("axis", "SELECT unnest(range(last_bin + 1))::INTEGER AS bin, t0 FROM span"),
    ("st", f"SELECT site, site_index, bin, CAST(t0 + bin * {STEP} AS DATE) AS date, sin(site_index + bin / 10.0) AS x, 0.1 + 0.05 * cos(site_index * bin) AS se FROM sites CROSS JOIN axis"),
    ("fa", "SELECT bin, j AS factor, cos(j * bin / 7.0::DOUBLE) AS x, 0.2 + 0.1 * sin(j + bin) AS se FROM axis CROSS JOIN (VALUES (1), (2)) v(j)"),
    ("lo", "SELECT site_index, j AS factor, sin(site_index * j) AS lam FROM sites, (VALUES (1), (2)) v(j) WHERE j <= site_index"),
    ("sh", "SELECT lo.site_index, fa.bin, sum(lam * x) AS v, sum(lam * lam * se * se) AS vv FROM lo JOIN fa USING (factor) GROUP BY 1, 2"),
]


def view_ctes(name: str, infix: str, mu: str, own: bool, variable: str) -> list[tuple[str, str]]:
    trig = "sin" if infix == "" else "cos"
    x, v = ("st.x", "st.se * st.se") if own else ("0.0::DOUBLE", "0.0::DOUBLE")
    season = f"{trig}(st.site_index + 1) * sin(2 * pi() * dayofyear(st.date) / 365.25) + {trig}(st.site_index * 2 + 1) * cos(2 * pi() * dayofyear(st.date) / 365.25)"
    return [(name, f"SELECT st.date, st.site, '{variable}' AS variable, sigma * ({x} + sh.v + {season} + {mu}) + scales.mu AS value, sigma * sqrt({v} + sh.vv) AS se, sigma * ({season} + {mu}) + scales.mu AS clim FROM st JOIN sh USING (site_index, bin) JOIN scales USING (site)")]


VIEWS = {"site": view_ctes("v_site", "", "sin(st.site_index)", True, "sst"), "lst": view_ctes("v_lst", "", "(sin(st.site_index) + 0.25)", True, "lst_sst"),
         "eco": view_ctes("v_eco", "eco", "cos(st.site_index)", True, "eco_sst"), "ref": view_ctes("v_ref", "", "0.0::DOUBLE", False, "ref_sst")}

for _tag, _var in (("site", None), ("lst", "lst_sst"), ("eco", "eco_sst"), ("ref", "ref_sst")):
    @query(f"G14_reconstruct_{_tag}_view", with_ctes(f"SELECT date, site, variable, {R('value')} AS value, {R('se')} AS se FROM v_{_tag}", "conv", [*BASE, *VIEWS[_tag]]))
    def g14(spark, sf, _var=_var):
        return view(spark, sf, _var)


@query("G19_climatology_view", with_ctes(f"SELECT date, site, 'mean_sst' AS variable, {R('clim')} AS value FROM v_site", "conv", [*BASE, *VIEWS["site"]]))
def g19(spark, sf):
    grid = the_grid(spark, sf, STEP)
    coefs = rec.view_coefficients(site_scales(grid), parameters(grid), 2, M)
    return rec.climatology_view(states(grid)[0], coefs)


@query("G19_climatology_instrument_view", with_ctes(f"SELECT date, site, 'eco_sst' AS variable, {R('clim')} AS value FROM v_eco", "conv", [*BASE, *VIEWS["eco"]]))
def g19_eco(spark, sf):
    grid = the_grid(spark, sf, STEP)
    coefs = rec.view_coefficients(site_scales(grid), parameters(grid), 2, M, "independent", "independent", "eco")
    return rec.climatology_view(states(grid)[0], coefs, "eco_sst")


@query("G20_fine_scale_contribution", with_ctes(f"SELECT site, date, {R('a.value')} AS fused, {R('b.value')} AS instrument, {R('a.value - b.value')} AS diff FROM v_site a JOIN v_ref b USING (site, date)", "conv", [*BASE, *VIEWS["site"], *VIEWS["ref"]]))
def g20(spark, sf):
    return rec.contribution(view(spark, sf), view(spark, sf, "ref_sst"))


# ---- smoothing ------------------------------------------------------------------------------


@query("G18_error_variances", with_ctes(f"""SELECT variable, {R('greatest((1.4826 * mad(d)) ** 2, 1e-6)')} AS r FROM (SELECT a.variable, a.value - b.value AS d FROM conv a JOIN conv b ON a.point_id = b.point_id AND a.time = b.time AND b.variable = 'ref_sst'
WHERE a.variable IN ('eco_sst', 'lst_sst') AND a.value - b.value IS NOT NULL) GROUP BY variable"""))
def g18(spark, sf):
    spread = matchup.match_up_variance(celsius_temperatures(spark, sf), ["eco_sst", "lst_sst"], ["ref_sst"])
    return sm.error_variances(spread, "ref_sst")


def residuals(spark, sf, grid):
    """Scaled observations minus each series' own intercept and season."""
    y = scaled(spark, sf, grid).where("variable <> 'ref_sst'")
    regs = design.small_side(design.seasonal_regressions(y, 1, SEASON_DAYS, 10))
    from ..functions.exprs import harmonic_terms

    t = harmonic_terms("date", 1)
    joined = y.join(regs, ["variable", "site"])
    return joined.select("site", "date", "variable", (F.col("y") - F.col("mu") - F.col("c1") * t["sin1"] - F.col("c2") * t["cos1"]).alias("resid"))


COLLAPSED = [("resid", "SELECT b.variable, b.site, g.date, b.y - r.mu - r.c1 * sin(2 * pi() * dayofyear(g.date) / 365.25) - r.c2 * cos(2 * pi() * dayofyear(g.date) / 365.25) AS e FROM scaled g JOIN scaled b USING (row, bin) JOIN reg r ON r.variable = b.variable AND r.site = b.site WHERE b.variable <> 'ref_sst'"),
             ("colla", "SELECT site, date, sum(e / v.r) / sum(1 / v.r) AS ybar, 1 / sum(1 / v.r) AS rbar FROM resid JOIN (VALUES ('eco_sst', 0.6::DOUBLE), ('lst_sst', 0.9::DOUBLE)) v(variable, r) USING (variable) GROUP BY 1, 2")]


def collapsed(spark, sf, grid):
    var = spark.createDataFrame([("eco_sst", 0.6), ("lst_sst", 0.9)], "variable string, r double")
    return sm.collapse(residuals(spark, sf, grid), var)


@query("G16_collapsed_observations", with_ctes(f"SELECT site, date, {R('ybar')} AS ybar, {R('rbar')} AS rbar FROM colla", "conv", [*grid_ctes(), *SCALES, SCALED, *REG, *COLLAPSED]))
def g16_collapse(spark, sf):
    return collapsed(spark, sf, the_grid(spark, sf))


SMOOTHER = [
    ("axis", "SELECT s.site, b.bin, c.ybar, c.rbar FROM (SELECT DISTINCT site FROM colla) s CROSS JOIN (SELECT unnest(range(last_bin + 1))::INTEGER AS bin, t0 FROM span) b LEFT JOIN colla c ON c.site = s.site AND c.date = CAST(b.t0 + b.bin AS DATE)"),
    ("fw", """SELECT site, -1 AS bin, 0.0::DOUBLE AS am, 0.0::DOUBLE AS av, 0.0::DOUBLE AS m, 1.0::DOUBLE AS v FROM (SELECT DISTINCT site FROM colla)
UNION ALL SELECT a.site, a.bin, 0.9 * f.m, 0.81 * f.v + 0.2, CASE WHEN ybar IS NULL THEN 0.9 * f.m ELSE 0.9 * f.m + (0.81 * f.v + 0.2) / (0.81 * f.v + 0.2 + rbar) * (ybar - 0.9 * f.m) END,
CASE WHEN ybar IS NULL THEN 0.81 * f.v + 0.2 ELSE (0.81 * f.v + 0.2) * (1 - (0.81 * f.v + 0.2) / (0.81 * f.v + 0.2 + rbar)) END FROM fw f JOIN axis a ON a.site = f.site AND a.bin = f.bin + 1"""),
    ("bw", """SELECT site, bin, m AS x, v AS w FROM fw WHERE bin = (SELECT last_bin FROM span)
UNION ALL SELECT f.site, f.bin, f.m + f.v * 0.9 / n.av * (b.x - n.am), f.v + (f.v * 0.9 / n.av) ** 2 * (b.w - n.av) FROM bw b JOIN fw n ON n.site = b.site AND n.bin = b.bin JOIN fw f ON f.site = b.site AND f.bin = b.bin - 1 WHERE f.bin >= 0"""),
]


@query("G16_smoothed_states", "WITH RECURSIVE " + with_ctes(f"SELECT site, CAST(t0 + bin AS DATE) AS date, {R('x')} AS x, {R('sqrt(w)')} AS se FROM bw CROSS JOIN span", "conv", [*grid_ctes(), *SCALES, SCALED, *REG, *COLLAPSED, *SMOOTHER])[5:])
def g16(spark, sf):
    grid = the_grid(spark, sf)
    return sm.smooth(collapsed(spark, sf, grid), grid.start, grid.last_bin, 0.9, 0.2)


CANDIDATES = [(rho, tau) for rho in (0.5, 0.8, 0.95) for tau in (0.05, 0.2, 0.5)]


@query("G17_likelihood_grid", "WITH RECURSIVE " + with_ctes(f"SELECT rho, tau, {R('sum(ll)')} AS log_likelihood FROM kf WHERE k = n GROUP BY rho, tau", "conv", [*grid_ctes(), *SCALES, SCALED, *REG, *COLLAPSED,
    ("ob", "SELECT site, CAST(date_diff('day', t0, date) AS DOUBLE) AS bin, ybar, rbar, row_number() OVER (PARTITION BY site ORDER BY date) AS k, count(*) OVER (PARTITION BY site) AS n FROM colla CROSS JOIN span"),
    ("cand", "SELECT rho, tau FROM (VALUES (0.5::DOUBLE), (0.8), (0.95)) a(rho) CROSS JOIN (VALUES (0.05::DOUBLE), (0.2), (0.5)) b(tau)"),
    ("kf", """SELECT site, rho, tau, 0::BIGINT AS k, max(n) AS n, -1.0::DOUBLE AS bin, 0.0::DOUBLE AS m, 1.0::DOUBLE AS v, 0.0::DOUBLE AS ll FROM ob CROSS JOIN cand GROUP BY site, rho, tau
UNION ALL SELECT site, rho, tau, k, n, bin, am + pv / (pv + rbar) * (ybar - am), pv * (1 - pv / (pv + rbar)), ll - 0.5 * (ln(2 * pi() * (pv + rbar)) + (ybar - am) ** 2 / (pv + rbar)) FROM (
SELECT o.site, f.rho, f.tau, o.k, f.n, o.bin, o.ybar, o.rbar, f.ll, rho ** (o.bin - f.bin) * f.m AS am, (rho * rho) ** (o.bin - f.bin) * f.v + tau * (1 - (rho * rho) ** (o.bin - f.bin)) / (1 - rho * rho) AS pv FROM kf f JOIN ob o ON o.site = f.site AND o.k = f.k + 1)""")])[5:])
def g17(spark, sf):
    grid = the_grid(spark, sf)
    return sm.log_likelihoods(collapsed(spark, sf, grid), grid.start, CANDIDATES)


@query("G17_best_candidate", ORACLES["G17_likelihood_grid"] + " ORDER BY log_likelihood DESC LIMIT 1")
def g17_best(spark, sf):
    grid = the_grid(spark, sf)
    scores = cut(sm.log_likelihoods(collapsed(spark, sf, grid), grid.start, CANDIDATES))
    return scores.orderBy(F.desc("log_likelihood")).limit(1)


FIT = {
    "ref_sst": {"tag": "ref", "intercept": "site+instrument", "seasonality": "shared", "site_state": True},
    "eco_sst": {"tag": "eco", "intercept": "site", "seasonality": "shared", "site_state": True},
    "lst_sst": {"tag": "lst", "intercept": "site+instrument", "seasonality": "shared", "site_state": True},
}


@query("G16_states_on_a_five_day_axis", with_ctes("""SELECT site, CAST(last_bin AS BIGINT) - 2 AS n_states, CAST(t0 + 15 AS DATE) AS first, CAST(t0 + 5 * last_bin AS DATE) AS last, CAST(5 AS INTEGER) AS step
FROM (SELECT DISTINCT site FROM grid) CROSS JOIN span""", "conv", grid_ctes(5)))
def g16_axis(spark, sf):
    """A fit of a five-day grid, from its fourth bin on: which dates have states at each site?"""
    from ..plans.config import ModelConfig
    from ..plans.fit import fit, prepare

    grid = the_grid(spark, sf, 5)
    cfg = ModelConfig(instruments=FIT, scale_reference="ref_sst", candidates=[[0.9, 0.1], [0.95, 0.3]], start=str(grid.time_axis.within(None, None).start + dt.timedelta(days=14)))
    states = fit(prepare(grid.long(), cfg, grid.time_axis, strict=False), cfg, "ref_sst", "ref_sst", strict=False).states
    before = F.lag("date").over(Window.partitionBy("site").orderBy("date"))
    gaps = states.withColumn("gap", F.datediff("date", before))
    once = F.when(F.min("gap") == F.max("gap"), F.max("gap"))
    return gaps.groupBy("site").agg(F.count("x").alias("n_states"), F.min("date").alias("first"), F.max("date").alias("last"), once.alias("step"))


FAULTY_SITES = [f"P{i}" for i in range(20, 28)]
FAULTS = [("w", "SELECT 'P' || i AS site FROM (SELECT unnest(range(20, 28)) AS i)"), ("h", "SELECT * FROM (VALUES ('P21'), ('P30')) v(site)"),
          ("p", "SELECT variable, site, site IN (SELECT site FROM h) AND variable = 'eco_sst' AS held FROM series WHERE site IN (SELECT site FROM w)")]


@query("V1_model_configuration_problems", with_ctes("""SELECT 'sites: no data at ' || site AS problem FROM w WHERE site NOT IN (SELECT site FROM series)
UNION ALL SELECT 'holdout_sites: ' || site || ' is not a selected site' FROM h WHERE site NOT IN (SELECT site FROM p)
UNION ALL SELECT 'holdout: nothing is left at ' || site FROM p WHERE site IN (SELECT site FROM h) GROUP BY site HAVING bool_and(held)
UNION ALL SELECT 'instruments: tags must be unique' UNION ALL SELECT DISTINCT 'instruments: no entry for ' || variable FROM p WHERE variable NOT IN ('lst_sst', 'eco_sst')
UNION ALL SELECT 'holdout: ' || variable || ' is withheld everywhere' FROM p WHERE variable IN ('lst_sst', 'eco_sst') GROUP BY variable HAVING bool_and(held)
UNION ALL SELECT DISTINCT 'scale_reference: no insitu_sst at ' || site FROM p
UNION ALL SELECT 'start must be before end'""", "conv", [*grid_ctes(), *FAULTS]))
def v1_model(spark, sf):
    from ..plans.config import ModelConfig
    from ..plans.validate import model_problems, series_facts

    kinds = {"tag": "same", "intercept": "site", "seasonality": "shared"}
    cfg = ModelConfig(instruments={"lst_sst": kinds, "eco_sst": kinds}, sites=FAULTY_SITES, holdout_sites=["P21", "P30"], holdout_variables=["eco_sst"], scale_reference="insitu_sst", start="2000-01-01", end="1999-01-01")
    found = model_problems(cfg, series_facts(cfg, the_grid(spark, sf).series))
    return spark.createDataFrame([(p,) for p in found], "problem string")


@query("V2_series_present", with_ctes("SELECT w.variable, w.site, count(g.value) AS n_values, count(g.value) > 0 AS present FROM (SELECT variable, 'P' || i AS site FROM (VALUES ('eco_sst'), ('ref_sst'), ('insitu_sst')) v(variable) CROSS JOIN (SELECT unnest(range(20, 27)) AS i)) w LEFT JOIN grid g ON g.variable = w.variable AND g.site = w.site GROUP BY 1, 2", "conv", grid_ctes()))
def v2(spark, sf):
    from ..plans.validate import series_present

    wanted = [(v, f"P{i}") for v in ("eco_sst", "ref_sst", "insitu_sst") for i in range(20, 27)]
    return series_present(the_grid(spark, sf).long(), wanted)
