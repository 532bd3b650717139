"""Designs, reconstruction, smoothing, bootstrap and the three jobs end to end."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaweave.operators import design as ds, grid as g, reconstruct as rec, scoring as so, smoothing as sm
from thermaweave.plans import runs
from thermaweave.sources import readers as rd
from thermaweave.plans import config as cf, fit as ft, holdout as ho, preprocess as pp, validate as va
from thermaweave.sources import writers as wr

D = dt.date(2020, 1, 1)


def day(n):
    return D + dt.timedelta(days=int(n))


def posterior(y, r, rho, tau, v0):
    """Dense Gaussian posterior of an AR(1) path started one step before the first observation."""
    n = len(y)
    cov = np.empty((n, n))
    var = [rho**2 * v0 + tau]
    for _ in range(n - 1):
        var.append(rho**2 * var[-1] + tau)
    for i in range(n):
        for j in range(i, n):
            cov[i, j] = cov[j, i] = rho ** (j - i) * var[i]
    seen = ~np.isnan(y)
    s = cov[np.ix_(seen, seen)] + np.diag(r[seen])
    k = cov[:, seen] @ np.linalg.inv(s)
    ll = -0.5 * (y[seen] @ np.linalg.solve(s, y[seen]) + np.linalg.slogdet(2 * np.pi * s)[1])
    return k @ y[seen], np.sqrt(np.diag(cov - k @ cov[seen])), ll


def test_smoother_and_likelihood_equal_the_dense_posterior(spark):
    rng = np.random.default_rng(12)
    rows, want, total = [], {}, {}
    cands = [(0.9, 0.3), (1.0, 0.2), (0.4, 1.0)]
    for s in ("a", "b"):
        y, r = rng.normal(size=30), rng.uniform(0.1, 1.0, 30)
        y[rng.random(30) < 0.4] = np.nan
        y[0] = 0.5
        rows += [(s, day(i), float(y[i]), float(r[i])) for i in range(30) if y[i] == y[i]]
        want[s] = posterior(y, r, 0.9, 0.3, 1.0)
        for c in cands:
            total[c] = total.get(c, 0.0) + posterior(y, r, *c, 1.0)[2]
    obs = spark.createDataFrame(rows, "site string, date date, ybar double, rbar double")
    got = sm.smooth(obs, D, 29, 0.9, 0.3).orderBy("site", "date").toPandas()
    for s in ("a", "b"):
        part = got[got.site == s]
        assert np.allclose(part.x, want[s][0]) and np.allclose(part.se, want[s][1])
    scores = {(r["rho"], r["tau"]): r["log_likelihood"] for r in sm.log_likelihoods(obs, D, cands).collect()}
    assert scores == pytest.approx(total)
    assert sm.best_candidate(sm.log_likelihoods(obs, D, cands)) == max(total, key=total.get)


def serial(y, r, rho, tau, init):
    """The plain recursions, one bin after the other."""
    n = len(y)
    ahead, ahead_var, x, var = (np.empty(n) for _ in range(4))
    m, v = 0.0, init
    for t in range(n):
        m, v = rho * m, rho * rho * v + tau
        ahead[t], ahead_var[t] = m, v
        if y[t] == y[t]:
            gain = v / (v + r[t])
            m, v = m + gain * (y[t] - m), v * (1.0 - gain)
        x[t], var[t] = m, v
    for t in range(n - 2, -1, -1):
        back = var[t] * rho / ahead_var[t + 1]
        x[t] += back * (x[t + 1] - ahead[t + 1])
        var[t] += back * back * (var[t + 1] - ahead_var[t + 1])
    return x, np.sqrt(var)


def test_a_series_over_many_blocks_equals_the_serial_recursions(spark):
    rng = np.random.default_rng(3)
    n, step = 5000, 5
    rows, want, total = [], {}, {}
    cands = [(0.97, 0.2), (1.0, 0.05)]
    for s in ("a", "b"):
        y, r = rng.normal(size=n).cumsum() * 0.1, rng.uniform(0.1, 1.0, n)
        y[rng.random(n) < 0.6] = np.nan
        y[1000:1600] = np.nan  # whole blocks without data
        rows += [(s, day(step * i + 2), float(y[i]), float(r[i])) for i in range(n) if y[i] == y[i]]
        want[s] = serial(y, r, *cands[0], 1.5)
    obs = spark.createDataFrame(rows + [("a", day(-9), 1.0, 1.0), ("bare", day(step * n + 50), 1.0, 1.0)], "site string, date date, ybar double, rbar double")
    got = sm.smooth(obs, D, n - 1, *cands[0], 1.5, step, block_bins=128).orderBy("site", "date").toPandas()
    assert list(got[got.site == "a"].date) == [day(step * i) for i in range(n)]
    for s in ("a", "b"):
        part = got[got.site == s]
        assert np.abs(part.x.to_numpy() - want[s][0]).max() < 1e-9 and np.abs(part.se.to_numpy() - want[s][1]).max() < 1e-9
    assert (got[got.site == "bare"].x == 0).all()
    few, many = ({(r["rho"], r["tau"]): r["log_likelihood"] for r in sm.log_likelihoods(obs, D, cands, 1.5, step, n - 1, block_bins=b).collect()} for b in (100, 10**6))
    assert few == pytest.approx(many, rel=1e-12)


def test_collapse_weights_by_precision(spark):
    r = spark.createDataFrame([("s", D, "a", 1.0), ("s", D, "b", 4.0), ("s", D, "c", None)], "site string, date date, variable string, resid double")
    v = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 1.0)], "variable string, r double")
    got = sm.collapse(r, v).first()
    assert (got["ybar"], got["rbar"]) == pytest.approx(((1 + 4 / 3) / (4 / 3), 0.75))


def test_regressions_skip_short_and_degenerate_series(spark):
    rng = np.random.default_rng(2)
    rows = [("v", "ok", day(i * 7), float(rng.normal())) for i in range(60)] + [("v", "short", day(i), 1.0) for i in range(4)] + [("v", "one day", D, float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "variable string, site string, date date, y double")
    got = ds.seasonal_regressions(df, 2, 365.25, 10).collect()
    assert [r["site"] for r in got] == ["ok"]
    part = [r for r in rows if r[1] == "ok"]
    doy = np.array([r[2].timetuple().tm_yday for r in part])
    x = np.column_stack([np.ones(60)] + [f(2 * np.pi * k * doy / 365.25) for k in (1, 2) for f in (np.sin, np.cos)])
    assert [got[0][c] for c in ("mu", "c1", "c2", "c3", "c4")] == pytest.approx(np.linalg.lstsq(x, np.array([r[3] for r in part]), rcond=None)[0].tolist())


@pytest.fixture(scope="module")
def world(spark):
    sites = spark.createDataFrame([("a", 1, 10.0, 2.0), ("b", 2, 12.0, 3.0)], "site string, site_index long, mu double, sigma double")
    names = {"mu_1": 0.1, "mu_2": 0.2, "c1_1": 0.5, "c1_2": 0.6, "c2_1": -0.5, "c2_2": 0.4, "lambda_1_1": 0.7, "lambda_2_1": 0.8, "lambda_2_2": 0.9, "mu_x": 0.3}
    params = spark.createDataFrame(list(names.items()), "name string, value double")
    states = spark.createDataFrame([(s, day(i), float(i), 0.5) for s in "ab" for i in range(3)], "site string, date date, x double, se double")
    factors = spark.createDataFrame([(j, day(i), float(i + j), 0.1 * j) for j in (1, 2) for i in range(3)], "factor int, date date, x double, se double")
    return sites, params, states, rec.factor_table(factors, 2)


def test_reconstruction_is_the_matrix_product(world):
    sites, params, states, factors = world
    got = {(r["site"], r["date"]): r for r in rec.reconstruct_view(states, factors, rec.view_coefficients(sites, params, 2, 2)).collect()}
    for s, (mu, sg, m, c1, c2, l1, l2) in {"a": (10, 2, 0.1, 0.5, -0.5, 0.7, 0.0), "b": (12, 3, 0.2, 0.6, 0.4, 0.8, 0.9)}.items():
        for i in range(3):
            doy = day(i).timetuple().tm_yday
            x = i + l1 * (i + 1) + l2 * (i + 2)
            season = c1 * np.sin(2 * np.pi * doy / 365.25) + c2 * np.cos(2 * np.pi * doy / 365.25)
            r = got[s, day(i)]
            assert r["value"] == pytest.approx(sg * (x + season + m) + mu)
            assert r["se"] == pytest.approx(sg * np.sqrt(0.25 + l1**2 * 0.01 + l2**2 * 0.04))


def test_views_share_and_miss_parameters(world, spark):
    sites, params, states, factors = world
    site = rec.reconstruct_view(states, factors, rec.view_coefficients(sites, params, 2, 2)).select("site", "date", "value")
    same = rec.reconstruct_view(states, factors, rec.view_coefficients(sites, params, 2, 2, "site", "shared", "x"), "x").select("site", "date", "value")
    assert site.exceptAll(same).count() == 0
    off = rec.view_coefficients(sites, params, 2, 2, "site+instrument", "shared", "x").collect()
    assert sorted(r["intercept"] for r in off) == pytest.approx([0.4, 0.5])
    assert {r["intercept"] for r in rec.view_coefficients(sites, params, 2, 2, "zero").collect()} == {0.0}
    with pytest.raises(Exception, match="no parameter named"):
        rec.view_coefficients(sites, params, 2, 2, "independent", "shared", "x").collect()
    none = params.where("name like 'lambda%'")
    assert {r["intercept"] for r in rec.view_coefficients(sites, none, 2, 2, optional=True).collect()} == {0.0}
    with pytest.raises(Exception, match="no parameter named mu_2"):
        rec.view_coefficients(sites, params.where("name <> 'mu_2'"), 2, 2, optional=True).collect()


def test_loading_and_design_guards(spark):
    sites = spark.createDataFrame([(1,), (2,), (3,)], "site_index long")
    got = {(r["site_index"], r["factor"]): (r["name"], r["fixed_value"]) for r in ds.loading_names(sites, 2, fixed_diag=True).collect()}
    assert got == {(1, 1): (None, 1.0), (2, 1): ("lambda_2_1", None), (2, 2): (None, 1.0), (3, 1): ("lambda_3_1", None), (3, 2): ("lambda_3_2", None)}
    with pytest.raises(ValueError):
        ds.loading_names(sites, 4)
    full = spark.createDataFrame([("q_1_2", 1.0), ("q_2_1", 2.0), ("other", 3.0)], "name string, value double")
    assert ds.cells_from_names(full, fold=False).count() == 2
    with pytest.raises(Exception, match="same cell"):
        ds.cells_from_names(full).collect()
    with pytest.raises(Exception, match="exceeds"):
        ds.cells_from_names(full.limit(1), n_rows=1).collect()
    series = spark.createDataFrame([(1, "v", "a", 1)], "row long, variable string, site string, site_index long")
    blind = ds.instrument_table(spark, {"v": {"tag": "v", "intercept": "zero", "seasonality": "shared", "site_state": False}})
    with pytest.raises(Exception, match="no instrument observes"):
        ds.observation_design(series, blind, 0, 1).collect()


def preds(spark, per_site, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(s, day(i), float(rng.normal()), float(rng.normal()), 1.0, float(rng.normal()), float(rng.normal())) for s, n in per_site.items() for i in range(n)]
    return spark.createDataFrame(rows, "site string, date date, obs double, pred_full double, se_full double, pred_ref_model double, pred_ref_raw double")


def test_one_row_per_site_leaves_only_the_site_draw(spark):
    p = preds(spark, {f"s{i}": 1 for i in range(12)})
    draws = so.bootstrap_draws(p, 40).toPandas()
    assert (draws.n_draws == 12).all()
    errs = {float(r["pred_full"] - r["obs"]) ** 2 for r in p.collect()}
    assert draws.mse_full.between(min(errs), max(errs)).all() and draws.mse_full.nunique() > 20


def test_identical_rows_give_zero_width_intervals(spark):
    rows = [("s", day(i), 1.0, 2.0, 1.0, 3.0, 4.0) for i in range(20)]
    p = spark.createDataFrame(rows, preds(spark, {"s": 1}).schema)
    for r in so.bootstrap_intervals(so.bootstrap_draws(p, 30)).collect():
        assert r["mse_lo"] == pytest.approx(r["mse_hi"]) and (r["model"] == "full") == (r["dmse_lo"] is None)


def test_intervals_cover_the_estimate_and_a_hot_site_is_split(spark):
    p = preds(spark, {"hot": 25_000, "b": 200, "c": 100}, 3)
    table, draws = so.score_table(p, 20)
    assert draws.count() == 20
    for r in table.collect():
        assert r["mse_lo"] <= r["mse_lo2"] <= r["mse_hi2"] <= r["mse_hi"] and r["rmse_hi"] == pytest.approx(r["mse_hi"] ** 0.5)


def test_lossy_join_is_refused(spark):
    p = preds(spark, {"a": 5, "b": 5})
    truth = p.select("site", "date", F.col("obs").alias("value"))
    assert so.checked_predictions(truth, p, ["a", "b"]) is p
    with pytest.raises(ValueError, match="do not cover"):
        so.checked_predictions(truth, p.where("site = 'a'"))
    with pytest.raises(ValueError):
        so.checked_predictions(truth, p, ["a"])


# ---- jobs -----------------------------------------------------------------------------------


def test_config_reports_every_problem_at_once():
    cfg = cf.from_dict(cf.PreprocessConfig, {
        "variables": {"t": {"variable": "t_raw"}}, "group_id": "nowhere", "range": {"variables": ["t", "zz"], "lower": 5, "upper": 1},
        "season": {"variables": ["t"], "thresholds": [2.0, 3.0]}, "match_up": {"variables": [{"target": "t", "reference": "t"}], "passes": 0}, "grid": {"time_step": 0}})
    found = va.preprocessing_problems(cfg, ["site", "time", "variable", "value"])
    for part in ("group_id", "zz is not a label", "lower must be less", "must not increase", "no column point_id", "must differ", "passes", "time_step"):
        assert any(part in f for f in found), part
    with pytest.raises(ValueError, match="unknown Range keys: lowr"):
        cf.from_dict(cf.PreprocessConfig, {"range": {"lowr": 1}})


def test_model_config_problems(spark):
    kinds = {"tag": "x", "intercept": "site", "seasonality": "shared"}
    cfg = cf.ModelConfig(instruments={"t": kinds, "r": {**kinds}}, sites=["a", "b", "zz"], holdout_sites=["b", "q"], holdout_variables=["t"], scale_reference="r", factors=9)
    series = spark.createDataFrame([("t", "a"), ("t", "b"), ("r", "a"), ("w", "a")], "variable string, site string")
    with pytest.raises(va.ConfigError) as caught:
        va.validate_model(cfg, series)
    for part in ("no data at zz", "q is not a selected site", "tags must be unique", "no entry for w", "nothing is left at b", "no r at b", "factors"):
        assert any(part in f for f in caught.value.problems), part


def synthetic(spark):
    rng = np.random.default_rng(21)
    rows = []
    for s, (lat, lon) in {"a": (-43.0, 147.0), "b": (-43.1, 147.1), "c": (-43.2, 147.2)}.items():
        x = 0.0
        for i in range(400):
            x = 0.95 * x + rng.normal(0, 0.3)
            doy = day(i).timetuple().tm_yday
            truth = 15 + 4 * np.sin(2 * np.pi * doy / 365.25) + x
            hour = float(rng.uniform(0, 24))
            for v, val in (("ref", truth + 0.2 + rng.normal(0, 0.6)), ("hi", truth + rng.normal(0, 0.3)), ("insitu", truth)):
                missing = (v == "hi" and rng.random() < 0.6) or (v == "insitu" and rng.random() < 0.5)
                value = None if missing else float(val if v == "insitu" else val + 273.15)
                if v == "hi" and value is not None and i % 97 == 0:
                    value = 200.0
                rows.append((s, lat, lon, day(i), v, value))
            rows += [(s, lat, lon, day(i), "hour", hour), (s, lat, lon, day(i), "wind", float(rng.uniform(0, 10)))]
    return spark.createDataFrame(rows, "point_id string, lat double, lon double, time date, variable string, value double")


def test_three_jobs_end_to_end(spark, tmp_path):
    raw = synthetic(spark)
    labels = {v: {"variable": v} for v in ("ref", "hi", "insitu", "hour", "wind")}
    cfg = cf.from_dict(cf.PreprocessConfig, {
        "variables": labels, "group_id": "point_id", "units": {"variables": ["ref", "hi"]}, "range": {"variables": ["ref", "hi"]},
        "wind": {"variables": [{"target": "hi", "wind": "wind", "hour": "hour"}]}, "season": {"variables": ["hi", "ref"]},
        "match_up": {"variables": [{"target": "hi", "reference": "ref"}], "lower": 4.0, "upper": 4.0},
        "variance": {"targets": ["hi"], "references": ["ref", "insitu"], "by": ["point_id"]}, "grid": {"variables": ["ref", "hi", "insitu"]}})
    done = pp.preprocess(raw, cfg)
    counts = done.stage_counts().orderBy("step").collect()
    assert counts[0]["n_in"] == raw.count() and counts[-1]["n_out"] == done.clean.count()
    assert done.clean.count() + done.removed.count() == raw.count()
    assert {r["stage"] for r in done.removed.select("stage").distinct().collect()} >= {"physics_filter", "wind_filter"}
    root = str(tmp_path / "out")
    wr.write_preprocessing(root, done.clean, done.removed, done.tables())
    with pytest.raises(Exception, match="(?i)exists"):
        wr.write_preprocessing(root, done.clean, done.removed, {})
    grid = done.grid()
    assert grid.series.count() == 9 and done.basis(grid).count() == grid.last_bin + 1

    kinds = {
        "ref": {"tag": "ref", "intercept": "site+instrument", "seasonality": "shared", "site_state": True},
        "hi": {"tag": "hi", "intercept": "site", "seasonality": "shared", "site_state": True},
        "insitu": {"tag": "insitu", "intercept": "site", "seasonality": "shared", "site_state": True}}
    model = cf.ModelConfig(instruments=kinds, holdout_sites=["c"], holdout_variables=["insitu"], scale_reference="ref", views=["ref"])
    va.validate_model(model, grid.series)
    data = ft.prepare(grid.long(), model)
    fitted = ft.fit(data, model, "ref", "ref")
    assert 0 < fitted.rho <= 1 and fitted.states.count() == 3 * 400
    views = fitted.views()
    tables = ho.score_holdout(data.holdout, views[""], views["ref"], data.observed, "ref", ["c"], list(kinds), replicates=30)
    overall = {r["model"]: r for r in tables["overall"].collect()}
    # The fused series beats the noisy instrument it was scaled by.
    assert overall["full"]["MSE"] < overall["ref_raw"]["MSE"] and overall["full"]["n"] == data.holdout.count()
    assert tables["by_site"].count() == 3
    wr.write_scores(f"{root}/scores", tables)


def test_jobs_from_folders(spark, tmp_path):
    raw = synthetic(spark)
    rows = raw.where("variable in ('ref', 'hi')").select("point_id", "time", "variable", "value")
    grid = g.build_grid(rows, ["ref", "hi"], 5)
    where, out = str(tmp_path / "grid"), str(tmp_path / "run")
    wr.write_grid(grid, where)
    kinds = {"ref": {"tag": "ref", "intercept": "site+instrument", "seasonality": "shared"}, "hi": {"tag": "hi", "intercept": "site", "seasonality": "shared"}}
    cfg = cf.ModelConfig(instruments=kinds, scale_reference="ref", views=["ref"], holdout_variables=[], start=str(day(20)))
    runs.run_fit(spark, cfg, where, out, "ref", "ref")
    axis = rd.read_axis(spark, out)
    assert axis == g.TimeAxis(day(25), 5, 74) and spark.read.parquet(f"{out}/dates").count() == 75
    states = spark.read.parquet(f"{out}/state_estimates")
    assert {r["date"] for r in states.where("site = 'a'").select("date").collect()} == {day(25 + 5 * k) for k in range(75)} and states.count() == 3 * 75
    assert {r["block"] for r in spark.read.parquet(f"{out}/design").select("block").distinct().collect()} == {"intercept", "season", "error", "site_state"}

    # The same run with shared factors from elsewhere: more factors than one block holds.
    m = 40
    cfg.factors = m
    rng = np.random.default_rng(1)
    lam = {(i, j): float(rng.normal()) for i in range(1, 4) for j in (*range(1, i + 1), 39, 40)}
    extra = spark.createDataFrame([(f"lambda_{i}_{j}", v) for (i, j), v in lam.items()], "name string, value double")
    dates = [r["date"] for r in spark.read.parquet(f"{out}/dates").orderBy("bin").collect()]
    fx, fse = rng.normal(size=(m, 75)), rng.uniform(0.1, 0.2, (m, 75))
    root = str(tmp_path / "joint")
    for name in ("sites", "rows", "state_estimates"):
        wr.write_table(spark.read.parquet(f"{out}/{name}"), f"{root}/{name}")
    wr.write_table(spark.read.parquet(f"{out}/params").unionByName(extra), f"{root}/params")
    wr.write_table(spark.createDataFrame([(j + 1, d, float(fx[j, k]), float(fse[j, k])) for j in range(m) for k, d in enumerate(dates)], "factor int, date date, x double, se double"), f"{root}/factors")
    runs.run_reconstruct(spark, cfg, root, f"{root}/out")
    plain = {(r["site"], r["date"]): r for r in spark.read.parquet(f"{out}/states.parquet").collect()}
    got = {(r["site"], r["date"]): r for r in spark.read.parquet(f"{root}/out/states.parquet").collect()}
    sites = {r["site"]: r for r in spark.read.parquet(f"{out}/sites").collect()}
    assert set(got) == set(plain)
    for (s, d), r in got.items():
        k, i, sigma = dates.index(d), sites[s]["site_index"], sites[s]["sigma"]
        assert r["value"] == pytest.approx(plain[s, d]["value"] + sigma * sum(v * fx[j - 1, k] for (n, j), v in lam.items() if n == i))
        assert r["se"] == pytest.approx(np.sqrt(plain[s, d]["se"] ** 2 + sigma**2 * sum((v * fse[j - 1, k]) ** 2 for (n, j), v in lam.items() if n == i)))
    blind = cf.ModelConfig(instruments={v: {**k, "site_state": False} for v, k in kinds.items()}, factors=2)
    with pytest.raises(Exception, match="no instrument observes the state"):
        runs.run_reconstruct(spark, blind, root, f"{root}/blind")
    with pytest.raises(Exception, match="no instrument observes the state"):
        runs.run_fit(spark, cf.ModelConfig(instruments=blind.instruments, scale_reference="ref", holdout_variables=[]), where, str(tmp_path / "blind"), "ref", "ref")


def test_impute_and_combine_jobs(spark, tmp_path):
    schema = "point_id string, lat double, lon double, time date, variable string, stat string, radius_m int, value double"
    rows = [("d", 0.0, 0.0, day(k), "v", "m", 1, float(k)) for k in range(3)] + [("r", 0.0, 0.05, day(k), "v", "m", 1, None) for k in range(3)]
    wr.write_table(spark.createDataFrame(rows, schema), str(tmp_path / "in"), fmt="parquet")
    runs.run_impute(spark, str(tmp_path / "in"), str(tmp_path / "filled"), "v", "m", "v", fmt="parquet")
    got = {(r["point_id"], r["time"]): (r["value"], r["v_donor"]) for r in spark.read.parquet(str(tmp_path / "filled")).collect()}
    assert got["r", day(1)] == (1.0, "d") and got["d", day(2)] == (2.0, None)

    root = str(tmp_path / "runs")
    view = "model string, run string, date date, site string, variable string, value double, se double"
    old = [("m1", "2024-01-01", day(0), "a", "sst", 1.0, 0.1)]
    new = [("m1", "2025-01-01", day(k), "a", "sst", 2.0 + k, 0.1) for k in range(2)] + [("m2", "2023-01-01", day(0), "b", "sst", 9.0, 0.1)]
    wr.write_runs(spark.createDataFrame(old, view), root)
    wr.write_runs(spark.createDataFrame(new, view), root)
    half = spark.createDataFrame([("m2", "2026-01-01", day(0), "b", "sst", 0.0, 0.1)], view)
    half.write.mode("append").partitionBy("model", "run").parquet(f"{root}/states")  # broke off before its manifest
    assert {(r["model"], r["run"], r["n_rows"]) for r in rd.list_runs(spark, root).collect()} == {("m1", "2024-01-01", 1), ("m1", "2025-01-01", 2), ("m2", "2023-01-01", 1)}
    wr.write_table(spark.createDataFrame([("a", "A", "t", 1.0, 2.0, "x", None)], "id string, site_name string, site_type string, lat double, lon double, region string, notes string"), str(tmp_path / "places"), fmt="csv")
    runs.run_combine(spark, root, str(tmp_path / "places"), str(tmp_path / "all"), ["m2", "m1"])
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "all")).collect() if not r["value"].startswith("model")]
    assert sorted((x.split(",")[0], x.split(",")[1], x.split(",")[3]) for x in lines) == [("m1", "2025-01-01", "A"), ("m1", "2025-01-01", "A"), ("m2", "2023-01-01", "")]


def test_every_fault_of_a_configuration_is_reported_at_once():
    from thermaweave.plans.validate import preprocessing_problems

    cfg = cf.PreprocessConfig(variables={"t": {"variable": "x"}, "r": {"variable": "y"}})
    cfg.units.src, cfg.wind.threshold, cfg.match_up.scale, cfg.match_up.center = "X", -1.0, "foo", "bar"
    cfg.match_up.by, cfg.variance.pairs, cfg.variance.valid_range = ["nowhere"], "zip", [5, 1]
    cfg.grid.variables, cfg.grid.site, cfg.grid.harmonics = ["t", "t"], "nosite", 0
    found = " / ".join(preprocessing_problems(cfg, ["variable", "value", "point_id", "time"]))
    for part in ("units: src", "wind: threshold", "scale must", "center must", "no group column nowhere", "pairs must", "valid_range", "named twice", "no column nosite", "harmonics must"):
        assert part in found, part
