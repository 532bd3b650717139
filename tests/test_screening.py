"""Boundary rules on hand-made rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaweave.functions import quantiles
from thermaweave.operators import matchup as mu, screening as sc, summaries
from thermaweave.operators.labelling import convert_temperature, label_variables

LONG = "site string, lon double, time date, variable string, value double"
D = dt.date(2020, 1, 1)


def long(spark, rows):
    return spark.createDataFrame(rows, LONG)


def test_last_matching_spec_wins_and_null_never_matches(spark):
    df = spark.createDataFrame([("a", "mean", 1.0), ("a", "near", 2.0), ("b", "mean", 3.0), (None, "mean", 4.0)], "variable string, stat string, value double")
    out = label_variables(df, {"any": {"variable": ["a", "b"]}, "a_mean": {"variable": "a", "stat": "mean"}})
    assert sorted(out.collect()) == [("a_mean", 1.0), ("any", 2.0), ("any", 3.0)] and out.columns == ["variable", "value"]
    with pytest.raises(ValueError, match="not found"):
        label_variables(df, {"x": {"nope": 1}})


def test_conversion_guards(spark):
    kelvin = long(spark, [("s", 0.0, D, "t", 290.0), ("s", 0.0, D, "t", None), ("s", 0.0, D, "w", 5.0)])
    done = convert_temperature(kelvin, ["t"])
    assert {r["variable"]: r["value"] for r in done.where("value is not null").collect()} == {"t": pytest.approx(16.85), "w": 5.0}
    with pytest.raises(ValueError, match="already converted"):
        convert_temperature(done, ["t"])
    with pytest.warns(UserWarning):
        convert_temperature(done, ["t"], strict=False)
    assert convert_temperature(kelvin, ["t"], "C", "C") is kelvin
    assert convert_temperature(kelvin, ["absent"]) is kelvin
    for src, dst, x, y in (("F", "C", 212.0, 100.0), ("C", "K", 0.0, 273.15), ("K", "F", 273.15, 32.0)):
        got = convert_temperature(long(spark, [("s", 0.0, D, "t", x)]), ["t"], src, dst, check_range=False).first()["value"]
        assert got == pytest.approx(y)


def test_range_bounds_are_rejected_and_missing_kept(spark):
    df = long(spark, [("s", 0.0, D, "t", v) for v in (0.0, 0.01, 39.99, 40.0, -3.0, None)] + [("s", 0.0, D, "u", 99.0)])
    out = sc.screen_range(df, "t")
    assert sorted(r["value"] for r in sc.removed(out).collect()) == [-3.0, 0.0, 40.0]
    assert sc.kept(out).count() == 4
    strict = sc.screen_range(df, "t", keep_na=False)
    assert sc.kept(strict).count() == 3 and sc.removed(strict).count() == 3
    with pytest.raises(ValueError):
        sc.screen_range(df, "t", 5, 5)


WIND_CASES = [  # name, lon, hour, wind, value, rejected
    ("calm day", 0.0, 12.0, 1.0, 20.0, True), ("wind at threshold", 0.0, 12.0, 2.0, 20.0, True), ("windy day", 0.0, 12.0, 2.1, 20.0, False),
    ("at early edge", 0.0, 10.0, 1.0, 20.0, False), ("at late edge", 0.0, 18.0, 1.0, 20.0, False), ("calm night", 0.0, 2.0, 0.5, 20.0, False),
    ("wraps past midnight", 180.0, 0.5, 1.0, 20.0, True), ("wraps below zero", -150.0, 23.0, 1.0, 20.0, True), ("empty target", 0.0, 12.0, 1.0, None, True),
]


def wind_rows(cases):
    rows = []
    for i, (name, lon, hour, wind, value, _) in enumerate(cases):
        day = D + dt.timedelta(days=i)
        rows += [(name, lon, day, "t", value), (name, lon, day, "w", wind), (name, lon, day, "h", hour)]
    return rows


def test_wind_window_edges(spark):
    out = sc.screen_wind(long(spark, wind_rows(WIND_CASES)), "t", "w", "h", 10, 18, 2.0)
    bad = {r["site"] for r in sc.removed(out).collect()}
    assert bad == {c[0] for c in WIND_CASES if c[5]}
    assert {r["variable"] for r in sc.removed(out).collect()} == {"t"}
    both = sc.screen_wind(long(spark, wind_rows(WIND_CASES)), "t", "w", "h", 10, 18, 2.0, drop_covariates=True)
    assert sc.removed(both).count() == 3 * len(bad)


def test_wind_unknown_covariates_and_null_ids(spark):
    cases = [("inside, no wind", 0.0, 12.0, None, 20.0, None), ("outside, no wind", 0.0, 2.0, None, 20.0, None), ("calm, no hour", 0.0, None, 1.0, 20.0, None),
             ("windy, no hour", 0.0, None, 9.0, 20.0, None), (None, 0.0, 12.0, 1.0, 20.0, None), ("nothing", 0.0, None, None, 20.0, None)]
    df = long(spark, wind_rows(cases))
    assert [r["site"] for r in sc.removed(sc.screen_wind(df, "t", "w", "h", 10, 18, 2.0)).collect()] == [None]
    strict = sc.removed(sc.screen_wind(df, "t", "w", "h", 10, 18, 2.0, keep_na=False)).collect()
    assert {r["site"]: r["reason"] for r in strict} == {
        "inside, no wind": sc.DAY_NO_WIND, "calm, no hour": sc.CALM_NO_TIME, None: sc.CALM_DAY, "nothing": sc.NO_COVARIATES}


def test_duplicate_key_is_an_error(spark):
    df = long(spark, wind_rows(WIND_CASES[:1]) + [("calm day", 0.0, D, "t", 3.0)])
    with pytest.raises(Exception, match="duplicate observations"):
        sc.screen_wind(df, "t", "w", "h", 10, 18).collect()
    with pytest.raises(Exception, match="duplicate observations"):
        sc.pivot_keys(df, ["site", "time"], ["t", "w"]).collect()


def ols_scores(values, days, groups, robust=False):
    doy = np.array([d.timetuple().tm_yday for d in days], float)
    cols = [np.sin(2 * np.pi * doy / 365.25), np.cos(2 * np.pi * doy / 365.25)] + [(np.array(groups) == g).astype(float) for g in sorted(set(groups))]
    x = np.column_stack(cols)
    r = values - x @ np.linalg.lstsq(x, values, rcond=None)[0]
    c, s = (np.median(r), 1.4826 * np.median(np.abs(r - np.median(r)))) if robust else (r.mean(), r.std(ddof=1))
    return (r - c) / s


@pytest.mark.parametrize("robust", [False, True])
@pytest.mark.parametrize("n_groups", [1, 3])
def test_seasonal_screen_equals_dummy_regression(spark, robust, n_groups):
    rng = np.random.default_rng(5)
    days = [D + dt.timedelta(days=int(d)) for d in rng.integers(0, 900, 240)]
    groups = [f"g{i % n_groups}" for i in range(240)]
    vals = 15 + 4 * np.sin(2 * np.pi * np.array([d.timetuple().tm_yday for d in days]) / 365.25) + np.array([int(g[1]) for g in groups]) + rng.normal(size=240)
    vals[7] += 60.0
    vals[11] += 9.0  # hidden by the first one
    df = long(spark, [(g, 0.0, d, "t", float(v)) for g, d, v in zip(groups, days, vals)] + [("g0", 0.0, D, "t", None)])
    out = sc.screen_seasonal(df, "t", [6.0, 4.0], group="site", robust=robust)
    alive, want = np.ones(240, bool), {}
    for p, thr in enumerate([6.0, 4.0], start=1):
        idx = np.flatnonzero(alive)
        z = ols_scores(vals[idx], [days[i] for i in idx], [groups[i] for i in idx], robust)
        for i, s in zip(idx, z):
            if abs(s) >= thr:
                want[vals[i]] = (p, s)
                alive[i] = False
    got = {r["value"]: (r["removed_pass"], r["resid"]) for r in sc.removed(out).collect()}
    assert got.keys() == want.keys() and len(got) >= 2
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], abs=1e-8) for k in want)
    assert sc.kept(out).where("value is null").count() == 1


def test_seasonal_screen_leaves_untestable_series(spark):
    flat = [("g", 0.0, D + dt.timedelta(days=i), "t", 5.0) for i in range(50)]
    assert sc.removed(sc.screen_seasonal(long(spark, flat), "t", [2.0], group="site")).count() == 0
    few = [("g", 0.0, D + dt.timedelta(days=i), "t", float(i)) for i in range(4)]
    assert sc.removed(sc.screen_seasonal(long(spark, few), "t", [0.1], group="site")).count() == 0


def match_rows(ys, xs, site="s"):
    rows = []
    for i, (y, x) in enumerate(zip(ys, xs)):
        day = D + dt.timedelta(days=i)
        rows += [(site, 0.0, day, "t", y), (site, 0.0, day, "r", x)]
    return rows


def test_match_up_screen_bounds_and_missing_reference(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(15, 3, 60)
    y = x + rng.normal(0, 1, 60)
    y[3], y[9] = x[3] - 20, x[9] + 20
    xs = [float(v) for v in x]
    xs[20] = None
    out = mu.screen_match_up(long(spark, match_rows([float(v) for v in y], xs)), "t", "r", 2.58, 3.0, min_n=10)
    d = np.delete(y - x, 20)
    med = np.median(d)
    s = 1.4826 * np.median(np.abs(d - med))
    want = sorted(float(y[i]) for i in range(60) if i != 20 and not (-2.58 * s < y[i] - x[i] - med < 3.0 * s))
    got = sc.removed(out).collect()
    assert sorted(r["value"] for r in got) == pytest.approx(want)
    assert {r["reason"] for r in got} >= {mu.TOO_COLD, mu.TOO_WARM}
    strict = mu.screen_match_up(long(spark, match_rows([float(v) for v in y], xs)), "t", "r", 2.58, 3.0, min_n=10, keep_na=False)
    assert sc.removed(strict).where(F.col("reason") == mu.UNMATCHED).count() == 1
    with pytest.raises(ValueError, match="match-ups"):
        mu.screen_match_up(long(spark, match_rows([1.0, 2.0], [1.0, 2.0])), "t", "r")


def test_small_group_takes_the_pooled_fit_and_zero_mad_the_sd(spark):
    rows = [("big", float(i % 3), 0.0, True) for i in range(40)] + [("small", 50.0, 0.0, True)] * 3 + [("void", 1.0, None, True)]
    df = spark.createDataFrame(rows, "_grp string, _y double, _x double, _use boolean")
    fit = {r["group"]: r for r in mu.fit_match_up(df, min_n=10).collect()}
    assert fit["small"]["n"] == 3 and fit["void"]["n"] == 0
    assert fit["small"]["intercept"] == fit["void"]["intercept"] == np.median([r[1] for r in rows if r[2] is not None])
    flat = spark.createDataFrame([("a", 1.0, 0.0, True)] * 30 + [("a", 9.0, 0.0, True)] * 4, "_grp string, _y double, _x double, _use boolean")
    assert mu.fit_match_up(flat, 5).first()["scale"] == pytest.approx(np.std([1.0] * 30 + [9.0] * 4, ddof=1))


def huber_line(y, x):
    design = np.column_stack([np.ones_like(x), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    for _ in range(50):
        r = y - design @ beta
        s = np.median(np.abs(r)) / 0.6745
        w = np.minimum(1.0, 1.345 * s / np.maximum(np.abs(r), 1e-300))
        new = np.linalg.solve(design.T @ (w[:, None] * design), design.T @ (w * y))
        moved = np.sqrt(np.sum((r - (y - design @ new)) ** 2) / max(1e-20, np.sum(r**2)))
        beta = new
        if moved <= 1e-4:
            return beta
    return None


@pytest.mark.parametrize("limit", [10**9, 10])
def test_huber_line_equals_reweighted_least_squares(spark, limit, monkeypatch):
    monkeypatch.setattr(quantiles, "RANKED", limit)
    rng = np.random.default_rng(9)
    rows, want = [], {}
    for g in ("a", "b"):
        x = rng.normal(15, 4, 80)
        y = 1.5 + 0.9 * x + rng.normal(0, 0.5, 80)
        y[:6] -= 12
        rows += [(g, float(a), float(b), True) for a, b in zip(y, x)]
        want[g] = huber_line(y, x)
    df = spark.createDataFrame(rows, "_grp string, _y double, _x double, _use boolean")
    for r in mu.fit_match_up(df, 10, slope=None, intercept=None).collect():
        assert (r["intercept"], r["slope"]) == pytest.approx(tuple(want[r["group"]]), abs=1e-8)


def test_spread_below_min_n_is_null_and_a_group_may_be_called_all(spark):
    rows = [(f"s{i}", "(all)" if i < 12 else "b", "t", float(i)) for i in range(15)] + [(f"s{i}", "(all)" if i < 12 else "b", "r", float(i % 4)) for i in range(15)]
    df = spark.createDataFrame(rows, "site string, aoi string, variable string, value double")
    got = {(r["pooled"], r["group"]): r for r in mu.match_up_variance(df, ["t"], ["r"], by=["aoi"], trim=1.0).collect()}
    assert got[True, "(all)"]["n"] == 15 and got[False, "(all)"]["n"] == 12
    assert got[False, "b"]["n"] == 3 and got[False, "b"]["bias"] is None and got[False, "b"]["n_trim"] is None


def test_narrowing_gives_the_same_tables(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(f"s{i}", "ab"[i % 2], v, float(x)) for i in range(600) for v, x in (("t", rng.normal()), ("r", rng.normal()))]
    df = spark.createDataFrame(rows, "site string, aoi string, variable string, value double").cache()
    small = mu.match_up_variance(df, ["t"], ["r"], by=["aoi"], trim=1.5).orderBy("pooled", "group").toPandas()
    monkeypatch.setattr(quantiles, "RANKED", 30)
    large = mu.match_up_variance(df, ["t"], ["r"], by=["aoi"], trim=1.5).orderBy("pooled", "group").toPandas()
    assert np.allclose(small.select_dtypes("number"), large.select_dtypes("number"))
    frame = summaries.kept_removed_frame(sc.screen_range(df, "t", -1, 1), "aoi")
    b = summaries.variable_summary(frame).orderBy("variable", "pooled", "group").toPandas()
    monkeypatch.undo()
    a = summaries.variable_summary(frame).orderBy("variable", "pooled", "group").toPandas()
    assert np.allclose(a.select_dtypes("number").astype(float), b.select_dtypes("number").astype(float), equal_nan=True)


def test_removals_partition_the_input_and_order_does_not_matter(spark):
    rng = np.random.default_rng(4)
    rows = wind_rows([(f"s{i}", 0.0, float(rng.uniform(0, 24)), float(rng.uniform(0, 5)), float(rng.normal(20, 15)), None) for i in range(80)])

    def run(df):
        out = sc.screen_wind(sc.screen_range(df, "t", step=1), "t", "w", "h", 9, 18, 2.0, step=2)
        assert sc.kept(out).count() + sc.removed(out).count() == len(rows)
        counts = sc.stage_counts(out, [(1, "a", "t"), (2, "b", "t")]).orderBy("step").collect()
        assert counts[0]["n_out"] == counts[1]["n_in"] and counts[1]["n_out"] == sc.kept(out).count()
        return sorted(map(str, sc.removed(out).collect()))

    assert run(long(spark, rows)) == run(long(spark, rows[::-1]).repartition(5))


@pytest.mark.parametrize("limit", [10**9, 10])
def test_trim_falls_back_to_the_ordinary_spread(spark, limit, monkeypatch):
    monkeypatch.setattr(quantiles, "RANKED", limit)
    d = [0.0] * 30 + [5.0, -7.0, 100.0]
    rows = [(f"s{i}", v, x) for i, diff in enumerate(d) for v, x in (("t", float(i % 5) + diff), ("r", float(i % 5)))]
    df = spark.createDataFrame(rows, "site string, variable string, value double")
    got = mu.match_up_variance(df, ["t"], ["r"], trim=1.0).first()
    sd = np.std(d, ddof=1)
    near = [x for x in d if abs(x) <= sd]
    assert got["rsd"] == 0.0 and got["n_trim"] == len(near) and got["sd_trim"] == pytest.approx(np.std(near, ddof=1))


def test_nan_is_missing_from_labelling_on(spark):
    rows = [("s1", "x", float("nan")), ("s2", "x", 5.0), ("s3", "x", None)]
    df = label_variables(spark.createDataFrame(rows, "site string, variable string, value double"), {"t": {"variable": "x"}})
    out = sc.screen_range(df, "t", 0.0, 40.0)
    assert sc.removed(out).count() == 0 and sc.kept(out).where("value is null").count() == 2
    got = {r["reason"]: r["n"] for r in sc.range_summary(df, ["t"]).collect()}
    assert got == {"retained": 1, sc.MISSING: 2, sc.BELOW: 0, sc.ABOVE: 0}
