"""Grid, hold-out and donor edge cases."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaweave.operators.spheretree import search
from thermaweave.operators import donors as dn, grid as g, guards
from thermaweave.functions.exprs import haversine_km

D = dt.date(2021, 3, 1)


def day(n):
    return D + dt.timedelta(days=n)


LONG = "point_id string, time date, variable string, value double"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        ("b", day(0), "t", None),  # the axis starts on a missing value
        ("a", day(3), "t", 1.0), ("a", day(3), "t", 3.0), ("a", day(9), "t", 5.0), ("b", day(4), "r", 2.0), ("a", day(12), "r", None), ("c", day(5), "t", None), ("a", day(40), "u", 7.0),
    ], LONG)


def test_axis_counts_missing_rows_and_cells_average(rows):
    grid = g.build_grid(rows, ["t", "r"])
    assert (grid.start, grid.last_bin) == (D, 12)
    got = {(r["row_key"], r["bin"]): r["value"] for r in grid.long().collect()}
    assert got == {("t_a", 3): 2.0, ("t_a", 9): 5.0, ("r_b", 4): 2.0}
    assert [(r["row"], r["row_key"], r["site_index"]) for r in grid.series.orderBy("row").collect()] == [(1, "t_a", 1), (2, "r_b", 2)]
    assert {tuple(r) for r in grid.dropped.collect()} == {("t", "b"), ("t", "c"), ("r", "a"), ("r", "c")}
    dense = grid.dense()
    assert dense.count() == 2 * 13 and dense.where("value is not null").count() == 3
    arrays = {r["row_key"]: r["values"] for r in grid.arrays().collect()}
    assert len(arrays["t_a"]) == 13 and arrays["t_a"][3] == 2.0 and arrays["t_a"][4] is None


def test_wide_steps_and_other_aggregates(rows):
    five = g.build_grid(rows, ["t", "r"], 5)
    assert {(r["row_key"], r["bin"], r["date"]) for r in five.long().collect()} == {("t_a", 0, day(0)), ("t_a", 1, day(5)), ("r_b", 0, day(0))}
    for agg, want in (("sum", 4.0), ("median", 2.0), ("max", 3.0), ("min", 1.0)):
        assert g.build_grid(rows, ["t"], agg=agg).cells.where("bin = 3").first()["value"] == want
    with pytest.raises(ValueError, match="no non-missing"):
        g.build_grid(rows.where("value is null"), ["t"])
    with pytest.raises(ValueError, match="could not be read"):
        g.build_grid(rows.unionByName(rows.sparkSession.createDataFrame([("a", None, "t", 1.0)], LONG)), ["t"])


def test_period_is_open_at_the_start(rows):
    long = rows.select(F.col("point_id").alias("site"), F.col("time").alias("date"), "variable", "value")
    got = {r["date"] for r in g.select_period(long, ["a"], day(3), day(12)).collect()}
    assert got == {day(9), day(12)}


def test_holdout_may_not_empty_a_site(rows):
    long = g.build_grid(rows, ["t", "r"]).long()
    fit, held = g.split_holdout(long.unionByName(long.withColumn("variable", F.lit("x"))), ["b"], ["r"])
    assert held.count() == 1 and fit.count() == 5
    with pytest.raises(ValueError, match="no observations at: b"):
        g.split_holdout(long, ["b"], ["r"])


def test_scaling_centres_the_reference_and_refuses_flat_sites(spark):
    rng = np.random.default_rng(0)
    rows = [(s, day(i), v, float(rng.normal(10, 2))) for s in "ab" for i in range(50) for v in ("ref", "t")]
    long = spark.createDataFrame(rows, "site string, date date, variable string, value double")
    y = g.scale_values(long, g.scale_constants(long, "ref")).where("variable = 'ref'")
    for r in y.groupBy("site").agg(F.avg("y").alias("m"), F.stddev_samp("y").alias("s")).collect():
        assert (r["m"], r["s"]) == pytest.approx((0.0, 1.0), abs=1e-12)
    with pytest.raises(Exception, match="no usable scale at site c"):
        g.scale_constants(long.unionByName(spark.createDataFrame([("c", D, "ref", 1.0)], long.schema)), "ref").collect()


def test_autocorrelation_passes_over_gaps(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=60)
    keep = rng.random(60) > 0.3
    df = spark.createDataFrame([("s", int(i), float(x[i])) for i in range(60) if keep[i]], "site string, bin int, value double")
    z = np.where(keep, x - x[keep].mean(), np.nan)
    cov = [np.nansum(z[: 60 - k] * z[k:]) / (np.sum(~np.isnan(z[: 60 - k] * z[k:])) + k) for k in range(6)]
    got = [r["acf"] for r in g.autocorrelation(df, ["site"], 5).orderBy("lag").collect()]
    assert got == pytest.approx([c / cov[0] for c in cov])


def test_thinning_keeps_evenly_spaced_columns(spark):
    df = spark.createDataFrame([("s", day(i), "t", 1.0) for i in range(101)], LONG.replace("point_id", "point_id"))
    grid = g.build_grid(df, ["t"])
    kept = sorted(r["bin"] for r in g.thin_columns(grid, 11).collect())
    assert kept == list(range(0, 101, 10)) and g.thin_columns(grid, 500).count() == 101


# ---- donors ---------------------------------------------------------------------------------

SITE = "site string, lat double, lon double, n_valid long"


def km(a, b):
    p = np.radians
    h = np.sin(p(b[0] - a[0]) / 2) ** 2 + np.cos(p(a[0])) * np.cos(p(b[0])) * np.sin(p(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * np.arcsin(min(1, np.sqrt(h)))


def test_nearest_donors_equal_brute_force_across_the_globe(spark):
    rng = np.random.default_rng(6)
    spots = [(float(np.degrees(np.arcsin(z))), float(l)) for z, l in zip(rng.uniform(-1, 1, 60), rng.uniform(-180, 180, 60))]
    spots += [(89.9, 0.0), (89.9, 180.0), (10.0, 179.99), (10.0, -179.99), (-43.0, 147.0), (-43.0, 147.01)]
    donors = [(f"d{i:02d}", *p, 10) for i, p in enumerate(spots)]
    recips = [(f"r{i}", float(np.degrees(np.arcsin(z))), float(l)) for i, (z, l) in enumerate(zip(rng.uniform(-1, 1, 25), rng.uniform(-180, 180, 25)))]
    recips += [("pole", 89.95, 90.0), ("seam", 10.0, 179.999)]
    rd = spark.createDataFrame(recips, "site string, lat double, lon double")
    dd = spark.createDataFrame(donors, SITE)
    for k, limit in ((1, None), (3, None), (2, 3000.0)):
        got = {}
        for r in dn.nearest_donors(rd, dd, k, limit).orderBy("site", "rank").collect():
            got.setdefault(r["site"], []).append(r["donor"])
        for s, la, lo in recips:
            near = sorted((km((la, lo), d[1:3]), d[0]) for d in donors)
            want = [d for x, d in near if limit is None or x <= limit][:k]
            assert got.get(s, []) == want, (s, k, limit)


def test_distance_ties_go_to_the_first_id_and_thin_donors_are_passed_over(spark):
    r = spark.createDataFrame([("r", 0.0, 0.0), ("far", 60.0, 60.0)], "site string, lat double, lon double")
    tied = spark.createDataFrame([("b", 0.0, 0.1, 50), ("a", 0.0, -0.1, 20), ("c", 0.15, 0.0, 50)], SITE)
    assert [x["donor"] for x in dn.nearest_donors(r, tied, 1, 25.0).collect()] == ["a"]
    pick = {x["site"]: x for x in dn.covered_donors(r, tied, 25.0, 0.5).collect()}
    assert set(pick) == {"r"} and pick["r"]["donor"] == "b" and pick["r"]["switched"]
    assert dn.covered_donors(r, tied, 25.0, 0.4).first()["donor"] == "a"
    assert {x["site"]: x["donor"] for x in dn.covered_donors(r, tied, None, 1.0).collect()}["r"] == "b"


def test_tree_search_equals_brute_force_for_dense_points_and_remote_recipients(spark):
    rng = np.random.default_rng(9)
    spots = np.column_stack([-43 + rng.uniform(0, 0.05, 20_000), 147 + rng.uniform(0, 0.05, 20_000)])
    spots[:3000] = spots[0]  # many at one position
    n_valid = rng.integers(1, 60, 20_000)
    donors = [(f"d{i:05d}", *map(float, p), int(n)) for i, (p, n) in enumerate(zip(spots, n_valid))]
    recips = [(f"r{i}", float(np.degrees(np.arcsin(z))), float(l)) for i, (z, l) in enumerate(zip(rng.uniform(-1, 1, 100), rng.uniform(-180, 180, 100)))]
    recips += [donors[7][:3], ("in", -42.98, 147.02), ("nowhere", None, 1.0), ("odd", float("nan"), 1.0)]
    rd, dd = spark.createDataFrame(recips, "site string, lat double, lon double"), spark.createDataFrame(donors, SITE).repartition(8)
    for k, limit, most in ((2, None, None), (1, 12_000.0, None), (1, None, "n_valid"), (1, 9000.0, "n_valid")):
        visits: list = []
        got = {}
        for r in search(rd, dd, k, limit, most, visits=visits).orderBy("site", "rank").collect():
            got.setdefault(r["site"], []).append(r["donor"])
        for s, la, lo in recips[:-2]:
            p = np.radians
            h = np.sin(p(spots[:, 0] - la) / 2) ** 2 + np.cos(p(la)) * np.cos(p(spots[:, 0])) * np.sin(p(spots[:, 1] - lo) / 2) ** 2
            far = 2 * 6371 * np.arcsin(np.minimum(1, np.sqrt(h)))
            near = [i for i in np.lexsort((np.arange(20_000), far, -n_valid if most else np.zeros(20_000)))[:50] if donors[i][0] != s]
            near = [i for i in (near if limit is None else [j for j in np.lexsort((np.arange(20_000), far, -n_valid if most else np.zeros(20_000))) if far[j] <= limit]) if donors[i][0] != s][:k]
            want = [(round(float(far[i]), 3), int(n_valid[i])) for i in near]
            have = [(round(float(far[int(d[1:])]), 3), int(n_valid[int(d[1:])])) for d in got.get(s, [])]
            assert [w[0] for w in have] == [w[0] for w in want] and (not most or have == want), (s, k, limit, most)
        assert sum(visits) <= 40 * 32 * len(recips), (k, limit, most, visits)  # some leaves a recipient, of 625
    assert search(rd, dd.limit(0), 1).count() == 0 and search(rd.limit(0), dd, 1).count() == 0
    assert search(rd, dd, 1, 1e-6).where("site = 'in'").count() == 0


def test_fill_keeps_gaps_and_refuses_duplicate_donor_dates(spark):
    schema = "point_id string, lat double, lon double, time date, variable string, value double"
    rows = [("d", 0.0, 0.0, day(0), "v", 1.5), ("d", 0.0, 0.0, day(1), "v", None), ("r", 0.0, 0.05, day(0), "v", None), ("r", 0.0, 0.05, day(1), "v", None),
            ("r", 0.0, 0.05, day(2), "v", None), ("r", 0.0, 0.05, day(0), "w", 9.0), ("bare", 0.0, 0.06, day(0), "w", 8.0)]
    df = spark.createDataFrame(rows, schema)
    out = dn.impute_nearest(df, F.col("variable") == "v", "v", 25.0)
    got = {(r["point_id"], r["time"], r["variable"]): (r["value"], r["v_imputed"], r["v_donor"]) for r in out.collect()}
    assert len(got) == len(rows) and got["r", day(0), "v"] == (1.5, True, "d") and got["r", day(1), "v"] == (None, True, "d")
    assert got["r", day(2), "v"] == (None, True, "d") and got["r", day(0), "w"] == (9.0, False, None) and got["bare", day(0), "w"] == (8.0, False, None)
    twice = df.unionByName(df.where("point_id = 'd' and value = 1.5"))
    with pytest.raises(Exception, match="duplicate donor rows"):
        dn.impute_nearest(twice, F.col("variable") == "v", "v", 25.0).collect()


def test_haversine_column(spark):
    got = spark.range(1).select(haversine_km(F.lit(-43.0), F.lit(147.0), F.lit(-42.0), F.lit(148.0)).alias("k")).first()["k"]
    assert got == pytest.approx(km((-43.0, 147.0), (-42.0, 148.0)))


def test_a_series_in_many_blocks_gives_the_same_windows(spark):
    rng = np.random.default_rng(11)
    rows = [(s, int(b), float(rng.normal())) for s in ("a", "b") for b in sorted(rng.choice(500, 350, replace=False))]
    cells = spark.createDataFrame(rows, "site string, bin int, value double")
    whole = {(r["site"], r["lag"]): (r["n_pairs"], r["acf"]) for r in g.autocorrelation(cells, ["site"], 12).collect()}
    cut = {(r["site"], r["lag"]): (r["n_pairs"], r["acf"]) for r in g.autocorrelation(cells, ["site"], 12, block_bins=10).collect()}
    assert set(cut) == set(whole) and all(cut[k] == pytest.approx(whole[k]) for k in cut)
    dated = spark.createDataFrame([(s, day(b - 250), v) for s, b, v in rows], "site string, date date, value double")
    whole, cut = ({(r["site"], r["date"]): r["value_mean"] for r in g.rolling_mean(dated, ["site"], before=7, after=2, block_days=n).collect()} for n in (4096, 10))
    assert len(cut) == len(rows) and cut == pytest.approx(whole)
    got = {r["site"]: r["n_dates"] for r in g.with_distinct_dates(dated.unionByName(dated).unionByName(spark.createDataFrame([("a", None, 1.0), ("c", None, 1.0)], dated.schema)), ["site"]).collect()}
    assert got == {"a": 350, "b": 350, "c": 0}


def test_equal_tables_are_compared_without_a_join_of_rows(spark):
    a = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"), (F.col("id") * 0.5).alias("value"))
    old, new, n, n_values = guards.differing_rows(a, a.repartition(7), ["k"])
    assert (old.count(), new.count(), n, n_values) == (0, 0, 20_000, 20_000)
    b = a.withColumn("value", F.when(F.col("k") == "k77", 1e6).otherwise(F.col("value")))
    old, new, n, _ = guards.differing_rows(a, b, ["k"])
    assert 1 <= old.count() == new.count() < 10 and n + old.count() == 20_000
    r = guards.compare_tables(a, b, ["k"]).first()
    assert (r["n_paired"], r["n_only_old"], r["n_only_new"]) == (20_000, 0, 0) and r["max_abs_diff"] == pytest.approx(1e6 - 38.5)


def test_broadcast_needs_few_bytes_as_well(spark):
    from thermaweave.functions.lineage import small_side

    notes = spark.createDataFrame([("a", "x" * 5000), ("b", None)], "id string, notes string")
    plan = lambda t: t.join(t.select("id"), "id")._jdf.queryExecution().toString()
    assert "ResolvedHint (strategy=broadcast)" in plan(small_side(notes)) and "ResolvedHint (strategy=broadcast)" not in plan(small_side(notes, max_bytes=4000))


def test_guards(spark):
    a = spark.createDataFrame([("x", 1.0), ("y", None), (None, 2.0)], "k string, value double")
    assert guards.same_data(a, a, ["k"])
    assert not guards.same_data(a, a.na.fill(0.0), ["k"])
    assert not guards.same_data(a, a.where("k is not null"), ["k"])
    assert guards.require_unique(a, ["k"]) is a
    with pytest.raises(ValueError, match="duplicate keys"):
        guards.require_unique(a.unionByName(a), ["k"])
