"""Queries on tables that leave almost no value or match-up, as large tables do (a cell with any row of the highest tax is a gap)."""

import os

import pytest
from compare import difference, duck

import __spark_entry__ as e
from thermaweave.operators import matchup

MATCH_UP = ["G3_match_up_screen", "G3_match_up_two_passes_by_region", "G3_match_up_two_passes_by_point", "G3_match_up_drop_unmatched", "G4_fit_both_fixed", "G21_cold_tail_sd_screen", "G21_free_line_sd_screen"]


SCALED = ["A9_scale_constants", "G14_reconstruct_site_view", "G14_reconstruct_lst_view", "G14_reconstruct_eco_view", "G14_reconstruct_ref_view", "G19_climatology_view", "G19_climatology_instrument_view", "G20_fine_scale_contribution",
          "G16_collapsed_observations", "G16_smoothed_states", "G16_states_on_a_five_day_axis", "G17_likelihood_grid", "G17_best_candidate"]


def thinned(sf_dir, out, lost):
    """The tables, with a gap wherever ``lost`` holds for a line."""
    for f in os.listdir(sf_dir):
        if f != "lineitem.parquet":
            os.symlink(f"{sf_dir}/{f}", out / f)
    duck(sf_dir).execute(f"COPY (SELECT * REPLACE (CASE WHEN {lost} THEN 0.08 ELSE least(l_tax, 0.07) END AS l_tax) FROM lineitem) TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return str(out)


@pytest.fixture(scope="module", params=["true", "hash(l_orderkey * 10 + l_linenumber) % 3 > 0"], ids=["no value", "five match-ups"])
def sparse(request, sf_dir, tmp_path_factory):
    return thinned(sf_dir, tmp_path_factory.mktemp("sparse"), request.param)


@pytest.fixture(scope="module")
def few(sf_dir, tmp_path_factory):
    return thinned(sf_dir, tmp_path_factory.mktemp("few"), "hash(l_orderkey * 10 + l_linenumber) % 500 > 0")


def agree(spark, sf_dir, name):
    assert difference(spark, duck(sf_dir), sf_dir, name, e.queries(), e.oracle_sql()) in (None, "both empty")


@pytest.mark.parametrize("name", MATCH_UP)
def test_match_ups(spark, sparse, name):
    agree(spark, sparse, name)


@pytest.mark.parametrize("name", SCALED)
def test_sites_without_a_scale(spark, few, name):
    agree(spark, few, name)


@pytest.fixture(scope="module")
def empty(sf_dir, tmp_path_factory):
    return thinned(sf_dir, tmp_path_factory.mktemp("empty"), "true")


@pytest.mark.parametrize("name", [n for n in SCALED if n.startswith(("G14", "G19", "G20"))] + ["G16_collapsed_observations", "T4_long_grid", "J10_dropped_series", "G15_seasonal_basis"])
def test_grid_without_a_value(spark, empty, name):
    agree(spark, empty, name)


@pytest.fixture(scope="module")
def lone(sf_dir, tmp_path_factory):
    """One value of eco_sst in all; the other instruments keep theirs."""
    first = "(SELECT min(l_orderkey * 10 + l_linenumber) FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'O')"
    return thinned(sf_dir, tmp_path_factory.mktemp("lone"), f"l_returnflag = 'A' AND l_orderkey * 10 + l_linenumber <> {first}")


@pytest.mark.parametrize("name", ["A2_variable_summary", "A4_removal_summary"])
def test_season_of_a_lone_value(spark, lone, name):
    agree(spark, lone, name)


@pytest.fixture(scope="module")
def flagged(sf_dir, tmp_path_factory):
    """Return flags beside A, N and R, and none: the view takes them all for the reference, which then repeats at a key."""
    out = tmp_path_factory.mktemp("flagged")
    for f in os.listdir(sf_dir):
        if f != "lineitem.parquet":
            os.symlink(f"{sf_dir}/{f}", out / f)
    flag = "CASE WHEN l_orderkey % 7 = 0 THEN NULL WHEN l_orderkey % 7 = 1 THEN 'X' ELSE l_returnflag END"
    duck(sf_dir).execute(f"COPY (SELECT * REPLACE ({flag} AS l_returnflag) FROM lineitem) TO '{out}/lineitem.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["G3_match_up_screen", "G3_match_up_two_passes_by_point", "G3_match_up_drop_unmatched"])
def test_reference_that_repeats_at_a_key(spark, flagged, name):
    agree(spark, flagged, name)


def test_guard_against_repeats_stays(spark):
    rows = [("P1", "2020-01-01", v, x) for v, x in (("eco_sst", 1.0), ("ref_sst", 2.0), ("ref_sst", 3.0))]
    df = spark.createDataFrame(rows, "point_id string, time string, variable string, value double")
    with pytest.raises(Exception, match="duplicate observations per key"):
        matchup.screen_match_up(df, "eco_sst", "ref_sst", min_n=1).collect()
    with pytest.raises(Exception, match="duplicate observations per key"):
        matchup.screen_match_up(df, "ref_sst", "eco_sst", min_n=1, strict=False).collect()


@pytest.mark.parametrize("name", ["G3_match_up_screen", "G3_match_up_two_passes_by_point", "G3_match_up_drop_unmatched"])
def test_screen_does_not_draw_its_rows_twice(spark, sf_dir, name):
    plan = e.queries()[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan
