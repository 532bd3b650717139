"""Registered queries against their SQL. ``ALL_QUERIES=1`` runs every one; else one per family."""

import os

import pytest
from compare import difference

import __spark_entry__ as entry

QUICK = [
    "P1_label_variables", "P1_last_match_wins", "P4_range_screen", "P5_range_summary", "P6_wind_screen", "P7_wind_reasons_strict", "P8_wind_summary",
    "G1_seasonal_residual_robust", "G2_seasonal_summary", "G3_match_up_two_passes_by_point", "G21_cold_tail_sd_screen", "A7_match_up_variance", "A8_trimmed_spread_in_valid_range",
    "A2_variable_summary", "A4_removal_summary", "A5_stage_counts", "A20_histogram_60_bins", "T4_dense_grid", "T5_series_arrays", "J10_dropped_series", "T8_scaled_observations",
    "N2_rolling_mean", "N5_autocorrelation", "A17_modal_gap", "P14_shallow_profiles", "J7_covered_donor", "J8_N6_three_nearest", "J9_fill_from_covered", "J4_joined_predictions",
    "A12_skill_by_level", "B1_bootstrap_draws", "B3_contrast_intervals", "G9_seed_table", "G13_observation_design", "G14_reconstruct_eco_view", "G17_likelihood_grid", "R2_parse_dates",
    "R4_read_runs_with_labels", "W6_write_combined", "U3_observations_with_estimates", "V5_same_data_check", "V1_labels_that_match", "B2_intervals_by_site", "G5_huber_line",
    "G16_states_on_a_five_day_axis", "W2_run_manifest", "W2_written_axis", "J6_nearest_donor", "A18_N4_distinct_dates_per_bin",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_matches_sql(spark, con, sf_dir, name):
    assert difference(spark, con, sf_dir, name, QUERIES, ORACLES) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_stable_schema(spark):
    df = entry.entry(spark)
    assert df.columns[:3] == ["variable", "pooled", "group"] and df.count() > 0
