"""Registered queries against their SQL counterparts.

A plain run takes one query per operator family; PANELSPARK_ALL=1 takes every query.
"""

import os

import pytest
from compare import connect, differences

import __spark_entry__ as entry

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()
CORE = """area_panel supplier_panel rank_cells category_labels row_hashes evaluable_series densify_locf interpolate_short_gaps
missing_masks missingness_profile trailing_streaks spread_other_table spread_vs_world feature_frame status_mix series_census panel_facts
table_gap movement_class bulletin_feed data_drift increment_correlation lead_lag missing_months keyed_facts panel_view carry_forward
constraint_violations table_fingerprint scale_before_cutoff rolling_baselines mase_by_series backtest_report crps_of_samples quantile_crps
coherent_vintages stamped_ledger ledger_append forecast_scorecard band_scales dedup_by_regime panel_audit score_summary
replica_representatives signed_rank_sums best_two_models shape_features ljung_box stationarity spectral_entropy giacomini_white
kendall_relevance csv_round_trip page_cells page_ranks stream_event_windows exponential_smoothing champion_challenger rolling_candidates
champion_by_horizon best_challenger shadow_vintages significance_by_horizon model_confidence_set release_manifest csv_quarantine snapshot_months
stream_snapshot_revisions systemic_drift contract_check quantile_band_correction meta_weighted_ensemble""".split()
ALL = bool(os.environ.get("PANELSPARK_ALL"))


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if ALL or n in CORE))
def test_equals_sql(spark, sf, con, name):
    assert differences(QUERIES[name](spark, sf), con, ORACLES[name]) == []


def test_core_names_exist():
    assert set(CORE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(n for n in set(QUERIES) - set(ORACLES) if ALL or n in CORE))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
