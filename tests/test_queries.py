"""Registered queries against their DuckDB twins; FAIRLINE_ALL=1 runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from check import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = """p3_normalise_dates p6_impute_median p12_standardise_name a6_first_per_group a9_pair_career_record a12_pressure_stats a18_entity_group_lift
j5_asof_matchup_join j7_similar_group_history j12_match_names_contains w2_rolling_days_lagged w8_expected_value_vs_mix w12_decayed_power_form w15_recent_n_indicators
w35_streak_feature_set w36_fatigue_state w38_travel_features w39_rest_patterns m4_weather_indices m8_park_weather_interaction m18_quantile_indicators b1_price_market
b7_size_bets_greedy_cap b9_accept_within_limit b11_calibrate_percentile a20_ledger_summary a24_latency_summary t1_alert_rules_batch d4_profile_columns d12_quartile_lift
d15_leak_check s4_read_dataset_union s6_flatten_odds_json s9_reduce_hourly_weather s10_upsert_matchup_tables e1_time_split e9_binary_metrics t2_throughput_stream
t4_incremental_matchup_update x3_daily_opportunities""".split()
NAMES = sorted(entry.queries()) if os.environ.get("FAIRLINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF, name)
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["user_id", "day"] and df.count() == 50


@pytest.mark.parametrize("name", ["a9_pair_career_record", "j5_asof_matchup_join", "w12_decayed_power_form", "w35_streak_feature_set", "w40_schedule_density"])
def test_plan_stays_in_the_jvm(spark, name):
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan
